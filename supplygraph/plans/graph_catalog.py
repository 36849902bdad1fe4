"""Graph construction, reachability and the overlay over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplygraph.operators import advisories as A
from supplygraph.operators import build as B
from supplygraph.operators import incident as I
from supplygraph.operators import reach as R
from supplygraph.operators import typosquat as T
from supplygraph.operators import views as W
from supplygraph.plans.domain import LIVE_FROM, LIVE_UNTIL
from supplygraph.plans.functions_catalog import SKELETON_SQL
from supplygraph.plans.registry import query

# -- lockfile tree -----------------------------------------------------------------
# Lines 1 to 3 of an order are installed at the root, line 4 and up below the
# package of their parent line. A name is declared by the parent and by line 1.

_TREE_SQL = """, tree AS (SELECT DISTINCT e.lock_id, CASE WHEN e.line <= 3 THEN 'node_modules/' || e.name ELSE 'node_modules/' || p.name || '/node_modules/' || e.name END AS path
  FROM entry e LEFT JOIN (SELECT s.lock_id, s.line, v.name FROM lock_slot s JOIN package_version v ON v.pv = s.rep) p ON p.lock_id = e.lock_id AND p.line = e.line // 2 WHERE e.line <= 3 OR p.name IS NOT NULL),
declared AS (
  SELECT DISTINCT e.lock_id, 'node_modules/' || p.name AS from_path, e.name AS dep FROM entry e JOIN (SELECT s.lock_id, s.line, v.name FROM lock_slot s JOIN package_version v ON v.pv = s.rep) p ON p.lock_id = e.lock_id AND p.line = e.line // 2
  UNION SELECT lock_id, '', name FROM entry WHERE line IN (1, 5)
  UNION SELECT lock_id, 'packages/api', name FROM entry WHERE line = 1),
tried AS (SELECT *, from_path || '/node_modules/' || dep AS path FROM declared WHERE from_path <> '' UNION ALL SELECT *, 'node_modules/' || dep FROM declared WHERE from_path = '' OR from_path LIKE 'node_modules/%'),
hit AS (SELECT t.lock_id, t.from_path, t.dep, arg_max(t.path, length(t.path)) AS found_path FROM tried t JOIN tree x USING (lock_id, path) GROUP BY ALL) """


def _named_slots(fleet):
    return fleet.lock_slot.join(fleet.package_version.select(F.col("pv").alias("rep"), F.col("name").alias("parent")), "rep").select("lock_id", "line", "parent")


def lock_tree(fleet):
    e = fleet.entry.select("lock_id", F.col("line").alias("own"), "name", "version", "dev", F.floor(F.col("line") / 2).cast("int").alias("line"))
    nested = e.join(_named_slots(fleet), ["lock_id", "line"], "left").filter("own <= 3 OR parent IS NOT NULL")
    path = F.when(F.col("own") <= 3, F.concat(F.lit("node_modules/"), "name")).otherwise(
        F.concat(F.lit("node_modules/"), "parent", F.lit("/node_modules/"), "name")
    )
    return nested.withColumn("path", path)


def lock_declared(fleet):
    e = fleet.entry.select("lock_id", F.col("line").alias("own"), F.col("name").alias("dep"), F.floor(F.col("line") / 2).cast("int").alias("line"))
    nested = e.join(_named_slots(fleet), ["lock_id", "line"]).select("lock_id", F.concat(F.lit("node_modules/"), "parent").alias("from_path"), "dep")
    root = e.filter("own IN (1, 5)").select("lock_id", F.lit("").alias("from_path"), "dep")
    workspace = e.filter("own = 1").select("lock_id", F.lit("packages/api").alias("from_path"), "dep")
    return nested.unionByName(root).unionByName(workspace).distinct()


@query("join_dep_resolve", _TREE_SQL + "SELECT d.lock_id, d.from_path, d.dep, h.found_path FROM declared d LEFT JOIN hit h USING (lock_id, from_path, dep)")
def _(fleet):
    return B.resolve_dependencies(lock_declared(fleet), lock_tree(fleet)).select("lock_id", "from_path", "dep", "found_path")


def lock_entry_table(fleet):
    """The tree's entries; their declarations stay a table (``lock_declared``)."""
    none = F.lit(None).cast("string")
    lock = F.col("lock_id").cast("string")
    services = lock_declared(fleet).filter("from_path IN ('', 'packages/api')").select("lock_id", F.col("from_path").alias("path")).distinct().select(
        "lock_id", "path", F.concat(F.when(F.col("path") == "", "svc").otherwise("api"), lock).alias("service_name"),
        none.alias("name"), none.alias("version"), F.lit(False).alias("link"), F.lit(False).alias("dev"),
    )
    packages = lock_tree(fleet).groupBy("lock_id", "path").agg(F.min("name").alias("name"), F.min("version").alias("version"), F.bool_and("dev").alias("dev")).select(
        "lock_id", "path", none.alias("service_name"), "name", "version", F.lit(False).alias("link"), "dev"
    )
    return services.unionByName(packages)


_EDGE_SQL = _TREE_SQL + """, node AS (SELECT lock_id, path, 'pkg:npm/' || min(name) || '@' || min(version) AS pv FROM (SELECT e.lock_id, e.name, e.version, CASE WHEN e.line <= 3 THEN 'node_modules/' || e.name ELSE 'node_modules/' || p.name || '/node_modules/' || e.name END AS path
  FROM entry e LEFT JOIN (SELECT s.lock_id, s.line, v.name FROM lock_slot s JOIN package_version v ON v.pv = s.rep) p ON p.lock_id = e.lock_id AND p.line = e.line // 2 WHERE e.line <= 3 OR p.name IS NOT NULL) GROUP BY lock_id, path),
link AS (SELECT d.lock_id, d.dep, d.from_path, h.found_path, f.pv AS src, t.pv AS dst, d.from_path IN ('', 'packages/api') AS svc FROM declared d LEFT JOIN hit h USING (lock_id, from_path, dep)
  LEFT JOIN node f ON f.lock_id = d.lock_id AND f.path = d.from_path LEFT JOIN node t ON t.lock_id = d.lock_id AND t.path = h.found_path WHERE d.from_path IN ('', 'packages/api') OR f.pv IS NOT NULL) """


def tree_entries(fleet):
    """``lock_entry_table``, written once."""
    if not hasattr(fleet, "_tree_entries"):
        fleet._tree_entries = fleet.scratch.save(lock_entry_table(fleet), "lock_tree")
    return fleet._tree_entries


@query("join_dep_edges", _EDGE_SQL + """SELECT DISTINCT lock_id, CASE WHEN found_path IS NULL THEN 'unresolved' WHEN svc THEN 'direct' ELSE 'transitive' END AS kind,
CASE from_path WHEN '' THEN 'svc' || lock_id WHEN 'packages/api' THEN 'api' || lock_id END AS service,
CASE WHEN found_path IS NOT NULL AND NOT svc THEN src END AS src, dst, dep, CASE WHEN found_path IS NOT NULL AND svc THEN from_path = '' END AS dev
FROM link WHERE found_path IS NULL OR svc OR src <> dst""")
def _(fleet):
    return B.dependency_edges(tree_entries(fleet), declared=lock_declared(fleet).withColumn("dev", F.col("from_path") == ""))


@query("join_npm_graph", _EDGE_SQL + """SELECT DISTINCT lock_id, CASE WHEN svc THEN CASE from_path WHEN '' THEN 'svc:svc' || lock_id ELSE 'svc:api' || lock_id END ELSE src END AS parent, dst AS child
FROM link WHERE found_path IS NOT NULL AND (svc OR src <> dst)""")
def _(fleet):
    return B.npm_graph(tree_entries(fleet), lock_declared(fleet).withColumn("dev", F.lit(False)))


@query("join_repo_graph", """, e AS (SELECT src AS parent, dst AS child FROM lock_edge UNION ALL SELECT NULL, pv FROM lock_root UNION ALL SELECT pv, 'pkg:pypi/p' || (pk % 10) FROM package_version)
SELECT node, node NOT IN (SELECT child FROM e WHERE parent IS NOT NULL) AS direct FROM (SELECT child AS node FROM e UNION SELECT parent FROM e WHERE parent IS NOT NULL)""")
def _(fleet):
    npm = fleet.lock_edge.select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    listed = fleet.lock_root.select(F.lit(None).cast("string").alias("parent"), F.col("pv").alias("child"))
    python = fleet.package_version.select(F.col("pv").alias("parent"), F.concat(F.lit("pkg:pypi/p"), (F.col("pk") % 10).cast("string")).alias("child"))
    return B.repo_graph(npm, listed, python)


# -- closures and registry edges ----------------------------------------------------------


@query("closure_present_in", "SELECT pv, service, CAST(min(depth) AS INT) AS depth, bool_and(dev_only) AS dev, min(depth) = 1 AS direct FROM lock_closure GROUP BY pv, service")
def _(fleet):
    return B.present_in(fleet.lock_closure)


@query("closure_resolved_in", "SELECT lock_id, service, pv, CAST(depth AS INT) AS depth, via_direct, dev_only, observed_at AS first_seen FROM lock_closure")
def _(fleet):
    return B.closure(fleet.lock_root, fleet.lock_edge, fleet.scratch).select(
        "lock_id", "service", "pv", "depth", "via_direct", "dev_only", F.col("observed_at").alias("first_seen")
    )


@query("edge_requires", "SELECT src, dst_name, range FROM requires")
def _(fleet):
    return B.requires(fleet.requires.select("src", "dst_name", "range"), fleet.package).select("src", "dst_name", "range")


@query("edge_satisfied_by", "SELECT src, dst, range FROM satisfied_by")
def _(fleet):
    return B.satisfied_by(fleet.requires, fleet.package_version, fleet.affects)


@query("edge_provenance", """, v AS (SELECT p.pv, p.name, p.publisher, s.repo FROM published_by p JOIN sourced_from s USING (pv))
SELECT 'maintained_by' AS edge, 'pkg:npm/' || name AS src, 'npm-user:' || maintainer AS dst FROM maintained_by
UNION SELECT 'owned_by', 'pkg:npm/%40fleet/' || name, 'org:fleet' FROM v UNION SELECT 'sourced_from', replace(pv, 'pkg:npm/', 'pkg:npm/%40fleet/'), repo FROM v
UNION SELECT 'published_by', replace(pv, 'pkg:npm/', 'pkg:npm/%40fleet/'), 'npm-user:' || publisher FROM v""")
def _(fleet):
    v = fleet.published_by.join(fleet.sourced_from.select("pv", "repo"), "pv").join(fleet.package_version.select("pv", "version"), "pv").select(
        F.concat(F.lit("@fleet/"), "name").alias("name"), "version",
        F.concat(F.lit("git+https://"), F.regexp_replace("repo", "^repo:", ""), F.lit(".git")).alias("repository"),
        "publisher", F.lit("x@y.z").alias("publisher_email"),
    )
    m = fleet.maintained_by.select("name", F.col("maintainer").alias("username"), F.lit("").alias("email"))
    return B.provenance_edges(v, m)


@query("edge_lock_entries", """, d AS (SELECT lock_id, pv, bool_and(dev) AS dev FROM entry GROUP BY lock_id, pv)
SELECT 'entry:' || c.service || ':' || c.pv AS entry, c.lock_id, c.service, c.pv, CAST(c.depth AS INT) AS depth, d.dev FROM lock_closure c JOIN d USING (lock_id, pv)""")
def _(fleet):
    return B.lock_entries(fleet.lock_closure, fleet.entry)


def advisory_targets(fleet):
    """Targets named by version: odd packages as PyPI, some names no registry allows."""
    a = fleet.advisory.select("advisory_id", "pk", "name", "fixed_version", F.explode(F.array(F.lit("1.0.0"), F.lit("2.0.1"), F.lit("9.9.9"))).alias("version"))
    return a.select(
        "advisory_id", F.when(F.col("pk") % 5 == 0, F.concat(F.lit("_"), "name")).otherwise(F.col("name")).alias("package"), "version",
        F.when(F.col("pk") % 2 == 1, "pypi").otherwise("npm").alias("eco"), "fixed_version", F.lit("0").alias("introduced_version"),
    )


_TARGET_SQL = """, target AS (SELECT advisory_id, CASE WHEN pk % 5 = 0 THEN '_' || name ELSE name END AS package, unnest(['1.0.0', '2.0.1', '9.9.9']) AS version,
CASE WHEN pk % 2 = 1 THEN 'pypi' ELSE 'npm' END AS eco, fixed_version, pk % 5 = 0 AS odd FROM advisory) """


def npm_versions(fleet):
    return fleet.package_version.select("name", "version", F.lit("npm").alias("eco"), "published_at")


@query("edge_affects", _TARGET_SQL + """SELECT t.advisory_id, v.pv, t.fixed_version, '0' AS introduced_version, coalesce(f.published_at, 0) AS fixed_published_at
FROM target t JOIN package_version v ON v.name = t.package AND v.version = t.version LEFT JOIN package_version f ON f.name = t.package AND f.version = t.fixed_version WHERE t.eco = 'npm'""")
def _(fleet):
    return A.affects_edges(advisory_targets(fleet), npm_versions(fleet))


@query("edge_unattached", _TARGET_SQL + """SELECT advisory_id, package, version, CASE WHEN eco = 'npm' AND odd THEN 'unkeyable name' WHEN eco = 'pypi' AND odd THEN 'unkeyable name' WHEN eco = 'pypi' THEN 'PyPI, not in graph' ELSE 'not in graph' END AS reason
FROM target t WHERE NOT EXISTS (SELECT 1 FROM package_version v WHERE t.eco = 'npm' AND v.name = t.package AND v.version = t.version)""")
def _(fleet):
    return A.unattached(advisory_targets(fleet), npm_versions(fleet))


@query("edge_pypi_resolved", """SELECT DISTINCT 'pkg:pypi/' || replace(name, '_', '-') || '@' || version AS pv, service, CASE pk % 3 WHEN 0 THEN 'locked' WHEN 1 THEN 'pinned' ELSE 'resolved' END AS kind, -1 AS depth FROM entry""")
def _(fleet):
    nodes = fleet.entry.select("service", "name", "version", F.when(F.col("pk") % 3 == 0, "app/uv.lock").otherwise("app/requirements.txt").alias("manifest")).distinct()
    asked = fleet.entry.filter("pk % 3 > 0").select("service", "name", F.when(F.col("pk") % 3 == 1, "==1.0.0").otherwise(">=1").alias("specifier")).distinct()
    return B.pypi_resolved(nodes, asked)


@query("join_import_bridge", "SELECT service, specifier, pv, confidence FROM bridge")
def _(fleet):
    return B.import_bridge(fleet.external_import, fleet.lock_root, fleet.entry)


@query("universe_materialise", """SELECT name, version FROM package_version
UNION SELECT name, '9.9.9' FROM advisory WHERE pk % 2 = 0""")
def _(fleet):
    advised = fleet.advisory.select("name", F.lit("9.9.9").alias("version"), F.when(F.col("pk") % 2 == 0, "npm").otherwise("PyPI").alias("ecosystem"))
    return B.universe(fleet.package_version, advised, fleet.package_version)


# -- advisories ------------------------------------------------------------------------------

_COMPONENT_SQL = """, root AS (SELECT alias, min(advisory_id) AS canonical FROM advisory_alias GROUP BY alias) """


@query("alias_components", """, far AS (SELECT advisory_id, alias, 'PYSEC-' || (CAST(substr(alias, 6) AS INT) % 10) AS far FROM advisory_alias),
root AS (SELECT far, min(advisory_id) AS canonical FROM far GROUP BY far)
SELECT advisory_id AS id, canonical FROM far JOIN root USING (far) UNION SELECT alias, canonical FROM far JOIN root USING (far) UNION SELECT far, canonical FROM root""")
def _(fleet):
    near = fleet.advisory_alias.select(F.col("advisory_id").alias("osv_id"), "alias")
    # an alias that is itself listed under another name
    far = near.select(F.col("alias").alias("osv_id"), F.concat(F.lit("PYSEC-"), (F.substr("alias", F.lit(6)).cast("int") % 10).cast("string")).alias("alias"))
    return A.alias_components(near.unionByName(far.distinct()), fleet.scratch)


def merged_findings(fleet):
    text = F.concat(F.lit("flaw "), F.repeat(F.lit("x"), (F.col("pk") % 7).cast("int")))
    return fleet.advisory.select(
        F.col("advisory_id").alias("osv_id"), F.concat(F.lit("GHSA-"), (F.col("pk") % 50).cast("string")).alias("alias"), F.col("name").alias("package"),
        F.lit("1.0.0").alias("version"), F.lit("npm").alias("ecosystem"), text.alias("summary"), F.lit("").alias("details"),
        F.when(F.col("pk") % 3 == 0, F.concat(F.lit("CVSS:"), F.col("pk").cast("string"))).otherwise("").alias("cvss_vector"),
        F.when(F.col("pk") % 4 == 0, (F.col("pk") / 10.0)).cast("double").alias("score"),
        F.when(F.col("severity") == "unknown", "").otherwise(F.col("severity")).alias("severity_label"),
        F.when(F.col("pk") % 2 == 0, F.col("published")).otherwise(0).cast("bigint").alias("published"), F.col("published").alias("modified"),
        F.when(F.col("pk") % 2 == 0, F.col("fixed_version")).otherwise("").alias("fixed_version"), F.lit("0").alias("introduced_version"), F.col("pk").alias("row_no"),
    )


@query("advisory_merge", _COMPONENT_SQL + """, r AS (SELECT a.* EXCLUDE (summary), x.canonical, 'flaw ' || repeat('x', CAST(pk % 7 AS INT)) AS summary FROM advisory a JOIN advisory_alias USING (advisory_id) JOIN root x USING (alias))
SELECT canonical, arg_max(summary, length(summary)) AS summary, '' AS details, coalesce(arg_min('CVSS:' || pk, pk) FILTER (pk % 3 = 0), '') AS cvss_vector,
coalesce(CAST(arg_max(pk / 10.0, pk) FILTER (pk % 4 = 0) AS DOUBLE), -1) AS severity_score,
coalesce(arg_max(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) FILTER (severity <> 'unknown'), '') AS severity,
coalesce(arg_min(published, pk) FILTER (pk % 2 = 0), 0) AS published, max(published) AS modified, count(*) AS n_rows FROM r GROUP BY canonical""")
def _(fleet):
    f = merged_findings(fleet)
    return A.merge_advisories(f, A.alias_components(f.select("osv_id", "alias"), fleet.scratch))


@query("advisory_merge_ids", _COMPONENT_SQL + """SELECT canonical, alias FROM root UNION SELECT canonical, advisory_id FROM advisory_alias JOIN root USING (alias) WHERE advisory_id <> canonical""")
def _(fleet):
    f = merged_findings(fleet)
    return A.advisory_ids(f, A.alias_components(f.select("osv_id", "alias"), fleet.scratch))


@query("advisory_merge_targets", _COMPONENT_SQL + """SELECT canonical, 'npm' AS eco, name AS package, '1.0.0' AS version, CASE WHEN pk % 2 = 0 THEN fixed_version ELSE '' END AS fixed_version, '0' AS introduced_version
FROM advisory JOIN advisory_alias USING (advisory_id) JOIN root USING (alias)""")
def _(fleet):
    f = merged_findings(fleet)
    return A.affected_versions(f, A.alias_components(f.select("osv_id", "alias"), fleet.scratch))


@query("scan_vulnerable", _TARGET_SQL + "SELECT DISTINCT 'npm' AS eco, v.name, v.version FROM package_version v JOIN target t ON t.eco = 'npm' AND t.package = v.name AND t.version = v.version")
def _(fleet):
    return A.vulnerable(npm_versions(fleet), advisory_targets(fleet)).select("eco", "name", "version")


@query("enrich_advisories", """SELECT v.name, v.version, a.advisory_id AS osv_id, a.fixed_version AS fixed, a.severity, CASE WHEN v.pk % 3 = 0 THEN 'https://x/' || v.name END AS homepage
FROM package_version v JOIN advisory a USING (pk) WHERE v.major < a.n""")
def _(fleet):
    ranges = fleet.advisory.select(F.col("advisory_id").alias("osv_id"), F.col("name").alias("package"), F.lit("0").alias("introduced"), F.col("fixed_version").alias("fixed"), "severity")
    meta = fleet.package.filter("pk % 3 = 0").select("name", F.concat(F.lit("https://x/"), "name").alias("homepage"))
    return A.enrich(fleet.package_version.select("name", "version"), ranges, meta)


# -- files ----------------------------------------------------------------------------------------

RAW_PATH = (
    "CASE l_suppkey % 6 WHEN 0 THEN 'apps/web/src/f' || l_partkey || '.ts' WHEN 1 THEN 'node_modules/x/f' || l_partkey || '.js' WHEN 2 THEN 'corpus/fleet/p' || l_partkey || '/package-lock.json' "
    "WHEN 3 THEN 'corpus-tools/p' || l_partkey || '/package-lock.json' WHEN 4 THEN 'apps/dist/f' || l_partkey || '.js' ELSE 'api/p' || l_partkey || '.py' END"
)
_FILES_SQL = f"""WITH f AS (SELECT DISTINCT l_linenumber AS repo, {RAW_PATH} AS path FROM lineitem),
g AS (SELECT *, CASE WHEN path LIKE 'node_modules/%' THEN 'structural' WHEN path LIKE 'corpus/fleet/%' THEN 'corpus/fleet' WHEN path LIKE '%/dist/%' THEN 'dist' END AS ignored FROM f) """


def repo_listing(fleet):
    files = fleet.table("lineitem").selectExpr("l_linenumber AS repo", f"{RAW_PATH} AS path").distinct()
    patterns = fleet.table("region").select(F.explode(F.array(*[F.lit(p) for p in ("corpus/fleet/", "/dist  # built", "# nothing", "web/src")])).alias("pattern"))
    return B.ignore_reason(F.col("path"), patterns, files)


@query("path_ignore", _FILES_SQL + "SELECT repo, path, ignored FROM g", domain=False)
def _(fleet):
    return repo_listing(fleet).select("repo", "path", "ignored")


@query("view_repo_inventory", _FILES_SQL + """SELECT repo, count(*) FILTER (path LIKE '%package-lock.json' AND ignored IS NULL) AS n_lockfiles, count(*) FILTER (path LIKE '%package-lock.json' AND ignored IS NOT NULL) AS n_ignored,
count(*) FILTER (path LIKE '%.js' AND ignored IS NULL) AS n_js, count(*) FILTER (path LIKE '%.ts' AND ignored IS NULL) AS n_ts, count(*) FILTER (path LIKE '%.py' AND ignored IS NULL) AS n_py,
count(*) FILTER (path LIKE '%package-lock.json' AND ignored IS NULL) > 0 AS usable FROM g GROUP BY repo""", domain=False)
def _(fleet):
    return W.repo_inventory(repo_listing(fleet))


@query("artifact_scan", """, f AS (SELECT CAST(doc_id % 3 AS INT) AS repo, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 's' || (doc_id % 3) || '-' || (doc_id % 2) END AS service,
CASE doc_id % 5 WHEN 0 THEN '.claude/hooks/d' || doc_id || '.js' WHEN 1 THEN '.vscode/d' || doc_id || '.json' WHEN 2 THEN 'src/d' || doc_id || '.ts' WHEN 3 THEN 'setup_bun' || doc_id || '.js' ELSE '.github/workflows/d' || doc_id || '.yml' END AS path, text FROM documents),
k AS (SELECT repo, service, path, CASE WHEN path LIKE '%setup_bun%.js' THEN 'ioc-path' WHEN contains(text, 'the ') THEN 'ioc-content' ELSE 'watched-dir' END AS kind, sha256(text) AS sha256 FROM f WHERE path NOT LIKE 'src/%'),
s AS (SELECT DISTINCT repo, service FROM f WHERE service IS NOT NULL)
SELECT service, path, kind, sha256 FROM k WHERE service IS NOT NULL UNION ALL SELECT s.service, path, kind, sha256 FROM k JOIN s USING (repo) WHERE k.service IS NULL""")
def _(fleet):
    i = F.col("doc_id")
    path = F.expr(
        "CASE doc_id % 5 WHEN 0 THEN '.claude/hooks/d' || doc_id || '.js' WHEN 1 THEN '.vscode/d' || doc_id || '.json' WHEN 2 THEN 'src/d' || doc_id || '.ts' "
        "WHEN 3 THEN 'setup_bun' || doc_id || '.js' ELSE '.github/workflows/d' || doc_id || '.yml' END"
    )
    files = fleet.table("documents").select(
        (i % 3).cast("int").alias("repo"), F.when(i % 4 != 0, F.concat(F.lit("s"), (i % 3).cast("string"), F.lit("-"), (i % 2).cast("string"))).alias("service"),
        path.alias("path"), F.col("text").cast("binary").alias("content"),
    )
    services = files.filter("service IS NOT NULL").select("repo", "service")
    return B.artifact_scan(files, ["*setup_bun*.js"], ["the "], services)


# -- look-alike names ------------------------------------------------------------------------------
# Each package gets a twin with two letters swapped and few downloads.


def squat_names(fleet):
    p = fleet.package.filter("downloads IS NOT NULL")
    twin = F.expr("CASE pk % 4 WHEN 0 THEN substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3) WHEN 1 THEN replace(name, '-', '_') WHEN 2 THEN name || '-extra' ELSE '@s/' || name END")
    few = F.when(F.col("pk") % 8 == 3, F.lit(None)).otherwise(F.lit(1)).cast("bigint")
    names = p.select("name", "downloads").unionByName(p.select(twin.alias("name"), few.alias("downloads"))).groupBy("name").agg(F.max("downloads").alias("downloads"))
    return names


_SQUAT_SQL = """, p AS (SELECT pk, name, downloads FROM package WHERE downloads IS NOT NULL),
twin AS (SELECT pk, name AS target, downloads, CASE pk % 4 WHEN 0 THEN substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3) WHEN 1 THEN replace(name, '-', '_') WHEN 2 THEN name || '-extra' ELSE '@s/' || name END AS candidate FROM p),
top AS (SELECT name, downloads FROM p ORDER BY downloads DESC, name LIMIT 300) """


def squat_targets(fleet):
    return T.popular_targets(fleet.package)


_CANDIDATE_SQL = _SQUAT_SQL + """, names AS (SELECT name FROM p UNION SELECT candidate FROM twin),
n AS (SELECT name, regexp_replace(name, '^@[^/]+/', '') AS bare, SKELETON AS skel FROM names),
v0 AS (SELECT name, bare AS v FROM n WHERE length(bare) >= 4), v1 AS (SELECT DISTINCT name, substr(v, 1, i - 1) || substr(v, i + 1) AS v FROM (SELECT name, v, unnest(range(1, length(v) + 1)) AS i FROM v0)),
v2 AS (SELECT DISTINCT name, substr(v, 1, i - 1) || substr(v, i + 1) AS v FROM (SELECT name, v, unnest(range(1, length(v) + 1)) AS i FROM v1)),
tag AS (SELECT name, 'd:' || v AS t FROM v0 UNION SELECT name, 'd:' || v FROM v1 UNION SELECT name, 'd:' || v FROM v2 UNION SELECT name, 's:' || skel FROM n UNION SELECT name, 'b:' || bare FROM n)
SELECT DISTINCT c.name AS candidate, x.name AS target FROM tag c JOIN tag x ON x.t = c.t AND x.name <> c.name WHERE x.name IN (SELECT name FROM top)""".replace("SKELETON", SKELETON_SQL)


@query("typosquat_candidates", _CANDIDATE_SQL)
def _(fleet):
    return T.candidates(squat_names(fleet), squat_targets(fleet))


FOUND_SQL = _SQUAT_SQL + """, names AS (SELECT name, max(downloads) AS downloads FROM (SELECT name, downloads FROM p UNION ALL SELECT candidate, CASE WHEN pk % 8 = 3 THEN NULL ELSE 1 END FROM twin) GROUP BY name),
n AS (SELECT name, downloads, regexp_extract(name, '^(@[^/]+)/', 1) AS scope, regexp_replace(name, '^@[^/]+/', '') AS bare, SKELETON AS skel FROM names),
pair AS (SELECT c.name AS candidate, t.name AS target, c.bare AS cb, t.bare AS tb, c.scope AS cs, t.scope AS ts, c.skel = t.skel AS same, t.downloads // greatest(1, c.downloads) AS popularity_ratio,
  least(damerau_levenshtein(c.bare, t.bare), 3) AS d FROM n c JOIN n t ON c.name <> t.name AND t.downloads >= greatest(1, c.downloads) * 10 AND (c.scope = t.scope OR c.bare = t.bare)
  WHERE c.downloads IS NOT NULL AND length(c.bare) >= 4 AND t.name IN (SELECT name FROM top)),
found AS (SELECT candidate, target, CASE WHEN cb = tb THEN 'scope_confusion' WHEN regexp_replace(cb, '[-._]', '', 'g') = regexp_replace(tb, '[-._]', '', 'g') THEN 'separator' WHEN same THEN 'homoglyph'
  WHEN length(cb) = length(tb) AND d = 1 AND levenshtein(cb, tb) = 2 THEN 'transposition'
  WHEN length(cb) = length(tb) + 1 AND list_bool_or([substr(cb, i, 1) = substr(cb, i + 1, 1) AND substr(cb, 1, i) || substr(cb, i + 2) = tb FOR i IN range(1, length(cb))]) THEN 'repeated_char'
  ELSE 'edit_distance' END AS technique, CAST(d AS INT) AS distance, popularity_ratio
  FROM pair WHERE (d <= 2 OR same) AND NOT ((cs = '') <> (ts = '') AND cb = tb)
  AND NOT (cb <> tb AND (starts_with(cb, tb || '.') OR starts_with(cb, tb || '-') OR starts_with(cb, tb || '_') OR starts_with(tb, cb || '.') OR starts_with(tb, cb || '-') OR starts_with(tb, cb || '_')))) """.replace("SKELETON", SKELETON_SQL)


@query("typosquat_edges", FOUND_SQL + "SELECT candidate, target, technique, distance, popularity_ratio FROM found")
def _(fleet):
    return T.edges(squat_names(fleet), squat_targets(fleet))


@query("q_typosquats", FOUND_SQL + "SELECT candidate, target, technique, distance FROM found WHERE target IN (SELECT name FROM advisory)")
def _(fleet):
    squats = T.edges(squat_names(fleet), squat_targets(fleet))
    return R.imitators(squats, fleet.advisory.select("name")).select("candidate", "target", "technique", "distance")


# -- workspaces ----------------------------------------------------------------------------------------


@query("scope_filter", "SELECT pv, service, CAST(depth AS INT) AS depth, dev_only FROM resolved_in JOIN workspace USING (service) WHERE workspace = 'ASIA'")
def _(fleet):
    return W.scope_filter(fleet.resolved_in, fleet.workspace, "ASIA").select("pv", "service", "depth", "dev_only")


@query("workspace_collisions", """SELECT lower(n_name) AS service, count(DISTINCT c_mktsegment) AS n_workspaces FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY lower(n_name) HAVING count(DISTINCT c_mktsegment) > 1""", domain=False)
def _(fleet):
    c, n = fleet.table("customer"), fleet.table("nation")
    claims = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_mktsegment").alias("workspace"), F.col("n_name").alias("service"))
    return W.workspace_collisions(claims)


# -- questions -----------------------------------------------------------------------------------------


@query("q_exact_lookup", "SELECT pv, name, version, published_at FROM package_version WHERE pv = (SELECT min(pv) FROM package_version)")
def _(fleet):
    versions = fleet.keyed("package_version", "pv")
    return R.exact_lookup(versions, versions.least()).select("pv", "name", "version", "published_at")


@query("q_held_versions", "SELECT pv, name, version FROM package_version WHERE pk IN (0, 1, 2)")
def _(fleet):
    return R.held_versions(fleet.package_version, fleet.package.filter("pk IN (0, 1, 2)")).select("pv", "name", "version")


@query("q_direct_dependents", "SELECT dst AS pv, src AS dependent, range FROM satisfied_by")
def _(fleet):
    return R.direct_dependents(fleet.package_version, fleet.satisfied_by)


@query("q_transitive_dependents", """, w AS (SELECT pv, pv AS node, 0 AS depth FROM incident UNION SELECT w.pv, s.src, w.depth + 1 FROM w JOIN satisfied_by s ON s.dst = w.node WHERE w.depth < 5)
SELECT pv, node AS dependent, CAST(min(depth) AS INT) AS depth FROM w GROUP BY pv, node HAVING min(depth) > 0""")
def _(fleet):
    return R.transitive_dependents(fleet.incident, fleet.satisfied_by, fleet.scratch)


@query("q_transitive_dependents_affected", """, w AS (SELECT DISTINCT pv, pv AS node, 0 AS depth FROM affects UNION SELECT w.pv, s.src, w.depth + 1 FROM w JOIN satisfied_by s ON s.dst = w.node WHERE w.depth < 5)
SELECT pv, node AS dependent, CAST(min(depth) AS INT) AS depth FROM w GROUP BY pv, node HAVING min(depth) > 0""")
def _(fleet):
    return R.transitive_dependents(fleet.affects.select("pv").distinct(), fleet.satisfied_by, fleet.scratch)


@query("q_lockfile_entries", "SELECT lock_id, line, e.pv, dev FROM entry e JOIN (SELECT DISTINCT pv FROM affects) a ON a.pv = e.pv")
def _(fleet):
    return R.lockfile_entries(fleet.affects, fleet.entry).select("lock_id", "line", "pv", "dev")


@query("q_exposed_projects", "SELECT r.pv, service, CAST(depth AS INT) AS depth, via_direct, dev_only, first_seen FROM resolved_in r JOIN (SELECT DISTINCT pv FROM affects) a ON a.pv = r.pv")
def _(fleet):
    return R.exposed(fleet.affects, fleet.resolved_in).select("pv", "service", "depth", "via_direct", "dev_only", "first_seen")


@query("q_exposed_services", "SELECT service, count(DISTINCT r.pv) AS n_versions, CAST(min(depth) AS INT) AS min_depth FROM resolved_in r JOIN (SELECT DISTINCT pv FROM affects) a ON a.pv = r.pv GROUP BY service")
def _(fleet):
    hit = R.exposed(fleet.affects, B.present_in(fleet.lock_closure))
    return hit.groupBy("service").agg(F.count_distinct("pv").alias("n_versions"), F.min("depth").alias("min_depth"))


@query("q_live_window", f"""SELECT v.pv, r.service, first_seen FROM package_version v JOIN resolved_in r ON r.pv = v.pv WHERE v.published_at <= {LIVE_UNTIL} AND first_seen > 0 AND first_seen <= v.published_at + 31536000 AND last_seen >= v.published_at""")
def _(fleet):
    windows = fleet.package_version.filter(F.col("published_at") <= LIVE_UNTIL).select("pv", F.col("published_at").alias("since"), (F.col("published_at") + 31536000).alias("until"))
    return R.live_window(windows, fleet.resolved_in).select("pv", "service", "first_seen")


_SHARED_SQL = """, t AS (SELECT identity, count(*) FILTER (is_subject) AS n FROM l GROUP BY identity)
SELECT identity, member, n - CASE WHEN is_subject THEN 1 ELSE 0 END AS other_subjects, is_subject FROM l JOIN t USING (identity) WHERE n - CASE WHEN is_subject THEN 1 ELSE 0 END > 0"""


def _shared(df, identity, member):
    return df.select(F.col(identity).alias("identity"), F.col(member).alias("member"), "other_subjects", "is_subject")


@query("q_shared_maintainer", ", l AS (SELECT DISTINCT maintainer AS identity, name AS member, name IN (SELECT name FROM incident) AS is_subject FROM maintained_by)" + _SHARED_SQL)
def _(fleet):
    return _shared(R.shared_identity(fleet.maintained_by, fleet.incident.select("name"), "maintainer", "name"), "maintainer", "name")


@query("q_shared_repository", ", l AS (SELECT DISTINCT repo AS identity, name AS member, name IN (SELECT name FROM incident) AS is_subject FROM sourced_from)" + _SHARED_SQL)
def _(fleet):
    return _shared(R.shared_identity(fleet.sourced_from, fleet.incident.select("name"), "repo", "name"), "repo", "name")


@query("q_shared_publisher", ", l AS (SELECT DISTINCT publisher AS identity, pv AS member, pv IN (SELECT pv FROM incident) AS is_subject FROM published_by)" + _SHARED_SQL)
def _(fleet):
    return _shared(R.shared_identity(fleet.published_by, fleet.incident.select("pv"), "publisher", "pv"), "publisher", "pv")


@query("q_incidents", "SELECT v.pv, incident_id, live_from, live_until FROM package_version v JOIN incident i ON i.pv = v.pv")
def _(fleet):
    return R.incidents_for(fleet.package_version, fleet.incident).select("pv", "incident_id", F.col("live_from").cast("int").alias("live_from"), F.col("live_until").cast("int").alias("live_until"))


@query("q_advisories", "SELECT pv, advisory_id, severity, fixed_version, fixed_published_at FROM affects")
def _(fleet):
    return R.advisories_for(fleet.package_version, fleet.affects).select("pv", "advisory_id", "severity", "fixed_version", "fixed_published_at")


_PATH_SQL = """, up AS (SELECT dst AS src, src AS dst FROM depends_on UNION SELECT pv, 'svc:' || lower(service) FROM lock_root),
p AS (SELECT pv AS source, pv AS node, [pv] AS path, 0 AS hops FROM (SELECT DISTINCT pv FROM affects)
  UNION ALL SELECT p.source, u.dst, list_append(p.path, u.dst), p.hops + 1 FROM p JOIN up u ON u.src = p.node WHERE NOT list_contains(p.path, u.dst) AND p.hops < 10) """


def path_subjects(fleet):
    return fleet.affects.select("pv").distinct()


@query("q_paths_one_source", _PATH_SQL + """SELECT source, node AS target, CAST(hops AS INT) AS hops, array_to_string(path, ' ') AS path FROM p WHERE node LIKE 'svc:%'
QUALIFY row_number() OVER (PARTITION BY source ORDER BY hops, path) <= 25""")
def _(fleet):
    up = R.upward_edges(fleet.depends_on, fleet.lock_root)
    found = R.paths_one_source(path_subjects(fleet), up, fleet.workspace, fleet.scratch, 10)
    return found.select("source", "target", "hops", F.array_join("path", " ").alias("path"))


def many_paths(fleet):
    up = R.upward_edges(fleet.depends_on, fleet.lock_root)
    return R.paths_many(path_subjects(fleet), up, fleet.workspace, fleet.scratch)


@query("q_paths_many", _PATH_SQL + """SELECT source, node AS target, CAST(hops AS INT) AS hops, array_to_string(path, ' ') AS path FROM p WHERE node LIKE 'svc:%'
QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY hops, path) <= 3""")
def _(fleet):
    return many_paths(fleet).select("source", "target", "hops", F.array_join("path", " ").alias("path"))


@query("view_dependency_path", _PATH_SQL + """, k AS (SELECT source, node, hops, path FROM p WHERE node LIKE 'svc:%' QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY hops, path) <= 3)
SELECT source, node AS service, CAST(hops AS INT) AS hops, array_to_string(list_transform(list_reverse(path), lambda x: regexp_replace(regexp_replace(x, '^pkg:[^/]+/', ''), '^svc:', '')), ' -> ') AS chain
FROM k""")
def _(fleet):
    return W.dependency_path(many_paths(fleet)).select("source", "service", "hops", "chain")


_EXPOSURE_SQL = """, p AS (SELECT pv, pv AS node, [pv] AS path, 0 AS depth FROM (SELECT DISTINCT pv FROM affects)
  UNION ALL SELECT p.pv, d.src, list_append(p.path, d.src), p.depth + 1 FROM p JOIN depends_on d ON d.dst = p.node WHERE p.depth < 8) """


@query("q_exposure_paths", _EXPOSURE_SQL + """SELECT pv, node, CAST(min(depth) AS INT) AS depth, array_to_string(arg_min(path, (depth, list_reverse(path))), ' ') AS path FROM p GROUP BY pv, node HAVING min(depth) > 0""")
def _(fleet):
    found = R.exposure_paths(fleet.affects.select("pv").distinct(), fleet.depends_on, fleet.scratch)
    return found.select("pv", "node", "depth", F.array_join("path", " ").alias("path"))


# -- code -------------------------------------------------------------------------------------------------

_CALLING_SQL = """, cf AS (SELECT DISTINCT b.pv, b.service, c.fn, b.specifier FROM bridge b JOIN calls_external c USING (service, specifier) WHERE b.pv IN (SELECT pv FROM affects)),
back AS (SELECT DISTINCT fn, fn AS node, 0 AS depth FROM cf UNION SELECT b.fn, c.src, b.depth + 1 FROM back b JOIN calls c ON c.dst = b.node WHERE b.depth < 8) """


@query("q_calling_functions", _CALLING_SQL + "SELECT pv, service, fn, specifier FROM cf")
def _(fleet):
    return R.calling_functions(fleet.affects, fleet.bridge, fleet.calls_external)


@query("q_reachable_routes", _CALLING_SQL + """SELECT b.fn, method, pattern, r.service AS route_service, CAST(min(depth) AS INT) AS depth FROM back b JOIN route r ON r.fn = b.node GROUP BY ALL""")
def _(fleet):
    users = R.calling_functions(fleet.affects, fleet.bridge, fleet.calls_external)
    return R.reachable_routes(users, fleet.calls, fleet.route, fleet.scratch)


@query("q_artifacts_for", "SELECT service, path, kind FROM artifact WHERE service IN (SELECT service FROM resolved_in r JOIN incident i ON i.pv = r.pv)")
def _(fleet):
    return R.artifacts_for(R.exposed(fleet.incident, fleet.resolved_in), fleet.artifact).select("service", "path", "kind")


@query("q_persistence", """SELECT service, path, kind, CASE WHEN path LIKE '.claude/%' THEN '.claude' WHEN path LIKE '.vscode/%' THEN '.vscode' ELSE '.github/workflows' END AS watched_dir,
CASE kind WHEN 'ioc-content' THEN 0 WHEN 'ioc-path' THEN 1 ELSE 2 END AS kind_rank FROM artifact""")
def _(fleet):
    return R.persistence(fleet.artifact).select("service", "path", "kind", "watched_dir", "kind_rank")


@query("q_import_reach", "SELECT service, specifier, pv, CAST(hops AS INT) AS hops FROM import_reach")
def _(fleet):
    return R.import_reach(fleet.bridge, R.version_reach(fleet.bridge, fleet.depends_on, fleet.scratch))


_CODE_SQL = """, im AS (SELECT r.* FROM import_reach r JOIN (SELECT DISTINCT pv FROM affects) a ON a.pv = r.pv), us AS (SELECT * FROM im JOIN calls_external USING (service, specifier)),
cl AS (SELECT DISTINCT pv, fn AS node, 0 AS depth FROM us UNION SELECT c.pv, k.src, c.depth + 1 FROM cl c JOIN calls k ON k.dst = c.node WHERE c.depth < 2),
near AS (SELECT pv, node, min(depth) AS depth FROM cl GROUP BY pv, node) """


def reach_of(fleet):
    subjects = fleet.affects.select("pv").distinct()
    imports = fleet.scratch.save(R.imports_reaching(subjects, fleet.bridge, fleet.depends_on, fleet.scratch), "reaching")
    return R.code_reach(subjects, imports, fleet.calls_external, fleet.calls, fleet.scratch)


@query("q_code_reach", _CODE_SQL + """SELECT DISTINCT pv, 'version' AS layer, pv AS node, 0 AS distance FROM affects
UNION SELECT pv, 'import', 'import:' || service || ':' || specifier, CAST(hops AS INT) FROM im UNION SELECT pv, CASE depth WHEN 0 THEN 'function' ELSE 'caller' END, 'fn:' || node, CAST(depth AS INT) FROM near""")
def _(fleet):
    return reach_of(fleet)[0]


@query("q_code_reach_edges", _CODE_SQL + """SELECT pv, pv AS src, 'import:' || service || ':' || specifier AS dst, 'loaded_by' AS edge FROM im
UNION SELECT pv, 'import:' || service || ':' || specifier, 'fn:' || fn, 'used_by' FROM us
UNION SELECT a.pv, 'fn:' || c.src, 'fn:' || c.dst, 'calls' FROM calls c JOIN near a ON a.node = c.src JOIN near b ON b.node = c.dst AND b.pv = a.pv""")
def _(fleet):
    return reach_of(fleet)[1]


@query("q_code_reach_truncated", _CODE_SQL + """SELECT n.pv, count(DISTINCT c.src) AS n_truncated FROM near n JOIN calls c ON c.dst = n.node WHERE n.depth = 2 GROUP BY n.pv""")
def _(fleet):
    nodes, _ = reach_of(fleet)
    edge = nodes.filter("layer = 'caller' AND distance = 2").select("pv", F.regexp_replace("node", "^fn:", "").cast("bigint").alias("fn"))
    return R.truncated_callers(edge, fleet.calls)


@query("q_heat", "SELECT node, heat, CAST(hops AS INT) AS hops, severity FROM heat")
def _(fleet):
    return R.layered_heat(fleet.affects, R.heat_layers(fleet), fleet.scratch).select("node", "heat", "hops", "severity")


@query("q_call_depth", """, w AS (SELECT fn, 0 AS depth FROM function WHERE fn NOT IN (SELECT dst FROM calls) UNION SELECT c.dst, w.depth + 1 FROM w JOIN calls c ON c.src = w.fn WHERE w.depth < 6)
SELECT f.fn, CAST(coalesce(max(w.depth), 0) AS INT) AS depth FROM function f LEFT JOIN w USING (fn) GROUP BY f.fn""")
def _(fleet):
    return R.call_depth(fleet.function, fleet.calls, fleet.scratch)


# -- overlay -------------------------------------------------------------------------------------------------


def requested_incidents(fleet):
    asked = fleet.package_version.filter("pk % 53 = 0").select("pv").unionByName(fleet.advisory.select(F.concat(F.lit("pkg:npm/"), "name", F.lit("@9.9.9")).alias("pv")))
    return I.request(asked, LIVE_FROM)


@query("dml_incident_upsert", """SELECT 'SIM-' || pv AS incident_id, pv, 820454400 AS live_from, 820454400 + 21600 AS live_until FROM package_version WHERE pk % 53 = 0
UNION ALL SELECT incident_id, pv, live_from, live_until FROM incident WHERE pk % 53 <> 0""")
def _(fleet):
    after, _ = I.upsert(fleet.incident, requested_incidents(fleet), fleet.package_version)
    return after.select("incident_id", "pv", F.col("live_from").cast("int").alias("live_from"), F.col("live_until").cast("int").alias("live_until"))


@query("dml_incident_refused", "SELECT 'pkg:npm/' || name || '@9.9.9' AS pv, 'not held' AS reason FROM advisory")
def _(fleet):
    return I.upsert(fleet.incident, requested_incidents(fleet), fleet.package_version)[1]


@query("dml_incident_retract", "SELECT incident_id, pv FROM incident WHERE pk % 2 <> 0")
def _(fleet):
    gone = fleet.package_version.filter("pk % 2 = 0").select(F.concat(F.lit("SIM-"), "pv").alias("incident_id"))
    return I.retract(fleet.incident, gone)[0].select("incident_id", "pv")


@query("dml_incident_retract_report", "SELECT 'SIM-' || v.pv AS incident_id, i.pv IS NOT NULL AS existed FROM package_version v LEFT JOIN incident i ON i.pv = v.pv WHERE v.pk % 2 = 0")
def _(fleet):
    gone = fleet.package_version.filter("pk % 2 = 0").select(F.concat(F.lit("SIM-"), "pv").alias("incident_id"))
    return I.retract(fleet.incident, gone)[1]
