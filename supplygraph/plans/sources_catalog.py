"""Documents, sinks and the live feed over the driver's tables.

Input documents are rendered from table rows, one bounded document per row, and
read back by the same parsers that read files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from supplygraph.operators import reach as R
from supplygraph.plans.graph_catalog import RAW_PATH, repo_listing
from supplygraph.plans.registry import query
from supplygraph.sources import documents as D
from supplygraph.sources import sinks as K
from supplygraph.streaming import feed as L

# -- lockfiles ----------------------------------------------------------------------------

RAW_LOCK = (
    "'{\"name\":\"svc' || lock_id || '\",\"lockfileVersion\":' || CASE WHEN pk % 9 = 0 THEN '1' ELSE '3,\"packages\":{\"\":{\"dependencies\":{\"' || name || '\":\"*\"}},"
    "\"packages/api\":{\"name\":\"api\"},\"node_modules/' || name || '\":{\"version\":\"' || version || '\",\"dev\":' || CASE WHEN dev THEN 'true' ELSE 'false' END || '},"
    "\"node_modules/' || name || '/node_modules/@s/x\":{\"version\":\"1.0.0\",\"name\":\"@s/x\"},\"node_modules/api\":{\"link\":true},\"node_modules/_bad\":{\"version\":\"1\"},\"node_modules/gone\":{}}' END || '}'"
)


def lock_texts(fleet):
    return fleet.entry.groupBy("lock_id", "pk", "name", "version").agg(F.bool_and("dev").alias("dev")).selectExpr(
        "lock_id || ':' || name || ':' || version AS id", f"{RAW_LOCK} AS text"
    )


_LOCK_SQL = """, t AS (SELECT lock_id || ':' || name || ':' || version AS id, lock_id, pk, name, version, bool_and(dev) AS dev FROM entry GROUP BY lock_id, pk, name, version) """


@query("src_lockfile", _LOCK_SQL + """, ok AS (SELECT * FROM t WHERE pk % 9 <> 0)
SELECT id AS lock_id, '' AS path, 'service' AS role, 'svc' || lock_id AS service_name, '' AS name, NULL AS version, false AS root_level, false AS dev FROM ok
UNION ALL SELECT id, 'packages/api', 'service', 'api', 'api', NULL, false, false FROM ok
UNION ALL SELECT id, 'node_modules/' || name, 'package', NULL, name, version, true, dev FROM ok
UNION ALL SELECT id, 'node_modules/' || name || '/node_modules/@s/x', 'package', NULL, '@s/x', '1.0.0', false, false FROM ok
UNION ALL SELECT id, 'node_modules/api', 'link', NULL, 'api', NULL, false, false FROM ok
UNION ALL SELECT id, 'node_modules/_bad', 'unkeyable', NULL, '_bad', '1', false, false FROM ok
UNION ALL SELECT id, 'node_modules/gone', 'unresolved', NULL, 'gone', NULL, false, false FROM ok""")
def _(fleet):
    entries = D.lock_entries(D.lockfiles(lock_texts(fleet), "id", "text"))
    return entries.select("lock_id", "path", "role", "service_name", "name", "version", "root_level", "dev")


@query("src_lockfile_rejected", _LOCK_SQL + "SELECT id AS lock_id, 1 AS lock_version, 'no packages map' AS reject FROM t WHERE pk % 9 = 0")
def _(fleet):
    return D.lockfiles(lock_texts(fleet), "id", "text").filter("reject IS NOT NULL").select("lock_id", "lock_version", "reject")


@query("src_lockfile_discover", f"""WITH f AS (SELECT DISTINCT l_linenumber AS repo, {RAW_PATH} AS path FROM lineitem) SELECT repo, path, path LIKE 'corpus/fleet/%' AS skipped FROM f WHERE path LIKE '%/package-lock.json'""", domain=False)
def _(fleet):
    files = repo_listing(fleet).filter(F.substring_index("path", "/", -1) == "package-lock.json")
    return files.filter("ignored IS NULL OR ignored <> 'structural'").select("repo", "path", F.col("ignored").isNotNull().alias("skipped"))


# -- Python ----------------------------------------------------------------------------------

RAW_LINE = (
    "CASE p_partkey % 6 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '-r other.txt' WHEN 2 THEN replace(p_name, ' ', '_') || p_partkey || '[tls]>=1.' || p_partkey || ' ; python_version < \"3\"  # why' "
    "WHEN 3 THEN 'Flask.' || replace(p_name, ' ', '.') || p_partkey || ' == 2.0' WHEN 4 THEN '  bare-' || p_partkey ELSE '' END"
)


@query("src_requirements", """SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN replace(p_name, ' ', '-') || p_partkey WHEN 3 THEN 'flask-' || replace(p_name, ' ', '-') || p_partkey ELSE 'bare-' || p_partkey END AS name,
CASE p_partkey % 6 WHEN 2 THEN '>=1.' || p_partkey WHEN 3 THEN '== 2.0' ELSE '' END AS specifier FROM part WHERE p_partkey % 6 IN (2, 3, 4)""", domain=False)
def _(fleet):
    return D.requirements(fleet.table("part").selectExpr("p_partkey", f"{RAW_LINE} AS line"), "p_partkey", "line")


RAW_MANIFEST = (
    "CASE l_suppkey % 5 WHEN 0 THEN 'a' || l_partkey || '/requirements.txt' WHEN 1 THEN '.venv/lib/a' || l_partkey || '/requirements.txt' WHEN 2 THEN 'corpus/fleet/p' || l_partkey || '/uv.lock' "
    "WHEN 3 THEN 'b' || l_partkey || '/poetry.lock' ELSE 'b/setup' || l_partkey || '.py' END"
)


@query("src_requirements_discover", f"""WITH f AS (SELECT DISTINCT {RAW_MANIFEST} AS path, l_suppkey % 5 AS k FROM lineitem) SELECT path FROM f WHERE k IN (0, 3)""", domain=False)
def _(fleet):
    from supplygraph.operators.build import ignore_reason

    files = fleet.table("lineitem").selectExpr(f"{RAW_MANIFEST} AS path").distinct().filter(D.is_python_manifest(F.col("path")))
    patterns = fleet.table("region").select(F.lit("corpus").alias("pattern"))
    return ignore_reason(F.col("path"), patterns, files).filter("ignored IS NULL").select("path")


RAW_PIP = (
    "'{\"install\":[{\"metadata\":{\"name\":\"P_' || p_partkey || '\",\"version\":\"1.' || p_size || '\",\"license\":\"' || p_type || '\",\"requires_dist\":[\"Child.' || p_partkey || ' (>=1)\",\"absent>2\",\"tls; extra == ''x''\"]}},"
    "{\"metadata\":{\"name\":\"child-' || p_partkey || '\",\"version\":\"2\",\"license_expression\":\"MIT\"}},{\"metadata\":{\"name\":\"tls\",\"version\":\"3\"}}]}'"
)


def pip_texts(fleet):
    return fleet.table("part").selectExpr("p_partkey", f"{RAW_PIP} AS text")


@query("src_pip_report", """SELECT p_partkey, 'p-' || p_partkey AS name, '1.' || p_size AS version, p_type AS license FROM part UNION ALL SELECT p_partkey, 'child-' || p_partkey, '2', 'MIT' FROM part UNION ALL SELECT p_partkey, 'tls', '3', '' FROM part""", domain=False)
def _(fleet):
    return D.pip_report(pip_texts(fleet), "p_partkey", "text")[0].select("p_partkey", "name", "version", "license")


@query("src_pip_report_edges", "SELECT p_partkey, 'p-' || p_partkey AS parent, 'child-' || p_partkey AS child FROM part", domain=False)
def _(fleet):
    return D.pip_report(pip_texts(fleet), "p_partkey", "text")[1]


# -- registry --------------------------------------------------------------------------------

RAW_DOC = (
    "'{\"name\":\"' || name || '\",\"dist-tags\":{\"latest\":\"2.0.0\"},\"time\":{\"1.0.0\":\"2024-01-01T00:00:00Z\",\"2.0.0\":\"2024-01-02T00:00:0' || (pk % 10) || '.123Z\"},"
    "\"maintainers\":[{\"name\":\"u' || (pk % 9) || '\",\"email\":\"e@x.io\"},\"plain\"],' || CASE WHEN pk % 2 = 0 THEN '\"repository\":{\"url\":\"git+https://github.com/o/r' || pk || '.git\"},' ELSE '' END || "
    "'\"versions\":{\"1.0.0\":{\"dist\":{\"integrity\":\"sha-' || pk || '\"},\"dependencies\":{\"a\":\"^1\",\"b\":\"\"},\"peerDependencies\":{\"c\":\"*\"},\"repository\":\"github:o/first\"},"
    "\"2.0.0\":{\"hasInstallScript\":' || CASE WHEN pk % 3 = 0 THEN 'true' ELSE 'false' END || ',\"deprecated\":\"use x\",\"license\":{\"type\":\"MIT\"},\"description\":\"d\",\"repository\":{\"url\":\"github:o/second\"},"
    "\"_npmUser\":{\"name\":\"u' || (pk % 7) || '\",\"email\":\"p@x.io\"},\"optionalDependencies\":{\"o\":\"1\"},\"devDependencies\":{\"t\":\"2\"},\"bundleDependencies\":[\"o\"]}}}'"
)


def documents(fleet):
    return D.packuments(fleet.package.selectExpr(f"{RAW_DOC} AS text"), "text")


@query("src_packument", "SELECT name, '2.0.0' AS latest, 2 AS version_count, CASE WHEN pk % 2 = 0 THEN 'git+https://github.com/o/r' || pk || '.git' ELSE 'github:o/second' END AS repository, false AS deprecated FROM package")
def _(fleet):
    return D.packument_package(documents(fleet))


@query("src_packument_versions", """SELECT name, '1.0.0' AS version, 'sha-' || pk AS integrity, false AS has_install_script, false AS deprecated, '' AS license, 'github:o/first' AS repository, '' AS publisher, 1704067200 AS published_at FROM package
UNION ALL SELECT name, '2.0.0', '', pk % 3 = 0, true, 'MIT', 'github:o/second', 'u' || (pk % 7), 1704153600 + pk % 10 FROM package""")
def _(fleet):
    return D.packument_versions(documents(fleet)).drop("description", "publisher_email")


@query("src_packument_dependencies", """SELECT name, v.* FROM package, (VALUES ('1.0.0', 'a', '^1', 'prod', false, false, false), ('1.0.0', 'b', '*', 'prod', false, false, false), ('1.0.0', 'c', '*', 'peer', false, true, false),
('2.0.0', 'o', '1', 'optional', true, false, true), ('2.0.0', 't', '2', 'dev', false, false, false)) v(version, dst_name, range, dep_type, optional, peer, bundled)""")
def _(fleet):
    return D.packument_dependencies(documents(fleet))


@query("src_packument_maintainers", "SELECT name, 'u' || (pk % 9) AS username, 'e@x.io' AS email FROM package UNION ALL SELECT name, 'plain', '' FROM package")
def _(fleet):
    return D.packument_maintainers(documents(fleet))


@query("src_downloads", """SELECT name, pk + 1 AS downloads FROM package UNION ALL SELECT name || '.js', 7 FROM package WHERE pk % 2 = 0""")
def _(fleet):
    text = F.expr(
        "CASE WHEN pk % 2 = 0 THEN '{\"' || upper(name) || '\":{\"downloads\":' || (pk + 1) || ',\"package\":\"x\"},\"' || name || '.js\":{\"downloads\":7},\"none' || pk || '\":null}' "
        "ELSE '{\"downloads\":' || (pk + 1) || ',\"package\":\"' || name || '\",\"start\":\"x\"}' END"
    )
    return D.downloads(fleet.package.select(text.alias("text")), "text")


@query("src_maintainer_search", "SELECT pk, name AS package, unnest(['a' || pk, 'b']) AS maintainer FROM package UNION ALL SELECT pk, name || '-x', NULL FROM package")
def _(fleet):
    text = F.expr("'{\"objects\":[{\"package\":{\"name\":\"' || name || '\",\"maintainers\":[{\"username\":\"a' || pk || '\"},{\"name\":\"b\"},{}]}},{\"package\":{\"name\":\"' || name || '-x\",\"maintainers\":[]}},{\"package\":{}}]}'")
    return D.maintainer_search(fleet.package.select("pk", text.alias("text")), "pk", "text")


@query("src_package_meta", """SELECT name, CASE WHEN pk % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'A' || pk AS author, 'https://h/' || pk AS homepage, 'MIT' AS license, '1.' || pk AS latest, 'm1|m2' AS maintainers FROM package""")
def _(fleet):
    text = F.expr(
        "CASE WHEN pk % 2 = 0 THEN '{\"info\":{\"name\":\"' || replace(name, '-', '_') || '\",\"author\":\"A' || pk || '\",\"home_page\":\"https://h/' || pk || '\",\"license\":\"MIT\",\"version\":\"1.' || pk || '\",\"maintainer\":\"m1, m2\"}}' "
        "ELSE '{\"name\":\"' || name || '\",\"author\":{\"name\":\"A' || pk || '\"},\"homepage\":\"https://h/' || pk || '\",\"license\":\"MIT\",\"dist-tags\":{\"latest\":\"1.' || pk || '\"},\"maintainers\":[{\"name\":\"m1\"},{\"name\":\"m2\"}]}' END"
    )
    return D.package_meta(fleet.package.select(text.alias("text")), "text").withColumn("maintainers", F.array_join("maintainers", "|"))


# -- advisories ---------------------------------------------------------------------------------


def raw_findings(fleet):
    """Findings rows as feeds write them, some unusable."""
    pk = F.col("pk")
    s = lambda c: c.cast("string")
    return fleet.affects.select(
        F.when(pk % 11 == 0, "").when(pk % 11 == 1, F.concat(F.lit("_"), "name")).otherwise(F.concat(F.lit(" "), F.upper("name"))).alias("package"),
        F.when(pk % 11 == 2, "").otherwise(F.col("version")).alias("version"), F.lit("npm").alias("ecosystem"), F.lit("package-lock.json").alias("source_file"),
        F.col("advisory_id").alias("osv_id"), F.concat(F.lit("GHSA-"), s(pk % 50), F.lit(" | ,OSV-"), s(pk)).alias("aliases"), F.lit(" flaw, \"quoted\" ").alias("summary"),
        F.lit("").alias("cvss_vector"), F.when(pk % 3 == 0, s(pk % 10)).when(pk % 3 == 1, F.upper("severity")).otherwise("weird").alias("severity_score"),
        F.col("fixed_version"), F.col("introduced_version"), F.lit("2024-01-01T00:00:00Z").alias("published"), F.lit("").alias("modified"),
        F.lit("line").alias("details"), F.concat(F.lit("https://x/"), s(pk), F.lit("|https://y")).alias("references"),
    )


_FIND_SQL = """SELECT CASE WHEN pk % 11 = 0 THEN '' WHEN pk % 11 = 1 THEN NULL ELSE name END AS package, CASE WHEN pk % 11 = 2 THEN '' ELSE version END AS version, advisory_id AS osv_id, 'GHSA-' || (pk % 50) || ';OSV-' || pk AS aliases, 'flaw, "quoted"' AS summary,
CAST(CASE WHEN pk % 3 = 0 THEN pk % 10 END AS DOUBLE) AS score, CASE WHEN pk % 3 = 1 AND severity <> 'unknown' THEN severity ELSE '' END AS severity_label, CAST(1704067200 AS BIGINT) AS published, CAST(0 AS BIGINT) AS modified,
CASE WHEN pk % 11 = 0 THEN 'missing package or osv_id' WHEN pk % 11 = 2 THEN 'no version' WHEN pk % 11 = 1 THEN 'unkeyable name' END AS skipped FROM affects"""
_FIND_COLS = ["package", "version", "osv_id", "aliases", "summary", "score", "severity_label", "published", "modified", "skipped"]


@query("src_osv_csv", _FIND_SQL.replace("CASE WHEN pk % 11 = 0 THEN '' WHEN pk % 11 = 1 THEN NULL ELSE name END AS package", "CASE WHEN pk % 11 IN (0, 1) THEN NULL ELSE name END AS package"))
def _(fleet):
    path = fleet.scratch.path("findings-csv")
    K.write_csv(K.findings_csv(raw_findings(fleet)), path)
    typed = D.findings(D.read_findings_csv(fleet.spark, path)).withColumn("aliases", F.array_join("aliases", ";"))
    return typed.select(*_FIND_COLS)


def osv_texts(fleet):
    text = F.expr(
        "'{\"id\":\"' || advisory_id || '\",\"aliases\":[\"GHSA-' || (pk % 50) || '\"],\"summary\":\"s\",\"details\":\"two\\\\nlines\",\"published\":\"p\",\"severity\":[{\"type\":\"V3\",\"score\":\"CVSS:' || pk || '\"}],\"database_specific\":{\"severity\":\"' || severity || '\"},"
        "\"references\":[{\"type\":\"WEB\",\"url\":\"w\"},{\"type\":\"ADVISORY\",\"url\":\"a' || pk || '\"}],\"affected\":[{\"ranges\":[{\"events\":[{\"introduced\":\"5.0.0\"},{\"fixed\":\"6.0.0\"}]}]},{\"ranges\":[{\"events\":[{\"introduced\":\"0\"},{\"fixed\":\"' || fixed_version || '\"}]}]}]}'"
    )
    held = fleet.package_version.select("pk", "version")
    return fleet.advisory.withColumn("text", text).join(held, "pk").withColumn("eco", F.lit("npm"))


_OSV_SQL = """SELECT a.name AS package, v.version, a.advisory_id AS osv_id, 'GHSA-' || (a.pk % 50) AS aliases, 'CVSS:' || a.pk AS cvss_vector, a.severity AS severity_score,
CASE WHEN v.major = 5 THEN '6.0.0' WHEN v.major < a.n THEN a.fixed_version ELSE '6.0.0; ' || a.fixed_version END AS fixed_version, CASE WHEN v.major = 5 THEN '5.0.0' WHEN v.major < a.n THEN '0' ELSE '5.0.0; 0' END AS introduced_version,
'two lines' AS details, 'a' || a.pk AS "references", SRC AS source_file FROM advisory a JOIN package_version v USING (pk)"""
_OSV_COLS = ["package", "version", "osv_id", "aliases", "cvss_vector", "severity_score", "fixed_version", "introduced_version", "details", "references", "source_file"]


@query("src_osv_json", _OSV_SQL.replace("SRC", "''"))
def _(fleet):
    return D.osv_records(osv_texts(fleet), "text", "eco", "name", "version").select(*_OSV_COLS)


@query("src_osv_scan_report", _OSV_SQL.replace("SRC", "'package-lock.json'"))
def _(fleet):
    report = F.concat(
        F.lit('{"results":[{"source":{"path":"package-lock.json"},"packages":[{"package":{"name":"'), "name", F.lit('","version":"'), "version",
        F.lit('","ecosystem":"npm"},"vulnerabilities":['), "text", F.lit("]}]}]}"),
    )
    return D.scan_reports(osv_texts(fleet).select(report.alias("report")), "report").select(*_OSV_COLS)


RAW_CONTRACT = (
    "'{\"advisory_id\":\"' || advisory_id || '\",\"package\":\"' || name || '\",\"affected_range\":\"' || affected_range || '\"' || CASE WHEN pk % 2 = 0 THEN ',\"affected_versions\":[\"1.0.0\",\"1.0.1\"],\"published_at\":' || published || "
    "',\"severity\":\"' || severity || '\",\"iocs\":{\"paths\":[\".claude/*\"],\"content_markers\":[\"m\"]}' ELSE ',\"withdrawn_at\":0' END || '}'"
)


@query("src_advisory_json", """SELECT advisory_id, name AS package, 'npm' AS ecosystem, CASE WHEN pk % 2 = 0 THEN '1.0.0|1.0.1' ELSE '' END AS affected_versions, affected_range, CASE WHEN pk % 2 = 0 THEN published ELSE 0 END AS published_at,
4102444800 AS withdrawn_at, CASE WHEN pk % 2 = 0 THEN severity ELSE 'unknown' END AS severity, CASE WHEN pk % 2 = 0 THEN '.claude/*' ELSE '' END AS ioc_paths FROM advisory""")
def _(fleet):
    docs = D.advisory_documents(fleet.advisory.selectExpr(f"{RAW_CONTRACT} AS text"), "text")
    return docs.drop("content_markers").withColumn("affected_versions", F.array_join("affected_versions", "|")).withColumn("ioc_paths", F.array_join("ioc_paths", "|"))


# -- code and files ------------------------------------------------------------------------------


def code_texts(fleet):
    text = F.expr(
        "'{\"service\":\"s' || fn || '\",\"files\":[{\"key\":\"f\",\"path\":\"' || file || '\",\"lang\":\"ts\"}],\"functions\":[{\"key\":\"a\",\"name\":\"a' || fn || '\",\"file\":\"f\",\"line\":' || line || ',\"exported\":true},{\"key\":\"b\",\"name\":\"b\",\"file\":\"f\",\"line\":2,\"exported\":false}],"
        "\"calls\":[[\"a\",\"b\"],[\"a\",\"zzz\"]],\"externalImports\":[{\"key\":\"i\",\"specifier\":\"lodash\",\"file\":\"f\",\"names\":[\"x\"]}],\"callsExternal\":[[\"b\",\"i\"],[\"zzz\",\"i\"]],\"routes\":[{\"key\":\"r\",\"method\":\"GET\",\"pattern\":\"/' || fn || '\",\"file\":\"f\",\"line\":3,\"handler\":\"a\"}]}'"
    )
    return fleet.function.select(text.alias("text"))


@query("src_code_facts", """SELECT 'file' AS kind, 's' || fn AS service, 'f' AS a, file AS b FROM function UNION ALL SELECT 'function', 's' || fn, 'a', 'a' || fn FROM function UNION ALL SELECT 'function', 's' || fn, 'b', 'b' FROM function
UNION ALL SELECT 'calls', 's' || fn, 'a', 'b' FROM function UNION ALL SELECT 'external_import', 's' || fn, 'i', 'lodash' FROM function UNION ALL SELECT 'calls_external', 's' || fn, 'b', 'i' FROM function UNION ALL SELECT 'route', 's' || fn, 'a', '/' || fn FROM function""")
def _(fleet):
    t = D.code_facts(code_texts(fleet), "text")
    pick = {"file": ("key", "path"), "function": ("key", "name"), "calls": ("src", "dst"), "external_import": ("key", "specifier"), "calls_external": ("src", "dst"), "route": ("handler", "pattern")}
    out = None
    for kind, (a, b) in pick.items():
        part = t[kind].select(F.lit(kind).alias("kind"), "service", F.col(a).alias("a"), F.col(b).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_repo_files", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM documents", domain=False)
def _(fleet):
    files = D.repo_files(fleet.table("documents").select("doc_id", F.col("text").cast("binary").alias("content")))
    return files.select("doc_id", F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


# -- sinks --------------------------------------------------------------------------------------------


def _staged(fleet):
    v = fleet.package_version
    cols = ["pv", "published_at", "deprecated", "licence", "ord"]
    old = v.withColumn("licence", F.when(F.col("pk") % 2 == 0, "MIT").otherwise("")).withColumn("ord", F.lit(0)).select(*cols)
    new = v.filter("pk % 3 = 0").select(
        "pv", F.when(F.col("pk") % 2 == 0, 0).otherwise(77).cast("bigint").alias("published_at"), F.lit(False).alias("deprecated"),
        F.when(F.col("pk") % 5 == 0, "").otherwise("ISC").alias("licence"), F.lit(1).alias("ord"),
    )
    return old, new


@query("sink_graph", """SELECT pv, CASE WHEN pk % 3 = 0 AND pk % 2 <> 0 THEN 77 ELSE published_at END AS published_at, deprecated, CASE WHEN pk % 3 = 0 AND pk % 5 <> 0 THEN 'ISC' WHEN pk % 2 = 0 THEN 'MIT' ELSE '' END AS licence FROM package_version""")
def _(fleet):
    old, new = _staged(fleet)
    path = fleet.scratch.path("nodes")
    merged = K.merge_nodes(old, new, "pv", "ord")
    K.write_table(merged, path)
    return fleet.spark.read.schema(merged.schema).parquet(path)


@query("sink_graph_code_tier", """SELECT pv, CASE WHEN pk % 3 = 0 THEN CASE WHEN pk % 2 = 0 THEN 0 ELSE 77 END ELSE published_at END AS published_at, CASE WHEN pk % 3 = 0 THEN false ELSE deprecated END AS deprecated,
CASE WHEN pk % 3 = 0 THEN CASE WHEN pk % 5 = 0 THEN '' ELSE 'ISC' END WHEN pk % 2 = 0 THEN 'MIT' ELSE '' END AS licence FROM package_version""")
def _(fleet):
    old, new = _staged(fleet)
    path = fleet.scratch.path("code-nodes")
    merged = K.replace_nodes(old, new, "pv", "ord")
    K.write_table(merged, path)
    return fleet.spark.read.schema(merged.schema).parquet(path)


@query("sink_graph_edges", "SELECT src, dst, CASE WHEN length(src) % 2 = 0 THEN 'new' ELSE 'old' END AS tag FROM depends_on")
def _(fleet):
    old = fleet.depends_on.select("src", "dst", F.lit("old").alias("tag"), F.lit(0).alias("ord"))
    new = fleet.depends_on.filter("length(src) % 2 = 0").select("src", "dst", F.lit("new").alias("tag"), F.lit(1).alias("ord"))
    path = fleet.scratch.path("edges")
    merged = K.merge_edges(old, new, "ord")
    K.write_table(merged, path)
    return fleet.spark.read.schema(merged.schema).parquet(path)


@query("sink_advisory_json", """SELECT advisory_id, name AS package, string_agg(version, '|' ORDER BY version) AS affected_versions, any_value(fixed_version) AS fixed_versions, 'GHSA-' || (pk % 50) || '|OSV-' || pk AS aliases,
'https://x/' || pk || '|https://y' AS "references" FROM affects WHERE pk % 11 > 2 GROUP BY advisory_id, name, pk""")
def _(fleet):
    docs = K.advisory_documents(D.findings(raw_findings(fleet)).filter("skipped IS NULL"), "npm")
    path = fleet.scratch.path("advisory-json")
    docs.write.json(path)
    back = fleet.spark.read.schema(docs.schema).json(path)
    return back.select("advisory_id", "package", *[F.array_join(c, "|").alias(c) for c in ("affected_versions", "fixed_versions", "aliases", "references")])


@query("sink_findings_csv", """SELECT name AS package, version, 'npm' AS ecosystem, advisory_id AS osv_id, severity AS severity_score, fixed_version, '' AS cvss_vector, '' AS "references" FROM affects""")
def _(fleet):
    path = fleet.scratch.path("csv")
    rows = fleet.affects.select(F.col("name").alias("package"), "version", F.lit("npm").alias("ecosystem"), F.col("advisory_id").alias("osv_id"), F.col("severity").alias("severity_score"), "fixed_version")
    K.write_csv(K.findings_csv(rows), path)
    return D.read_findings_csv(fleet.spark, path).fillna("").select("package", "version", "ecosystem", "osv_id", "severity_score", "fixed_version", "cvss_vector", "references")


@query("sink_exposure_csv", """, p AS (SELECT pv, pv AS node, [pv] AS path, 0 AS depth FROM (SELECT DISTINCT pv FROM affects) UNION ALL SELECT p.pv, d.src, list_append(p.path, d.src), p.depth + 1 FROM p JOIN depends_on d ON d.dst = p.node WHERE p.depth < 8)
SELECT pv AS vulnerable, node AS exposed, CAST(min(depth) AS VARCHAR) AS depth, array_to_string(arg_min(path, (depth, list_reverse(path))), ' -> ') AS path FROM p GROUP BY pv, node HAVING min(depth) > 0""")
def _(fleet):
    path = fleet.scratch.path("exposure")
    rows = K.exposure_csv(R.exposure_paths(fleet.affects.select("pv").distinct(), fleet.depends_on, fleet.scratch))
    K.write_csv(rows, path)
    return fleet.spark.read.schema(rows.schema).csv(path, header=True, escape='"')


@query("sink_edges_csv", "SELECT src AS parent, dst AS child FROM depends_on")
def _(fleet):
    path = fleet.scratch.path("dependencies")
    rows = K.edges_csv(fleet.depends_on)
    K.write_csv(rows, path)
    return fleet.spark.read.schema(rows.schema).csv(path, header=True, escape='"')


# -- the live feed -----------------------------------------------------------------------------------------

_NOW = 1706745600  # 2024-02-01
_FRESH = 5 * 86400


def _feed_folder(fleet):
    """The feed as files: every change twice, as feeds repeat documents."""
    if not hasattr(fleet, "_feed"):
        path = fleet.scratch.path("feed")
        fleet.publish_event.unionByName(fleet.publish_event).write.parquet(path)
        fleet._feed = path
    return fleet.spark.readStream.schema(fleet.publish_event.schema).parquet(fleet._feed)


@query("src_change_feed", "SELECT package, event_id AS seq FROM publish_event")
def _(fleet):
    path = fleet.scratch.path("pages")
    page = F.concat(F.lit('{"results":[{"id":"'), F.upper("package"), F.lit('","seq":'), F.col("event_id").cast("string"), F.lit('},{"id":"_design/x","seq":0}],"last_seq":'), F.col("event_id").cast("string"), F.lit("}"))
    fleet.publish_event.select(page.alias("value")).write.text(path)
    stream = D.change_pages(D.read_change_feed(fleet.spark, path), "value")
    return L.run_available(stream, fleet.scratch.path("changes"), "changes")


@query("st_publish_events", f"SELECT DISTINCT package, version, publisher, published_at FROM publish_event WHERE published_at >= {_NOW - _FRESH}")
def _(fleet):
    stream = L.publish_events(_feed_folder(fleet), _NOW, _FRESH).select("package", "version", "publisher", "published_at")
    return L.run_available(stream, fleet.scratch.path("publishes"), "publishes")


def _alerts(fleet):
    """Change documents to graded alerts, through one streaming query."""
    if not hasattr(fleet, "_alert_table"):
        path = fleet.scratch.path("documents")
        fleet.package.selectExpr(f"{RAW_DOC} AS value").write.text(path)
        docs = D.packuments(fleet.spark.readStream.text(path), "value")
        events = L.newest_in_document(docs)
        listed = fleet.package.select(F.col("name").alias("package"), F.lit("u3").alias("username")).filter("package LIKE '%1%'")
        graded = L.fleet_join(L.version_signals(events, listed), fleet.package.filter("pk % 4 = 0")).drop("previous")
        graded = graded.withColumn("kind", L.alert_kind()).withColumn("seen_at", F.col("published_at"))
        fleet._alert_table = L.run_available(graded, fleet.scratch.path("alerts"), "alerts")
    return fleet._alert_table


_ALERT_SQL = """, ev AS (SELECT pk, name AS package, '2.0.0' AS version, 1704153600 + pk % 10 AS published_at, 'u' || (pk % 7) AS publisher, pk % 3 = 0 AS script, contains(name, '1') AND pk % 7 <> 3 AS outsider, pk % 4 = 0 AS in_fleet FROM package),
al AS (SELECT *, array_to_string(list_filter([CASE WHEN script THEN 'INSTALL_SCRIPT_ADDED' END, 'REPOSITORY_CHANGED', CASE WHEN outsider THEN 'PUBLISHER_NOT_MAINTAINER' END], lambda x: x IS NOT NULL), '|') AS signals FROM ev) """


@query("st_version_signals", _ALERT_SQL + "SELECT package, version, publisher, published_at, signals FROM al")
def _(fleet):
    return _alerts(fleet).select("package", "version", "publisher", "published_at", F.array_join("signals", "|").alias("signals"))


@query("st_fleet_join", f"SELECT DISTINCT event_id, package, event_id % 50 < 10 AS in_fleet FROM publish_event WHERE published_at >= {_NOW - _FRESH}")
def _(fleet):
    held = fleet.publish_event.filter("event_id % 50 < 10").select(F.col("package").alias("name"))
    stream = L.fleet_join(L.publish_events(_feed_folder(fleet), _NOW, _FRESH), held).select("event_id", "package", "in_fleet")
    return L.run_available(stream, fleet.scratch.path("joined"), "joined")


@query("st_alert_grade", _ALERT_SQL + "SELECT package, in_fleet, CASE WHEN in_fleet THEN 'fleet' ELSE 'anomaly' END AS kind FROM al")
def _(fleet):
    return _alerts(fleet).select("package", "in_fleet", "kind")


@query("st_enrich", _ALERT_SQL + """SELECT package, (SELECT count(DISTINCT service) FROM resolved_in r JOIN package_version v USING (pv) WHERE v.name = package) AS n_services, coalesce((SELECT sum(n) FROM (SELECT DISTINCT maintainer FROM maintained_by m WHERE m.name = package) JOIN
(SELECT maintainer, count(DISTINCT name) - 1 AS n FROM maintained_by GROUP BY maintainer) USING (maintainer)), 0)::BIGINT AS n_frontier FROM al WHERE in_fleet""")
def _(fleet):
    resolved = fleet.holders.join(fleet.package_version.select("pv", F.col("name").alias("package")), "pv")
    sizes = fleet.maintained_by.groupBy("maintainer").agg((F.count_distinct("name") - 1).alias("n"))
    near = fleet.maintained_by.select(F.col("name").alias("package"), "maintainer").distinct().join(sizes, "maintainer").groupBy("package").agg(F.sum("n").alias("n_frontier"))
    alerts, out = _alerts(fleet), fleet.scratch.path("enriched")
    path = fleet.scratch.path("hits")
    alerts.write.parquet(path)
    stream = fleet.spark.readStream.schema(alerts.schema).parquet(path)
    once = L.enrich_each(stream, resolved, near, out)
    stream.writeStream.foreachBatch(once).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return L.enriched(fleet.spark, out, "package string, n_services long, n_frontier long")[0]


def _bursts(fleet):
    if hasattr(fleet, "_bursts"):
        return fleet._bursts
    beat_schema = "publisher STRING, package STRING, repository STRING, published_at BIGINT"
    path = fleet.scratch.path("timed")
    fleet.publish_event.select("publisher", "package", "repository", "published_at").write.parquet(path)
    # a heartbeat a week later closes the last windows
    beat = fleet.publish_event.agg((F.max("published_at") + 7 * 86400).alias("published_at")).select(F.lit("").alias("publisher"), F.lit("").alias("package"), F.lit(None).cast("string").alias("repository"), "published_at")
    beat.write.mode("append").parquet(path)
    stream = fleet.spark.readStream.schema(beat_schema).parquet(path)
    panes = L.run_available(L.burst_panes(stream, "1 hour", late="12 hours"), fleet.scratch.path("panes"), "panes")
    fleet._bursts = fleet.scratch.save(L.bursts_of_panes(panes, 12 * 3600, 3600), "bursts")
    return fleet._bursts


_BURST_SQL = """, g AS (SELECT e.publisher AS identity, e.package, e.event_id, e.published_at, e.repository, (published_at // 3600 - unnest(range(0, 12))) * 3600 AS s FROM publish_event e),
w AS (SELECT identity, s AS started_at, s + 43200 AS ended_at, count(DISTINCT package) AS n_packages, count(*) AS n_artifacts, min(published_at) AS first_at, max(published_at) AS last_at, max(published_at) - min(published_at) AS span_seconds,
CASE WHEN count(DISTINCT repository) = 1 OR (count(DISTINCT CASE WHEN package LIKE '@%' THEN split_part(package, '/', 1) ELSE '' END) = 1 AND max(package) LIKE '@%') THEN 'release' ELSE 'spread' END AS verdict
FROM g GROUP BY identity, s HAVING count(DISTINCT package) >= 3) """


@query("st_correlated_burst", _BURST_SQL + "SELECT * FROM w")
def _(fleet):
    return _bursts(fleet)


@query("st_best_burst", _BURST_SQL + "SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY identity ORDER BY n_packages DESC, n_artifacts DESC, span_seconds, started_at) = 1")
def _(fleet):
    return L.best_bursts(_bursts(fleet))


@query("st_recent_alerts", _ALERT_SQL + "SELECT package, version, published_at AS seen_at FROM al WHERE in_fleet ORDER BY seen_at DESC, package, version LIMIT 500")
def _(fleet):
    return L.recent_alerts(_alerts(fleet), "fleet").select("package", "version", "seen_at")


@query("st_counters", _ALERT_SQL + f"""SELECT (SELECT 2 * count(*) FROM publish_event) AS changes, (SELECT count(*) FROM publish_event WHERE published_at >= {_NOW - _FRESH}) AS publishes, count(*) FILTER (signals <> '') AS alerts, count(*) FILTER (in_fleet) AS fleet_hits,
(SELECT 2 * count(*) FROM publish_event) - (SELECT count(*) FROM publish_event WHERE published_at >= {_NOW - _FRESH}) AS skipped FROM al""")
def _(fleet):
    """Read from the progress of two running queries: the publishes and the alerts."""
    seen = L.FeedCounters()
    changes = L.counted(_feed_folder(fleet), "changes", changes=F.count(F.lit(1)))
    fresh = L.counted(L.publish_events(changes, _NOW, _FRESH), "publishes", publishes=F.count(F.lit(1)))
    L.run_available(fresh.select("package", "version"), fleet.scratch.path("counted"), "publishes", counters=seen)
    alerts = _alerts(fleet)
    path = fleet.scratch.path("told")
    alerts.write.parquet(path)
    told = L.alert_counters(fleet.spark.readStream.schema(alerts.schema).parquet(path))
    L.run_available(told.select("package"), fleet.scratch.path("counted"), "alerts", counters=seen)
    seen.totals["skipped"] = seen.totals["changes"] - seen.totals["publishes"]
    return seen.frame(fleet.spark, ["changes", "publishes", "alerts", "fleet_hits", "skipped"])
