"""Scalar functions and version rules over the driver's tables.

Raw spellings are derived from table columns by expressions that both engines
read the same way; what each function makes of them is checked by other SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from supplygraph.functions import names as N
from supplygraph.functions import similarity as Y
from supplygraph.functions import versions as V
from supplygraph.operators import build as B
from supplygraph.operators import views as W
from supplygraph.plans.registry import query

RAW_NAME = (
    "CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN '@' || p_type || '/' || replace(p_name, ' ', '-') "
    "WHEN 2 THEN '  ' || replace(p_name, ' ', '.') || ' ' WHEN 3 THEN '_' || replace(p_name, ' ', '-') "
    "WHEN 4 THEN replace(p_name, ' ', '/') WHEN 5 THEN 'a/b/' || p_brand ELSE replace(p_name, ' ', '_') || '-' || p_partkey END"
)
_NPM_SQL = """CASE WHEN lower(trim(raw)) = '' OR length(trim(raw)) > 214 OR regexp_replace(lower(trim(raw)), '^@[^/]+/', '') = ''
  OR contains(regexp_replace(lower(trim(raw)), '^@[^/]+/', ''), '/') OR regexp_matches(regexp_replace(lower(trim(raw)), '^@[^/]+/', ''), '^[._]')
  OR regexp_matches(lower(trim(raw)), '[^a-z0-9._~@/-]') THEN NULL ELSE lower(trim(raw)) END"""
_NAMES_SQL = f"WITH t AS (SELECT p_partkey, {RAW_NAME} AS raw FROM part), c AS (SELECT p_partkey, raw, {_NPM_SQL} AS name FROM t) "


def raw_names(fleet):
    return fleet.table("part").selectExpr("p_partkey", f"{RAW_NAME} AS raw")


@query("fn_npm_name", _NAMES_SQL + "SELECT p_partkey, raw, name FROM c", domain=False)
def _(fleet):
    return raw_names(fleet).select("p_partkey", "raw", N.npm_name("raw").alias("name"))


@query("fn_pypi_name", f"""WITH t AS (SELECT p_partkey, {RAW_NAME} AS raw FROM part),
u AS (SELECT *, regexp_replace(lower(trim(raw)), '[-_.]+', '-', 'g') AS n FROM t)
SELECT p_partkey, CASE WHEN n <> '' AND n NOT LIKE '-%' AND n NOT LIKE '%-' THEN n END AS name FROM u""", domain=False)
def _(fleet):
    return raw_names(fleet).select("p_partkey", N.pypi_name("raw").alias("name"))


@query("fn_split_scope", _NAMES_SQL + """SELECT p_partkey, CASE WHEN name LIKE '@%/%' THEN split_part(name, '/', 1) END AS scope,
CASE WHEN name LIKE '@%/%' THEN split_part(name, '/', 2) ELSE name END AS bare FROM c""", domain=False)
def _(fleet):
    c = raw_names(fleet).withColumn("name", N.npm_name("raw"))
    return c.select("p_partkey", N.scope_of("name").alias("scope"), N.bare_of("name").alias("bare"))


@query("fn_purl", _NAMES_SQL + """SELECT p_partkey, 'pkg:npm/' || replace(name, '@', '%40') AS package_purl,
'pkg:npm/' || replace(name, '@', '%40') || '@' || p_partkey || '.0' AS version_purl FROM c""", domain=False)
def _(fleet):
    version = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".0 "))
    return raw_names(fleet).select("p_partkey", N.package_purl("raw").alias("package_purl"), N.version_purl("raw", version).alias("version_purl"))


RAW_PURL = (
    "CASE p_partkey % 5 WHEN 0 THEN 'pkg:npm/%40' || lower(p_type) || '/x' || p_partkey || '@1.' || p_partkey "
    "WHEN 1 THEN 'pkg:npm/%40' || lower(p_type) || '/x' WHEN 2 THEN 'pkg:pypi/y' || p_partkey || '@2' "
    "WHEN 3 THEN 'npm/z@1' ELSE 'pkg:npm/w' || p_partkey || '@' END"
)


@query("fn_parse_purl", f"""WITH t AS (SELECT p_partkey, {RAW_PURL} AS raw FROM part) SELECT p_partkey,
CASE p_partkey % 5 WHEN 2 THEN 'pypi' WHEN 3 THEN NULL ELSE 'npm' END AS ecosystem,
CASE p_partkey % 5 WHEN 0 THEN replace(split_part(substr(raw, 9), '@', 1), '%40', '@') WHEN 1 THEN replace(substr(raw, 9), '%40', '@')
  WHEN 2 THEN 'y' || p_partkey WHEN 4 THEN 'w' || p_partkey END AS name,
CASE p_partkey % 5 WHEN 0 THEN '1.' || p_partkey WHEN 2 THEN '2' END AS version FROM t""", domain=False)
def _(fleet):
    p = fleet.table("part").selectExpr("p_partkey", f"{RAW_PURL} AS raw").withColumn("p", N.parse_purl("raw"))
    return p.select("p_partkey", "p.ecosystem", "p.name", "p.version")


@query("fn_entity_keys", """SELECT c_custkey, 'svc:' || lower(c_mktsegment) AS service_key,
CASE c_custkey % 3 WHEN 0 THEN 'npm-user:' || lower(c_name) WHEN 1 THEN 'email:' || c_custkey || '@x.io' END AS account_key,
'org:' || lower(c_mktsegment) AS organization_key FROM customer""", domain=False)
def _(fleet):
    user = F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE ' ' END")
    mail = F.expr("CASE WHEN c_custkey % 3 = 1 THEN c_custkey || '@X.io' ELSE 'nobody' END")
    return fleet.table("customer").select(
        "c_custkey", N.service_key("c_mktsegment").alias("service_key"), N.account_key(user, mail).alias("account_key"),
        N.organization_key(F.concat(F.lit("@"), F.col("c_mktsegment"))).alias("organization_key"),
    )


RAW_REPO = (
    "CASE p_partkey % 7 WHEN 0 THEN 'github:' || p_type || '/R' || p_partkey WHEN 1 THEN 'git+https://github.com/' || p_type || '/r' || p_partkey || '.git' "
    "WHEN 2 THEN 'ssh://git@github.com/' || p_type || '/r' || p_partkey WHEN 3 THEN 'git@github.com:' || p_type || '/r' || p_partkey || '.git#main' "
    "WHEN 4 THEN 'https://gitlab.com/' || p_type || '/r' || p_partkey || '/sub/' WHEN 5 THEN 'nowhere' ELSE p_type || '/r' || p_partkey END"
)


@query("fn_repo_url", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 5 THEN NULL ELSE 'repo:' || CASE WHEN p_partkey % 7 = 4 THEN 'gitlab.com' ELSE 'github.com' END
|| '/' || lower(p_type) || '/r' || p_partkey END AS repo FROM part""", domain=False)
def _(fleet):
    return fleet.table("part").selectExpr("p_partkey", f"{RAW_REPO} AS raw").select("p_partkey", N.repository_key("raw").alias("repo"))


@query("fn_service_identity", "SELECT pv, publisher = 'github actions' AS automation FROM published_by")
def _(fleet):
    return fleet.published_by.select("pv", N.is_service_identity(F.upper("publisher"), F.lit("a@b.c")).alias("automation"))


RAW_TIME = (
    "CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T03:04:05Z' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) "
    "|| 'T03:04:05.123456789+02:00' WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE 'soon' END"
)


@query("fn_iso_ts", """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate) + 11045 WHEN 1 THEN epoch(o_orderdate) + 11045 - 7200
WHEN 2 THEN epoch(o_orderdate) ELSE 0 END AS BIGINT) AS seconds FROM orders""", domain=False)
def _(fleet):
    return fleet.table("orders").selectExpr("o_orderkey", f"{RAW_TIME} AS raw").select("o_orderkey", N.epoch_seconds("raw").alias("seconds"))


@query("fn_severity", """, s AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN ' Critical' WHEN 'SMALL' THEN 'HIGH' WHEN 'STANDARD' THEN 'medium' WHEN 'LARGE' THEN 'low' ELSE '' END AS raw FROM part)
SELECT p_partkey, CASE WHEN trim(raw) = '' THEN 'unknown' ELSE lower(trim(raw)) END AS word,
CAST(CASE lower(trim(raw)) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS INT) AS rank,
CAST(CASE lower(trim(raw)) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.65 WHEN 'low' THEN 0.45 ELSE 0.55 END AS DOUBLE) AS base FROM s""")
def _(fleet):
    raw = F.expr("CASE p_type WHEN 'ECONOMY' THEN ' Critical' WHEN 'SMALL' THEN 'HIGH' WHEN 'STANDARD' THEN 'medium' WHEN 'LARGE' THEN 'low' ELSE '' END")
    return fleet.table("part").select("p_partkey", N.severity_word(raw).alias("word"), N.severity_rank(raw).alias("rank"), N.severity_base(raw).alias("base"))


@query("fn_alias_split", "SELECT advisory_id, advisory_id || ';' || alias || ';OSV-' || substr(alias, 6) AS ids FROM advisory_alias")
def _(fleet):
    raw = F.concat(F.col("advisory_id"), F.lit(" | "), F.col("alias"), F.lit(" ,, OSV-"), F.substr("alias", F.lit(6)), F.lit(" |"))
    return fleet.advisory_alias.select("advisory_id", F.array_join(N.split_aliases(raw), ";").alias("ids"))


@query("fn_split_spec", """SELECT pv, '@s/' || name AS name, version FROM package_version UNION ALL SELECT pv, '@' || name, '' FROM package_version""")
def _(fleet):
    v = fleet.package_version
    specs = v.select("pv", F.concat(F.lit(" @s/"), "name", F.lit("@"), "version").alias("s")).unionByName(v.select("pv", F.concat(F.lit("@"), "name").alias("s")))
    return specs.withColumn("p", N.split_spec("s")).select("pv", "p.name", "p.version")


@query("fn_entry_name", "SELECT lock_id, pv, CASE WHEN line % 2 = 0 THEN name ELSE '@s/' || name END AS name FROM entry")
def _(fleet):
    path = F.concat(F.lit("node_modules/a/node_modules/"), F.when(F.col("line") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("@s/"), "name")))
    return fleet.entry.select("lock_id", "pv", N.entry_name(path).alias("name"))


@query("fn_specifier_package", "SELECT service, specifier, CASE WHEN pk % 40 = 0 THEN '@s/' || specifier ELSE specifier END AS package FROM external_import")
def _(fleet):
    raw = F.when(F.col("pk") % 40 == 0, F.concat(F.lit("@s/"), "specifier", F.lit("/lib/x"))).otherwise(F.concat("specifier", F.lit("/lib")))
    return fleet.external_import.select("service", "specifier", N.specifier_package(raw).alias("package"))


RAW_LICENCE = (
    "CASE p_partkey % 5 WHEN 0 THEN '\"' || p_type || '\"' WHEN 1 THEN '{\"type\":\"' || p_type || '\"}' WHEN 2 THEN '[{\"type\":\"' || p_type || '\"}]' "
    "WHEN 3 THEN '[\"' || p_type || '\",\"X\"]' ELSE '{}' END"
)


@query("fn_licence", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE p_type END AS licence FROM part", domain=False)
def _(fleet):
    return fleet.table("part").selectExpr("p_partkey", f"{RAW_LICENCE} AS raw").select("p_partkey", N.licence("raw").alias("licence"))


@query("fn_resolution_kind", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'locked' WHEN 1 THEN 'pinned' ELSE 'resolved' END AS kind FROM part""", domain=False)
def _(fleet):
    manifest = F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'a/poetry.lock' ELSE 'a/requirements.txt' END")
    spec = F.expr("CASE p_partkey % 4 WHEN 1 THEN '==1.0' WHEN 2 THEN '==1.*' ELSE '>=1' END")
    return fleet.table("part").select("p_partkey", N.resolution_kind(manifest, spec).alias("kind"))


SKELETON_SQL = "regexp_replace(regexp_replace(lower(name), '^@[^/]+/', ''), '[-._]', '', 'g')"
for _a, _b in Y.CONFUSABLES:
    SKELETON_SQL = f"replace({SKELETON_SQL}, '{_a}', '{_b}')"


@query("fn_skeleton", f"SELECT pk, name, {SKELETON_SQL} AS skeleton FROM package")
def _(fleet):
    return fleet.package.select("pk", "name", Y.skeleton("name").alias("skeleton"))


RAW_TWIN = (
    "CASE pk % 6 WHEN 0 THEN name WHEN 1 THEN substr(name, 2, 1) || substr(name, 1, 1) || substr(name, 3) WHEN 2 THEN substr(name, 1, length(name) - 1) "
    "WHEN 3 THEN name || 'xy' WHEN 4 THEN name || 'xyz' ELSE 'q' || substr(name, 2) END"
)


@query("fn_osa_distance", """SELECT pk, CAST(CASE pk % 6 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN substr(name, 1, 1) = substr(name, 2, 1) THEN 0 ELSE 1 END
WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS INT) AS distance FROM package""")
def _(fleet):
    p = fleet.package.selectExpr("pk", "name", f"{RAW_TWIN} AS twin")
    return p.select("pk", Y.osa_distance("name", "twin").alias("distance"))


@query("fn_deletion_variants", """, n AS (SELECT pk, name AS s FROM package),
one AS (SELECT DISTINCT pk, s, substr(s, 1, i - 1) || substr(s, i + 1) AS v FROM (SELECT pk, s, unnest(range(1, length(s) + 1)) AS i FROM n)),
two AS (SELECT DISTINCT pk, s, substr(v, 1, i - 1) || substr(v, i + 1) AS v FROM (SELECT pk, s, v, unnest(range(1, length(v) + 1)) AS i FROM one)),
every AS (SELECT pk, s AS v FROM n UNION SELECT pk, v FROM one UNION SELECT pk, v FROM two)
SELECT pk, count(*) AS n_variants, min(v) AS first_variant, max(v) AS last_variant FROM every GROUP BY pk""")
def _(fleet):
    v = fleet.package.select("pk", Y.deletion_variants("name").alias("v"))
    return v.select("pk", F.size("v").cast("bigint").alias("n_variants"), F.array_min("v").alias("first_variant"), F.array_max("v").alias("last_variant"))


@query("fn_doubled_char", "SELECT pk, pk % 3 = 0 AS doubled FROM package")
def _(fleet):
    twin = F.expr("CASE pk % 3 WHEN 0 THEN substr(name, 1, 3) || substr(name, 3) WHEN 1 THEN name || '!' ELSE name END")
    return fleet.package.select("pk", Y.has_doubled_char(twin, "name").alias("doubled"))


@query("fn_fmt_ts", """SELECT pv, CASE pk % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'still live' ELSE strftime(make_timestamp(published_at * 1000000), '%Y-%m-%d') END AS word FROM package_version""")
def _(fleet):
    ts = F.expr("CASE pk % 3 WHEN 0 THEN 0 WHEN 1 THEN 4102444800 ELSE published_at END")
    return fleet.package_version.select("pv", N.date_word(ts).alias("word"))


@query("fn_glob_match", """SELECT path, service, path LIKE '.claude/%.js' AS m1, path LIKE '.vscode/_.js' AS m2, regexp_matches(path, '^\\.github/.*/[0-4].*\\.js$') AS m3 FROM artifact""")
def _(fleet):
    p = F.col("path")
    return fleet.artifact.select(
        "path", "service", N.glob_match(p, F.lit(".claude/*.js")).alias("m1"), N.glob_match(p, F.lit(".vscode/?.js")).alias("m2"),
        N.glob_match(p, F.lit(".github/*/[0-4]*.js")).alias("m3"),
    )


@query("fn_sentinel_fill", """SELECT pk, coalesce(downloads, -1) AS downloads, CASE WHEN pk % 2 = 0 THEN 1 ELSE 0 END AS even, 'a' || (pk % 3) || '|b|' || 'c' AS tags FROM package""")
def _(fleet):
    tags = F.array(F.lit("c"), F.concat(F.lit("a"), (F.col("pk") % 3).cast("string")), F.lit("b"))
    return fleet.package.select("pk", N.with_default("downloads", -1).alias("downloads"), N.flag(F.col("pk") % 2 == 0).alias("even"), N.flat_list(tags).alias("tags"))


# --------------------------------------------------------------------------
# versions. Texts are parsed once per distinct value.
# --------------------------------------------------------------------------

RAW_VERSION = (
    "CASE l_orderkey % 4 WHEN 3 THEN l_linenumber || '.' || (l_suppkey % 10) ELSE l_linenumber || '.' || (l_suppkey % 10) || '.' || (l_partkey % 5) || "
    "CASE l_orderkey % 4 WHEN 0 THEN '-alpha.' || (l_partkey % 12) WHEN 1 THEN '-rc+b5' ELSE '' END END"
)
RAW_RANGE = (
    "CASE l_partkey % 8 WHEN 0 THEN '^' || l_linenumber || '.2.0' WHEN 1 THEN '~' || l_linenumber || '.3' WHEN 2 THEN l_linenumber || '.x' "
    "WHEN 3 THEN '>=' || l_linenumber || '.0.0 <' || (l_linenumber + 2) WHEN 4 THEN l_linenumber || '.0.0 - ' || (l_linenumber + 1) || '.2' "
    "WHEN 5 THEN '*' WHEN 6 THEN '>' || l_linenumber || '.4 || 1.1.1' ELSE 'git+ssh://x' END"
)
_V_SQL = f"""WITH t AS (SELECT DISTINCT {RAW_VERSION} AS raw FROM lineitem),
g AS (SELECT raw, regexp_matches(raw, '^\\d+\\.\\d+\\.\\d+') AS ok, CAST(split_part(raw, '.', 1) AS BIGINT) AS major, CAST(split_part(raw, '.', 2) AS BIGINT) AS minor,
  TRY_CAST(regexp_extract(raw, '^\\d+\\.\\d+\\.(\\d+)', 1) AS BIGINT) AS patch, regexp_extract(raw, '-([^+]*)', 1) AS pre FROM t) """


def raw_versions(fleet):
    return fleet.table("lineitem").selectExpr(f"{RAW_VERSION} AS raw").distinct()


@query("ver_semver_parse", _V_SQL + """SELECT raw, CASE WHEN ok THEN major END AS major, CASE WHEN ok THEN minor END AS minor, CASE WHEN ok THEN patch END AS patch,
CASE WHEN ok THEN major || '.' || minor || '.' || patch || CASE WHEN pre = '' THEN '' ELSE '-' || pre END END AS canonical FROM g""", domain=False)
def _(fleet):
    v = raw_versions(fleet).withColumn("v", V.semver("raw"))
    number = lambda part: F.col(f"v.{part}").cast("bigint").alias(part)  # noqa: E731  the numbers of this table are small
    return v.select("raw", number("major"), number("minor"), number("patch"), V.semver_text(F.col("v")).alias("canonical"))


@query("ver_semver_order", _V_SQL + """, k AS (SELECT raw, major, minor, patch, CASE WHEN pre = '' THEN 1 ELSE 0 END AS rel, split_part(pre, '.', 1) AS word, coalesce(TRY_CAST(split_part(pre, '.', 2) AS INT), -1) AS num FROM g WHERE ok)
SELECT raw, CAST(row_number() OVER (PARTITION BY major, minor ORDER BY patch, rel, word, num, raw) AS BIGINT) AS place FROM k""", domain=False)
def _(fleet):
    from pyspark.sql import Window

    v = raw_versions(fleet).withColumn("v", V.semver("raw")).filter("v IS NOT NULL")
    return v.select("raw", F.row_number().over(Window.partitionBy("v.major", "v.minor").orderBy("v", "raw")).cast("bigint").alias("place"))


def comparator_text(sets):
    one = lambda c: F.concat(c["op"], F.coalesce(V.semver_text(c["ver"]), F.lit("")))
    return F.array_join(F.transform(sets, lambda g: F.array_join(F.transform(g, one), " ")), " || ")


@query("ver_range_expand", f"""WITH t AS (SELECT DISTINCT {RAW_RANGE} AS range, l_linenumber AS n, l_partkey % 8 AS k FROM lineitem)
SELECT DISTINCT range, CASE k WHEN 0 THEN '>=' || n || '.2.0 <' || (n + 1) || '.0.0-0' WHEN 1 THEN '>=' || n || '.3.0 <' || n || '.4.0-0'
WHEN 2 THEN '>=' || n || '.0.0 <' || (n + 1) || '.0.0-0' WHEN 3 THEN '>=' || n || '.0.0 <' || (n + 2) || '.0.0-0'
WHEN 4 THEN '>=' || n || '.0.0 <' || (n + 1) || '.3.0-0' WHEN 5 THEN '*' WHEN 6 THEN '>=' || n || '.5.0 || =1.1.1' END AS expanded FROM t""", domain=False)
def _(fleet):
    r = fleet.table("lineitem").selectExpr(f"{RAW_RANGE} AS range").distinct()
    return r.select("range", comparator_text(V.npm_range("range")).alias("expanded"))


_PAIR_SQL = f"""WITH t AS (SELECT DISTINCT {RAW_VERSION} AS raw, {RAW_RANGE} AS range, l_linenumber AS n, l_partkey % 8 AS k FROM lineitem),
g AS (SELECT *, regexp_matches(raw, '^\\d+\\.\\d+\\.\\d+') AS ok, CAST(split_part(raw, '.', 1) AS BIGINT) AS major, CAST(split_part(raw, '.', 2) AS BIGINT) AS minor,
  TRY_CAST(regexp_extract(raw, '^\\d+\\.\\d+\\.(\\d+)', 1) AS BIGINT) AS patch, contains(raw, '-') AS pre FROM t),
h AS (SELECT *, major * 10000 + minor * 100 + patch AS v FROM g),
w AS (SELECT *, CASE k WHEN 0 THEN n * 10000 + 200 WHEN 1 THEN n * 10000 + 300 WHEN 6 THEN n * 10000 + 500 WHEN 5 THEN 0 ELSE n * 10000 END AS lo,
  CASE k WHEN 0 THEN (n + 1) * 10000 WHEN 1 THEN n * 10000 + 400 WHEN 2 THEN (n + 1) * 10000 WHEN 3 THEN (n + 2) * 10000 WHEN 4 THEN (n + 1) * 10000 + 300 ELSE 99999999 END AS hi FROM h) """


@query("ver_range_satisfies", _PAIR_SQL + """SELECT DISTINCT raw, range, CASE WHEN NOT ok OR k = 7 THEN NULL WHEN pre THEN false
ELSE (v >= lo AND v < hi) OR (k = 6 AND v = 10101) END AS ok,
CASE WHEN NOT ok OR k = 7 THEN NULL WHEN pre AND k IN (1, 2, 4, 6) THEN (v >= lo AND v < hi) WHEN pre AND k IN (0, 3) THEN v > lo AND v < hi
WHEN pre THEN true ELSE (v >= lo AND v < hi) OR (k = 6 AND v = 10101) END AS ok_with_prerelease
FROM w""", domain=False)
def _(fleet):
    pairs = fleet.table("lineitem").selectExpr(f"{RAW_VERSION} AS raw", f"{RAW_RANGE} AS range").distinct()
    parsed = pairs.withColumn("v", V.semver("raw")).withColumn("s", V.npm_range("range"))
    return parsed.select("raw", "range", V.satisfies(F.col("v"), F.col("s")).alias("ok"), V.satisfies(F.col("v"), F.col("s"), True).alias("ok_with_prerelease"))


@query("ver_filter_satisfying", "SELECT pk, range, pv FROM admitted")
def _(fleet):
    ranges = fleet.requires.select(F.col("dst_pk").alias("pk"), "range")
    return B.range_join(ranges, fleet.package_version.select("pk", "pv", "version"), "pk").select("pk", "range", "pv")


@query("ver_max_satisfying", "SELECT pk, range, arg_max(version, (major, version)) AS best FROM admitted GROUP BY pk, range")
def _(fleet):
    ranges = fleet.requires.select(F.col("dst_pk").alias("pk"), "range")
    hits = B.range_join(ranges, fleet.package_version.select("pk", "pv", "version"), "pk")
    return hits.groupBy("pk", "range").agg(F.max_by("version", "ver").alias("best"))


@query("ver_newest_k", "SELECT name, version, row_number() OVER (PARTITION BY name ORDER BY major DESC, version DESC) AS rank FROM package_version QUALIFY rank <= 3")
def _(fleet):
    return B.newest_versions(fleet.package_version.select("name", "version")).select("name", "version", F.col("rank").cast("bigint").alias("rank"))


@query("ver_advisory_match", """SELECT a.advisory_id, v.version, CASE WHEN a.pk % 2 = 0 THEN v.version IN ('1.0.0', '2.0.1') ELSE v.major < a.n END AS affected
FROM advisory a JOIN package_version v USING (pk)""")
def _(fleet):
    a = fleet.advisory.withColumn(
        "listed", F.when(F.col("pk") % 2 == 0, F.array(F.lit("1.0.0"), F.lit("2.0.1"))).otherwise(F.array().cast("array<string>"))
    ).withColumn("sets", V.advisory_range("affected_range"))
    v = fleet.package_version.select("pk", "version", V.advisory_version("version").alias("ver"))
    hit = F.when(F.size("listed") > 0, F.array_contains("listed", F.col("version"))).otherwise(V.advisory_satisfies(F.col("ver"), F.col("sets")))
    return a.join(v, "pk").select("advisory_id", "version", hit.alias("affected"))


RAW_PEP = (
    "CASE l_orderkey % 6 WHEN 0 THEN l_linenumber || '.' || (l_suppkey % 10) WHEN 1 THEN l_linenumber || '.' || (l_suppkey % 10) || '.0' "
    "WHEN 2 THEN l_linenumber || '.' || (l_suppkey % 10) || 'RC' || (l_partkey % 3) WHEN 3 THEN 'v' || l_linenumber || '.' || (l_suppkey % 10) || '.post' || (l_partkey % 3) "
    "WHEN 4 THEN l_linenumber || '.' || (l_suppkey % 10) || '.dev' || (l_partkey % 3) ELSE 'release-' || l_linenumber END"
)
_PEP_SQL = f"""WITH t AS (SELECT DISTINCT {RAW_PEP} AS raw, l_linenumber AS major, l_suppkey % 10 AS minor, CASE WHEN l_orderkey % 6 IN (2, 3, 4) THEN l_partkey % 3 ELSE 0 END AS num, l_orderkey % 6 AS k FROM lineitem),
k AS (SELECT DISTINCT raw, major, minor, num, CASE k WHEN 4 THEN -1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS phase, k, CASE k WHEN 4 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS step FROM t WHERE k <> 5) """


def raw_pep(fleet):
    return fleet.table("lineitem").selectExpr(f"{RAW_PEP} AS raw").distinct()


@query("ver_pep440_parse", _PEP_SQL + """SELECT DISTINCT raw, CASE WHEN k <> 5 THEN CASE WHEN minor = 0 THEN CAST(major AS VARCHAR) ELSE major || '.' || minor END END AS release,
CAST(CASE k WHEN 4 THEN -1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 5 THEN NULL ELSE 3 END AS INT) AS phase, CASE WHEN k <> 5 THEN CAST(num AS BIGINT) END AS number, CASE WHEN k <> 5 THEN k IN (2, 4) END AS prerelease FROM t""", domain=False)
def _(fleet):
    v = raw_pep(fleet).withColumn("v", V.pep440("raw"))
    return v.select("raw", F.array_join("v.key.release", ".").alias("release"), "v.key.phase", F.col("v.key.number").cast("bigint").alias("number"), "v.prerelease")


OTHER_PEP = "l_linenumber || '.' || ((l_suppkey + l_partkey) % 10) || CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'rc1' ELSE '.post1' END"


@query("ver_pep440_compare", f"""WITH t AS (SELECT DISTINCT {RAW_PEP} AS a, {OTHER_PEP} AS b, l_suppkey % 10 AS x, (l_suppkey + l_partkey) % 10 AS y, l_orderkey % 6 AS k, l_partkey % 3 AS n FROM lineitem),
s AS (SELECT a, b, x * 100 + CASE k WHEN 4 THEN n WHEN 2 THEN 10 + n WHEN 3 THEN 30 + n ELSE 20 END AS sa, y * 100 + CASE n WHEN 0 THEN 20 WHEN 1 THEN 11 ELSE 31 END AS sb, k FROM t)
SELECT DISTINCT a, b, CASE WHEN k <> 5 THEN CAST(sign(sa - sb) AS INT) END AS cmp FROM s""", domain=False)
def _(fleet):
    pairs = fleet.table("lineitem").selectExpr(f"{RAW_PEP} AS a", f"{OTHER_PEP} AS b").distinct()
    return pairs.select("a", "b", V.pep440_compare(V.pep440("a"), V.pep440("b")).alias("cmp"))


@query("ver_pep440_sort", _PEP_SQL + "SELECT raw, CAST(row_number() OVER (PARTITION BY major ORDER BY minor, step, num, raw) AS BIGINT) AS place FROM k", domain=False)
def _(fleet):
    from pyspark.sql import Window

    v = raw_pep(fleet).withColumn("v", V.pep440("raw")).filter("v IS NOT NULL")
    w = Window.partitionBy(F.get("v.release", F.lit(0))).orderBy("v.key", "raw")
    return v.select("raw", F.row_number().over(w).cast("bigint").alias("place"))


@query("ver_pep440_latest", f"""WITH t AS (SELECT l_partkey, {RAW_PEP} AS raw, (l_linenumber * 100 + l_suppkey % 10) * 100 + CASE l_orderkey % 6 WHEN 4 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 20 END + CASE WHEN l_orderkey % 6 IN (2, 3, 4) THEN l_partkey % 3 ELSE 0 END AS s, l_orderkey % 6 AS k FROM lineitem)
SELECT l_partkey AS pk, arg_max(raw, (CASE WHEN k IN (2, 4) THEN 0 ELSE 1 END, s, raw)) AS latest FROM t WHERE k <> 5 GROUP BY l_partkey""", domain=False)
def _(fleet):
    rows = fleet.table("lineitem").selectExpr("l_partkey AS pk", f"{RAW_PEP} AS raw")
    parsed = rows.select("raw").distinct().withColumn("v", V.pep440("raw")).filter("v IS NOT NULL")
    order = F.struct((~F.col("v.prerelease")).alias("stable"), F.col("v.key").alias("key"), F.col("raw").alias("raw"))
    return rows.join(parsed, "raw").groupBy("pk").agg(F.max_by("raw", order).alias("latest"))


@query("ver_pep440_satisfies", _PEP_SQL + """, s(spec, c) AS (VALUES ('>=2.0,<4', 1), ('~=3.1', 2), ('==2.*', 3), ('>3.0', 4), ('!=1.0', 5), ('>=1.0rc0', 6), ('>=1.*', 7), ('', 8)),
a AS (SELECT *, (major * 100 + minor) * 100 + step * 10 + num AS v, k IN (2, 4) AS pre FROM k)
SELECT raw, spec, CASE WHEN c = 8 THEN true WHEN c = 6 THEN v >= 10010 WHEN pre THEN false
WHEN c = 7 THEN NULL WHEN c = 1 THEN v >= 20020 AND major < 4 WHEN c = 2 THEN major = 3 AND v >= 30120 WHEN c = 3 THEN major = 2
WHEN c = 4 THEN v > 30020 AND NOT (major = 3 AND minor = 0) WHEN c = 5 THEN v <> 10020 END AS ok FROM a, s""", domain=False)
def _(fleet):
    specs = F.explode(F.array(*[F.lit(x) for x in (">=2.0,<4", "~=3.1", "==2.*", ">3.0", "!=1.0", ">=1.0rc0", ">=1.*", "")]))
    v = raw_pep(fleet).withColumn("v", V.pep440("raw")).filter("v IS NOT NULL").withColumn("spec", specs)
    return v.select("raw", "spec", V.pep440_satisfies("raw", "spec", F.col("v")).alias("ok"))


@query("ver_loose_range", """SELECT a.advisory_id, v.version, v.major >= 2 AND v.major < a.n + 1 AS inside, CAST(v.major AS BIGINT) AS first_part
FROM advisory a JOIN package_version v USING (pk)""")
def _(fleet):
    a = fleet.advisory.select("advisory_id", "pk", F.lit("2.0.0").alias("lo"), F.concat((F.regexp_extract("fixed_version", r"^(\d+)", 1).cast("int") + 1).cast("string"), F.lit(".0.0")).alias("hi"))
    v = fleet.package_version.select("pk", "version")
    return a.join(v, "pk").select("advisory_id", "version", V.loose_contains("version", "lo", "hi").alias("inside"), F.get(V.loose_key("version"), F.lit(0)).cast("bigint").alias("first_part"))


@query("ver_fix_list", """, f AS (SELECT advisory_id, unnest([n || '.0.0', (n + 1) || '.0.0', 'next', '1.0.' || n]) AS fix FROM advisory)
SELECT advisory_id, fix, row_number() OVER (PARTITION BY advisory_id ORDER BY fix = 'next', TRY_CAST(split_part(fix, '.', 1) AS INT), fix) AS position FROM f""")
def _(fleet):
    n = F.regexp_extract("fixed_version", r"^(\d+)", 1)
    text = F.concat(F.lit(" next;"), F.col("fixed_version"), F.lit("; "), (n.cast("int") + 1).cast("string"), F.lit(".0.0,"), F.col("fixed_version"), F.lit(", 1.0."), n)
    rows = fleet.advisory.select("advisory_id", text.alias("texts"))
    return W.fix_list(rows, "advisory_id", "texts").select("advisory_id", "fix", F.col("position").cast("bigint").alias("position"))


@query("ver_recommended_fix", """, f AS (SELECT DISTINCT a.pv, t.version, unnest([fixed_version, '0.9.0', '3.1.0']) AS fix FROM affects a JOIN package_version t USING (pv))
SELECT pv, coalesce(min(fix) FILTER (CAST(split_part(fix, '.', 1) AS INT) * 100 + CAST(split_part(fix, '.', 2) AS INT) * 10 + CAST(split_part(fix, '.', 3) AS INT)
> CAST(split_part(version, '.', 1) AS INT) * 100 + CAST(split_part(version, '.', 3) AS INT)), '') AS recommended_fix FROM f GROUP BY pv""")
def _(fleet):
    fixes = fleet.affects.select("pv", F.explode(F.array("fixed_version", F.lit("0.9.0"), F.lit("3.1.0"))).alias("fix")).distinct()
    return W.recommended_fix(fleet.package_version.select("pv", "version"), fixes)
