"""Grading, threats, publish history and read models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplygraph.operators import findings as G
from supplygraph.operators import publish as P
from supplygraph.operators import reach as R
from supplygraph.operators import views as W
from supplygraph.plans.graph_catalog import FOUND_SQL, squat_names, squat_targets
from supplygraph.plans.registry import query

# -- grading --------------------------------------------------------------------------

_FRONT_SQL = """, link AS (
  SELECT DISTINCT 'publisher' AS route, publisher AS identity, name FROM published_by WHERE publisher <> 'github actions'
  UNION SELECT 'maintainer', maintainer, name FROM maintained_by UNION SELECT 'repository', repo, name FROM sourced_from),
own AS (
  SELECT DISTINCT 'publisher' AS route, publisher AS identity, name FROM published_by WHERE publisher <> 'github actions' AND pv IN (SELECT pv FROM incident)
  UNION SELECT 'repository', repo, name FROM sourced_from WHERE pv IN (SELECT pv FROM incident)
  UNION SELECT 'maintainer', maintainer, name FROM maintained_by WHERE name IN (SELECT name FROM incident)),
holder AS (SELECT route, identity, count(*) AS n FROM own GROUP BY ALL),
reached AS (SELECT l.* FROM link l JOIN holder h USING (route, identity) LEFT JOIN own o USING (route, identity, name) WHERE h.n > CASE WHEN o.name IS NULL THEN 0 ELSE 1 END),
front AS (SELECT name, count(DISTINCT identity) FILTER (route = 'publisher') AS n_publishers, count(DISTINCT identity) FILTER (route = 'maintainer') AS n_maintainers,
  count(DISTINCT identity) FILTER (route = 'repository') AS n_repositories, CAST(count(DISTINCT route) AS BIGINT) AS n_routes FROM reached GROUP BY name),
impact AS (SELECT name, count(DISTINCT service) AS n_services FROM resolved_in JOIN package_version USING (pv) GROUP BY name),
frontier AS (SELECT f.*, coalesce(i.n_services, 0) AS n_services, row_number() OVER (ORDER BY n_routes DESC, f.name) <= 200 AS impact_measured, 'INVESTIGATE' AS confidence FROM front f LEFT JOIN impact i USING (name)) """


@query("agg_assess", """, cf AS (SELECT DISTINCT a.advisory_id, b.service, c.fn FROM affects a JOIN bridge b USING (pv) JOIN calls_external c ON c.service = b.service AND c.specifier = b.specifier),
back AS (SELECT DISTINCT fn, fn AS node, 0 AS depth FROM cf UNION SELECT b.fn, c.src, b.depth + 1 FROM back b JOIN calls c ON c.dst = b.node WHERE b.depth < 8),
held AS (SELECT advisory_id, service, count(DISTINCT r.pv) AS n_packages, CAST(min(depth) AS BIGINT) AS min_depth, bool_and(dev_only) AS dev_only FROM affects a JOIN resolved_in r USING (pv) GROUP BY advisory_id, service),
used AS (SELECT advisory_id, service, count(*) AS n FROM cf GROUP BY ALL),
rt AS (SELECT cf.advisory_id, r.service, count(DISTINCT r.pattern) AS n FROM cf JOIN (SELECT DISTINCT fn, node FROM back) b USING (fn) JOIN route r ON r.fn = b.node GROUP BY ALL),
art AS (SELECT service, count(*) AS n, count(*) FILTER (kind LIKE 'ioc-%') AS c FROM artifact GROUP BY service)
SELECT h.advisory_id, h.service, n_packages, min_depth, dev_only, coalesce(used.n, 0) AS n_functions, coalesce(rt.n, 0) AS n_routes, coalesce(art.n, 0) AS n_artifacts, coalesce(art.c, 0) AS n_confirmed,
CASE WHEN art.c > 0 THEN 'P0' WHEN rt.n > 0 THEN 'P1' WHEN used.n > 0 THEN 'P2' ELSE 'P3' END AS tier
FROM held h LEFT JOIN used USING (advisory_id, service) LEFT JOIN rt USING (advisory_id, service) LEFT JOIN art ON art.service = h.service""")
def _(fleet):
    return G.assess(fleet)


_ATOMS = [
    "DIRECTLY_COMPROMISED", "RESOLVES_COMPROMISED_VERSION", "TRANSITIVELY_EXPOSED", "POSSIBLE_EXACT", "POSSIBLE",
    "RESOLVES_SUBJECT_VERSION", "SHARED_MAINTAINER", "KNOWN_VULNERABILITY",
]


@query("agg_confidence", """SELECT pv, CASE WHEN pk % 97 = 0 THEN 'CERTAIN' WHEN major % 3 = 0 THEN 'HIGH' WHEN pk % 2 = 0 THEN 'MEDIUM' WHEN pk % 5 = 0 THEN 'INVESTIGATE' ELSE 'LOW' END AS confidence FROM package_version""")
def _(fleet):
    atoms = F.array_compact(F.array(
        F.when(F.col("pk") % 97 == 0, _ATOMS[0]), F.when(F.col("major") % 3 == 0, _ATOMS[2]), F.when(F.col("pk") % 2 == 0, _ATOMS[3]),
        F.when(F.col("pk") % 5 == 0, _ATOMS[6]), F.when(F.col("pk") % 7 == 0, _ATOMS[7]),
    ))
    return fleet.package_version.select("pv", G.confidence(atoms).alias("confidence"))


def squats(fleet):
    from supplygraph.operators import typosquat as T

    if not hasattr(fleet, "_squats"):
        fleet._squats = fleet.scratch.save(T.edges(squat_names(fleet), squat_targets(fleet)), "squats")
    return fleet._squats


_SAID = {k: f"'{v}'" for k, v in G.NEGATIVE.items()}
_FINDINGS_SQL = f""", flag AS (SELECT pv FROM incident UNION SELECT pv FROM affects), live AS (SELECT DISTINCT r.pv, r.service FROM resolved_in r JOIN incident i ON i.pv = r.pv WHERE first_seen > 0 AND first_seen <= live_until AND last_seen >= live_from),
flagged AS (SELECT name, min(pv) AS pv FROM flag JOIN package_version USING (pv) GROUP BY name), l AS (SELECT DISTINCT maintainer, name FROM maintained_by),
kin AS (SELECT l.maintainer, l.name, min(f.pv) AS subject FROM l JOIN l o ON o.maintainer = l.maintainer AND o.name <> l.name JOIN flagged f ON f.name = o.name GROUP BY l.maintainer, l.name),
claim AS (
SELECT pv AS subject, CAST(NULL AS VARCHAR) AS identity, pv AS entity, 'PackageVersion' AS entity_type, 'DIRECTLY_COMPROMISED' AS status, 'DIRECTLY_COMPROMISED' AS atoms, pv AS path, 'incident ' || min(incident_id) || ' names it' AS reason, '' AS negatives, 0 AS n_negative, 'CERTAIN' AS confidence FROM incident GROUP BY pv
UNION ALL SELECT pv, NULL, pv, 'PackageVersion', 'VULNERABLE', 'KNOWN_VULNERABILITY', pv, array_to_string(list_sort(list(DISTINCT advisory_id))[1:3], '; '), CASE WHEN pv IN (SELECT pv FROM incident) THEN '' ELSE {_SAID['incident']} END, CASE WHEN pv IN (SELECT pv FROM incident) THEN 0 ELSE 1 END, 'LOW' FROM affects GROUP BY pv
UNION ALL SELECT r.pv, NULL, r.service, 'Project', CASE WHEN depth = 1 THEN 'DIRECTLY_EXPOSED' ELSE 'TRANSITIVELY_EXPOSED' END,
  'RESOLVES_COMPROMISED_VERSION' || CASE WHEN depth > 1 THEN '|TRANSITIVELY_EXPOSED' ELSE '' END || CASE WHEN live.pv IS NOT NULL THEN '|LIVE_WINDOW_OVERLAP' ELSE '' END,
  r.service || CASE WHEN depth > 1 THEN ' > ' || via_direct ELSE '' END || ' > ' || r.pv, 'a lockfile resolves ' || r.pv || CASE WHEN depth > 1 THEN ' at depth ' || depth || ' via ' || via_direct ELSE '' END,
  concat_ws('|', CASE WHEN dev_only THEN {_SAID['dev']} END, CASE WHEN live.pv IS NULL AND r.pv IN (SELECT pv FROM live) THEN {_SAID['window']} END),
  CASE WHEN dev_only THEN 1 ELSE 0 END + CASE WHEN live.pv IS NULL AND r.pv IN (SELECT pv FROM live) THEN 1 ELSE 0 END, 'HIGH'
  FROM resolved_in r JOIN flag USING (pv) LEFT JOIN live ON live.pv = r.pv AND live.service = r.service
UNION ALL SELECT subject, 'maintainer ' || maintainer, name, 'Package', 'RELATED / INVESTIGATE', 'SHARED_MAINTAINER', name || ' > maintainer ' || maintainer || ' > ' || subject, 'maintainer ' || maintainer || ' also maintains the package of ' || subject,
  {_SAID['named']} || '|' || {_SAID['held']} || '|' || {_SAID['alone']}, 3, 'INVESTIGATE' FROM kin) """


def finding_rows(found):
    return found.select(
        "subject", "identity", "entity", "entity_type", "status", F.array_join("atoms", "|").alias("atoms"), F.array_join("path", " > ").alias("path"), "reason",
        F.array_join("negatives", "|").alias("negatives"), F.col("n_negative").cast("int").alias("n_negative"), "confidence",
    )


@query("agg_findings", _FINDINGS_SQL + "SELECT * FROM claim")
def _(fleet):
    none = fleet.package.select(F.col("name").alias("candidate"), F.col("name").alias("target")).limit(0)
    return finding_rows(G.findings(fleet, none))


@query("agg_findings_with_imitators", FOUND_SQL + _FINDINGS_SQL.lstrip() + f"""SELECT * FROM claim
UNION ALL SELECT f.pv, NULL, candidate, 'Package', 'RELATED / INVESTIGATE', 'TYPOSQUAT_NEIGHBOR', candidate || ' > ' || target || ' > ' || f.pv, 'its name resembles ' || target, {_SAID['name']}, 1, 'INVESTIGATE' FROM (SELECT DISTINCT candidate, target FROM found) JOIN flagged f ON f.name = target""")
def _(fleet):
    return finding_rows(G.findings(fleet, squats(fleet)))


_WIDE_SQL = """, back AS (SELECT pv, pv AS node, 0 AS d FROM incident UNION SELECT b.pv, s.src, b.d + 1 FROM back b JOIN satisfied_by s ON s.dst = b.node WHERE b.d < 5),
size AS (SELECT maintainer, count(DISTINCT name) - 1 AS n FROM maintained_by GROUP BY maintainer),
wide AS (SELECT i.incident_id, i.pv, i.name,
  (SELECT count(*) FROM satisfied_by s WHERE s.dst = i.pv) AS n_direct, (SELECT count(DISTINCT node) FROM back b WHERE b.pv = i.pv AND d > 0) AS n_transitive,
  (SELECT count(DISTINCT lock_id) FROM entry e WHERE e.pv = i.pv) AS n_entries, (SELECT count(*) FROM resolved_in r WHERE r.pv = i.pv) AS n_projects,
  (SELECT count(*) FROM resolved_in r WHERE r.pv = i.pv AND first_seen > 0 AND first_seen <= i.live_until AND last_seen >= i.live_from) AS n_live,
  (SELECT count(*) FROM affects a WHERE a.pv = i.pv) AS n_advisories,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT DISTINCT maintainer FROM maintained_by m WHERE m.name = i.name) JOIN size USING (maintainer)) AS n_shared_maintainer FROM incident i) """


@query("agg_blast_radius", _WIDE_SQL + "SELECT pv, n_direct, n_transitive, n_entries, n_projects, n_live, n_advisories, n_shared_maintainer FROM wide")
def _(fleet):
    return G.blast_radius(fleet, fleet.incident, squats(fleet)).drop("n_typosquats")


_THREAT_COLS = "pv, kind, severity, n_advisories, window_start, window_end, n_services, live_services, after_fix_services, in_code, min_hops, n_imports, function_count"


@query("agg_threats", f"SELECT {_THREAT_COLS.replace('min_hops', 'CAST(min_hops AS BIGINT) AS min_hops')} FROM threat")
def _(fleet):
    return G.threats(fleet).select(*_THREAT_COLS.split(", "))


@query("agg_frontier", _FRONT_SQL + "SELECT * FROM frontier")
def _(fleet):
    return G.frontier(fleet, fleet.incident)


@query("agg_frontier_services", _FRONT_SQL + """SELECT 'service' AS kind, service AS item FROM resolved_in JOIN package_version USING (pv) WHERE name IN (SELECT name FROM reached) GROUP BY service
UNION ALL SELECT DISTINCT 'rotate-' || route, identity FROM reached""")
def _(fleet):
    return G.frontier_services(fleet, fleet.incident)


_RANGE_SQL = """, ro AS (SELECT dst AS pv, count(DISTINCT src) AS range_only FROM satisfied_by GROUP BY dst), cf AS (SELECT pv, count(DISTINCT service) AS confirmed FROM resolved_in GROUP BY pv),
rv AS (SELECT pv, coalesce(range_only, 0) AS range_only, coalesce(confirmed, 0) AS confirmed FROM ro FULL JOIN cf USING (pv)) """


@query("agg_range_vs_lock", _RANGE_SQL + "SELECT pv, range_only, confirmed FROM rv")
def _(fleet):
    return G.range_vs_lock(fleet)


@query("agg_suggested_targets", _RANGE_SQL + """, r AS (SELECT rv.*, CAST(CASE WHEN i.pv IS NULL THEN 0 ELSE 1 END AS BIGINT) AS marked, coalesce(a.n, 0) AS n_advisories FROM rv LEFT JOIN incident i USING (pv) LEFT JOIN (SELECT pv, count(*) AS n FROM affects GROUP BY pv) a USING (pv))
SELECT pv, marked, n_advisories, range_only, confirmed FROM r""")
def _(fleet):
    return G.suggested_targets(fleet)


@query("agg_verdict", """SELECT t.pv, severity, n_advisories, coalesce(f.n, 0) AS n_fixes, n_services,
CASE WHEN kind = 'compromised' THEN 'compromised, held by ' || n_services || ' service(s)' WHEN n_services > 0 THEN severity || ', held by ' || n_services || ' service(s)' ELSE 'not held' END AS headline
FROM threat t LEFT JOIN (SELECT pv, count(DISTINCT fixed_version) AS n FROM affects GROUP BY pv) f ON f.pv = t.pv WHERE kind <> 'deprecated'""")
def _(fleet):
    return G.verdict(fleet)


@query("agg_verdict_items", """, f AS (SELECT pv FROM threat WHERE kind <> 'deprecated')
SELECT pv, 'advisory' AS kind, advisory_id AS item FROM affects JOIN f USING (pv) UNION SELECT pv, 'fix', fixed_version FROM affects JOIN f USING (pv) WHERE fixed_version IS NOT NULL
UNION SELECT pv, 'service', service FROM resolved_in JOIN f USING (pv)""")
def _(fleet):
    return G.verdict_items(fleet)


@query("agg_fleet_overview", """SELECT service, count(*) AS n_versions, count(DISTINCT v.name) AS n_packages, count(*) FILTER (depth = 1) AS n_direct, count(t.kind) AS n_threats, count(*) FILTER (t.in_code) AS n_reaching,
count(*) FILTER (t.severity = 'critical') AS n_critical, count(*) FILTER (t.severity = 'high') AS n_high, count(*) FILTER (t.severity = 'moderate') AS n_moderate,
count(*) FILTER (t.severity = 'low') AS n_low, count(*) FILTER (t.severity = 'unknown') AS n_unknown, count(*) FILTER (t.kind = 'compromised') AS n_compromised,
count(*) FILTER (t.kind = 'vulnerable') AS n_vulnerable, count(*) FILTER (t.kind = 'deprecated') AS n_deprecated
FROM resolved_in r JOIN package_version v ON v.pv = r.pv LEFT JOIN threat t ON t.pv = r.pv GROUP BY service""")
def _(fleet):
    return G.fleet_overview(fleet)


def scan_rows(fleet):
    eco = F.when(F.col("pk") % 7 == 0, "PyPI").otherwise("npm")
    return fleet.affects.select(F.col("name").alias("package"), "version", eco.alias("ecosystem"))


@query("agg_scan_summary", "SELECT CASE WHEN pk % 7 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem, count(*) AS n_findings, count(DISTINCT name) AS n_packages FROM affects GROUP BY ALL")
def _(fleet):
    return G.scan_summary(scan_rows(fleet))[0]


@query("agg_scan_summary_top", "SELECT name AS package, version, count(*) AS n_rows FROM affects GROUP BY ALL ORDER BY n_rows DESC, package, version LIMIT 8")
def _(fleet):
    return G.scan_summary(scan_rows(fleet))[1]


_STATS = ["package_version", "package", "advisory", "incident", "function", "route", "artifact", "requires", "satisfied_by", "depends_on", "resolved_in", "affects", "calls", "calls_external", "maintained_by", "published_by", "sourced_from"]


@query("agg_graph_stats", " UNION ALL ".join(f"SELECT '{t}' AS label, count(*) AS n_rows FROM {t}" for t in _STATS))
def _(fleet):
    # the pairs of resolved_in, which has one row for each
    return G.graph_stats({t: fleet.holders if t == "resolved_in" else getattr(fleet, t) for t in _STATS})


@query("agg_threat_counts", """SELECT count(*) AS total, count(*) FILTER (in_code) AS in_code, count(*) FILTER (kind = 'compromised') AS compromised, count(*) FILTER (kind = 'vulnerable') AS vulnerable, count(*) FILTER (kind = 'deprecated') AS deprecated,
(SELECT count(*) FROM package_version) AS versions, (SELECT count(*) FROM external_import) AS imports, (SELECT count(*) FROM function) AS functions FROM threat""")
def _(fleet):
    return G.threat_counts(fleet.threat_base, fleet.loaded_threats, fleet.package_version, fleet.external_import, fleet.function)


@query("agg_artifact_counts", "SELECT count(*) AS total, count(*) FILTER (kind LIKE 'ioc-%') AS ioc, count(*) FILTER (kind = 'watched-dir') AS watched FROM artifact")
def _(fleet):
    return G.artifact_counts(fleet.artifact)


@query("agg_code_coverage", """SELECT workspace, bool_or(service IN (SELECT service FROM function WHERE fn % 25 < 8)) AS has_code_graph FROM workspace GROUP BY workspace""")
def _(fleet):
    return G.code_coverage(fleet.workspace, fleet.function.filter("fn % 25 < 8"))


# -- publish history ------------------------------------------------------------------------
# The feed covers thirty days, so thresholds in days become thresholds in hours.

_NOW = 1706745600  # 2024-02-01
_HIST_SQL = """, h AS (SELECT *, replace(replace(repository, 'https://', 'repo:'), '#', '') AS repo_key, row_number() OVER w AS seq, lag(version) OVER w AS pv, lag(published_at) OVER w AS pt, lag(has_install_script) OVER w AS ps,
  lag(repository) OVER w AS pr FROM publish_event WINDOW w AS (PARTITION BY package ORDER BY published_at, version)) """


def history(fleet):
    return P.dated_history(fleet.publish_event)


@query("win_dated_history", _HIST_SQL + "SELECT package, version, published_at, seq, pv AS previous FROM h")
def _(fleet):
    return history(fleet).select("package", "version", "published_at", F.col("seq").cast("bigint").alias("seq"), F.col("previous.version").alias("previous"))


def feed_maintainers(fleet):
    """Accounts 0 to 49 maintain everything they touch on even event numbers."""
    e = fleet.publish_event.filter("event_id % 4 = 0 AND CAST(substr(publisher, 2) AS BIGINT) < 50")
    return e.select("package", F.upper("publisher").alias("username")).distinct()


@query("win_publisher_not_maintainer", """, m AS (SELECT DISTINCT package, publisher FROM publish_event WHERE event_id % 4 = 0 AND CAST(substr(publisher, 2) AS BIGINT) < 50)
SELECT package, version, 'PUBLISHER_NOT_MAINTAINER' AS signal, publisher AS witness FROM publish_event e WHERE package IN (SELECT package FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.package = e.package AND m.publisher = e.publisher)""")
def _(fleet):
    return P.publisher_not_maintainer(fleet.publish_event, feed_maintainers(fleet)).drop("published_at")


@query("win_install_script_added", _HIST_SQL + "SELECT package, version, 'INSTALL_SCRIPT_ADDED' AS signal, pv AS witness FROM h WHERE has_install_script AND NOT ps")
def _(fleet):
    return P.install_script_added(history(fleet)).drop("published_at")


@query("win_dormancy_break", _HIST_SQL + "SELECT package, version, 'DORMANCY_BREAK' AS signal, pv AS witness FROM h WHERE published_at - pt >= 86400")
def _(fleet):
    return P.dormancy_break(history(fleet), 24 * 3600).drop("published_at")


@query("win_repository_change", _HIST_SQL + """SELECT package, version, CASE WHEN repository IS NULL THEN 'REPOSITORY_REMOVED' ELSE 'REPOSITORY_CHANGED' END AS signal, pv AS witness FROM h WHERE pr IS NOT NULL AND repository IS DISTINCT FROM pr""")
def _(fleet):
    return P.repository_change(history(fleet)).drop("published_at")


def _burst_sql(window: int, least: int) -> str:
    return f""", r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY published_at, version) AS rn FROM publish_event),
s AS (SELECT *, min(rn) OVER (PARTITION BY package ORDER BY published_at RANGE BETWEEN {window} PRECEDING AND CURRENT ROW) AS start_rn FROM r),
e AS (SELECT *, rn - start_rn + 1 AS n FROM s WHERE rn - start_rn + 1 >= {least} AND published_at >= {_NOW - 20 * 86400} QUALIFY row_number() OVER (PARTITION BY package, start_rn ORDER BY rn) = 1)
SELECT e.package, e.version, e.published_at, b.version AS start_version, b.published_at AS started_at, e.n AS n_versions FROM e JOIN r b ON b.package = e.package AND b.rn = e.start_rn"""


@query("win_publish_burst", _burst_sql(6 * 3600, 3))
def _(fleet):
    return P.publish_burst(fleet.publish_event, 6 * 3600, 3, P.is_recent(_NOW, 20 * 86400))


_CORR_SQL = """, d AS (SELECT e.publisher AS identity, e.published_at AS t, count(DISTINCT o.package) AS n_packages, count(DISTINCT o.event_id) AS n_artifacts FROM publish_event e JOIN publish_event o ON o.publisher = e.publisher
  AND o.published_at BETWEEN e.published_at - WINDOW AND e.published_at GROUP BY ALL),
best AS (SELECT * FROM d WHERE n_packages >= 3 QUALIFY row_number() OVER (PARTITION BY identity ORDER BY n_packages DESC, n_artifacts DESC, t) = 1),
i AS (SELECT b.identity, e.*, CASE WHEN package LIKE '@%/%' THEN split_part(package, '/', 1) ELSE '' END AS sc FROM best b JOIN publish_event e ON e.publisher = b.identity AND e.published_at BETWEEN b.t - WINDOW AND b.t)
SELECT identity, min(published_at) AS started_at, max(published_at) AS ended_at, count(DISTINCT package) AS n_packages, count(*) AS n_artifacts, count(DISTINCT repository) AS n_repositories, count(DISTINCT sc) AS n_scopes,
CASE WHEN count(DISTINCT repository) = 1 OR (count(DISTINCT sc) = 1 AND max(sc) <> '') THEN 'release' ELSE 'spread' END AS verdict FROM i GROUP BY identity"""


@query("win_correlated_burst", _CORR_SQL.replace("WINDOW", str(12 * 3600)))
def _(fleet):
    return P.correlated_burst(fleet.publish_event, 12 * 3600)


@query("win_recency", _HIST_SQL + f"SELECT package, version, 'INSTALL_SCRIPT_ADDED' AS signal, pv AS witness FROM h WHERE has_install_script AND NOT ps AND published_at >= {_NOW - 7 * 86400}")
def _(fleet):
    return P.install_script_added(history(fleet)).filter(P.is_recent(_NOW, 7 * 86400)).drop("published_at")


@query("win_version_publishers", """, c AS (SELECT package, publisher, count(*) AS n_published FROM publish_event GROUP BY package, publisher QUALIFY row_number() OVER (PARTITION BY package ORDER BY count(*) DESC, publisher) <= 8),
v AS (SELECT package, publisher, version, row_number() OVER (PARTITION BY package, publisher ORDER BY published_at DESC, version) AS version_rank FROM publish_event)
SELECT package, publisher, n_published, version, version_rank FROM c JOIN v USING (package, publisher) WHERE version_rank <= 4""")
def _(fleet):
    shown = P.version_publishers(fleet.publish_event, fleet.publish_event.select("package"))
    return shown.select("package", "publisher", "n_published", "version", F.col("version_rank").cast("bigint").alias("version_rank"))


@query("win_newest_publish", f"""SELECT package, arg_max(version, (published_at, version)) AS version, max(published_at) AS published_at FROM publish_event GROUP BY package HAVING max(published_at) >= {_NOW - 3 * 86400}""")
def _(fleet):
    return P.newest_publish(fleet.publish_event, _NOW, 3 * 86400).select("package", "version", "published_at")


def all_signals(fleet):
    return P.signals(fleet.publish_event, feed_maintainers(fleet), _NOW)


_SIGNAL_SQL = _HIST_SQL + f""", m AS (SELECT DISTINCT package, publisher FROM publish_event WHERE event_id % 4 = 0 AND CAST(substr(publisher, 2) AS BIGINT) < 50),
r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY published_at, version) AS rn FROM publish_event),
s AS (SELECT *, min(rn) OVER (PARTITION BY package ORDER BY published_at RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS start_rn FROM r),
e AS (SELECT * FROM s WHERE rn - start_rn + 1 >= 3 QUALIFY row_number() OVER (PARTITION BY package, start_rn ORDER BY rn) = 1),
signal AS (
  SELECT package, version, 'PUBLISHER_NOT_MAINTAINER' AS signal FROM publish_event x WHERE package IN (SELECT package FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.package = x.package AND m.publisher = x.publisher)
  UNION ALL SELECT package, version, 'INSTALL_SCRIPT_ADDED' FROM h WHERE has_install_script AND NOT ps UNION ALL SELECT package, version, 'DORMANCY_BREAK' FROM h WHERE published_at - pt >= 31536000
  UNION ALL SELECT package, version, CASE WHEN repository IS NULL THEN 'REPOSITORY_REMOVED' ELSE 'REPOSITORY_CHANGED' END FROM h WHERE pr IS NOT NULL AND repository IS DISTINCT FROM pr
  UNION ALL SELECT package, version, 'PUBLISH_BURST' FROM e) """


@query("agg_anomaly_counts", _SIGNAL_SQL + "SELECT signal, count(*) AS n FROM signal GROUP BY signal")
def _(fleet):
    return all_signals(fleet).groupBy("signal").agg(F.count("*").alias("n"))


# -- lists and sets ------------------------------------------------------------------------------

_ORDER_SQL = "in_code DESC, kind = 'compromised' DESC, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'moderate' THEN 3 WHEN 'unknown' THEN 2 ELSE 1 END DESC, n_services DESC, name, version"


@query("srt_capped", "SELECT pv, severity, (SELECT count(*) FROM affects) - 25 AS omitted FROM affects ORDER BY severity, pv, advisory_id LIMIT 25")
def _(fleet):
    return W.capped(fleet.affects.select("pv", "severity", "advisory_id"), [F.col("severity"), F.col("pv"), F.col("advisory_id")], 25).drop("advisory_id")


@query("srt_threat_list", f"SELECT pv, kind, severity, n_services, 0::BIGINT AS omitted FROM threat WHERE in_code")
def _(fleet):
    return W.threat_list(fleet.threat, only_reaching=True).select("pv", "kind", "severity", "n_services", "omitted")


@query("srt_union_lookup", "SELECT pv, name, version FROM package_version WHERE pk IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def _(fleet):
    return fleet.package_version.join(fleet.table("part").filter("p_size = 1").select(F.col("p_partkey").alias("pk")), "pk", "left_semi").select("pv", "name", "version")


@query("set_union_distinct", """SELECT src, dst, min(edge) AS edge FROM (SELECT src, dst, 'depends_on' AS edge FROM lock_edge UNION ALL SELECT src, dst, 'admits' FROM satisfied_by) WHERE src <> dst GROUP BY src, dst""")
def _(fleet):
    edges = fleet.lock_edge.select("src", "dst", F.lit("depends_on").alias("edge")).unionByName(fleet.satisfied_by.select("src", "dst", F.lit("admits").alias("edge")))
    return W.distinct_edges(edges)


@query("set_difference", """, l AS (SELECT DISTINCT dst AS pv, service FROM satisfied_by JOIN resolved_in ON pv = src), r AS (SELECT pv, service FROM resolved_in WHERE depth > 1)
SELECT pv, service, 'missed' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT pv, service, 'extra' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def _(fleet):
    walked = fleet.satisfied_by.join(fleet.resolved_in.select(F.col("pv").alias("src"), "service"), "src").select(F.col("dst").alias("pv"), "service").distinct()
    return W.closure_difference(walked, fleet.resolved_in.filter("depth > 1").select("pv", "service"))


# -- graphs ----------------------------------------------------------------------------------------



@query("view_package_graph", """, kin0 AS (SELECT DISTINCT i.pv, m2.name AS node FROM incident i JOIN maintained_by m1 ON m1.name = i.name JOIN maintained_by m2 ON m2.maintainer = m1.maintainer AND m2.name <> i.name),
n AS (SELECT a.pv, 'threat' AS layer, a.advisory_id AS node FROM affects a JOIN incident i ON i.pv = a.pv UNION SELECT pv, 'threat', incident_id FROM incident UNION SELECT pv, 'version', pv FROM incident
  UNION (SELECT dst, 'range-admits', src FROM satisfied_by JOIN incident i ON i.pv = dst)
  UNION SELECT e.pv, 'resolution', 'lock:' || lock_id FROM entry e JOIN incident i ON i.pv = e.pv UNION SELECT r.pv, 'project', 'svc:' || lower(service) FROM resolved_in r JOIN incident i ON i.pv = r.pv
  UNION (SELECT pv, 'related', node FROM kin0 QUALIFY row_number() OVER (PARTITION BY pv ORDER BY node) <= 24))
SELECT n.pv, layer, n.node, CASE WHEN n.node = n.pv THEN 1.0::DOUBLE ELSE h.heat END AS heat FROM n LEFT JOIN heat h ON h.node = n.node""")
def _(fleet):
    return W.package_graph(fleet, fleet.incident)[0]


@query("view_package_graph_edges", """, kin0 AS (SELECT DISTINCT i.pv, m2.name AS node FROM incident i JOIN maintained_by m1 ON m1.name = i.name JOIN maintained_by m2 ON m2.maintainer = m1.maintainer AND m2.name <> i.name)
SELECT a.pv, a.advisory_id AS src, a.pv AS dst, 'names' AS edge FROM affects a JOIN incident i ON i.pv = a.pv UNION SELECT pv, incident_id, pv, 'names' FROM incident
UNION (SELECT dst, src, dst, 'admits' FROM satisfied_by JOIN incident i ON i.pv = dst)
UNION SELECT e.pv, e.pv, 'lock:' || lock_id, 'resolved_by' FROM entry e JOIN incident i ON i.pv = e.pv UNION SELECT e.pv, 'lock:' || lock_id, 'svc:' || lower(service), 'lockfile_of' FROM entry e JOIN incident i ON i.pv = e.pv
UNION (SELECT pv, pv, node, 'shares_identity' FROM kin0 QUALIFY row_number() OVER (PARTITION BY pv ORDER BY node) <= 24)""")
def _(fleet):
    return W.package_graph(fleet, fleet.incident, heated=False)[1]


_PROJECT_SQL = """, held AS (SELECT r.service, r.pv, r.depth, h.heat FROM resolved_in r LEFT JOIN heat h ON h.node = r.pv),
pn AS (SELECT * FROM held WHERE heat IS NOT NULL UNION ALL (SELECT * FROM held WHERE heat IS NULL AND depth = 1)) """


@query("view_project_graph", _PROJECT_SQL + "SELECT service, pv, CAST(least(depth, 5) AS INT) AS layer, heat FROM pn")
def _(fleet):
    return W.project_graph(fleet)[0]


@query("view_project_graph_edges", _PROJECT_SQL + """SELECT DISTINCT a.service, src, dst FROM lock_edge e JOIN (SELECT DISTINCT lock_id, service FROM entry) l ON l.lock_id = e.lock_id JOIN pn a ON a.service = l.service AND a.pv = e.src JOIN pn b ON b.service = l.service AND b.pv = e.dst""")
def _(fleet):
    return W.project_graph(fleet)[1]


@query("view_micro_graph", """, w AS (SELECT fn, 0 AS depth FROM function WHERE fn NOT IN (SELECT dst FROM calls) UNION SELECT c.dst, w.depth + 1 FROM w JOIN calls c ON c.src = w.fn WHERE w.depth < 6), cd AS (SELECT fn, max(depth) AS depth FROM w GROUP BY fn),
n AS (SELECT DISTINCT 'svc:' || lower(service) AS node, service, 'entry' AS layer, 0 AS "column" FROM function UNION ALL SELECT 'route:' || pattern, service, 'route', 0 FROM route
  UNION ALL SELECT 'fn:' || f.fn, service, CASE WHEN f.fn IN (SELECT fn FROM route) THEN 'handler' ELSE 'function' END, coalesce(cd.depth, 0) FROM function f LEFT JOIN cd USING (fn)
  UNION ALL SELECT DISTINCT 'file:' || service || ':' || file, service, 'file', 0 FROM function
  UNION ALL SELECT DISTINCT 'import:' || service || ':' || specifier, service, 'import', 7 FROM external_import)
SELECT n.node, service, layer, CAST("column" AS INT) AS "column", heat FROM n LEFT JOIN heat h ON h.node = n.node""")
def _(fleet):
    return W.micro_graph(fleet, R.call_depth(fleet.function, fleet.calls, fleet.scratch))


@query("view_micro_graph_edges", """SELECT 'svc:' || lower(service) AS src, 'file:' || service || ':' || file AS dst, 'holds' AS edge FROM function UNION SELECT 'file:' || service || ':' || file, 'fn:' || fn, 'contains' FROM function
UNION SELECT 'route:' || pattern, 'fn:' || fn, 'handled_by' FROM route UNION SELECT 'fn:' || src, 'fn:' || dst, 'calls' FROM calls UNION SELECT 'fn:' || fn, 'import:' || service || ':' || specifier, 'uses' FROM calls_external""")
def _(fleet):
    return W.micro_graph_edges(fleet)


def _whole(fleet):
    nodes = {
        "package_version": fleet.package_version.select(F.col("pv").alias("node")), "advisory": fleet.advisory.select(F.col("advisory_id").alias("node")),
        "incident": fleet.incident.select(F.col("incident_id").alias("node")), "service": fleet.workspace.select(F.col("service").alias("node")),
    }
    edges = {
        "depends_on": fleet.depends_on, "affects": fleet.affects.select(F.col("advisory_id").alias("src"), F.col("pv").alias("dst")),
        "resolved_in": fleet.resolved_in.select(F.col("pv").alias("src"), F.col("service").alias("dst")), "compromises": fleet.incident.select(F.col("incident_id").alias("src"), F.col("pv").alias("dst")),
    }
    return W.full_graph(nodes, edges)


_FULL_SQL = """, n AS (SELECT 'package_version' AS label, pv AS node FROM package_version UNION SELECT 'advisory', advisory_id FROM advisory UNION SELECT 'incident', incident_id FROM incident UNION SELECT 'service', service FROM workspace),
l AS (SELECT 'depends_on' AS edge, src, dst FROM depends_on UNION SELECT 'affects', advisory_id, pv FROM affects UNION SELECT 'resolved_in', pv, service FROM resolved_in UNION SELECT 'compromises', incident_id, pv FROM incident),
s AS (SELECT * FROM l WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)) """


@query("view_full_graph", _FULL_SQL + "SELECT label, node FROM n")
def _(fleet):
    return _whole(fleet)[0]


@query("view_full_graph_edges", _FULL_SQL + "SELECT edge, src, dst FROM s")
def _(fleet):
    return _whole(fleet)[1]


@query("view_full_graph_stats", _FULL_SQL + """SELECT label AS kind, count(*) AS n_total, count(*) AS n_shown FROM n GROUP BY label
UNION ALL SELECT edge, count(*), (SELECT count(*) FROM s WHERE s.edge = l.edge) FROM l GROUP BY edge""")
def _(fleet):
    return _whole(fleet)[2]


@query("view_node_detail", """SELECT advisory_id AS node, unnest(['name', 'severity', 'fixed_version', 'published']) AS property, unnest([name, severity, fixed_version, CAST(published AS VARCHAR)]) AS value FROM advisory""")
def _(fleet):
    return W.node_detail(fleet.advisory.select("advisory_id", "name", "severity", "fixed_version", "published"))


# -- threats and fixes -----------------------------------------------------------------------------------

_FIX_SQL = """, fx AS (SELECT t.pv, coalesce(min(fixed_version) FILTER (CAST(split_part(fixed_version, '.', 1) AS INT) > CAST(split_part(t.version, '.', 1) AS INT)), '') AS recommended_fix FROM threat t LEFT JOIN affects a ON a.pv = t.pv GROUP BY t.pv) """


@query("view_advisory_chips", "SELECT a.advisory_id, a.name, a.severity, min(f.pv) AS example, count(f.pv) AS n_held FROM advisory a LEFT JOIN affects f ON f.advisory_id = a.advisory_id GROUP BY ALL")
def _(fleet):
    return W.advisory_chips(fleet)


@query("view_resolve_package", """SELECT name, version, count(DISTINCT service) AS n_services, bool_or(depth = 1) AS direct, bool_and(dev_only) AS dev_only, 'substring' AS match_type
FROM resolved_in JOIN package_version USING (pv) WHERE contains(name, 'ring-1') GROUP BY name, version""")
def _(fleet):
    return W.resolve_package(fleet, "ring-1")


@query("view_resolve_package_exact", """, m AS (SELECT *, CASE WHEN name = 'red-widget-1' THEN 0 WHEN contains(name, 'red-widget-1') THEN 1 END AS mode FROM resolved_in JOIN package_version USING (pv))
SELECT name, version, count(DISTINCT service) AS n_services, bool_or(depth = 1) AS direct, bool_and(dev_only) AS dev_only, CASE WHEN min(mode) = 0 THEN 'exact' ELSE 'substring' END AS match_type
FROM m WHERE mode = (SELECT min(mode) FROM m) GROUP BY name, version""")
def _(fleet):
    return W.resolve_package(fleet, " Red-Widget-1 ")


@query("view_threat_detail", "SELECT t.pv, t.kind, t.severity AS threat_severity, a.advisory_id, a.severity, a.fixed_version, a.introduced_version, d.summary FROM threat t LEFT JOIN affects a ON a.pv = t.pv LEFT JOIN advisory d ON d.advisory_id = a.advisory_id")
def _(fleet):
    return W.threat_detail(fleet)


@query("view_impacted_services", "SELECT r.pv, service, depth = 1 AS direct, NOT dev_only AS production, CAST(depth AS INT) AS depth FROM resolved_in r JOIN incident i ON i.pv = r.pv")
def _(fleet):
    return W.impacted_services(fleet, fleet.incident)


@query("view_remediation", _FIX_SQL + """, im AS (SELECT pv, count(*) FILTER (depth = 1) AS d, count(*) FILTER (depth > 1) AS i, count(*) FILTER (NOT dev_only) AS p FROM resolved_in GROUP BY pv)
SELECT t.pv, kind, severity, recommended_fix, coalesce(d, 0) AS n_direct, coalesce(i, 0) AS n_indirect, coalesce(p, 0) AS n_production,
CASE WHEN in_code THEN 'P1' WHEN im.pv IS NULL THEN 'UNKNOWN' WHEN p > 0 THEN 'P3' ELSE 'P3-dev' END AS priority FROM threat t JOIN fx ON fx.pv = t.pv LEFT JOIN im ON im.pv = t.pv""")
def _(fleet):
    return W.remediation(fleet)


_SCOPED_SQL = _FIX_SQL + """, sc AS (SELECT workspace, t.pv, t.name, t.version, kind, severity, in_code, h.n AS n_services, recommended_fix FROM (SELECT workspace, pv, count(DISTINCT service) AS n FROM resolved_in JOIN workspace USING (service) GROUP BY ALL) h JOIN threat t ON t.pv = h.pv JOIN fx ON fx.pv = t.pv) """


@query("view_scoped_threats", _SCOPED_SQL + "SELECT workspace, pv, kind, severity, in_code, n_services, recommended_fix FROM sc")
def _(fleet):
    return W.scoped_threats(fleet)


@query("view_briefing", _SCOPED_SQL + f"""SELECT workspace, pv, kind, severity, in_code, n_services, row_number() OVER (PARTITION BY workspace ORDER BY {_ORDER_SQL}) AS rank, greatest(count(*) OVER (PARTITION BY workspace) - 12, 0) AS omitted FROM sc QUALIFY rank <= 12""")
def _(fleet):
    return W.briefing(fleet).withColumn("rank", F.col("rank").cast("bigint"))


@query("view_advisory_facts", "SELECT advisory_id, CASE WHEN pk % 3 = 0 THEN 'critical' ELSE severity END AS severity, fixed_version, CASE WHEN pk % 3 = 0 THEN 0 ELSE 1 END AS source_rank FROM advisory")
def _(fleet):
    a = fleet.advisory
    hand = a.filter("pk % 3 = 0").select("advisory_id", F.lit("critical").alias("severity"), "fixed_version")
    return W.advisory_facts(hand, a.select("advisory_id", "severity", "fixed_version"))


@query("view_services", "SELECT w.service, workspace, count(r.pv) AS n_packages FROM workspace w LEFT JOIN resolved_in r ON r.service = w.service GROUP BY w.service, workspace")
def _(fleet):
    return W.services(fleet)


@query("view_service_profile", f"""SELECT pv, kind, severity, depth, dev_only, in_code, (SELECT count(*) FROM resolved_in WHERE service = 'NATION_3') AS n_packages, (SELECT count(*) FROM resolved_in WHERE service = 'NATION_3' AND depth = 1) AS n_direct, 0::BIGINT AS omitted FROM (SELECT t.pv, kind, severity, CAST(depth AS INT) AS depth, dev_only, in_code, name, version, 1 AS n_services FROM resolved_in r JOIN threat t ON t.pv = r.pv WHERE service = 'NATION_3')""")
def _(fleet):
    return W.service_profile(fleet, "NATION_3")


@query("view_search_advisories", """SELECT advisory_id, name, severity, fixed_version FROM advisory JOIN advisory_alias USING (advisory_id)
WHERE (contains(lower(summary), 'mall r') OR contains(name, 'mall r') OR contains(lower(advisory_id), 'mall r') OR contains(lower(alias), 'mall r')) AND advisory_id IN (SELECT advisory_id FROM affects)""")
def _(fleet):
    return W.search_advisories(fleet, " Mall R ")


@query("view_search_advisories_by_alias", """SELECT advisory_id, name, severity, fixed_version FROM advisory JOIN advisory_alias USING (advisory_id)
WHERE contains(lower(summary || ' ' || name || ' ' || advisory_id || ' ' || alias), 'ghsa-1') AND advisory_id IN (SELECT advisory_id FROM affects)""")
def _(fleet):
    return W.search_advisories(fleet, "ghsa-1")


# -- provenance and publishing ---------------------------------------------------------------------------


@query("view_provenance", """SELECT i.pv, p.publisher, p.publisher = 'github actions' AS automation, CASE WHEN m.n IS NOT NULL THEN EXISTS (SELECT 1 FROM maintained_by x WHERE x.name = i.name AND x.maintainer = p.publisher) END AS listed, s.repo,
coalesce(m.n, 0) AS n_maintainers, 1 AS n_incidents, CASE WHEN i.pk % 2 = 0 THEN 1 ELSE 0 END AS n_signals
FROM incident i JOIN published_by p ON p.pv = i.pv JOIN sourced_from s ON s.pv = i.pv LEFT JOIN (SELECT name, count(DISTINCT maintainer) AS n FROM maintained_by GROUP BY name) m ON m.name = i.name""")
def _(fleet):
    noticed = fleet.package.filter("pk % 2 = 0").select(F.col("name").alias("package"))
    out = W.provenance(fleet, fleet.incident, noticed)
    return out.withColumn("n_incidents", F.col("n_incidents").cast("int")).withColumn("n_signals", F.col("n_signals").cast("int"))


@query("view_publish_anomalies", _SIGNAL_SQL + """SELECT package, version, signal, CAST(CASE signal WHEN 'PUBLISHER_NOT_MAINTAINER' THEN 1 WHEN 'INSTALL_SCRIPT_ADDED' THEN 2 WHEN 'REPOSITORY_CHANGED' THEN 3 WHEN 'REPOSITORY_REMOVED' THEN 4 WHEN 'DORMANCY_BREAK' THEN 5 ELSE 6 END AS BIGINT) AS signal_rank FROM signal""")
def _(fleet):
    held = fleet.publish_event.select("package")
    return W.publish_anomalies(all_signals(fleet), held).select("package", "version", "signal", "signal_rank")


@query("view_attack_frontier", _FRONT_SQL + "SELECT *, name IN (SELECT name FROM resolved_in JOIN package_version USING (pv)) AS already_used_here FROM frontier")
def _(fleet):
    return W.attack_frontier(fleet, fleet.incident)


@query("view_incident_dossier", FOUND_SQL + _WIDE_SQL.lstrip() + """, claim AS (SELECT pv AS node, pv AS source, b, 0 AS hops FROM worst JOIN base USING (severity) UNION SELECT e.dst, c.source, c.b, c.hops + 1 FROM claim c JOIN heat_edge e ON e.src = c.node WHERE c.hops < 6 AND c.b - 0.14 * (c.hops + 1) >= 0.05),
hottest AS (SELECT node, arg_max(source, (round(b - 0.14 * hops, 4), -hops, CASE b WHEN 0.45 THEN 'low' WHEN 0.55 THEN 'unknown' WHEN 0.65 THEN 'moderate' WHEN 0.85 THEN 'high' ELSE 'critical' END, source)) AS source, arg_max(hops, (round(b - 0.14 * hops, 4), -hops)) AS hops FROM claim GROUP BY node)
SELECT incident_id, n_direct, n_transitive, n_entries, (SELECT count(*) FROM found WHERE target = w.name) AS n_typosquats,
(SELECT count(DISTINCT who) FROM (SELECT maintainer AS who FROM maintained_by m WHERE m.name = w.name UNION SELECT publisher FROM published_by p WHERE p.pv = w.pv AND publisher <> 'github actions')) AS n_identities,
n_projects, (SELECT count(DISTINCT src) FROM satisfied_by s WHERE s.dst = w.pv) AS range_only, n_live, n_advisories, n_shared_maintainer, (SELECT count(*) FROM hottest WHERE source = w.pv AND hops > 0) AS n_hot FROM wide w""")
def _(fleet):
    return W.incident_dossier(fleet, squats(fleet).select("candidate", "target"))


# -- text audits --------------------------------------------------------------------------------------------

_KNOWN_SQL = """, known AS (SELECT lower(name || '@' || version) AS spec FROM package_version UNION SELECT lower(name || '@' || fixed_version) FROM advisory UNION SELECT lower(package || '@' || version) FROM publish_event) """


@query("view_grounding_audit", _KNOWN_SQL + """, said AS (SELECT DISTINCT lock_id, CASE WHEN line % 2 = 0 THEN name || '@' || version WHEN line % 3 = 0 THEN name || '@7.7.7' END AS spec FROM entry)
SELECT lock_id, spec FROM said WHERE spec IS NOT NULL AND spec NOT IN (SELECT spec FROM known)""")
def _(fleet):
    said = F.concat(
        F.lit("Upgrade "), F.initcap(F.lit("x")), F.lit(" ("), F.col("name"), F.lit("@"),
        F.when(F.col("line") % 2 == 0, F.col("version")).when(F.col("line") % 3 == 0, F.lit("7.7.7")), F.lit("). Mail a@b.c, not node/x@y."),
    )
    texts = fleet.entry.select("lock_id", said.alias("text"))
    return W.ungrounded(texts, "lock_id", "text", W.known_specs(fleet, fleet.publish_event))


@query("view_grounding_audit_documents", _KNOWN_SQL + """, said AS (SELECT doc_id, text || ' Upgrade ' || name || '@' || CASE WHEN doc_id % 3 = 0 THEN '7.7.7' ELSE '1.0.0' END || '.' AS text FROM documents JOIN package ON pk = doc_id % 200 + 1),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(^|[^\\w@/-])(@?[a-z0-9][\\w.-]*(?:/[\\w.-]+)?@\\d[\\w.-]*)', 2)) AS s FROM said)
SELECT DISTINCT doc_id, lower(regexp_replace(s, '[.,;:)-]+$', '')) AS spec FROM m WHERE lower(regexp_replace(s, '[.,;:)-]+$', '')) NOT IN (SELECT spec FROM known)""")
def _(fleet):
    named = fleet.table("documents").join(fleet.package.select("pk", "name"), F.col("pk") == F.col("doc_id") % 200 + 1)
    version = F.when(F.col("doc_id") % 3 == 0, "7.7.7").otherwise("1.0.0")
    said = named.select("doc_id", F.concat("text", F.lit(" Upgrade "), "name", F.lit("@"), version, F.lit(".")).alias("text"))
    return W.ungrounded(said, "doc_id", "text", W.known_specs(fleet, fleet.publish_event))


_WORDS_SQL = "regexp_split_to_array(regexp_replace(lower(trim(text)), '[^a-z]+', ' ', 'g'), ' ')"
_OFF_SQL = f"""CASE WHEN trim(text) = '' OR list_has_any({_WORDS_SQL}, {W.DOMAIN_WORDS}) OR regexp_matches(text, '[\\w@/.-]+@[\\w.-]+') THEN NULL
WHEN regexp_matches(text, '(?i)\\b(write|compose|tell)\\s+(me\\s+)?(a|an|some)\\s+(poem|song|haiku|story|joke|essay|rap|limerick|screenplay)\\b') THEN 'asked for creative writing'
WHEN regexp_matches(text, '(?i)\\btranslate\\b.+\\b(to|into)\\s+\\w+') THEN 'asked for a translation' WHEN length(trim(text)) <= 60 AND regexp_matches(text, '\\d\\s*[+\\-*/^%]\\s*\\d') THEN 'asked to do arithmetic' END"""


@query("view_off_topic", f"""WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT o_orderkey, -1, CASE o_orderkey % 6 WHEN 0 THEN 'Write me a poem about ' || o_orderpriority WHEN 1 THEN 'please translate this into french'
WHEN 2 THEN 'what is ' || o_custkey || ' + 1?' WHEN 3 THEN 'is ' || o_orderkey || ' * 2 a vulnerable version' WHEN 4 THEN 'write a story on lodash@4.17' ELSE 'how bad?' END FROM orders)
SELECT conv_id, turn, {_OFF_SQL} AS reason FROM t""", domain=False)
def _(fleet):
    asked = F.expr(
        "CASE o_orderkey % 6 WHEN 0 THEN 'Write me a poem about ' || o_orderpriority WHEN 1 THEN 'please translate this into french' WHEN 2 THEN 'what is ' || o_custkey || ' + 1?' "
        "WHEN 3 THEN 'is ' || o_orderkey || ' * 2 a vulnerable version' WHEN 4 THEN 'write a story on lodash@4.17' ELSE 'how bad?' END"
    )
    texts = fleet.table("conversations").select("conv_id", "turn", "text").unionByName(
        fleet.table("orders").select(F.col("o_orderkey").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), asked.alias("text"))
    )
    return texts.select("conv_id", "turn", W.off_topic("text").alias("reason"))
