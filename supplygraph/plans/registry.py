"""Where the catalogue modules register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from supplygraph.plans.domain import Fleet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The projection of Fleet, stated in the checker's own SQL.
DOMAIN_SQL = """
entry AS (
  SELECT l_orderkey AS lock_id, l_linenumber AS line, p_partkey AS pk, replace(p_name, ' ', '-') || '-' || p_partkey AS name,
    l_linenumber || '.0.' || (l_suppkey % 2) AS version, l_linenumber AS major,
    'pkg:npm/' || replace(p_name, ' ', '-') || '-' || p_partkey || '@' || l_linenumber || '.0.' || (l_suppkey % 2) AS pv,
    l_suppkey AS supp, l_discount AS disc, o_custkey AS cust, n_name AS service,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS observed_at, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS shipped,
    l_returnflag = 'R' AS dev
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN nation ON n_nationkey = o_custkey % 25),
lock_slot AS (SELECT lock_id, line, min(pv) AS rep FROM entry GROUP BY ALL),
lock_edge AS (SELECT DISTINCT e.lock_id, s.rep AS src, e.pv AS dst FROM entry e JOIN lock_slot s ON s.lock_id = e.lock_id AND s.line = e.line // 2 WHERE s.rep <> e.pv),
lock_root AS (SELECT e.lock_id, e.service, e.observed_at, e.pv, bool_and(e.dev) AS dev FROM entry e LEFT JOIN lock_slot s ON s.lock_id = e.lock_id AND s.line = e.line // 2 WHERE s.rep IS NULL OR e.line = 5 GROUP BY ALL),
package_version AS (SELECT pv, pk, name, version, major, min(shipped) AS published_at, (pk % 41 = 0 AND major = 1) AS deprecated FROM entry GROUP BY pv, pk, name, version, major),
package AS (SELECT pk, name, CASE WHEN pk % 13 <> 0 THEN count(*) END AS downloads FROM entry GROUP BY pk, name),
requires AS (SELECT DISTINCT e.src, b.pk AS dst_pk, b.name AS dst_name, b.major AS m,
  CASE b.major % 3 WHEN 0 THEN '^' || b.major || '.0.0' WHEN 1 THEN b.major || '.x' ELSE '>=' || b.major || '.0.0 <' || (b.major + 2) || '.0.0' END AS range
  FROM lock_edge e JOIN package_version b ON b.pv = e.dst),
advisory AS (SELECT 'CVE-2024-' || p_partkey AS advisory_id, p_partkey AS pk, replace(p_name, ' ', '-') || '-' || p_partkey AS name, 2 + p_size % 4 AS n,
  '<' || (2 + p_size % 4) || '.0.0' AS affected_range, (2 + p_size % 4) || '.0.0' AS fixed_version,
  CASE p_type WHEN 'ECONOMY' THEN 'critical' WHEN 'SMALL' THEN 'high' WHEN 'STANDARD' THEN 'moderate' WHEN 'LARGE' THEN 'low' ELSE 'unknown' END AS severity,
  'Flaw of ' || p_brand || ': ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' request exhausts memory' AS summary,
  1704067200 + p_partkey * 3600 AS published FROM part WHERE p_size <= 5),
advisory_alias AS (SELECT advisory_id, 'GHSA-' || (pk % 50) AS alias FROM advisory),
affects AS (SELECT a.advisory_id, v.pv, a.pk, a.name, v.version, a.severity, a.published, a.fixed_version, '0' AS introduced_version, coalesce(f.published_at, 0) AS fixed_published_at
  FROM advisory a JOIN package_version v ON v.pk = a.pk AND v.major < a.n LEFT JOIN package_version f ON f.pk = a.pk AND f.version = a.fixed_version),
incident AS (SELECT 'SIM-' || pv AS incident_id, pv, pk, name, 820454400 AS live_from, 883612800 AS live_until FROM package_version WHERE pk % 97 = 0 AND major % 3 = 1),
maintained_by AS (SELECT DISTINCT pk, name, 'user' || supp AS maintainer FROM entry WHERE major = 1 AND disc <= 0.01),
published_by AS (SELECT pv, name, CASE WHEN min(supp) % 10 = 0 THEN 'github actions' ELSE 'user' || min(supp) END AS publisher FROM entry GROUP BY pv, name),
sourced_from AS (SELECT v.pv, v.name, 'repo:github.com/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) AS repo FROM package_version v JOIN part ON p_partkey = v.pk),
function AS (SELECT c_custkey AS fn, n_name AS service, 'src/' || lower(c_mktsegment) || '.ts' AS file, c_custkey % 500 AS line FROM customer JOIN nation ON n_nationkey = c_custkey % 25),
calls AS (SELECT a.fn AS src, b.fn AS dst FROM function a JOIN function b ON b.fn IN (a.fn + 25, a.fn + 75)),
external_import AS (SELECT DISTINCT service, name AS specifier, pk FROM entry),
calls_external AS (SELECT DISTINCT cust AS fn, service, name AS specifier FROM entry),
route AS (SELECT c_custkey AS fn, 'POST' AS method, '/c/' || c_custkey AS pattern, service FROM customer JOIN function ON fn = c_custkey WHERE c_acctbal > 9000),
artifact AS (SELECT n_name AS service, CASE s_suppkey % 3 WHEN 0 THEN '.claude/hooks/' WHEN 1 THEN '.vscode/' ELSE '.github/workflows/' END || s_suppkey || '.js' AS path,
  CASE WHEN s_suppkey % 7 = 0 THEN 'ioc-path' WHEN s_suppkey % 5 = 0 THEN 'ioc-content' ELSE 'watched-dir' END AS kind, s_suppkey * 1000 AS first_seen
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
publish_event AS (SELECT event_id, 'u' || user_id AS publisher, CASE WHEN event_id % 2 = 0 THEN '@' || event_type || '/p' || (event_id % 50) ELSE event_type || '-' || (event_id % 50) END AS package,
  '1.' || event_id || '.0' AS version, CAST(floor(epoch(ts)) AS BIGINT) AS published_at, value > 50 AS has_install_script,
  CASE WHEN value >= 5 THEN 'https://github.com/' || event_type || '/r' || (event_id % 7) END AS repository FROM events),
workspace AS (SELECT r_name AS workspace, n_name AS service FROM nation JOIN region ON r_regionkey = n_regionkey),
walk AS (
  SELECT lock_id, service, observed_at, dev, pv, pv AS via, 1 AS depth FROM lock_root
  UNION
  SELECT w.lock_id, w.service, w.observed_at, w.dev, e.dst, w.via, w.depth + 1 FROM walk w JOIN lock_edge e ON e.lock_id = w.lock_id AND e.src = w.pv WHERE w.depth < 32),
lock_closure AS (SELECT lock_id, service, observed_at, pv, min(depth) AS depth, arg_min(via, (depth, via)) AS via_direct, bool_and(dev) AS dev_only FROM walk GROUP BY lock_id, service, observed_at, pv),
resolved_in AS (SELECT pv, service, min(depth) AS depth, arg_min(via_direct, (depth, via_direct)) AS via_direct, bool_and(dev_only) AS dev_only, min(observed_at) AS first_seen, 4102444800 AS last_seen FROM lock_closure GROUP BY pv, service),
depends_on AS (SELECT DISTINCT src, dst FROM lock_edge),
bounds AS (SELECT DISTINCT dst_pk AS pk, range, m AS lo, CASE WHEN m % 3 = 2 THEN m + 2 ELSE m + 1 END AS hi FROM requires),
admitted AS (SELECT b.pk, b.range, v.pv, v.version, v.major FROM bounds b JOIN package_version v ON v.pk = b.pk AND v.major >= b.lo AND v.major < b.hi),
chosen AS (
  SELECT pk, range, pv FROM admitted QUALIFY row_number() OVER (PARTITION BY pk, range ORDER BY major DESC, version DESC, pv) <= 8
  UNION SELECT pk, range, pv FROM admitted WHERE pv IN (SELECT pv FROM affects)),
satisfied_by AS (SELECT r.src, c.pv AS dst, min(r.range) AS range FROM requires r JOIN chosen c ON c.pk = r.dst_pk AND c.range = r.range GROUP BY r.src, c.pv),
held_name AS (SELECT DISTINCT service, name AS specifier, pv FROM entry),
root_pv AS (SELECT DISTINCT service, pv FROM lock_root),
bridge0 AS (SELECT i.service, i.specifier, h.pv, r.pv IS NOT NULL AS root FROM (SELECT DISTINCT service, specifier FROM external_import) i
  LEFT JOIN held_name h ON h.service = i.service AND h.specifier = i.specifier LEFT JOIN root_pv r ON r.service = i.service AND r.pv = h.pv),
bridge1 AS (SELECT *, count(pv) OVER (PARTITION BY service, specifier) AS n, count(CASE WHEN root THEN 1 END) OVER (PARTITION BY service, specifier) AS nr FROM bridge0),
bridge AS (SELECT service, specifier, pv, CASE WHEN n = 0 THEN 'unmatched' WHEN nr > 0 THEN 'hoisted' WHEN n = 1 THEN 'sole-version' ELSE 'ambiguous' END AS confidence FROM bridge1 WHERE nr = 0 OR root),
loads AS (
  SELECT service, specifier, pv, 0 AS hops FROM bridge WHERE pv IS NOT NULL
  UNION SELECT l.service, l.specifier, d.dst, l.hops + 1 FROM loads l JOIN depends_on d ON d.src = l.pv WHERE l.hops < 12),
import_reach AS (SELECT service, specifier, pv, min(hops) AS hops FROM loads GROUP BY service, specifier, pv),
base(severity, b, o) AS (VALUES ('critical', 1.0, 5), ('high', 0.85, 4), ('moderate', 0.65, 3), ('unknown', 0.55, 2), ('low', 0.45, 1)),
worst AS (SELECT pv, arg_max(severity, o) AS severity, count(*) AS n_advisories, min(published) AS first_advisory,
  max(CASE WHEN fixed_published_at > 0 THEN fixed_published_at ELSE 4102444800 END) AS last_fix FROM affects JOIN base USING (severity) GROUP BY pv),
threat0 AS (SELECT v.pv, v.name, v.version, CASE WHEN i.pv IS NOT NULL THEN 'compromised' WHEN w.pv IS NOT NULL THEN 'vulnerable' ELSE 'deprecated' END AS kind,
  coalesce(w.severity, CASE WHEN i.pv IS NOT NULL THEN 'critical' END, 'unknown') AS severity, coalesce(w.n_advisories, 0) AS n_advisories,
  CASE WHEN w.pv IS NULL THEN 0 WHEN v.published_at > 0 THEN v.published_at ELSE w.first_advisory END AS window_start, coalesce(w.last_fix, 4102444800) AS window_end
  FROM package_version v LEFT JOIN worst w ON w.pv = v.pv LEFT JOIN incident i ON i.pv = v.pv WHERE w.pv IS NOT NULL OR i.pv IS NOT NULL OR v.deprecated),
threat AS (SELECT t.*, coalesce(s.n, 0) AS n_services, coalesce(s.live, 0) AS live_services, coalesce(s.late, 0) AS after_fix_services,
  r.pv IS NOT NULL AS in_code, r.min_hops, coalesce(r.n, 0) AS n_imports, coalesce(f.n, 0) AS function_count
  FROM threat0 t
  LEFT JOIN (SELECT t.pv, count(*) AS n, count(*) FILTER (window_start > 0 AND first_seen > 0 AND first_seen <= window_end AND last_seen >= window_start) AS live,
    count(*) FILTER (window_start > 0 AND first_seen > window_end) AS late FROM threat0 t JOIN resolved_in x ON x.pv = t.pv GROUP BY t.pv) s ON s.pv = t.pv
  LEFT JOIN (SELECT pv, count(*) AS n, min(hops) AS min_hops FROM import_reach GROUP BY pv) r ON r.pv = t.pv
  LEFT JOIN (SELECT pv, count(DISTINCT fn) AS n FROM import_reach JOIN calls_external USING (service, specifier) GROUP BY pv) f ON f.pv = t.pv),
heat_edge AS (
  SELECT dst AS src, src AS dst FROM depends_on UNION SELECT pv, 'svc:' || lower(service) FROM lock_root
  UNION SELECT pv, 'import:' || service || ':' || specifier FROM bridge WHERE pv IS NOT NULL
  UNION SELECT 'import:' || service || ':' || specifier, 'fn:' || fn FROM calls_external
  UNION SELECT 'fn:' || dst, 'fn:' || src FROM calls UNION SELECT 'fn:' || fn, 'route:' || pattern FROM route
  UNION SELECT 'fn:' || fn, 'file:' || service || ':' || file FROM function),
glow AS (
  SELECT pv AS node, b, severity, 0 AS hops FROM worst JOIN base USING (severity)
  UNION SELECT e.dst, g.b, g.severity, g.hops + 1 FROM glow g JOIN heat_edge e ON e.src = g.node WHERE g.hops < 6 AND g.b - 0.14 * (g.hops + 1) >= 0.05),
heat AS (SELECT node, max(CAST(round(b - 0.14 * hops, 4) AS DOUBLE)) AS heat, arg_max(hops, b - 0.14 * hops) AS hops, arg_max(severity, b - 0.14 * hops) AS severity FROM glow GROUP BY node)
"""


def query(key: str, sql: str | None = None, domain: bool = True):
    """Registers ``fn(fleet) -> DataFrame`` and its checking SQL.

    With ``domain`` the SQL continues the projection: it is either a SELECT or
    further CTEs (starting with a comma) and a SELECT.
    """

    def add(fn: Callable[[Fleet], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: fn(Fleet.of(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLES[key] = f"WITH RECURSIVE {DOMAIN_SQL.strip()}{'' if text.startswith(',') else ' '}{text}" if domain else text
        return fn

    return add
