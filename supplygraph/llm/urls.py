"""URL filtering against dated lists: an as-of join in time bins.

A list is a log of changes ``list, entry, at, action`` (``add`` or ``remove``,
epoch seconds). An entry is a host, which stands for itself and all hosts below
it, or a host with a path, which stands for the URLs below that path. A capture
``url, fetched_at`` is blocked if an entry that covers it was active when it was
fetched: its last change at or before that time added it.

Changes become validity intervals, cut at the bounds of time bins so that both
sides join on (entry, bin) with a range condition inside. The state at the start
of a bin comes from a window over the bins of an entry, not over its changes, so
an entry with a third of all changes or captures is spread over its bins, and
the join itself may be split further by its skew handling. Equal captures are
judged once.

Defined results: a null or unreadable URL, a null time or an empty list block
nothing; of changes to one entry at one instant an ``add`` wins; changes with a
null list, entry or time are ignored, as are actions of other names; repeated
changes count once; repeated captures each keep their row. Hosts are compared in
lower case without a trailing dot, paths as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplygraph.llm import common as C

BIN_SECONDS = 30 * 86_400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: str | Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def keys(url: str | Column) -> Column:
    """Every entry that would cover the URL: its host, the hosts above it, its host with each of its path's folders."""
    name, path = host(url), F.regexp_extract(url, PATH, 1)
    labels, folders = F.split(name, r"\."), F.filter(F.split(path, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    below = F.transform(
        F.when(F.size(folders) > 0, F.sequence(F.lit(1), F.size(folders))).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.concat(name, F.lit("/"), F.concat_ws("/", F.slice(folders, F.lit(1), i))),
    )
    return F.when(name != "", F.array_distinct(F.concat(above, below)))


def listed(entry: str) -> Column:
    """An entry as ``keys`` writes it: the host in lower case without a trailing dot, the path as it is."""
    return F.concat(F.rtrim(F.lower(F.regexp_extract(entry, "^[^/]*", 0)), F.lit(".")), F.regexp_extract(entry, "(?s)/.*", 0))


def states(changes: DataFrame) -> DataFrame:
    """``list, entry, at, bin, added``: one row an entry and instant."""
    known = changes.where("list is not null and entry is not null and at is not null and action in ('add', 'remove')")
    return (
        known.groupBy("list", listed("entry").alias("entry"), F.col("at").cast("long").alias("at"))
        .agg(F.max(F.col("action") == "add").alias("added"))
        .withColumn("bin", F.floor(F.col("at") / BIN_SECONDS))
    )


def intervals(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``list, entry, bin, valid_from, valid_to`` of the active times, for the ``(entry, bin)`` of ``wanted``."""
    state = states(changes)
    ends = state.groupBy("list", "entry", "bin").agg(F.max_by("added", "at").alias("left"))
    asked = ends.select("list", "entry").distinct().join(wanted.select("entry", "bin").distinct(), "entry").select("list", "entry", "bin")
    every = ends.select("list", "entry", "bin", "left", F.lit(False).alias("asked")).unionByName(asked.select("list", "entry", "bin", F.lit(None).cast("boolean").alias("left"), F.lit(True).alias("asked")))
    bins = every.groupBy("list", "entry", "bin").agg(F.max("left").alias("left"), F.max("asked").alias("asked"))
    earlier = Window.partitionBy("list", "entry").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    opening = bins.withColumn("added", F.last("left", ignorenulls=True).over(earlier)).where("asked and added").select(
        "list", "entry", "bin", (F.col("bin") * BIN_SECONDS).alias("at"), "added",
    )
    inside = state.select("list", "entry", "bin", "at", "added")
    # a change at the very start of a bin comes after what the bin opens with
    within = Window.partitionBy("list", "entry", "bin").orderBy("at", "later")
    steps = opening.withColumn("later", F.lit(0)).unionByName(inside.withColumn("later", F.lit(1)))
    ended = F.coalesce(F.lead("at").over(within), (F.col("bin") + 1) * BIN_SECONDS)
    return steps.select("list", "entry", "bin", "added", F.col("at").alias("valid_from"), ended.alias("valid_to")).where("added and valid_from < valid_to").drop("added")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """All rows of ``captures`` with ``n_entries``, ``entries`` (sorted, comma-joined ``list:entry``) and ``blocked``."""
    distinct = captures.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct()
    keyed = distinct.select("url", "fetched_at", F.floor(F.col("fetched_at") / BIN_SECONDS).alias("bin"), F.explode(keys("url")).alias("entry"))
    active = intervals(changes, keyed)
    hits = (
        keyed.join(active, ["entry", "bin"]).where("valid_from <= fetched_at and fetched_at < valid_to")
        .groupBy("url", "fetched_at").agg(F.collect_set(F.concat_ws(":", "list", "entry")).alias("found"))
        .select("url", "fetched_at", F.size("found").cast("long").alias("n_entries"), F.concat_ws(",", F.array_sort("found")).alias("entries"))
    )
    own = captures.drop("n_entries", "entries", "blocked")
    judged = own.join(hits, ["url", "fetched_at"], "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in own.columns], F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("entries", F.lit("")).alias("entries"), F.col("n_entries").isNotNull().alias("blocked"),
    )


def keep_allowed(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """The captures that no entry blocked at their time."""
    return judge(captures, changes).where("not blocked").select(*[F.col(f"`{c}`") for c in captures.columns])


# The tables have neither fetch times nor lists: both are derived from the pages.
YEAR = 1_704_067_200


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, fetched_at``: an hour of one year by the page's id."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.expr(f"{YEAR} + pmod(page_id * 7919, 8784) * 3600").cast("long").alias("fetched_at"),
    )


def list_changes(pages: DataFrame) -> DataFrame:
    """Two lists over the pages' hosts: whole hosts (or the host above an ``m.``) and first folders.

    The digits of an entry's md5 say whether it is listed, when it is added,
    whether it is taken off 60 days later and put on again after 60 more.
    """
    urls = pages.select(F.col("url").cast("string").alias("url")).distinct()
    name = host("url")
    named = urls.select(F.regexp_replace(name, r"^m\.", "").alias("h"), F.concat(name, F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]*)", 1)).alias("f")).where("h <> ''")
    entries = named.select(F.lit("hosts").alias("list"), F.col("h").alias("entry")).unionByName(named.select(F.lit("folders").alias("list"), F.col("f").alias("entry"))).distinct()
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(md5(entry), {k}, 1)) - 1")
    dated = entries.where(digit(1) < 5).select(
        "list", "entry", (F.lit(YEAR) + (digit(2) * 16 + digit(3)) * 86_400).cast("long").alias("t"), digit(4).alias("off"), digit(5).alias("again"),
    )
    step = lambda k: F.struct((F.col("t") + 60 * 86_400 * k).alias("at"), F.lit("remove" if k == 1 else "add").alias("action"))
    steps = F.filter(F.array(step(0), F.when(F.col("off") < 8, step(1)), F.when((F.col("off") < 8) & (F.col("again") < 8), step(2))), lambda s: s.isNotNull())
    return dated.select("list", "entry", F.explode(steps).alias("s")).select("list", "entry", "s.at", "s.action")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return judge(captures(pages), list_changes(pages))


OP10_SQL = r"""
WITH cap AS (SELECT page_id, url, 1704067200 + ((page_id * 7919 % 8784) + 8784) % 8784 * 3600 AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)', 1)) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p FROM pages),
named AS (SELECT DISTINCT regexp_replace(h, '^m\.', '') AS h, h || '/' || regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS f FROM cap WHERE h <> ''),
entry AS (SELECT 'hosts' AS list, h AS entry FROM named UNION SELECT 'folders', f FROM named),
digits AS (SELECT list, entry, [instr('0123456789abcdef', substr(md5(entry), k, 1)) - 1 FOR k IN [1, 2, 3, 4, 5]] AS d FROM entry),
dated AS (SELECT list, entry, 1704067200 + (d[2] * 16 + d[3]) * 86400 AS t, d[4] < 8 AS off, d[5] < 8 AS again FROM digits WHERE d[1] < 5),
live AS (
  SELECT list, entry, t AS a, CASE WHEN off THEN t + 5184000 ELSE 9999999999 END AS b FROM dated
  UNION ALL SELECT list, entry, t + 10368000, 9999999999 FROM dated WHERE off AND again),
covering AS (
  SELECT DISTINCT url, fetched_at, unnest(list_concat(
    [array_to_string(l[i:], '.') FOR i IN range(1, len(l) + 1)],
    [h || '/' || array_to_string(f[1:i], '/') FOR i IN range(1, len(f) + 1)])) AS entry
  FROM (SELECT url, fetched_at, h, string_split(h, '.') AS l, [x FOR x IN string_split(p, '/') IF x <> ''] AS f FROM cap WHERE h <> '')),
hits AS (SELECT url, fetched_at, count(*) AS n_entries, string_agg(list || ':' || entry, ',' ORDER BY list || ':' || entry) AS entries
  FROM (SELECT DISTINCT url, fetched_at, list, entry FROM covering JOIN live USING (entry) WHERE a <= fetched_at AND fetched_at < b) GROUP BY ALL)
SELECT page_id, url, fetched_at, coalesce(n_entries, 0) AS n_entries, coalesce(entries, '') AS entries, n_entries IS NOT NULL AS blocked
FROM cap LEFT JOIN hits USING (url, fetched_at)"""
