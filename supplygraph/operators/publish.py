"""Publish-history signals. Slices of time keep a very busy package or account cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.operators.fixpoint import top_k
from supplygraph.operators.history import SLICE_SECONDS, with_halo, with_previous


def dated_history(versions: DataFrame) -> DataFrame:
    """Versions with a known time, oldest first, beside their predecessor.

    ``versions``: package, version, published_at, has_install_script,
    repository, publisher. An unknown time is dropped, never sorted first.
    """
    known = versions.filter("published_at > 0").withColumn("repo_key", N.repository_key("repository"))
    return with_previous(
        known, "package", "published_at", "version", ["version", "published_at", "has_install_script", "repo_key"]
    )


def is_recent(now: int | None, horizon: int | None = S.RECENT_SECONDS) -> Column:
    """Applied to the version that would be reported, after its predecessor is known."""
    return F.lit(True) if horizon is None or now is None else F.col("published_at") >= now - horizon


def _signal(df: DataFrame, name: str, witness: Column) -> DataFrame:
    return df.select("package", "version", "published_at", F.lit(name).alias("signal"), witness.alias("witness"))


def publisher_not_maintainer(versions: DataFrame, maintainers: DataFrame, full: Column | None = None) -> DataFrame:
    """Publisher outside the listed maintainers, where such a list is known.

    ``maintainers``: package, username. Two anti/semi joins instead of a list.
    """
    listed = maintainers.filter(N.strip("username") != "").select("package", F.lower("username").alias("who")).distinct()
    rows = versions.filter((F.coalesce("publisher", F.lit("")) != "") & (F.col("published_at") > 0))
    rows = rows.filter(~N.is_service_identity("publisher", F.col("publisher_email")) if "publisher_email" in versions.columns
                       else ~N.is_service_identity("publisher"))
    if full is not None:
        rows = rows.filter(full)
    known = rows.join(listed.select("package").distinct(), "package", "left_semi")
    outsiders = known.withColumn("who", F.lower("publisher")).join(listed, ["package", "who"], "left_anti")
    return _signal(outsiders, "PUBLISHER_NOT_MAINTAINER", F.col("publisher"))


def install_script_added(history: DataFrame) -> DataFrame:
    gained = F.col("has_install_script") & ~F.coalesce(F.col("previous.has_install_script"), F.lit(False))
    return _signal(history.filter(F.col("previous").isNotNull() & gained), "INSTALL_SCRIPT_ADDED", F.col("previous.version"))


def dormancy_break(history: DataFrame, seconds: int = S.DORMANCY_SECONDS) -> DataFrame:
    quiet = F.col("published_at") - F.col("previous.published_at") >= seconds
    return _signal(history.filter(quiet), "DORMANCY_BREAK", F.col("previous.version"))


def repository_change(history: DataFrame) -> DataFrame:
    before, after = F.col("previous.repo_key"), F.col("repo_key")
    rows = history.filter(before.isNotNull() & ~before.eqNullSafe(after))
    return rows.select(
        "package", "version", "published_at",
        F.when(after.isNull(), "REPOSITORY_REMOVED").otherwise("REPOSITORY_CHANGED").alias("signal"),
        F.col("previous.version").alias("witness"),
    )


def publish_burst(
    versions: DataFrame, window: int = S.BURST_WINDOW_SECONDS, least: int = S.BURST_MIN_VERSIONS,
    recent: Column | None = None, width: int = SLICE_SECONDS,
) -> DataFrame:
    """At least ``least`` versions of a package inside a sliding window.

    Reported once per window start, at the first recent version completing it.
    Versions are first counted by second, so a slice of a package holds a row a
    second at most, however many versions it has; ``recent`` may look at
    ``published_at`` alone. The version that completes a window is then found
    by its place among those of its second, of which the first ``least`` are
    enough.
    """
    known = versions.filter("published_at > 0").select("package", "version", "published_at")
    seconds = known.groupBy("package", "published_at").agg(F.count("*").alias("n"), F.min("version").alias("first_version"))
    spread = with_halo(seconds, "published_at", window, max(width, 2 * window))
    frame = Window.partitionBy("package", "_slice").orderBy("published_at").rangeBetween(-window, 0)
    framed = spread.withColumn("total", F.sum("n").over(frame)).withColumn(
        "_start", F.min(F.struct("published_at", F.col("first_version").alias("version"))).over(frame)
    )
    # the version of a second that completes the window: as many of it as are still missing before it
    place = F.greatest(F.lit(1), F.lit(least) - (F.col("total") - F.col("n")))
    ends = framed.filter(~F.col("_halo") & (F.col("total") >= least)).withColumn("place", place)
    if recent is not None:
        ends = ends.filter(recent)
    chosen = ends.groupBy("package", F.col("_start.version").alias("start_version"), F.col("_start.published_at").alias("started_at")).agg(
        F.min_by(F.struct("published_at", "place", (F.col("total") - F.col("n") + F.col("place")).alias("n_versions")), "published_at").alias("e")
    ).select("package", "start_version", "started_at", "e.*")
    named = top_k(known, ["package", "published_at"], [F.col("version")], least).withColumnRenamed("rank", "place")
    return chosen.join(named, ["package", "published_at", "place"]).select(
        "package", "version", "published_at", "start_version", "started_at", F.col("n_versions").cast("bigint").alias("n_versions"),
    )


def correlated_burst(
    versions: DataFrame, window: int = S.BURST_WINDOW_SECONDS, least: int = S.BURST_MIN_PACKAGES,
    recent: Column | None = None, width: int = SLICE_SECONDS,
) -> DataFrame:
    """Per account, the window touching most distinct packages.

    The number of distinct packages in ``[t - window, t]`` is the number whose
    latest publish up to ``t`` is inside the window. Each publish is such a
    latest one from its own time until the account's next publish of the same
    package or until the window has passed. Counting these intervals is a
    running sum of +1 and -1 inside a slice; no set of packages is built.
    """
    rows = versions.filter((F.col("published_at") > 0) & (F.coalesce("publisher", F.lit("")) != ""))
    rows = rows.filter(~N.is_service_identity("publisher"))
    if recent is not None:
        rows = rows.filter(recent)
    rows = rows.select(
        F.lower("publisher").alias("identity"), "package", "version", F.col("published_at").alias("t"), "repository"
    )
    width = max(width, 2 * window)
    times = rows.groupBy("identity", "package", "t").agg(F.count("*").alias("n"))
    # the next publish matters only when it is near; a halo of `window` seconds
    # taken from the following slice is enough to see it
    ahead = times.withColumn("_home", F.floor(F.col("t") / width)).withColumn(
        "_slice",
        F.explode(F.when(F.col("t") - F.col("_home") * width <= window, F.array("_home", F.col("_home") - 1)).otherwise(F.array("_home"))),
    )
    next_t = F.lead("t").over(Window.partitionBy("identity", "package", "_slice").orderBy("t"))
    spans = ahead.withColumn("_next", next_t).filter("_slice = _home").select(
        "identity", "package", "t", "n", F.least(F.coalesce("_next", F.col("t") + window + 1), F.col("t") + window + 1).alias("until")
    )
    # an interval touches its own slice and at most the next one
    home, stop = F.floor(F.col("t") / width), F.floor((F.col("until") - 1) / width)
    pieces = spans.withColumn("_slice", F.explode(F.sequence(home, stop)))
    begin = F.greatest(F.col("t"), F.col("_slice") * width)
    plus = pieces.select("identity", "_slice", begin.alias("at"), F.lit(1).alias("d_pkg"))
    minus = pieces.select("identity", "_slice", F.col("until").alias("at"), F.lit(-1).alias("d_pkg"))
    # rows inside the window, counted the same way
    count_until = F.col("t") + window + 1
    row_pieces = times.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("t") / width), F.floor((count_until - 1) / width))))
    row_plus = row_pieces.select("identity", "_slice", F.greatest(F.col("t"), F.col("_slice") * width).alias("at"), F.col("n").alias("d_row"))
    row_minus = row_pieces.select("identity", "_slice", count_until.alias("at"), (-F.col("n")).alias("d_row"))
    deltas = (
        plus.unionByName(minus).withColumn("d_row", F.lit(0).cast("bigint"))
        .unionByName(row_plus.unionByName(row_minus).withColumn("d_pkg", F.lit(0)))
        .groupBy("identity", "_slice", "at").agg(F.sum("d_pkg").alias("d_pkg"), F.sum("d_row").alias("d_row"))
    )
    running = Window.partitionBy("identity", "_slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = deltas.select(
        "identity", F.col("at").alias("ended_at"),
        F.sum("d_pkg").over(running).alias("n_packages"), F.sum("d_row").over(running).alias("n_artifacts"),
    )
    best = counted.filter(F.col("n_packages") >= least).groupBy("identity").agg(
        F.max(F.struct("n_packages", "n_artifacts", (-F.col("ended_at")).alias("early"))).alias("b")
    ).select("identity", (-F.col("b.early")).alias("ended_at"))
    inside = rows.join(best, "identity").filter((F.col("t") <= F.col("ended_at")) & (F.col("t") >= F.col("ended_at") - window))
    where = F.coalesce(N.repository_key("repository"), F.nullif(F.coalesce("repository", F.lit("")), F.lit("")))
    scope = F.coalesce(N.scope_of("package"), F.lit(""))
    summed = inside.withColumn("_repo", where).withColumn("_scope", scope).groupBy("identity").agg(
        F.min("t").alias("started_at"), F.max("t").alias("ended_at"),
        F.count_distinct("package").alias("n_packages"), F.count("*").alias("n_artifacts"),
        F.count_distinct("_repo").alias("n_repositories"), F.count_distinct("_scope").alias("n_scopes"),
        F.max("_scope").alias("_any_scope"),
    )
    cohesive = (
        (F.col("n_packages") < 2) | (F.col("n_repositories") == 1) | ((F.col("n_scopes") == 1) & (F.col("_any_scope") != ""))
    )
    return summed.withColumn("verdict", F.when(cohesive, "release").otherwise("spread")).drop("_any_scope")


def version_publishers(versions: DataFrame, names: DataFrame, per_account: int = 4, accounts: int = 8) -> DataFrame:
    """Accounts behind a package's versions, busiest first, newest versions shown."""
    rows = versions.join(names.select("package").distinct(), "package", "left_semi").filter(F.coalesce("publisher", F.lit("")) != "")
    busy = top_k(
        rows.groupBy("package", "publisher").agg(F.count("*").alias("n_published")),
        ["package"], [F.desc("n_published"), F.col("publisher")], accounts,
    ).withColumnRenamed("rank", "account_rank")
    shown = top_k(
        rows.select("package", "publisher", "version", "published_at"), ["package", "publisher"],
        [F.desc("published_at"), F.col("version")], per_account,
    ).withColumnRenamed("rank", "version_rank")
    return busy.join(shown, ["package", "publisher"])


def newest_publish(versions: DataFrame, now: int, fresh: int = S.FRESH_SECONDS) -> DataFrame:
    newest = versions.filter("published_at > 0").groupBy("package").agg(
        F.max_by(F.struct("version", "publisher"), F.struct("published_at", "version")).alias("v"),
        F.max("published_at").alias("published_at"),
    )
    return newest.filter(F.lit(now) - F.col("published_at") <= fresh).select(
        "package", F.col("v.version").alias("version"), F.col("v.publisher").alias("publisher"), "published_at"
    )


def signals(versions: DataFrame, maintainers: DataFrame, now: int | None = None, horizon: int | None = S.RECENT_SECONDS) -> DataFrame:
    """All per-package signals, limited to versions recent enough to report."""
    history = dated_history(versions)
    burst = publish_burst(versions, recent=is_recent(now, horizon)).select(
        "package", "version", "published_at", F.lit("PUBLISH_BURST").alias("signal"), F.col("start_version").alias("witness")
    )
    rows = (
        publisher_not_maintainer(versions, maintainers)
        .unionByName(install_script_added(history))
        .unionByName(dormancy_break(history))
        .unionByName(repository_change(history))
    )
    return rows.filter(is_recent(now, horizon)).unionByName(burst)
