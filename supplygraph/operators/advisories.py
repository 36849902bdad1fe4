"""Advisory feeds: alias merge, attachment to held versions, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S
from supplygraph.functions import names as N
from supplygraph.functions import versions as V
from supplygraph.operators.fixpoint import components
from supplygraph.session import Scratch


def ranked_id(col):
    """Sortable form of an advisory id: CVE, GHSA, OSV, then the rest."""
    prefix = F.upper(F.substring_index(col, "-", 1))
    rank = F.when(prefix == "CVE", "0").when(prefix == "GHSA", "1").when(prefix == "OSV", "2").otherwise("3")
    return F.concat(rank, F.lit(" "), col)


def alias_components(findings: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, canonical) for every id seen, aliases of aliases included.

    ``findings``: osv_id, alias (NULL where a finding has none).
    """
    links = findings.select(
        ranked_id(F.col("osv_id")).alias("a"), ranked_id(F.coalesce("alias", "osv_id")).alias("b")
    ).distinct()
    plain = lambda c: F.substr(F.col(c), F.lit(3))
    return components(links, scratch).select(plain("node").alias("id"), plain("root").alias("canonical"))


def merge_advisories(findings: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per canonical advisory.

    ``findings`` carries ``row_no``, the order rows arrived in: longest texts,
    first vector, last score, worst label, first publication, latest change.
    """
    rows = findings.join(canonical.withColumnRenamed("id", "osv_id"), "osv_id")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    longest = lambda c: F.coalesce(
        F.max_by(filled(c), F.when(filled(c).isNotNull(), F.struct(F.length(c).alias("n"), (-F.col("row_no")).alias("o")))),
        F.lit(""),
    )
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("row_no")))
    score = F.col("score")
    rank = N.severity_rank("severity_label")
    return rows.groupBy("canonical").agg(
        longest("summary").alias("summary"),
        longest("details").alias("details"),
        F.coalesce(first(filled("cvss_vector")), F.lit("")).alias("cvss_vector"),
        F.coalesce(F.max_by(score, F.when(score.isNotNull(), F.col("row_no"))), F.lit(float(S.UNKNOWN_SCORE))).alias("severity_score"),
        F.coalesce(
            F.max_by("severity_label", F.when(rank > 0, F.struct(rank.alias("r"), (-F.col("row_no")).alias("o")))), F.lit("")
        ).alias("severity"),
        F.coalesce(first(F.when(F.col("published") > 0, F.col("published"))), F.lit(0)).cast("bigint").alias("published"),
        F.max("modified").alias("modified"),
        F.count("*").alias("n_rows"),
    )


def advisory_ids(findings: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical, alias): every other id of the advisory."""
    named = findings.select(F.col("osv_id").alias("id")).union(findings.filter("alias IS NOT NULL").select("alias")).distinct()
    return named.join(canonical, "id").filter("id <> canonical").select("canonical", F.col("id").alias("alias"))


def affected_versions(findings: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per (advisory, ecosystem, package, version): last fix, first introduction."""
    rows = findings.join(canonical.withColumnRenamed("id", "osv_id"), "osv_id").withColumn(
        "eco", F.coalesce(F.nullif(F.lower(N.strip("ecosystem")), F.lit("")), F.lit("npm"))
    )
    fix = F.nullif("fixed_version", F.lit(""))
    intro = F.nullif("introduced_version", F.lit(""))
    target = rows.groupBy("canonical", "eco", "package", "version").agg(
        F.coalesce(F.max_by(fix, F.when(fix.isNotNull(), F.col("row_no"))), F.lit("")).alias("fixed_version")
    )
    opened = rows.groupBy("canonical", "eco", "package").agg(
        F.coalesce(F.min_by(intro, F.when(intro.isNotNull(), F.col("row_no"))), F.lit("")).alias("introduced_version")
    )
    return target.join(opened, ["canonical", "eco", "package"])


def attach_advisories(advisories: DataFrame, versions: DataFrame) -> DataFrame:
    """Advisory to held version, with both ends of the range and the fix's date."""
    parsed = advisories.withColumn("sets", V.advisory_range("affected_range"))
    held = versions.select("pv", "pk", "version", "published_at", V.advisory_version("version").alias("ver"))
    hit = parsed.join(held, "pk").filter(V.advisory_satisfies(F.col("ver"), F.col("sets")))
    fixes = versions.select("pk", F.col("version").alias("fixed_version"), F.col("published_at").alias("fixed_published_at"))
    return hit.join(fixes, ["pk", "fixed_version"], "left").select(
        "advisory_id", "pv", "pk", "name", "version", "severity", "published", "fixed_version",
        F.lit("0").alias("introduced_version"),
        F.coalesce("fixed_published_at", F.lit(S.UNKNOWN_TS)).cast("bigint").alias("fixed_published_at"),
    )


def affects_edges(targets: DataFrame, versions: DataFrame) -> DataFrame:
    """Exact attachment: targets name a version, the fix is dated by a left join."""
    held = versions.select(N.version_purl("name", "version", "eco").alias("pv"), "published_at")
    keyed = targets.withColumn("pv", N.version_purl("package", "version", "eco"))
    dated = versions.select(
        "eco", F.col("name").alias("package"), F.col("version").alias("fixed_version"), F.col("published_at").alias("fixed_published_at")
    )
    return keyed.join(held.select("pv"), "pv", "left_semi").join(dated, ["eco", "package", "fixed_version"], "left").select(
        "advisory_id", "pv", "fixed_version", "introduced_version",
        F.coalesce("fixed_published_at", F.lit(S.UNKNOWN_TS)).cast("bigint").alias("fixed_published_at"),
    )


def unattached(targets: DataFrame, versions: DataFrame) -> DataFrame:
    """Advisory targets without a node, and why."""
    keyed = targets.withColumn("pv", N.version_purl("package", "version", "eco"))
    held = versions.select(N.version_purl("name", "version", "eco").alias("pv")).distinct()
    reason = (
        F.when(F.col("pv").isNull(), "unkeyable name")
        .when(F.col("eco") == "pypi", "PyPI, not in graph").otherwise("not in graph")
    )
    return keyed.join(held, "pv", "left_anti").select("advisory_id", "package", "version", reason.alias("reason"))


def vulnerable(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """Resolved (eco, name, version) that some advisory affects."""
    return resolved.join(targets.select("eco", F.col("package").alias("name"), "version").distinct(), ["eco", "name", "version"], "left_semi")


def enrich(nodes: DataFrame, ranges: DataFrame, meta: DataFrame) -> DataFrame:
    """Advisory details per vulnerable node, package metadata where known.

    ``ranges``: one row per (osv_id, package, introduced, fixed).
    """
    hits = nodes.join(ranges.withColumnRenamed("package", "name"), "name").filter(
        V.loose_contains("version", "introduced", "fixed")
    )
    return (
        hits.groupBy("name", "version", "osv_id").agg(F.min("fixed").alias("fixed"), F.max("severity").alias("severity"))
        .join(meta, "name", "left")
    )
