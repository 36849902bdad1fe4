"""Writers. Each is idempotent: running one twice leaves the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S


def merge_nodes(existing: DataFrame, staged: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by key, property by property: the latest value that says something.

    0, false, "" and NULL never replace a value. ``order`` is the arrival order
    (existing rows come before staged ones).
    """
    both = existing.withColumn("_age", F.struct(F.lit(0).alias("s"), F.col(order).alias("o"))).unionByName(
        staged.withColumn("_age", F.struct(F.lit(1).alias("s"), F.col(order).alias("o")))
    )
    types = dict(existing.dtypes)

    def says(c: str) -> Column:
        kind = types[c]
        if kind == "string":
            return F.col(c) != ""
        if kind == "boolean":
            return F.col(c)
        return F.col(c) != 0

    props = [c for c in existing.columns if c not in (key, order)]
    best = [
        F.coalesce(F.max_by(c, F.when(says(c), F.col("_age"))), F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_age")))).alias(c)
        for c in props
    ]
    return both.groupBy(key).agg(*best)


def replace_nodes(existing: DataFrame, staged: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by key, whole row: the last one staged wins."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(staged.withColumn("_s", F.lit(1)))
    props = [c for c in existing.columns if c not in (key, order)]
    last = F.max_by(F.struct(*props), F.struct("_s", order))
    return both.groupBy(key).agg(last.alias("_r")).select(key, "_r.*")


def merge_edges(existing: DataFrame, staged: DataFrame, order: str) -> DataFrame:
    """An edge is unique per (src, dst); writing it again overwrites it."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(staged.withColumn("_s", F.lit(1)))
    props = [c for c in existing.columns if c not in ("src", "dst", order)]
    if not props:
        return both.select("src", "dst").distinct()
    last = F.max_by(F.struct(*props), F.struct("_s", order))
    return both.groupBy("src", "dst").agg(last.alias("_r")).select("src", "dst", "_r.*")


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Replaces the touched partitions only; a table without partitions whole.

    Rows that come from ``path`` itself are refused: they would be lost while
    they are read. Write such a merge to a new folder.
    """
    if any(f.split(":", 1)[-1].lstrip("/").startswith(path.split(":", 1)[-1].strip("/") + "/") for f in df.inputFiles()):
        raise ValueError(f"the rows to write are read from {path}")
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    writer.parquet(path)


def advisory_documents(findings: DataFrame, ecosystem: str) -> DataFrame:
    """One document per (advisory, package): versions, fixes, aliases, links.

    ``findings``: osv_id, package, version, ecosystem, fixed_version, aliases
    and references (arrays), severity_label, published.
    """
    rows = findings.filter(F.lower("ecosystem") == ecosystem)
    # one advisory names the versions of one package, which bounds each list
    return rows.groupBy(F.col("osv_id").alias("advisory_id"), "package").agg(
        F.lit(ecosystem).alias("ecosystem"),
        F.sort_array(F.collect_set("version")).alias("affected_versions"),
        F.sort_array(F.collect_set(F.nullif("fixed_version", F.lit("")))).alias("fixed_versions"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("references")))).alias("references"),
        F.max("severity_label").alias("severity"), F.max("published").alias("published_at"),
    )


def findings_csv(findings: DataFrame) -> DataFrame:
    """The 15 columns as text, nothing missing."""
    flat = lambda c: F.array_join(c, " | ") if dict(findings.dtypes)[c].startswith("array") else F.col(c).cast("string")
    have = set(findings.columns)
    return findings.select(*[F.coalesce(flat(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in S.FINDING_COLUMNS])


def exposure_csv(paths: DataFrame) -> DataFrame:
    """Flat rows of exposure paths: vulnerable, exposed, depth, path."""
    return paths.select(
        F.col("pv").alias("vulnerable"), F.col("node").alias("exposed"), F.col("depth").cast("string").alias("depth"),
        F.array_join("path", " -> ").alias("path"),
    )


def edges_csv(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("parent"), F.col("dst").alias("child"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
