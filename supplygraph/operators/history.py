"""Ordered windows that survive one very large group.

A plain window sorts each group in one task. Here a group is cut into slices
of time (or any monotone integer), each slice is its own window partition, and
what a slice needs from its neighbours travels separately: the last row of the
previous slice, the number of rows before it, or a short halo of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# an hour: a package with a third of all rows still spreads over thousands of
# slices a year, while a halo of a quarter of an hour copies a quarter of the rows
SLICE_SECONDS = 3600


def _slice(ts: str, width: int) -> Column:
    return F.floor(F.col(ts) / F.lit(width)).cast("bigint")


def with_previous(
    df: DataFrame, group: str, ts: str, tie: str, cols: Sequence[str], width: int = SLICE_SECONDS
) -> DataFrame:
    """Adds ``seq`` (1-based position) and ``previous`` (struct, NULL at first)."""
    row = F.struct(*cols)
    sliced = df.withColumn("_slice", _slice(ts, width))
    tails = sliced.groupBy(group, "_slice").agg(
        F.count("*").alias("_n"), F.max_by(row, F.struct(ts, tie)).alias("_last")
    )
    over_slices = Window.partitionBy(group).orderBy("_slice")
    before = tails.select(
        group, "_slice",
        F.lag("_last").over(over_slices).alias("_carried"),
        (F.sum("_n").over(over_slices) - F.col("_n")).alias("_offset"),
    )
    inside = Window.partitionBy(group, "_slice").orderBy(ts, tie)
    return (
        sliced.withColumn("_row", F.row_number().over(inside))
        .withColumn("_lag", F.lag(row).over(inside))
        .join(before, [group, "_slice"])
        .withColumn("seq", F.col("_offset") + F.col("_row"))
        .withColumn("previous", F.coalesce("_lag", "_carried"))
        .drop("_slice", "_row", "_lag", "_carried", "_offset")
    )


def with_halo(df: DataFrame, ts: str, reach_seconds: int, width: int) -> DataFrame:
    """Copies the last ``reach_seconds`` of each slice into the next one."""
    here = _slice(ts, width)
    late = (F.col(ts) - here * F.lit(width)) >= F.lit(width - reach_seconds)
    slices = F.when(late, F.array(here, here + 1)).otherwise(F.array(here))
    return (
        df.withColumn("_home", here)
        .withColumn("_slice", F.explode(slices))
        .withColumn("_halo", F.col("_slice") != F.col("_home"))
        .drop("_home")
    )
