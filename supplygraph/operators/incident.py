"""The incident overlay: marking a held version compromised, and taking it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplygraph import schema as S


def request(versions: DataFrame, now: int, seconds: int = S.DEFAULT_INCIDENT_SECONDS) -> DataFrame:
    """Incident rows for versions; the id depends on the version alone."""
    return versions.select(
        F.concat(F.lit("SIM-"), F.col("pv")).alias("incident_id"), "pv", F.lit("SIMULATED").alias("status"),
        F.lit(now).cast("bigint").alias("live_from"), F.lit(now + seconds).cast("bigint").alias("live_until"),
    )


def upsert(incident: DataFrame, requested: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents afterwards, refused requests). A version nobody holds is refused."""
    cols = ["incident_id", "pv", "status", "live_from", "live_until"]
    accepted = requested.select(*cols).join(held.select("pv").distinct(), "pv", "left_semi").select(*cols)
    refused = requested.join(held.select("pv").distinct(), "pv", "left_anti").select("pv", F.lit("not held").alias("reason"))
    kept = incident.select(*cols).join(accepted.select("incident_id"), "incident_id", "left_anti").select(*cols)
    return kept.unionByName(accepted), refused


def retract(incident: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents afterwards, per id whether it existed)."""
    gone = ids.select("incident_id").distinct()
    existed = gone.join(
        incident.select("incident_id", F.lit(True).alias("e")).distinct(), "incident_id", "left"
    ).select("incident_id", F.coalesce("e", F.lit(False)).alias("existed"))
    return incident.join(gone, "incident_id", "left_anti"), existed
