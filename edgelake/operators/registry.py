"""Registry of viral objects: flags that expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.operators.scale import lookup_join, seen_recently
from edgelake.schemas import REGISTRY, VIRAL_TTL_SECONDS
from edgelake.sources.tables import upsert

# Fixed value: the status text of a viral object.
VIRAL = "TRUE"


def viral_flags(scores: DataFrame, scored_at: Column, ttl: int = VIRAL_TTL_SECONDS) -> DataFrame:
    """Registry rows of the positive scores ``(object_id, prediction)``, one per object.

    Of several scores of an object the latest flag counts.
    """
    flags = scores.where(F.col("prediction") == 1).groupBy("object_id").agg(F.max(scored_at).alias("scored_at"))
    return flags.select(
        "object_id",
        F.lit(VIRAL).alias("status"),
        "scored_at",
        (F.col("scored_at") + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"),
    )


def put_viral(registry: DataFrame, flags: DataFrame) -> DataFrame:
    """Registry with the flags set; a flag that is set again lives on from its new time."""
    return upsert(registry.select(*REGISTRY.fieldNames()), flags.select(*REGISTRY.fieldNames()), ["object_id"])


def live_flags(registry: DataFrame, at: Column, any_case: bool = True) -> DataFrame:
    """Objects flagged at a time. A lookup of many ids takes the status in any case, of one id only as is."""
    status = F.upper("status") if any_case else F.col("status")
    return registry.where(
        (status == VIRAL) & (F.col("scored_at") <= at) & (at < F.col("expires_at"))
    ).select("object_id")


def get_viral(ids: DataFrame, registry: DataFrame, at: Column, any_case: bool = True) -> DataFrame:
    """The ids that are flagged at a time; an id without a flag is not viral."""
    return lookup_join(ids, live_flags(registry, at, any_case), ["object_id"], "left_semi")


def add_viral_flag(requests: DataFrame, flags: DataFrame, ttl: int = VIRAL_TTL_SECONDS) -> DataFrame:
    """``viral``: whether the object of a request was flagged at the time of the request.

    ``flags`` is the history of all flags set, ``(object_id, scored_at)``; each lives ``ttl`` seconds.
    """
    micros = 1_000_000
    rows = requests.withColumn("_at", F.unix_micros("ts"))
    marks = flags.select("object_id", F.unix_micros("scored_at").alias("_scored"))
    return seen_recently(
        rows, marks, "object_id", "_at", "_scored", ttl * micros, "viral", include_now=True
    ).drop("_at")
