"""Hit, backhaul, latency, thrashing and dedup metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.functions.traffic import hit_flags, ratio
from edgelake.operators.scale import seen_recently


def classify_hits(measured: DataFrame, edge_max_hop: int, cloud_hop: int) -> DataFrame:
    """Hit flags of requests with a ``distance``."""
    return measured.withColumns(hit_flags(F.col("distance"), edge_max_hop, cloud_hop))


def mark_thrashing(measured: DataFrame, evictions: DataFrame, window_lines: int, cloud_hop: int) -> DataFrame:
    """``thrash``: a request that goes to the cloud for an object evicted at most ``window_lines`` before.

    A request runs before the evictions of its own line, so those do not count.
    """
    marks = evictions.select("object_id", F.col("line_no").alias("_evicted"))
    seen = seen_recently(measured, marks, "object_id", "line_no", "_evicted", window_lines, "_recent")
    return seen.withColumn("thrash", F.col("_recent") * (F.col("distance") >= cloud_hop).cast("int")).drop("_recent")


def request_metrics(measured: DataFrame, edge_max_hop: int, cloud_hop: int) -> DataFrame:
    """One row of totals and ratios of requests with ``distance``, ``viral`` and ``thrash``."""

    def total(col):
        return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")

    viral = F.col("viral")
    sums = classify_hits(measured, edge_max_hop, cloud_hop).agg(
        F.count(F.lit(1)).alias("total_requests"),
        total("is_edge_hit").alias("edge_hit_requests"),
        total("is_local_hit").alias("local_hit_requests"),
        total("is_neighbor_hit").alias("neighbor_hit_requests"),
        total("is_cloud").alias("cloud_requests"),
        total("distance").alias("total_latency"),
        total("viral").alias("viral_requests"),
        total(viral * F.col("distance")).alias("viral_latency_sum"),
        total(viral * F.col("is_cloud")).alias("viral_cloud_requests"),
        total("thrash").alias("cache_thrashing_count"),
    )
    requests = F.col("total_requests")
    return sums.withColumns({
        "edge_hit_ratio": ratio(F.col("edge_hit_requests"), requests),
        "cloud_backhaul_ratio": ratio(F.col("cloud_requests"), requests),
        "avg_latency": ratio(F.col("total_latency"), requests),
        "avg_viral_latency": ratio(F.col("viral_latency_sum"), F.col("viral_requests")),
    })


def node_mean_latency(measured: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean over all nodes of the mean distance of their requests; a node without requests adds 0."""
    per_node = measured.groupBy("node_id").agg(F.avg("distance").alias("latency"))
    return (
        nodes.select("node_id")
        .join(per_node, "node_id", "left")
        .agg(ratio(F.sum("latency"), F.count(F.lit(1))).alias("avg_latency"))
        .fillna({"avg_latency": 0.0})
    )


def dedup_efficiency(metrics: DataFrame, utilization: DataFrame) -> DataFrame:
    """Edge hit ratio per unit of average storage use; both inputs have one row."""
    used = utilization.select("avg_storage_utilization").scalar()
    return metrics.withColumn("avg_storage_utilization", used).withColumn(
        "dedup_efficiency_score", ratio(F.col("edge_hit_ratio"), F.col("avg_storage_utilization"))
    )


def dedup_rates(inserts: DataFrame, deletes: DataFrame, false_deletes: DataFrame | None = None) -> DataFrame:
    """``(adds, deletes, dedup_rate, false_delete_rate)`` from the rows added and deleted."""
    wrong = F.lit(0) if false_deletes is None else false_deletes.agg(F.count(F.lit(1))).scalar()
    gone = deletes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        inserts.agg(F.count(F.lit(1)).alias("adds"))
        .withColumn("deletes", gone)
        .withColumn("dedup_rate", ratio(F.col("deletes"), F.col("adds")))
        .withColumn("false_delete_rate", ratio(wrong, F.col("deletes")))
    )


def run_metrics(metrics: DataFrame, eviction_counts: DataFrame) -> DataFrame:
    """The reported metrics of a run, in report order."""
    counts = eviction_counts
    return metrics.withColumn("evicted_files", counts.select("evicted_files").scalar()).withColumn(
        "evicted_viral_files", counts.select("evicted_viral_files").scalar()
    ).select(
        F.col("total_requests").alias("totalRequests"),
        F.col("edge_hit_ratio").alias("edgeHitRatio"),
        F.col("local_hit_requests").alias("localHitRequests"),
        F.col("neighbor_hit_requests").alias("neighborHitRequests"),
        F.col("cloud_requests").alias("cloudRequests"),
        F.col("cloud_backhaul_ratio").alias("cloudBackhaulRatio"),
        F.col("avg_latency").alias("avgLatency"),
        F.col("viral_requests").alias("viralRequests"),
        F.col("avg_viral_latency").alias("avgViralLatency"),
        F.col("viral_cloud_requests").alias("viralCloudRequests"),
        F.col("evicted_files").alias("evictedFiles"),
        F.col("evicted_viral_files").alias("evictedViralFiles"),
        F.col("cache_thrashing_count").alias("cacheThrashingCount"),
        F.col("avg_storage_utilization").alias("avgStorageUtilization"),
        F.col("dedup_efficiency_score").alias("dedupEfficiencyScore"),
    )
