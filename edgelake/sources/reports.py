"""Reports of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_long(metrics: DataFrame) -> DataFrame:
    """One row of metrics to rows ``(metric, value)``."""
    wide = metrics.select(*[F.col(c).cast("double") for c in metrics.columns])
    return wide.unpivot([], list(wide.columns), "metric", "value")


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics_long(metrics).write.mode("overwrite").csv(path, header=True)


def run_summary(dedup: DataFrame, fpr: DataFrame, memory: DataFrame, latency: DataFrame) -> DataFrame:
    """One row of a run: the counters of a sweep, the filter rates and sizes, the latency.

    ``dedup`` has the columns of ``operators.metrics.dedup_rates`` and ``message_overhead``; ``fpr``
    and ``memory`` have a row per viewer, a list bounded by the number of nodes.
    """
    rates = fpr.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("viewer", "fpr"))), lambda r: r["fpr"]).alias("fpr_data")
    )
    sizes = memory.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("viewer", "bits"))), lambda r: r["bits"]).alias("memory")
    )
    return dedup.select(
        "*",
        rates.select("fpr_data").scalar().alias("fpr_data"),
        sizes.select("memory").scalar().alias("memory"),
        latency.select("avg_latency").scalar().alias("average_latency"),
    )


def write_run_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
