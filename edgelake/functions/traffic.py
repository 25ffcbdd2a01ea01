"""Growth of traffic and classes of a served request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def growth_rate(current: Column, previous: Column) -> Column:
    previous = F.coalesce(previous, F.lit(0))
    return (current - previous) / (previous + 1)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0.0 where there is nothing to divide by."""
    return F.when(F.coalesce(denominator, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator
    )


def hit_flags(distance: Column, edge_max_hop: int, cloud_hop: int) -> dict[str, Column]:
    """Local, neighbour, edge and cloud flags of a distance; a hop between the limits is neither."""
    return {
        "is_local_hit": (distance == 0).cast("int"),
        "is_neighbor_hit": ((distance > 0) & (distance <= edge_max_hop)).cast("int"),
        "is_edge_hit": (distance <= edge_max_hop).cast("int"),
        "is_cloud": (distance >= cloud_hop).cast("int"),
    }
