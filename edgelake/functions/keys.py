"""Object ids and node numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ids are taken modulo the largest signed 64-bit number.
ID_MODULUS = 9223372036854775807


def object_id(key: Column) -> Column:
    """Id of a text key: first 8 bytes of SHA-256 as a signed number, floor-modulo 2^63 - 1."""
    head = F.substring(F.sha2(key, 256), 1, 16)
    return F.pmod(F.conv(head, 16, -10).cast("bigint"), F.lit(ID_MODULUS).cast("bigint"))


def route(number: Column, n_nodes: int) -> Column:
    """Node that serves a client number; never negative."""
    return F.pmod(number, F.lit(n_nodes).cast("bigint")).cast("int")


def is_get(operation: Column) -> Column:
    return F.lower(F.trim(operation)) == "get"
