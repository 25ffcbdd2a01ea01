"""Hashes and sizes of membership filters."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five primes of the 64-bit xxHash, and the seed Spark hashes with.
PRIMES = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)
SPARK_SEED = 42

_WORD = 1 << 64


def _unshift(x: int, n: int) -> int:
    """The y for which ``y ^ (y >> n)`` is x."""
    y = x
    for _ in range(64 // n):
        y = x ^ (y >> n)
    return y


def _rotate_right(x: int, n: int) -> int:
    return (x >> n | x << (64 - n)) % _WORD


@functools.cache
def seed_key(seed: int) -> int:
    """The bigint that Spark's ``xxhash64`` maps to ``seed``.

    Of several columns Spark hashes each with the hash of those before it as its seed, so a first
    column with this number sets the seed of the next. The hash of one word is a chain of steps that
    all have an inverse; this walks them back.
    """
    p1, p2, p3, p4, p5 = PRIMES
    x = _unshift(seed % _WORD, 32) * pow(p3, -1, _WORD) % _WORD
    x = _unshift(x, 29) * pow(p2, -1, _WORD) % _WORD
    x = (_unshift(x, 33) - p4) * pow(p1, -1, _WORD) % _WORD
    word = _rotate_right(x, 27) ^ (SPARK_SEED + p5 + 8) % _WORD
    word = _rotate_right(word * pow(p1, -1, _WORD) % _WORD, 31) * pow(p2, -1, _WORD) % _WORD
    return word - _WORD if word >= _WORD // 2 else word


def seeded_hash(value: Column, seed: int) -> Column:
    """64-bit xxHash of a bigint column with a chosen seed."""
    return F.xxhash64(F.lit(seed_key(seed)).cast("bigint"), value.cast("bigint"))


def bloom_bits_per_entry(false_positive_rate: Column | float) -> Column | int:
    """Bits per entry of a Bloom filter for a rate; a column of rates gives a column."""
    if isinstance(false_positive_rate, Column):
        return F.ceil(-F.log(false_positive_rate) / math.log(2) ** 2).cast("bigint")
    return math.ceil(-math.log(false_positive_rate) / math.log(2) ** 2)


def bloom_hash_count(bits_per_entry: Column | int) -> Column | int:
    """Hash functions that suit so many bits per entry."""
    if isinstance(bits_per_entry, Column):
        return F.floor(bits_per_entry * math.log(2) + 0.5).cast("bigint")
    return math.floor(bits_per_entry * math.log(2) + 0.5)


def bloom_positions(value: Column, n_bits: int, n_hashes: int) -> Column:
    """Bit positions of a value; positions may repeat, and a repeat counts."""
    size = F.lit(n_bits).cast("bigint")
    first = seeded_hash(value, 0)
    rest = [seeded_hash(first, i) for i in range(1, n_hashes)]
    return F.array(*[F.abs(h % size) for h in [first, *rest]])


def fingerprint_bits(volume: Column, false_positive_rate: float) -> Column:
    """Bits of a fingerprint that keep ``volume`` entries under the rate."""
    return F.ceil((F.log(volume.cast("double")) - math.log(false_positive_rate)) / math.log(2)).cast("int")


def fingerprint(value: Column, n_bits: Column) -> Column:
    """Low ``n_bits`` bits of the hash (``n_bits`` below 63)."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), n_bits.cast("int")) - 1
    return seeded_hash(value, 0).bitwiseAND(mask)
