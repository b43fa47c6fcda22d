"""Bloom filters as relations of bit positions, by double hashing of md5, which any SQL engine can reproduce."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits_per_key(rate: float) -> int:
    """Bits for each key at a false positive rate."""
    return math.ceil(-math.log(rate) / math.log(2) ** 2)


def n_hashes(bits: int) -> int:
    return min(30, max(1, int(bits * 0.69)))


def n_bits(keys: int, rate: float) -> int:
    return max(64, keys * bits_per_key(rate))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The positions of a key: ``(h1 + i * h2) mod bits``."""
    digest = F.md5(key.cast("string"))
    h1 = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    h2 = F.conv(F.substr(digest, F.lit(9), F.lit(8)), 16, 10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def build(keys: DataFrame, key: str, bits: int, hashes: int, by: list[str] | None = None) -> DataFrame:
    """``[by], bit``: the bits set, for each group."""
    by = by or []
    return keys.select(*by, F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()


MOST_HASHES = 30


def probe(candidates: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The candidate rows that the filter may contain: all their positions are set. The set has ``bits`` rows at most, so it joins, never collects."""
    if hashes > MOST_HASHES:  # a filter that says nothing
        return candidates
    asked = candidates.select(F.col(key), F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("bit")).distinct()
    needed = asked.groupBy(key).agg(F.count("*").alias("needed"))
    held = asked.join(bloom, "bit").groupBy(key).agg(F.count("*").alias("held"))
    maybe = needed.join(held, key).where("needed = held").select(key)
    return candidates.join(maybe, key, "left_semi")


def runs_with(blooms: DataFrame, run: str, key: object, bits: int, hashes: int) -> DataFrame:
    """The runs whose filters (``run, bit``, see build()) may contain one key."""
    wanted = blooms.sparkSession.range(1).select(F.explode(F.array_distinct(positions(F.lit(key), bits, hashes))).alias("bit"))
    needed = wanted.agg(F.count("*").alias("needed"))
    held = blooms.join(F.broadcast(wanted), "bit", "left_semi").groupBy(run).agg(F.count("*").alias("held"))
    return held.join(F.broadcast(needed)).where("needed = held").select(run)
