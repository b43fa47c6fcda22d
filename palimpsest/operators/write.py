"""Writes: batches that get one version, and how rows roll over into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.model import Versioned


def dedupe_batch(batch: DataFrame, spec: Versioned, order: str, by: list[str] | None = None) -> DataFrame:
    """Of a batch's records for one key the last stays. ``by``: columns that name the batch, if there are several."""
    w = Window.partitionBy(*(by or []), *spec.keys).orderBy(F.col(order).desc())
    return batch.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def stamp(batch: DataFrame, spec: Versioned, latest: int) -> DataFrame:
    """The batch with its one version, the next after ``latest``."""
    return batch.withColumn(spec.ts, F.lit(latest + 1).cast("bigint"))


def puts(batch: DataFrame, spec: Versioned) -> DataFrame:
    return batch.withColumn(spec.deleted, F.lit(False))


def deletes(keys: DataFrame, spec: Versioned, like: DataFrame) -> DataFrame:
    """Deletion rows for keys (present or not), with the columns of ``like``."""
    fields = {f.name: f.dataType for f in like.schema}
    return keys.select(*[F.col(c) if c in spec.keys else F.lit(True).alias(c) if c == spec.deleted else F.lit(None).cast(t).alias(c) for c, t in fields.items()])


def roll(rows: DataFrame, spec: Versioned, size: Column, target_bytes: int, ranges: str) -> DataFrame:
    """``key.., run``: which output run each key goes to. A run ends once it has ``target_bytes``; versions of a key stay together.

    Sizes are added up per key first. The running sum goes within coarse key ranges (column ``ranges``), each of which starts a run of its own,
    so no task sees all keys.
    """
    per_key = rows.groupBy(ranges, *spec.keys).agg(F.sum(size).alias("__size"))
    w = Window.partitionBy(ranges).orderBy(*spec.keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__size").over(w), F.lit(0))
    return per_key.select(ranges, *spec.keys, F.floor(before / target_bytes).cast("bigint").alias("run"))
