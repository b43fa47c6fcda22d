"""Garbage collection of versions, and applying compaction tasks to a list of runs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.model import Versioned


def _goes(spec: Versioned, bottom: bool, drop: Iterable[Column]) -> Column:
    """Whether the newest version of a key up to the watermark is dropped too."""
    out = F.col(spec.deleted) if bottom else F.lit(False)
    return reduce(Column.__or__, drop, out)


def _rank(spec: Versioned) -> Column:
    return F.row_number().over(Window.partitionBy(*spec.keys).orderBy(F.col(spec.ts).desc()))


def retain(changelog: DataFrame, spec: Versioned, mark: object, bottom: bool, drop: Iterable[Column] = ()) -> DataFrame:
    """The versions that compaction keeps.

    Everything newer than the watermark ``mark``, which needs no shuffle; of the others the newest of each key, unless it deletes and there is
    nothing below (``bottom``), or one of the ``drop`` filters takes it. Spark limits that to one version of a key per task before the shuffle.
    """
    new = changelog.where(F.col(spec.ts) > F.lit(mark))
    old = changelog.where(F.col(spec.ts) <= F.lit(mark)).withColumn("__rn", _rank(spec)).where("__rn = 1").drop("__rn")
    return new.unionByName(old.where(~_goes(spec, bottom, drop)))


def reclaimed(changelog: DataFrame, spec: Versioned, mark: object, bottom: bool, drop: Iterable[Column] = ()) -> DataFrame:
    """The versions that compaction drops, from one window over those up to the watermark."""
    old = changelog.where(F.col(spec.ts) <= F.lit(mark)).withColumn("__rn", _rank(spec))
    return old.where((F.col("__rn") > 1) | _goes(spec, bottom, drop)).drop("__rn")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of runs ``(a_run, b_run)`` whose key ranges meet. Run statistics have one row per run: the smaller list is broadcast by size."""
    x = a.select(F.col("run_id").alias("a_run"), F.col("first_key").alias("a_first"), F.col("last_key").alias("a_last"))
    y = b.select(F.col("run_id").alias("b_run"), F.col("first_key").alias("b_first"), F.col("last_key").alias("b_last"))
    return x.join(y, (F.col("a_first") <= F.col("b_last")) & (F.col("a_last") >= F.col("b_first"))).select("a_run", "b_run")
