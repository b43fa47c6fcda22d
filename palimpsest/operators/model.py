"""What makes a DataFrame a changelog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Versioned:
    """Columns of a changelog: keys, version, and which rows delete.

    ``deleted`` is a boolean column; ``empty_value_deletes`` makes one from an opaque value. Versions order as their type does, newest last;
    ``(key, ts)`` is unique within a run.
    """

    keys: tuple[str, ...]
    ts: str = "ts"
    deleted: str = "deleted"

    def key_columns(self) -> list[Column]:
        return [F.col(k) for k in self.keys]


def empty_value_deletes(df: DataFrame, value: str, deleted: str = "deleted") -> DataFrame:
    """Adds the flag for stores in which a null or empty value means deletion."""
    return df.withColumn(deleted, F.coalesce(F.octet_length(F.col(value).cast("string")) == 0, F.lit(True)))


def require_keys(df: DataFrame, spec: Versioned) -> DataFrame:
    """Fails the job on a null or empty key."""
    bad = F.lit(False)
    for k in spec.keys:
        bad = bad | F.col(k).isNull() | F.coalesce(F.octet_length(F.col(k).cast("string")) == 0, F.lit(False))
    return df.where(F.assert_true(~bad, F.lit("null or empty key")).isNull())
