"""How rows fall into blocks, and what blocks say about them: layout, metadata, look-up, shared prefixes, samples for a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Writer options by codec name.
CODECS = {"none": "uncompressed", "zstd": "zstd", "zlib": "gzip", "lz4": "lz4_raw"}


def codec_options(name: str) -> dict[str, str]:
    """Options for ``df.write.options(**...)``; unknown codecs raise ValueError."""
    if name.lower() not in CODECS:
        raise ValueError(f"no such codec: {name}")
    return {"compression": CODECS[name.lower()]}


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of an entry: key, eight bytes of version, value."""
    return (F.octet_length(key.cast("string")) + 8 + F.coalesce(F.octet_length(value.cast("string")), F.lit(0))).cast("bigint")


def layout(rows: DataFrame, run: list[str], order: list[Column], size: Column, block_bytes: int) -> DataFrame:
    """Adds ``block``: entries of a run in order, ``block_bytes`` of them to a block by where they begin.

    Runs are laid out independently, each in its own window; a run is one file's worth of rows and so bounded.
    """
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("block", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / block_bytes).cast("bigint"))


def block_metadata(rows: DataFrame, run: list[str], key: str, ts: str) -> DataFrame:
    """Per block its first and last key, newest version and number of entries."""
    return rows.groupBy(*run, "block").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max(ts).alias("max_ts"), F.count("*").alias("n_entries"))


def find_block(metadata: DataFrame, run: list[str], keys: DataFrame, key: str) -> DataFrame:
    """The last block of a run that begins at or before a key, for each ``(run.., key)`` asked: a running maximum over block starts and keys,
    no range join. A look-up asks the runs that its key's pruning leaves."""
    starts = metadata.where("first_key is not null").select(*run, F.col("first_key").alias(key), F.lit(False).alias("__asked"), F.struct("first_key", "block").alias("__at"))
    asked = keys.where(F.col(key).isNotNull()).select(*run, key).distinct()
    both = starts.unionByName(asked.withColumns({"__asked": F.lit(True), "__at": F.lit(None).cast(starts.schema["__at"].dataType)}))
    w = Window.partitionBy(*run).orderBy(key, "__asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__at", F.max("__at").over(w)).where("__asked and __at is not null").select(*run, key, F.col("__at.block").alias("block"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(acc))


def dictionary_sample(rows: DataFrame, run: list[str], order: list[Column]) -> DataFrame:
    """The rows that train a dictionary: the first twenty of each run, then every hundredth."""
    n = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    return rows.withColumn("n", n.cast("bigint")).where("n <= 20 or n % 100 = 0")
