"""What is known of each run, and which runs a read can skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.bloom import MOST_HASHES, runs_with
from palimpsest.functions.keys import UNBOUNDED, Bound, overlaps, prefix_overlaps


def run_stats(rows: DataFrame, run: str, key: str, ts: str, deleted: str | None = None) -> DataFrame:
    """``run_id, first_key, last_key, max_ts, n_rows`` (and ``n_deleted``) for each run; one map-side combined aggregation."""
    more = [F.sum(F.col(deleted).cast("bigint")).alias("n_deleted")] if deleted else []
    return rows.groupBy(F.col(run).alias("run_id")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max(ts).alias("max_ts"), F.count("*").alias("n_rows"), *more)


def prune_range(stats: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    return stats.where(overlaps(F.col("first_key"), F.col("last_key"), lower, upper))


def prune_key(stats: DataFrame, key: object, blooms: DataFrame | None = None, bits: int = 0, hashes: int = 0) -> DataFrame:
    """Runs whose key range holds the key, and whose Bloom filters (``run_id, bit``), if given, may contain it."""
    out = stats.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key)))
    return out if blooms is None or hashes > MOST_HASHES else out.join(runs_with(blooms, "run_id", key, bits, hashes), "run_id", "left_semi")


def prune_prefix(stats: DataFrame, prefix: str) -> DataFrame:
    return stats.where(prefix_overlaps(F.col("first_key"), F.col("last_key"), prefix))


def level_stats(runs: DataFrame) -> DataFrame:
    """Per level its number of runs, rows and newest version."""
    return runs.groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("n_rows").alias("n_rows"), F.max("max_ts").alias("max_ts"))


def state_dump(runs: DataFrame) -> DataFrame:
    """Per level the ids of its runs, ascending, as text. One row per level; runs are metadata."""
    return runs.groupBy("level").agg(F.array_join(F.array_sort(F.collect_list("run_id")).cast("array<string>"), ",").alias("runs"))


def replay_log(log: DataFrame, key: str, seq: str, value: str, checksum: str) -> DataFrame:
    """The last value of each key in a write-ahead log, up to the first record whose crc32 doesn't match."""
    good = F.crc32(F.concat_ws("|", F.col(key).cast("string"), F.col(seq).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(""))).cast("binary")) == F.col(checksum)
    broken = log.where(~good).agg(F.min(seq).alias("broken"))
    whole = log.join(F.broadcast(broken)).where(F.col("broken").isNull() | (F.col(seq) < F.col("broken")))
    return whole.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def log_checksum(key: Column, seq: Column, value: Column) -> Column:
    return F.crc32(F.concat_ws("|", key.cast("string"), seq.cast("string"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"))


def replay_manifest(records: DataFrame) -> DataFrame:
    """``run_id`` of the runs that live after flushes and compactions ``(seq, kind, added array, removed array)``.

    A run lives if its last mention adds it; that is one aggregation, in whatever order the records come.
    """
    added = records.select("seq", F.explode("added").alias("run_id"), F.lit(True).alias("lives"))
    removed = records.select("seq", F.explode("removed").alias("run_id"), F.lit(False).alias("lives"))
    last = added.unionByName(removed).groupBy("run_id").agg(F.max_by("lives", F.struct("seq", "lives")).alias("lives"))
    return last.where("lives").select("run_id")
