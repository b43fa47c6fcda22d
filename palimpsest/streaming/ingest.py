"""Changelog streams: each micro-batch becomes one version of a store, or folds into the latest row of each key."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.model import Versioned


_ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def _adaptive(stream: SparkSession, own: SparkSession):
    """Streams with state run without adaptive plans. What is done with a batch, whose plan stands by then, may have them, or a run has a file for
    each shuffle partition, each with a Bloom filter."""
    before = stream.conf.get(_ADAPTIVE)
    stream.conf.set(_ADAPTIVE, own.conf.get(_ADAPTIVE))
    try:
        yield
    finally:
        stream.conf.set(_ADAPTIVE, before)


def ingest(stream: DataFrame, store, checkpoint: str, order: str, compact_every: int = 8) -> StreamingQuery:
    """Write each micro-batch (``key, value, deleted`` and ``order``) as one version; compaction runs between batches.

    ``order`` decides over all batches: the stream's state keeps the newest row of each key, and that is what a batch with rows of the key
    writes. So a row that comes late never replaces a newer one, and compaction may drop a deletion that later rows still have to respect.
    The manifest keeps the number of the newest batch of each checkpoint, so a batch that is replayed after a crash is not written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.batches.get(checkpoint, -1) >= number:
            batch.write.format("noop").mode("overwrite").save()  # the state of this batch may not have been saved
        else:
            with _adaptive(batch.sparkSession, store.spark):
                store.write_batch(batch, order, (checkpoint, number))
        if number % compact_every == compact_every - 1:
            store.compact()

    if "deleted" not in stream.columns:
        stream = stream.withColumn("deleted", F.lit(False))
    newest = latest(stream, Versioned(("key",), order), ["value"])
    return newest.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stream: DataFrame, spec: Versioned, columns: list[str]) -> DataFrame:
    """A streaming table of the newest version of each key, deletions included; by commit version, so late rows never replace newer ones."""
    value = F.struct(F.col(spec.ts), F.col(spec.deleted), *[F.col(c) for c in columns])
    return stream.groupBy(*spec.keys).agg(F.max(value).alias("v")).select(*spec.keys, "v.*")
