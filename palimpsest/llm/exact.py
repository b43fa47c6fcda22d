"""Exact deduplication as a stateful stream, in DataFrame and SQL functions only.

Texts are compared without the characters ``[\\x20\\x09-\\x0D]``. Digests are staged in the shared folder and streamed in micro-batches
into keyed RocksDB state that never expires: per digest the identifier of the row that stays (most code points in the original text, then
smallest doc_id), the locator of its content (source file and row) and the number of rows. The state is read back as a table.
Digest hits are not trusted: the full normalised bytes of all rows with a shared digest are compared with the bytes at the locator, by way of the
least and the greatest text of each digest, which combine on the map side, so a digest with a third of all rows moves three texts per task.
Where they differ, the rows are grouped by their whole text instead.

Null text is empty, and all empty (or all-blank) texts are equal. Rows that repeat doc_id and text form one group, of which one row
counts as kept. Ties in length go to the smaller doc_id; a null one counts as larger than all. Empty tables give empty results. Other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import id_text, marked, with_key, written
from palimpsest.sources.scratch import scratch

FILES_PER_BATCH = 1024
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State settings of the stream: RocksDB on the executors' disks, its memory bounded, only changes uploaded at each batch.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _apart(spark: SparkSession) -> SparkSession:
    """A session for the stream, with the settings of ``spark`` and those of the state; other queries keep theirs."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    for k, v in _STATE.items():
        own.conf.set(k, v)
    return own


def _keyed_state(spark: SparkSession, staged: str, schema) -> DataFrame:
    """Stream the staged digests through keyed state; ``digest, keep_id, keep_row, locator, group_size`` from what the state retains."""
    own, at = _apart(spark), scratch(spark, "dedup-state")
    (
        own.readStream.schema(schema)
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .parquet(staged)
        .groupBy("digest")
        .agg(F.max(F.struct("n_code_points", F.negate("doc_id").alias("minus_id"), F.negate("row").alias("minus_row"), "locator")).alias("keep"), F.count("*").alias("n"))
        .writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", at)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    state = own.read.format("statestore").load(at)
    value = state.schema["value"].dataType.fieldNames()
    keep = F.col(f"value.{value[0]}")
    kept = state.select("key.digest", F.negate(keep["minus_id"]).alias("keep_id"), F.negate(keep["minus_row"]).alias("keep_row"), keep["locator"].alias("locator"), F.col(f"value.{value[1]}").alias("group_size"))
    to = scratch(spark, "dedup-kept")
    kept.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(kept.schema).parquet(to)


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, locator``; the locator leads to the text that stays.

    ``digest`` names the texts; a weak one gives the same result, with more bytes to compare.
    """
    return _judged(*with_key(docs), digest).drop("row")


def _judged(named: DataFrame, key: str, digest: Callable[[Column], Column]) -> DataFrame:
    spark = named.sparkSession
    texts = id_text(named, F.col(key).alias("row"), F.input_file_name().alias("file")).withColumn("norm", normalised(F.col("text")))
    rows = texts.select("doc_id", "row", F.length("text").cast("long").alias("n_code_points"), F.struct("file", "row").alias("locator"), "norm")
    rows = rows.withColumn("text_sha256", sha256_hex(F.col("norm"))).withColumn("digest", F.col("text_sha256") if digest is sha256_hex else digest(F.col("norm"))).drop("norm")
    staged = scratch(spark, "dedup-staged")
    rows.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged).drop("locator")
    kept = _keyed_state(spark, staged, spark.read.parquet(staged).schema)
    out = rows.join(kept, "digest")
    hits = rows.join(kept.where("group_size > 1").select("digest", "keep_row"), "digest").select("row", "digest", (F.col("row") == F.col("keep_row")).alias("located"))
    hits = written(spark, hits, "dedup-hits")
    texts = marked(texts.select("row", "norm"), hits, "row").where("maybe").drop("maybe").join(hits.hint("merge"), "row")
    ends = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"), F.max(F.when(F.col("located"), F.col("norm"))).alias("there"))
    differ = written(spark, ends.where("least != there or greatest != there").select("digest"), "dedup-collisions")
    columns = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "locator", "row"]
    if not differ.take(1):
        return out.select(*columns)
    apart = out.join(differ, "digest", "left_anti").select(*columns)
    # texts that only share a digest: each whole text is a key of its own
    one = rows.join(texts.join(differ, "digest", "left_semi").select("row", "norm"), "row")
    place = spark.read.parquet(staged).select("row", "locator")
    first = one.groupBy("norm").agg(F.max(F.struct("n_code_points", F.negate("doc_id").alias("minus_id"), F.negate("row").alias("minus_row"))).alias("k"), F.count("*").alias("group_size"))
    first = first.select("norm", F.negate("k.minus_id").alias("keep_id"), F.negate("k.minus_row").alias("keep_row"), "group_size")
    first = first.join(place.withColumnRenamed("row", "keep_row"), "keep_row")
    return apart.unionByName(one.join(first, "norm").select(*columns))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    named, key = with_key(docs)
    kept = _judged(named, key, sha256_hex).where("kept").select(F.col("row").alias(key))
    return named.join(kept.hint("merge"), key, "left_semi").drop(key)
