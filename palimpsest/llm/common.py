"""Helpers shared by the text operators: reading tables, shared folders, packed rows, vectorised text scans."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.scratch import scratch

#: Text bytes a Python worker handles at once; numpy temporaries are a small multiple of it.
CHUNK_BYTES = 4 << 20

#: Odd 64-bit multiplier (golden ratio) used by every hash here.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc_id, text)`` and ``more`` only: whatever else the input carries can't clash with an output. Null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of the tables that ``df`` reads: for files their bytes; 0 for what has no known size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return sum(n for n in sizes if n < 1 << 60)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names every row, and the name of that column.

    It is doc_id where that is unique and never null, which is looked up here; such names of neighbouring rows compress well. Else the table is
    written once with a number for each row, so that rows keep theirs however often they are read.
    """
    name, known = fresh_name(docs, "row_key"), F.col("doc_id").cast("long")
    if not docs.groupBy(known.alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").take(1):
        return docs.withColumn(name, known), name
    return written(docs.sparkSession, docs.withColumn(name, F.monotonically_increasing_id()), "named"), name


def written(spark: SparkSession, df: DataFrame, what: str, narrow: bool = False) -> DataFrame:
    """Cut the lineage at a Parquet table in the shared folder; lost executors cost only their running tasks.

    narrow: rows of a few numbers each, written by one task per core rather than one per shuffle partition.
    """
    path = scratch(spark, what)
    if narrow:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of the set that marked() broadcasts, at most (64 MB).
MOST_BITS = 1 << 29


def marked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with a flag ``maybe``: whether their ``key``, a long, is among those of ``wanted`` (or one of few others). What is not can do without a join.

    The set is a bit map of at most MOST_BITS bits, eight to a key wanted where that is less, made and looked up in SQL functions; its size is known, so it is
    broadcast. ``wanted`` is read twice.
    """
    bits = min(MOST_BITS, max(1 << 20, 1 << (8 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits)) + 1  # the bit map functions count from 1
    maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substr("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce((F.call_function("shiftright", byte, (at % 8).cast("int")) % 2) == 1, F.lit(False))
    return rows.withColumn("part", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "part", "left").withColumn("maybe", maybe).drop("part", "map")


def dropped(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete what written() made, once nothing that is still to run reads it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for df in tables:
        if df is not None and (files := df.inputFiles()):
            at = path(files[0]).getParent()
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# ---- workers

_MODEL: dict[str, object] = {}


def model(name: str, build: Callable[[], object]) -> object:
    """What this worker has built under a name. It keeps one such thing, so those of operators that follow each other don't add up."""
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = build()
    return _MODEL[name]


def trim() -> None:
    """Give unused memory back to the system."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def frugal(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. Spark uses its workers again: after each task they give what they don't need back to the system."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()  # by name: what a module holds is not shipped with the function

    return whole


def chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """``(doc ids, texts)`` of about ``size`` bytes; a longer text comes alone."""
    for b in batches:
        ids = b.column("doc_id")
        texts = b.column("text")
        if not len(ids):
            continue
        length = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(ids) + 1])
        at, start, total = 0, 0, 0
        for at, n in enumerate(length.tolist()):
            if total and total + n > size:
                yield ids[start:at], texts[start:at].to_pylist()
                start, total = at, 0
            total += n
        yield ids[start:], texts[start:].to_pylist()


def filtered(batches: Iterable[pa.RecordBatch], keep: Callable[[list[str]], Sequence[bool]], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of whole batches, all columns, whose text ``keep`` accepts; null text is empty."""
    for b in batches:
        mask: list[bool] = []
        text = b.column("text").fill_null("")
        for _, texts in chunks([pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": text})], size):
            mask += list(keep(texts))
        yield b.filter(pa.array(mask, pa.bool_()))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    mix_in_place(x)
    return x


def mix_in_place(x: np.ndarray) -> None:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= GOLDEN
    x ^= x >> np.uint64(32)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, ``n`` of each at least."""
    had = _POWERS.get(base)
    if had is None or len(had[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        had = _POWERS[base] = (out[0], out[1])
    return had[0][:n], had[1][:n]


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """``p`` with which ``(p[j] - p[i]) * inverse**i`` is the hash of ``values[i:j]``, wherever it stands."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return (p[ends] - p[starts]) * powers(base, len(p))[1][starts]


def byte_values(seed: int) -> np.ndarray:
    """A scrambled 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))


def hex_digests(parts: Iterable[bytes]) -> list[str]:
    from hashlib import sha256

    return [sha256(x).hexdigest() for x in parts]
