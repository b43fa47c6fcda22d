"""Streams whose rows do not come in their order."""

import os
import shutil

import duckdb
import pytest

from palimpsest.plans.store_queries import ORACLES, QUERIES
from palimpsest.sources.store import Store
from palimpsest.streaming.ingest import ingest

SCHEMA = "key string, value string, deleted boolean, n int"
FILES = [
    [("a", "new", False, 9), ("b", None, True, 8), ("c", "old", False, 1), ("d", "kept", False, 5)],
    [("a", "late", False, 2), ("b", "late", False, 3), ("c", "new", False, 7), ("e", None, True, 6)],
    [("a", None, True, 4), ("b", "late", False, 7), ("e", "late", False, 5), ("f", "late", False, 1), ("f", "new", False, 2)],
]
NEWEST = [("a", "new"), ("c", "new"), ("d", "kept"), ("f", "new")]


def arrive(spark, folder, i):
    """The next file of the stream, younger than those before it."""
    spark.createDataFrame(FILES[i], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    for name in os.listdir(folder):
        if name.startswith("part-") and os.stat(f"{folder}/{name}").st_mtime > 1e9:
            os.utime(f"{folder}/{name}", (1000 + i, 1000 + i))


def run(spark, folder, store, at, every):
    ingest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), store, at, "n", every).awaitTermination()


def rows(store):
    return sorted((r["key"], r["value"]) for r in store.scan().collect())


@pytest.mark.parametrize("every", [1, 8])
def test_late_rows_replace_nothing(spark, tmp_path, every):
    """With a compaction after each batch deletions are gone from the runs when late rows come."""
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    for i in range(len(FILES)):
        arrive(spark, source, i)
    run(spark, source, store, str(tmp_path / "ck"), every)
    assert rows(store) == NEWEST and store.latest == len(FILES)


def test_late_rows_after_a_crash(spark, tmp_path):
    """The store has the first batch, the stream neither its commit nor its state."""
    source, at, store = str(tmp_path / "in"), str(tmp_path / "ck"), Store(spark, str(tmp_path / "store"))
    arrive(spark, source, 0)
    run(spark, source, store, at, 8)
    for name in ("0", ".0.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    for folder, _, names in os.walk(f"{at}/state/0"):
        for name in names:
            if name.lstrip(".").startswith("1."):
                os.remove(f"{folder}/{name}")
    for i in (1, 2):
        arrive(spark, source, i)
    store = Store(spark, store.path)
    run(spark, source, store, at, 8)
    assert rows(store) == NEWEST and store.latest == len(FILES)


def test_stream_ingest_of_mixed_files(spark, tmp_path):
    """Each file of the events spans all versions, so no order of the files is theirs."""
    types = ["view", "error", "click"]
    events = [(i, i * 7 % 11, types[i % 5 % 3]) for i in range(400)]
    for k in range(4):
        part = str(tmp_path / f"part-{k}")
        spark.createDataFrame([e for e in events if e[0] // 3 % 4 == k], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(part)
        os.makedirs(tmp_path / "events.parquet", exist_ok=True)
        shutil.move(next(f"{part}/{f}" for f in os.listdir(part) if f.startswith("part-")), tmp_path / "events.parquet" / f"part-{k}.parquet")
    sql = duckdb.connect()
    sql.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    out = QUERIES["stream_ingest"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(sql.execute(f"select {', '.join(out.columns)} from ({ORACLES['stream_ingest']})").fetchall())


def test_a_small_batch_is_one_file(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    arrive(spark, source, 0)
    run(spark, source, store, str(tmp_path / "ck"), 8)
    arrive(spark, source, 1)
    run(spark, source, store, str(tmp_path / "ck"), 8)
    files = [sum(name.endswith(".parquet") for name in os.listdir(f"{store.path}/{r.path}")) for r in store.runs]
    assert files == [1, 1] and spark.conf.get("spark.sql.adaptive.enabled") == "true"
