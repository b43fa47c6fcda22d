"""Queries that write the events into a store and read them back, each with the SQL for what must come out.

A store is written in five batches, one version each: of a batch's events the last of each user stays, and an error deletes. What is small enough
for rows in memory is the table of nations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.keys import excluded, included
from palimpsest.sources.scratch import scratch
from palimpsest.sources.service import Service
from palimpsest.sources.store import Options, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BATCHES = 5


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """``key, value, deleted, event_id, part``."""
    e = spark.read.parquet(f"{d}/events.parquet")
    top = e.agg(F.max("event_id")).first()[0] + 1
    value = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    return e.select(F.col("user_id").cast("string").alias("key"), value.alias("value"), (F.col("event_type") == "error").alias("deleted"), "event_id", F.floor(F.col("event_id") * BATCHES / top).cast("int").alias("part"))


def _filled(spark: SparkSession, d: str, options: Options | None = None, after_each: Callable[[Store], object] = lambda s: None) -> Store:
    store, rows = Store(spark, scratch(spark, "store"), options), _rows(spark, d)
    for part in range(BATCHES):
        store.write_batch(rows.where(F.col("part") == part).drop("part"), "event_id")
        after_each(store)
    return store


def _shown(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


_EV = f"ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type || ':' || event_id AS value, event_type = 'error' AS deleted, event_id, event_id * {BATCHES} // ((SELECT max(event_id) FROM events) + 1) + 1 AS ts FROM events)"
_BATCHED = f"{_EV}, log AS (SELECT key, value, deleted, ts FROM (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1)"


def _seen(at: int = BATCHES, where: str = "true") -> str:
    return f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS rn FROM log WHERE ts <= {at}) WHERE rn = 1 AND NOT deleted AND {where}"


@_query(f"WITH {_BATCHED} {_seen()}")
def store_scan(spark, d):
    return _shown(_filled(spark, d).scan())


@_query(f"WITH {_BATCHED} {_seen(3)}")
def store_snapshot(spark, d):
    return _shown(_filled(spark, d).scan(at=3))


@_query(f"WITH {_BATCHED} {_seen(BATCHES, "key >= '12' AND key < '30'")}")
def store_range(spark, d):
    return _shown(_filled(spark, d).scan(included("12"), excluded("30")))


@_query(f"WITH {_BATCHED} {_seen(BATCHES, "starts_with(key, '1')")}")
def store_prefix(spark, d):
    return _shown(_filled(spark, d).prefix("1"))


@_query(f"WITH {_BATCHED} SELECT key, ts, deleted FROM log")
def store_dump(spark, d):
    """Every version, deletions included."""
    return _filled(spark, d).rows().select("key", "ts", "deleted")


def _compacting(strategy: str, planner: dict):
    def run(spark, d):
        return _shown(_filled(spark, d, Options(strategy=strategy, planner=planner, keys_per_run=500), lambda s: s.maintain(2)).scan())

    return run


for _strategy, _planner in (
    ("full", {}), ("simple", {"ratio_percent": 200, "trigger": 2, "levels": 3}), ("tiered", {"tiers": 2, "amplification_percent": 200, "ratio_percent": 100, "width": 2}),
    ("leveled", {"trigger": 2, "levels": 3, "base_rows": 200, "multiplier": 2}),
):
    QUERIES[f"store_compacted_{_strategy}"], ORACLES[f"store_compacted_{_strategy}"] = _compacting(_strategy, _planner), f"WITH {_BATCHED} {_seen()}"


@_query(f"WITH {_BATCHED} SELECT count(*) AS n_rows, true AS are_apart, true AS are_bounded, 1 AS level FROM ({_seen()})")
def store_forced_compaction(spark, d):
    """All runs merged: live rows only, in runs of bounded size that do not overlap."""
    store = _filled(spark, d, Options(keys_per_run=500))
    store.compact(force=True)
    runs = sorted(store.runs, key=lambda r: r.first_key)
    apart = all(a.last_key < b.first_key for a, b in zip(runs, runs[1:], strict=False))
    out = store.state().agg(F.sum("n_rows").alias("n_rows"), F.max("level").alias("level"), F.max("n_rows").alias("most"))
    return out.select("n_rows", F.lit(apart).alias("are_apart"), (F.col("most") <= 1500).alias("are_bounded"), "level")


@_query(f"WITH {_BATCHED} {_seen(BATCHES, "NOT starts_with(key, '2')")}")
def store_filtered_compaction(spark, d):
    store = _filled(spark, d)
    store.add_filter(F.col("key").startswith("2"))
    store.compact(force=True)
    return _shown(store.rows())


@_query(f"WITH {_BATCHED}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS rn FROM log WHERE ts <= 3) SELECT key, ts FROM log WHERE ts > 3 UNION ALL SELECT key, ts FROM w WHERE rn = 1 AND NOT deleted")
def store_compaction_under_a_reader(spark, d):
    """A reader at version 3 keeps what it sees and all that is newer."""
    readers = []
    store = _filled(spark, d, after_each=lambda s: readers.append(s.begin()) if s.latest == 3 else None)
    store.compact(force=True)
    out = store.rows().select("key", "ts")
    readers[0].rollback()
    return out


_NATIONS = "na AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation)"


def _nations(spark, d, store: Store) -> Store:
    """One commit for each nation, and one that deletes those of region 0."""
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    for r in rows:
        store.put(r["n_name"], str(r["n_regionkey"]))
    store.write_rows([(r["n_name"], None, True) for r in rows if r["n_regionkey"] == 0])
    return store


@_query(f"WITH {_NATIONS} SELECT key, value FROM na WHERE value != '0'")
def store_memory(spark, d):
    """Rows in memory and frozen, none of them flushed."""
    store = Store(spark, scratch(spark, "store"))
    store.freeze()
    _nations(spark, d, store).freeze()
    return _shown(store.scan())


@_query(f"WITH {_NATIONS} SELECT count(*) + count(*) FILTER (value = '0') AS n_rows, count(*) + 1 AS max_ts, 0 AS level FROM na")
def store_flush(spark, d):
    """What the runs hold once memory has been flushed, as its size forces it and at the end."""
    store = _nations(spark, d, Store(spark, scratch(spark, "store"), Options(flush_rows=10)))
    store.force_flush()
    return store.state().agg(F.sum("n_rows").alias("n_rows"), F.max("max_ts").alias("max_ts"), F.max("level").alias("level"))


@_query(f"WITH {_BATCHED}, {_NATIONS} {_seen()} UNION ALL SELECT key, value FROM na WHERE value != '0'")
def store_recovery(spark, d):
    """Runs, and commits that only the log has, in a store that is opened anew."""
    store = _nations(spark, d, _filled(spark, d))
    return _shown(Store(spark, store.path).scan())


@_query("SELECT unnest(['compact', 'flush', 'snapshot']) AS kind, unnest([1, 5, 1]) AS n")
def store_manifest(spark, d):
    """The records of a manifest: five flushes, a snapshot after the fourth record, a compaction."""
    store = _filled(spark, d, Options(snapshot_every=4))
    store.compact(force=True)
    kinds = [(store.manifest.read(n)["kind"],) for n in store.manifest.numbers()]
    return spark.createDataFrame(kinds, "kind string").groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@_query(f"WITH {_BATCHED} SELECT key, value FROM ({_seen()}) WHERE key != '3' AND key != '4' UNION ALL SELECT '3', 'mine'")
def store_txn_scan(spark, d):
    """A transaction's own writes over its snapshot."""
    txn = _filled(spark, d).begin()
    txn.put("3", "mine")
    txn.delete("4")
    out = _shown(txn.scan())
    txn.rollback()
    return out


@_query(f"WITH {_BATCHED} SELECT key, value FROM ({_seen()}) WHERE starts_with(key, '1') AND key != '11' UNION ALL SELECT '1x', 'mine'")
def store_txn_prefix(spark, d):
    txn = _filled(spark, d).begin()
    txn.put("1x", "mine")
    txn.delete("11")
    out = _shown(txn.prefix("1"))
    txn.rollback()
    return out


@_query(f"WITH {_BATCHED}, s AS ({_seen()}) SELECT '3' AS key, 'mine' AS value UNION ALL SELECT '4', NULL UNION ALL SELECT '5', (SELECT value FROM s WHERE key = '5')")
def store_txn_get(spark, d):
    """Written, deleted and untouched keys of a transaction."""
    txn = _filled(spark, d).begin()
    txn.put("3", "mine")
    txn.delete("4")
    out = spark.createDataFrame([(k, txn.get(k)) for k in ("3", "4", "5")], "key string, value string")
    txn.rollback()
    return out


@_query(f"WITH {_BATCHED} SELECT key, value FROM ({_seen()}) WHERE key != '3' UNION ALL SELECT '3', 'mine'")
def store_commit(spark, d):
    """A commit, and a rolled back transaction that leaves nothing."""
    store = _filled(spark, d)
    one, two = store.begin(), store.begin()
    one.put("3", "mine")
    two.put("4", "lost")
    two.rollback()
    one.commit()
    return _shown(store.scan())


@_query("SELECT unnest(['get 3 in one', 'commit of one', 'get of one', 'get of nothing', 'nonsense', 'commit of another']) AS step, unnest(['ok', 'commit-failed', 'transaction-unknown', 'key-missing', 'bad-request', 'ok']) AS code")
def service_codes(spark, d):
    """What a service answers."""
    x = Service(_filled(spark, d, Options(serializable=True)))
    x.call("put", "3", "there")
    one, another = x.begin(), x.begin()
    steps = [("get 3 in one", x.run(f"get 3 {one}"))]
    x.run(f"put 5 x {one}")
    x.run("put 3 newer")
    steps += [("commit of one", x.run(f"commit {one}")), ("get of one", x.run(f"get 3 {one}")), ("get of nothing", x.run("get nothing")), ("nonsense", x.run("fly"))]
    x.run(f"put 6 y {another}")
    steps.append(("commit of another", x.run(f"commit {another}")))
    return spark.createDataFrame([(k, r.code) for k, r in steps], "step string, code string")


@_query(f"WITH {_BATCHED}, {_NATIONS} SELECT 'memory' AS part, count(*) + count(*) FILTER (value = '0') AS n_runs, count(*) + count(*) FILTER (value = '0') AS n_rows FROM na UNION ALL SELECT 'level 0', count(DISTINCT ts), count(*) FROM log")
def service_state(spark, d):
    return Service(_nations(spark, d, _filled(spark, d))).state()


@_query(f"WITH {_BATCHED} {_seen()}")
def store_pinned(spark, d):
    """Runs that are kept in the executors' memory."""
    store = _filled(spark, d)
    store.pin()
    return _shown(store.scan())


@_query(f"WITH {_EV} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1 AND NOT deleted")
def stream_ingest(spark, d):
    """The events as a stream into a store; its batches are versions."""
    from palimpsest.streaming.ingest import ingest

    source, store = scratch(spark, "stream-in"), Store(spark, scratch(spark, "store"))
    rows = _rows(spark, d)
    rows.write.parquet(source)
    ingest(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), store, scratch(spark, "stream-checkpoint"), "event_id").awaitTermination()
    return _shown(store.scan())
