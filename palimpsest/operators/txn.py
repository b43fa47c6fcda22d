"""Transactions: snapshots, overlays, read sets, conflicts and the watermark of active readers."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.keys import UNBOUNDED, Bound, with_prefix, within
from palimpsest.operators.read import overlay, visible_at


class TransactionClosed(RuntimeError):
    """The transaction was committed or rolled back."""


class TransactionConflict(RuntimeError):
    """A key that the transaction read was written after its snapshot."""


class TransactionUnknown(KeyError):
    """No open transaction has this number."""


class KeyMissing(KeyError):
    """No visible row has this key."""


def watermark(readers: DataFrame, commits: DataFrame, read_ts: str = "read_ts", commit_ts: str = "commit_ts") -> DataFrame:
    """One row ``watermark``: the least version still read, else the newest commit. Both sides are aggregates of one row."""
    least, latest = readers.agg(F.min(read_ts).alias("r")), commits.agg(F.max(commit_ts).alias("c"))
    return least.join(F.broadcast(latest)).select(F.coalesce("r", "c").alias("watermark"))


def active_readers(ledger: DataFrame, read_ts: str = "read_ts", change: str = "change") -> DataFrame:
    """``read_ts, readers`` from a ledger of +1 and -1: versions with readers left."""
    return ledger.groupBy(read_ts).agg(F.sum(change).alias("readers")).where("readers > 0")


def retained_snapshots(ledger: DataFrame, read_ts: str = "read_ts", change: str = "change") -> DataFrame:
    return active_readers(ledger, read_ts, change).agg(F.count("*").alias("n_snapshots"), F.min(read_ts).alias("oldest"))


def conflicts(read_set: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``(txn_id, key.., read_ts)`` that a commit ``(key.., commit_ts)`` wrote after the snapshot."""
    newest = committed.groupBy(*keys).agg(F.max("commit_ts").alias("__newest"))
    return read_set.join(newest, keys).where(F.col("__newest") > F.col("read_ts")).drop("__newest")


def prune_commits(committed: DataFrame, mark: int) -> DataFrame:
    """Commit records that some reader may still conflict with."""
    return committed.where(F.col("commit_ts") >= F.lit(mark))


class Watermark:
    """Counted versions in use, on the driver."""

    def __init__(self):
        self._counts: dict[int, int] = {}

    def add(self, ts: int) -> None:
        self._counts[ts] = self._counts.get(ts, 0) + 1

    def remove(self, ts: int) -> None:
        left = self._counts.get(ts, 0) - 1
        if left > 0:
            self._counts[ts] = left
        else:
            self._counts.pop(ts, None)

    def least(self) -> int | None:
        return min(self._counts, default=None)

    def distinct(self) -> int:
        return len(self._counts)


class Transaction:
    """Reads a snapshot under its own writes; see Store.begin()."""

    _numbers = itertools.count(1)

    def __init__(self, store, read_ts: int, serializable: bool):
        self.id, self.store, self.read_ts, self.serializable = next(self._numbers), store, read_ts, serializable
        self.writes: dict[object, tuple[object, bool]] = {}
        self.keys: set = set()  # looked up one by one
        self.scans: list[DataFrame] = []  # keys that scans returned
        self._closed = False

    def _open(self) -> None:
        if self._closed:
            raise TransactionClosed(f"transaction {self.id} is closed")

    def put(self, key: object, value: object) -> None:
        self._open()
        self.writes[key] = (value, False)

    def delete(self, key: object) -> None:
        self._open()
        self.writes[key] = (None, True)

    def local(self) -> DataFrame:
        """The overlay as rows."""
        return self.store.spark.createDataFrame([(k, v, self.read_ts, gone) for k, (v, gone) in self.writes.items()], self.store.schema)

    def get(self, key: object) -> object | None:
        """The overlay's value, else the snapshot's; either way the key has been read."""
        self._open()
        if self.serializable:
            self.keys.add(key)
        if key in self.writes:
            value, gone = self.writes[key]
            return None if gone else value
        return self.store.get(key, self.read_ts)

    def scan(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        self._open()
        return self._noted(self.store.rows(lower, upper), within(F.col(self.store.spec.keys[0]), lower, upper))

    def prefix(self, prefix: str) -> DataFrame:
        self._open()
        return self._noted(self.store.rows(), with_prefix(F.col(self.store.spec.keys[0]), prefix))

    def _noted(self, rows: DataFrame, wanted) -> DataFrame:
        spec = self.store.spec
        out = overlay(self.local().where(wanted), visible_at(rows.where(wanted), spec, self.read_ts), spec)
        if self.serializable:
            self.scans.append(out.select(*spec.keys))
        return out

    def read_set(self) -> DataFrame:
        """Exact keys read, never hashes; ranges read are not in it, so rows that appear later are allowed."""
        key = self.store.spec.keys[0]
        out = self.store.spark.createDataFrame([(k,) for k in self.keys], T.StructType([self.store.schema[key]]))
        for part in self.scans:
            out = out.unionByName(part)
        return out.distinct()

    def read_any(self, commits: list) -> bool:
        """Whether it read a key of these commits, each a set of keys or a run. Without scans and runs that needs no job."""
        written = set().union(*[c for c in commits if isinstance(c, set)])
        if written & self.keys:
            return True
        key, runs = self.store.spec.keys[0], [self.store.keys_of(c) for c in commits if not isinstance(c, set)]
        if written and self.scans and any(df.where(F.col(key).isin(list(written))).take(1) for df in self.scans):
            return True
        if not runs or not (self.keys or self.scans):
            return False
        seen = self.read_set()
        return any(df.join(seen, key, "left_semi").take(1) for df in runs)

    def commit(self) -> int | None:
        """The version written, or None if there was nothing to write. Raises TransactionConflict."""
        self._open()
        return self.store.commit(self)

    def rollback(self) -> None:
        self._open()
        self.close()

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self.store.release(self)

