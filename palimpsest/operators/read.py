"""Reads: merging runs, the visible version of each key, scans, look-ups and differences.

Predicates on keys and versions go below the newest-version step, where they reach the Parquet scan; predicates on values and on the deletion
flag stay above it, or a deleted key would show an older value. The step itself is ``row_number() = 1``, which Spark limits before the shuffle,
so a key with many versions costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.keys import UNBOUNDED, Bound, with_prefix, within
from palimpsest.operators.model import Versioned


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    rn = "__rn"
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"{rn} = 1").drop(rn)


def concat_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs whose key ranges are disjoint: nothing to merge."""
    return reduce(DataFrame.unionByName, runs)


def disjoint(stats: DataFrame, run: str = "run_id", first: str = "first_key", last: str = "last_key") -> DataFrame:
    """The runs that begin before the one before them ends; empty if concat_runs() may be used. One row per run, so one window is enough."""
    w = Window.orderBy(first, last, run)
    return stats.withColumn("previous_last", F.lag(last).over(w)).where(F.col(first) <= F.col("previous_last"))


def merge_runs(runs: list[DataFrame], spec: Versioned) -> DataFrame:
    """Overlapping runs, newest first: of equal ``(key, ts)`` the first run's row stays. Deletions are kept."""
    every = reduce(DataFrame.unionByName, [r.withColumn("__priority", F.lit(i)) for i, r in enumerate(runs)])
    return merge_prioritised(every, spec, "__priority").drop("__priority")


def merge_prioritised(rows: DataFrame, spec: Versioned, priority: str) -> DataFrame:
    """As merge_runs(), with the priority in a column; the lowest wins."""
    return _first(rows, [*spec.keys, spec.ts], [F.col(priority).asc()])


def overlay(local: DataFrame, base: DataFrame, spec: Versioned, keep_deleted: bool = False) -> DataFrame:
    """Rows of ``local`` hide those of ``base`` with the same key; local deletions hide and vanish."""
    both = local.withColumn("__priority", F.lit(0)).unionByName(base.withColumn("__priority", F.lit(1)))
    out = _first(both, [*spec.keys], [F.col("__priority").asc()]).drop("__priority")
    return out if keep_deleted else out.where(~F.col(spec.deleted))


def newest(changelog: DataFrame, spec: Versioned, at: object = None) -> DataFrame:
    """The newest version of each key up to ``at``, deletions included."""
    seen = changelog if at is None else changelog.where(F.col(spec.ts) <= F.lit(at))
    return _first(seen, [*spec.keys], [F.col(spec.ts).desc()])


def visible_at(changelog: DataFrame, spec: Versioned, at: object = None) -> DataFrame:
    """The table as of version ``at`` (None: now)."""
    return newest(changelog, spec, at).where(~F.col(spec.deleted))


def get(changelog: DataFrame, spec: Versioned, key: object, at: object = None) -> DataFrame:
    """The visible row of one key, or none."""
    values = key if isinstance(key, tuple) else (key,)
    match = reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in zip(spec.keys, values, strict=True)])
    return visible_at(changelog.where(match), spec, at)


def multi_get(changelog: DataFrame, spec: Versioned, keys: DataFrame, at: object = None) -> DataFrame:
    """The visible rows of a table of keys. The semi-join comes first, so only asked-for keys are merged; Spark broadcasts the keys if they are
    few and shuffles them if not."""
    return visible_at(changelog.join(keys.select(*spec.keys).distinct(), list(spec.keys), "left_semi"), spec, at)


def scan(changelog: DataFrame, spec: Versioned, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, at: object = None) -> DataFrame:
    """The visible rows of a key range, both bounds strict, in key order once sorted by the caller."""
    return visible_at(changelog.where(within(F.col(spec.keys[0]), lower, upper)), spec, at)


def seek(changelog: DataFrame, spec: Versioned, key: object, at: object = None, n: int = 1) -> DataFrame:
    """The first ``n`` visible rows at or after a key, in key order; versions below the key are never read."""
    return visible_at(changelog.where(F.col(spec.keys[0]) >= F.lit(key)), spec, at).orderBy(spec.keys[0]).limit(n)


def prefix_scan(changelog: DataFrame, spec: Versioned, prefix: str | bytes, at: object = None) -> DataFrame:
    return visible_at(changelog.where(with_prefix(F.col(spec.keys[0]), prefix)), spec, at)


def history(changelog: DataFrame, spec: Versioned, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    """All versions of a key range, deletions included."""
    return changelog.where(within(F.col(spec.keys[0]), lower, upper))


def prefix_history(changelog: DataFrame, spec: Versioned, prefix: str | bytes) -> DataFrame:
    """All versions of the keys with a prefix, deletions included."""
    return changelog.where(with_prefix(F.col(spec.keys[0]), prefix))


def version(changelog: DataFrame, spec: Versioned, key: object, at: object) -> DataFrame:
    """The exact ``(key, ts)`` row, whether it deletes or not."""
    return changelog.where((F.col(spec.keys[0]) == F.lit(key)) & (F.col(spec.ts) == F.lit(at)))


def diff(changelog: DataFrame, spec: Versioned, since: object, until: object) -> DataFrame:
    """Keys whose visible version differs between two snapshots: ``key.., change, old_ts, new_ts``.

    Both snapshots come from one shuffle of the changelog: the newest version up to each is a conditional maximum.
    """
    ts, gone = F.col(spec.ts), F.col(spec.deleted)
    upto = changelog.where(ts <= F.lit(until))
    early = F.when(ts <= F.lit(since), ts)
    both = upto.groupBy(*spec.keys).agg(F.max(early).alias("o"), F.max(ts).alias("n"), F.max_by(gone, early).alias("o_gone"), F.max_by(gone, ts).alias("n_gone"))
    old, new = F.when(~F.col("o_gone"), F.col("o")), F.when(~F.col("n_gone"), F.col("n"))
    out = both.select(*spec.keys, old.alias("old_ts"), new.alias("new_ts"))
    change = F.when(F.col("old_ts").isNull(), "added").when(F.col("new_ts").isNull(), "removed").otherwise("changed")
    return out.where(~F.col("old_ts").eqNullSafe(F.col("new_ts"))).select(*spec.keys, change.alias("change"), "old_ts", "new_ts")


def render(rows: DataFrame, key: str, value: str, separator: str = "\n") -> DataFrame:
    """One row ``text``: keys and values in turn, in key order. For results that fit one row only."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"))))
    return rows.agg(F.array_join(F.flatten(F.transform(pairs, lambda p: F.array(p["k"], p["v"]))), separator).alias("text"))
