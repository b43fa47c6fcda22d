"""Look-ups, conflicts and quorums over whole tables, by brute force."""

import os
from collections import defaultdict

import pytest

from palimpsest.functions import blocks
from palimpsest.plans import catalogue

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def found(spark, name):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, DATA).collect())


@pytest.fixture
def log(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type").collect()]


def test_find_block(spark):
    starts = [(1, 0, "b"), (1, 1, "d"), (1, 2, "d"), (2, 0, "a"), (None, 7, "c"), (3, 0, None)]
    wanted = [(r, k) for r in (1, 2, None, 4) for k in ["a", "b", "bb", "d", "z", "z", None]]
    out = blocks.find_block(spark.createDataFrame(starts, "run long, block long, first_key string"), ["run"], spark.createDataFrame(wanted, "run long, key string"), "key")
    best = {(r, k): max((f, b) for q, b, f in starts if q == r and f and f <= k)[1] for r in (1, 2, None) for k in "a b bb d z".split() if any(q == r and f and f <= k for q, _, f in starts)}
    assert sorted(map(repr, ((*k, b) for k, b in best.items()))) == sorted(repr(tuple(r)) for r in out.collect())


@tables
def test_find_block_of_every_key(spark):
    at = defaultdict(dict)
    for r in catalogue.QUERIES["block_layout"](spark, DATA).collect():
        at[r["run"]][r["first_key"]] = max(r["block"], at[r["run"]].get(r["first_key"], -1))
    asked = {(r["page_id"] // 50, r["url"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert found(spark, "find_block") == sorted((run, u, at[run][max(f for f in at[run] if f <= u)]) for run, u in asked) and len(asked) > 20


@tables
def test_conflicts_of_every_event(spark, log):
    step = max(e for e, _, _ in log) * 10 // 100
    want = {(e % 10, u, e % 10 * step) for e, u, _ in log if any(v == u and t == "purchase" and c > e % 10 * step for c, v, t in log)}
    assert found(spark, "txn_conflicts") == sorted(want)


@tables
def test_quorums_of_every_event(spark, log):
    votes, match = defaultdict(list), defaultdict(int)
    for e, u, t in log:
        votes[u % 7].append(t in ("click", "view", "purchase"))
        match[u % 5] = max(match[u % 5], e)
    assert found(spark, "quorum_votes") == sorted((c, 2 * sum(v) > len(v)) for c, v in votes.items())
    most = sorted(match.values(), reverse=True)[len(match) // 2]
    assert found(spark, "quorum_commit_index") == [(max((e for e, _, _ in log if e <= most and e // 500 == 1), default=None),)]
