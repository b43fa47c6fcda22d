"""The ladders: merges, snapshots, garbage collection, filters, bounds, prefixes; and properties on random changelogs."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import blocks, bloom, keys
from palimpsest.functions.keys import UNBOUNDED, Bound, excluded, included
from palimpsest.operators import compact, read, txn, write
from palimpsest.operators.model import Versioned, empty_value_deletes, require_keys
from palimpsest.plans import quorum

KV = Versioned(("key",))


def changelog(spark, rows):
    return spark.createDataFrame([(k, t, v, v == "") for k, t, v in rows], "key string, ts long, value string, deleted boolean")


def pairs(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def merged(spark, *runs):
    return pairs(read.merge_runs([changelog(spark, [(k, 0, v) for k, v in r.items()]) for r in runs], KV))


NORTH, EAST, SOUTH = {"ash": "n", "fir": "n", "yew": ""}, {"ash": "e", "elm": "e", "oak": "e"}, {"elm": "s", "fir": "s", "oak": "", "tea": "s"}


def test_merge_priority(spark):
    def first(*runs):
        out = {}
        for r in reversed(runs):
            out.update(r)
        return sorted(out.items())

    for order in ((NORTH, EAST, SOUTH), (SOUTH, NORTH, EAST), (EAST, SOUTH, NORTH), ({}, EAST), (EAST, {}), ({}, {})):
        assert merged(spark, *order) == first(*order)


LADDER = [("pear", 10, "g"), ("plum", 20, "b"), ("pear", 35, "y"), ("fig", 40, "v"), ("plum", 55, ""), ("lime", 60, "g"), ("fig", 61, ""), ("plum", 75, "r"), ("pear", 90, "")]


@pytest.mark.parametrize("at", [5, 10, 34, 35, 50, 55, 60, 61, 80, 90, 1000])
def test_snapshot_ladder(spark, at):
    seen = {}
    for k, t, v in LADDER:
        if t <= at:
            seen[k] = v
    assert pairs(read.visible_at(changelog(spark, LADDER), KV, at)) == sorted((k, v) for k, v in seen.items() if v)


def test_seek(spark):
    log = changelog(spark, LADDER)
    first = lambda key, at=None: [r["key"] for r in read.seek(log, KV, key, at).collect()]
    assert first("a", 50) == ["fig"] and first("fig", 50) == ["fig"] and first("fig") == ["lime"] and first("pear") == ["plum"] and first("q") == []
    assert [r["key"] for r in read.seek(log, KV, "g", 80, 2).collect()] == ["lime", "pear"]


def test_deleted_key_never_shows_an_older_value(spark):
    log = changelog(spark, LADDER)
    assert read.get(log, KV, "pear").count() == read.get(log, KV, "fig").count() == 0
    assert pairs(read.scan(log, KV, included("lime"), included("lime"))) == [("lime", "g")]
    assert pairs(read.scan(log, KV, excluded("lime"), excluded("plum"))) == []


OLD = [("x", 3, "1"), ("y", 4, "1"), ("x", 6, ""), ("z", 6, "1"), ("y", 8, "2"), ("z", 9, ""), ("x", 11, "3"), ("w", 12, "1"), ("w", 13, "")]


@pytest.mark.parametrize("mark", [0, 3, 5, 6, 8, 10, 12, 13, 99])
@pytest.mark.parametrize("bottom", [True, False])
def test_what_compaction_keeps(spark, mark, bottom):
    newest = {}
    for k, t, v in OLD:
        if t <= mark:
            newest[k] = (t, v)
    kept = {(k, t) for k, t, _ in OLD if t > mark} | {(k, t) for k, (t, v) in newest.items() if v or not bottom}
    log = changelog(spark, OLD)
    assert {(r["key"], r["ts"]) for r in compact.retain(log, KV, mark, bottom).collect()} == kept
    assert {(r["key"], r["ts"]) for r in compact.reclaimed(log, KV, mark, bottom).collect()} == {(k, t) for k, t, _ in OLD} - kept


def test_retention_limits_versions_before_the_shuffle(spark, tmp_path):
    at = str(tmp_path / "log")
    changelog(spark, OLD).write.parquet(at)
    log = spark.read.parquet(at)
    plan = compact.retain(log, KV, 6, True)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1 and "GreaterThan(ts,6)" in plan
    assert compact.reclaimed(log, KV, 6, True)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_filter_and_watermark(spark):
    rows = [(f"{n}/{k}", t, v) for n in ("keep", "toss") for k, t, v in (("i", 1, "a"), ("i", 5, "b"), ("j", 2, "a"), ("j", 6, ""), ("k", 3, "a"))]
    drop = [F.col("key").startswith("toss/")]
    got = lambda mark: sorted((r["key"], r["ts"]) for r in compact.retain(changelog(spark, rows), KV, mark, True, drop).collect())
    assert got(4) == [("keep/i", 1), ("keep/i", 5), ("keep/j", 2), ("keep/j", 6), ("keep/k", 3), ("toss/i", 5), ("toss/j", 6)]
    assert got(9) == [("keep/i", 5), ("keep/k", 3)]


def test_scan_over_runs(spark):
    runs = [{"bee": "new", "ant": ""}, {"ant": "mid", "cow": "mid"}, {"cow": "", "dog": "old", "eel": ""}]
    log = read.merge_runs([changelog(spark, [(k, 0, v) for k, v in r.items()]) for r in runs], KV)
    assert pairs(read.visible_at(log, KV)) == [("bee", "new"), ("cow", "mid"), ("dog", "old")]
    assert [k for k, _ in pairs(read.scan(log, KV, included("ant"), excluded("cow")))] == ["bee"]
    assert [k for k, _ in pairs(read.scan(log, KV, excluded("bee"), UNBOUNDED))] == ["cow", "dog"]
    assert read.get(log, KV, "ant").count() == read.get(log, KV, "gnu").count() == 0


def test_prefix(spark):
    log = changelog(spark, [(k, 1, "x") for k in ("key", "key:2", "key:3", "kez:", "l")])
    count = lambda p: read.prefix_scan(log, KV, p).count()
    assert [count(p) for p in ("k", "ke", "key", "key:", "key:2", "key:23")] == [4, 4, 3, 2, 1, 0]
    assert keys.prefix_successor(b"a\xff\xff") == b"b" and keys.prefix_successor(b"\xff") is None and keys.prefix_successor(b"") is None


def test_bounds():
    assert Bound.parse("UNBOUNDED") == UNBOUNDED and Bound.parse("Included", 3) == included(3)
    with pytest.raises(ValueError, match="no such bound"):
        Bound.parse("between", 1)
    with pytest.raises(ValueError, match="needs a key"):
        Bound.parse("excluded")


def test_signed_order(spark):
    df = spark.createDataFrame([(bytes([0x80]),), (bytes([0x7F]),), (bytes([0x01, 0x80]),), (b"",)], "k binary").select("k", keys.signed_byte_key(F.col("k")).alias("s"))
    assert [bytes(r["k"]) for r in df.orderBy("s").collect()] == [b"", b"\x80", b"\x01\x80", b"\x7f"]


def test_null_and_empty_keys_fail(spark):
    assert require_keys(changelog(spark, LADDER), KV).count() == len(LADDER)
    with pytest.raises(Exception, match="null or empty key"):
        require_keys(changelog(spark, [("", 1, "x")]), KV).collect()


def test_empty_value_deletes(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "key string, value string")
    assert [r["deleted"] for r in empty_value_deletes(df, "value").orderBy("key").collect()] == [True, True, False]


def random_log(seed):
    r = random.Random(seed)
    return [(r.choice("abcdef"), t, r.choice(["", "x", "y"]) and str(t)) if r.random() < 0.8 else (r.choice("abcdef"), t, "") for t in range(1, r.randint(2, 40))]


@pytest.mark.parametrize("seed", range(6))
def test_random_changelogs(spark, seed):
    rows = random_log(seed)
    log = changelog(spark, rows)
    mark = len(rows) // 2

    def model(at):
        out = {}
        for k, t, v in rows:
            if t <= at:
                out[k] = v
        return sorted((k, v) for k, v in out.items() if v)

    for bottom in (True, False):
        kept = compact.retain(log, KV, mark, bottom)
        for at in (mark, mark + 2, len(rows)):
            assert pairs(read.visible_at(log, KV, at)) == pairs(read.visible_at(kept, KV, at)) == model(at)
    change = {r["key"]: r["change"] for r in read.diff(log, KV, mark, len(rows)).collect()}
    old, new = dict(model(mark)), dict(model(len(rows)))
    newest = lambda k, at: max((t for key, t, _ in rows if key == k and t <= at), default=0)
    expected = {k: "added" if k not in old else "removed" if k not in new else "changed" for k in old.keys() | new.keys() if k not in old or k not in new or newest(k, mark) != newest(k, len(rows))}
    assert change == expected


def test_merge_is_associative(spark):
    a, b, c = (changelog(spark, [(k, 0, v) for k, v in r.items()]) for r in (NORTH, EAST, SOUTH))
    left = read.merge_runs([read.merge_runs([a, b], KV), c], KV)
    right = read.merge_runs([a, read.merge_runs([b, c], KV)], KV)
    assert pairs(left) == pairs(right)


def test_batch(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 3)], "key string, value string, n int")
    got = write.stamp(write.dedupe_batch(df, KV, "n"), KV, 7).collect()
    assert sorted((r["key"], r["value"], r["ts"]) for r in got) == [("a", "2", 8), ("b", "3", 8)]


def test_watermark_counts():
    w = txn.Watermark()
    for i in range(1001):
        w.add(i)
    assert (w.least(), w.distinct()) == (0, 1001)
    for i in range(500):
        w.remove(i)
    assert w.least() == 500
    for i in range(1000, 500, -1):
        w.remove(i)
    assert w.least() == 500
    w.remove(500)
    assert w.least() is None
    for ts in (2000, 2000, 2001):
        w.add(ts)
    assert (w.distinct(), w.least()) == (2, 2000)
    w.remove(2000)
    w.remove(2000)
    assert w.least() == 2001


def test_bloom(spark):
    n = bloom.n_bits(100, 0.01)
    k = bloom.n_hashes(bloom.bits_per_key(0.01))
    every = spark.range(10_000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    built = bloom.build(every.where("key < 'key' or substring(key, 4) % 100 = 0"), "key", n, k)
    maybe = {r["key"] for r in bloom.probe(every, "key", built, n, k).collect()}
    assert {f"key{i}" for i in range(0, 10_000, 100)} <= maybe
    assert len(maybe) < 100 + 9_900 * 0.03


def test_too_many_hashes_say_nothing(spark):
    some = spark.createDataFrame([("a",), ("b",)], "key string")
    assert bloom.probe(some, "key", bloom.build(some.limit(0), "key", 64, 3), 64, 31).count() == 2 and bloom.probe(some, "key", bloom.build(some.limit(0), "key", 64, 3), 64, 3).count() == 0


def test_find_block_has_no_range_join(spark):
    keys_, blocks_ = spark.range(100).selectExpr("id % 3 as run", "cast(id as string) as key"), spark.range(9).selectExpr("id % 3 as run", "id as block", "cast(id * 10 as string) as first_key")
    assert "NestedLoop" not in blocks.find_block(blocks_, ["run"], keys_, "key")._jdf.queryExecution().executedPlan().toString()


def test_votes(spark):
    nodes = spark.createDataFrame([(1, 4, None, 10, 4), (2, 5, 9, 10, 4), (3, 5, 7, 10, 4), (4, 5, None, 11, 4), (5, 6, None, 1, 1), (6, 3, 2, 12, 3)], "node int, current_term int, voted_for int, last_index int, last_term int")
    request = spark.createDataFrame([(7, 5, 10, 4)], "candidate int, term int, last_index int, last_term int")
    # 2 has voted for another, 4 has a longer log, 5 is in a later term
    assert {r["node"]: r["granted"] for r in quorum.votes(nodes, request).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_delimiter_prefixes(spark):
    df = spark.createDataFrame([("aaa:bbb:ccc",), ("plain",), ("x:",)], "k string").select("k", keys.delimiter_prefixes(F.col("k"), ":").alias("p"))
    assert {r["k"]: r["p"] for r in df.collect()} == {"aaa:bbb:ccc": ["aaa", "aaa:bbb"], "plain": [], "x:": ["x"]}


def test_codecs(spark, tmp_path):
    for name in blocks.CODECS:
        at = str(tmp_path / name)
        spark.range(100).selectExpr("concat('key_', id) as k").write.options(**blocks.codec_options(name)).parquet(at)
        assert spark.read.parquet(at).count() == 100
    with pytest.raises(ValueError, match="no such codec"):
        blocks.codec_options("rar")


def test_quorum(spark):
    m = spark.createDataFrame([(0, 9), (1, 4), (2, 6)], "node int, match_index int")
    log = spark.createDataFrame([(i, 1 if i < 6 else 2) for i in range(10)], "index int, term int")
    assert quorum.commit_index(m, log, 2).first()[0] == 6
    assert quorum.commit_index(m, log, 1).first()[0] == 5


def test_key_predicates_reach_the_scan(spark, tmp_path):
    at = str(tmp_path / "log")
    changelog(spark, LADDER).write.parquet(at)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole predicates in the plan's text
    df = read.scan(spark.read.parquet(at), KV, included("fig"), excluded("plum"), 50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(key,fig)" in pushed and "LessThan(key,plum)" in pushed and "LessThanOrEqual(ts,50)" in pushed and "deleted" not in pushed
