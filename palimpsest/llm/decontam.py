"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

A-Z become a-z, words are maximal runs of ``[0-9a-z]`` and everything beyond ASCII. A window is ten consecutive words of an item (the
whole item where it has fewer). Each word of the items becomes one letter, so the automaton has a node for each word of a window, and a match ends
at a word of the document, which is scanned once; word numbers lead back to its code points.

An automaton of GROUP_WINDOWS windows takes some 250 MB of a worker. Items with more windows are dealt into groups; the driver holds
one of them at a time, and each makes a pass of its own over the documents, whose (few) hits are written to the shared folder.

Null or empty texts have no words and no hits; items without words are ignored; an empty benchmark leaves every document clean; equal
items, or equal windows of different items, count for each item; rows that repeat are reported each. Columns other than doc_id/item_id and text
are ignored.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, filtered, frugal, hex_digests, id_text, model, written
from palimpsest.llm.kmers import keyed

WINDOW = 10
#: Windows in one automaton.
GROUP_WINDOWS = 500_000

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split()


class Scan:
    """The automaton over the windows of ``(item id, words)``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.letters: dict[bytes, str] = {}
        self.size, self.owner = array("i"), array("q")  # of each window, and its first item
        self.more: dict[int, list[int]] = {}  # further items
        self.items = [item for item, _ in items]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, (_, words) in enumerate(items):
            text = "".join([self.letters.setdefault(w, self._letter(len(self.letters))) for w in words])
            size = min(window, len(words))
            for key in {text[i : i + size] for i in range(len(words) - size + 1)} if size else ():
                at = self.trie.get(key, -1)
                if at < 0:
                    self.trie.add_word(key, len(self.owner))
                    self.size.append(size)
                    self.owner.append(number)
                else:
                    self.more.setdefault(at, []).append(number)
        if len(self.owner):
            self.trie.make_automaton()

    @staticmethod
    def _letter(n: int) -> str:
        """Code points from 1 on, without surrogates."""
        return chr(n + 1 if n + 1 < 0xD800 else n + 0x801)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The merged word intervals inside matches, and the ids of the items that match."""
        if not words or not len(self.owner):
            return [], set()
        found = list(self.trie.iter("".join([self.letters.get(w, "\0") for w in words])))
        if not found:
            return [], set()
        which = {at for _, at in found}
        items = {self.items[self.owner[at]] for at in which} | {self.items[i] for at in which for i in self.more.get(at, ())}
        return merged(sorted((end + 1 - self.size[at], end + 1) for end, at in found)), items


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in intervals:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def groups(benchmark: DataFrame, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in groups of GROUP_WINDOWS windows at most; longer items come in pieces that share ``window - 1`` words."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).toLocalIterator()
    out, room = [], GROUP_WINDOWS
    for item, text in rows:
        words = words_of(text)
        for at in range(0, max(1, len(words) - window + 1), GROUP_WINDOWS):
            piece = words[at : at + GROUP_WINDOWS + window - 1]
            n = max(1, len(piece) - window + 1)
            if out and n > room:
                yield out
                out, room = [], GROUP_WINDOWS
            if piece:
                out.append((item, piece))
                room -= n
    if out:
        yield out


class _Sent:
    """A broadcast group; each worker builds its automaton once."""

    def __init__(self, docs: DataFrame, items: list, window: int):
        self.sent, self.name, self.window = docs.sparkSession.sparkContext.broadcast(items), f"items {uuid.uuid4().hex}", window

    def scan(self) -> Scan:
        return model(self.name, lambda: Scan(self.sent.value, self.window))


def _spans(batch: list[list[tuple[int, int]]]) -> tuple[pa.Array, pa.Array]:
    return pa.array([[s for s, _ in x] for x in batch], pa.list_(pa.int32())), pa.array([[e for _, e in x] for x in batch], pa.list_(pa.int32()))


def _found(rows: DataFrame, group: _Sent) -> DataFrame:
    """``row_key, starts, ends, items`` of the rows that one group hits."""

    def run(batches):
        scan = group.scan()
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                keys = b.column("row_key").slice(at, len(ids))
                at += len(ids)
                got = [scan.hits(words_of(x)) for x in texts]
                some = [i for i, (spans, _) in enumerate(got) if spans]
                starts, ends = _spans([got[i][0] for i in some])
                yield pa.RecordBatch.from_pydict({"row_key": keys.take(pa.array(some, pa.int64())), "starts": starts, "ends": ends, "items": pa.array([sorted(got[i][1]) for i in some], pa.list_(pa.string()))})

    return rows.mapInArrow(frugal(run), "row_key long, starts array<int>, ends array<int>, items array<string>")


def _report(ids, texts: list[str], spans: list[list[tuple[int, int]]], items: list[set[str]]) -> pa.RecordBatch:
    n_words, places = [], []
    for text, own in zip(texts, spans, strict=True):
        n_words.append(len(words_of(text)))
        at = [m.span() for m in _WORD.finditer(text)] if own else []
        places.append([{"start": at[s][0], "end": at[e - 1][1]} for s, e in own])
    n_hit = [sum(e - s for s, e in x) for x in spans]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array(hex_digests(",".join(sorted(x)).encode() for x in items)), "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_()), "spans": pa.array(places, kind),
    })


_SHAPE = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans``: the hit passages as code point offsets ``(start, end)`` in the original text, end exclusive. One group of items is one narrow
    pass; with more, each pass writes its hits, which are brought together by row.
    """
    spark, every = docs.sparkSession, groups(benchmark, window)
    first, second = next(every, []), next(every, None)
    if second is None:
        group = _Sent(docs, first, window)

        def run(batches):
            scan = group.scan()
            for ids, texts in chunks(batches):
                got = [scan.hits(words_of(x)) for x in texts]
                yield _report(ids, texts, [x for x, _ in got], [x for _, x in got])

        return id_text(docs).mapInArrow(frugal(run), _SHAPE)
    rows, parts, items = keyed(docs), [], first
    while items is not None:
        group = _Sent(docs, items, window)
        parts.append(written(spark, _found(rows, group), "hits"))
        group.sent.unpersist()
        items, second = second, next(every, None)
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    joined = rows.join(found.groupBy("row_key").agg(*lists), "row_key", "left").select("doc_id", "text", "starts", "ends", "items")

    def together(batches):
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                starts, ends, items = (b.column(k).slice(at, len(ids)).to_pylist() for k in ("starts", "ends", "items"))
                at += len(ids)
                yield _report(ids, texts, [merged(sorted(zip(s or [], e or [], strict=True))) for s, e in zip(starts, ends, strict=True)], [set(x or ()) for x in items])

    return joined.mapInArrow(frugal(together), _SHAPE)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns; each group of items makes one narrow pass, and what
    passes all but the last is written."""

    def without(group: _Sent):
        def run(batches):
            scan = group.scan()
            yield from filtered(batches, lambda texts: [not scan.hits(words_of(x))[0] for x in texts])

        return docs.mapInArrow(frugal(run), docs.schema)

    before = None
    for items in groups(benchmark, window):
        if before is not None:
            docs = written(docs.sparkSession, docs, "clean")
        docs = without(before := _Sent(docs, items, window))
    return docs
