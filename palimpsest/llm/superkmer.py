"""Substring deduplication: every word inside a window of 35 words that also starts elsewhere goes, all its copies included.

Windows are routed by super-k-mer: consecutive windows with the same minimiser (the least hash among their five-word grams) travel as one
string. In a bucket, equal strings are united, all windows are sorted by hash and compared with their neighbours byte by byte, and a
window counts as often as the documents have it.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. Null and empty texts have none; texts of fewer than 35 words have no window; a window that
repeats within one document counts twice; rows that repeat doc_id and text are copies of each other, so their windows all go. Very long
texts are cut into overlapping pieces. Empty tables give empty results. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import CHUNK_BYTES, byte_values, chunks, frugal, hex_digests, mix, prefix_hash, ranges, span_hash
from palimpsest.llm.kmers import BASE_A, BASE_B, PACKED, by_bucket, classes, cut, frequent_minimisers, gathered, keyed, n_buckets, packed, string_hash, unpacked, without_spans

WINDOW, GRAM = 35, 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, overlap: int, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that overlap by ``overlap`` words, and the number of each one's first word."""
    start, number = 0, 0
    while len(text) - start > 2 * size and (m := _BREAK.search(text, start + size)):
        piece = text[start : m.start()]
        head = piece.rsplit(None, overlap)[0] if len(piece.split(None, overlap + 1)) > overlap else b""
        if not head or not head.split():
            size *= 2  # too few words here to overlap
            continue
        yield piece, number
        number += len(head.split())
        start += len(head)
    yield text[start:], number


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with a space after each word, where words start and end in it, and the number of words up to the end of each text."""
    buf = np.frombuffer(b"".join(x + b"\n" for x in texts), np.uint8)
    space = _SPACE[buf]
    after_word = np.r_[False, ~space[:-1]]
    word_ends = np.cumsum(space & after_word)
    upto = word_ends[np.cumsum([len(x) + 1 for x in texts]) - 1] if texts else np.zeros(0, np.int64)
    keep = ~space | after_word
    buf, space = buf[keep], space[keep]
    buf = np.where(space, np.uint8(32), buf)
    ends = np.flatnonzero(space)
    return np.concatenate([buf, np.zeros(8, np.uint8)]), np.r_[0, ends[:-1] + 1] if len(ends) else ends, ends, upto


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(string_hash(buf, starts, ends, byte_values(1), BASE_A) + (ends - starts).astype(np.uint64))


def pack(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    def cut_texts(texts):
        buf, starts, ends, upto = laid_out([p for x in texts for p, _ in pieces(x.encode("utf-8", "replace"), window - 1)])
        _, n, _, h = cut(word_hashes(buf, starts, ends), upto, window, gram)
        return n, h

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_minimisers(docs, cut_texts, buckets))

    def run(batches):
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                keys = b.column("row_key").slice(at, len(ids)).to_numpy(zero_copy_only=False)
                at += len(ids)
                parts = [(k, p, n) for k, x in zip(keys.tolist(), texts, strict=True) for p, n in pieces(x.encode("utf-8", "replace"), window - 1)]
                for some in [[x] for x in parts] if len(parts) > len(texts) else [parts]:  # a text in pieces comes alone
                    buf, starts, ends, upto = laid_out([p for _, p, _ in some])
                    if not len(upto) or upto[-1] < window:
                        continue
                    first, n, _, gram_hash = cut(word_hashes(buf, starts, ends), upto, window, gram, frequent.value)
                    if not len(first):
                        continue
                    doc = np.searchsorted(upto, first, side="right")
                    before = np.r_[0, upto[:-1]]
                    of = np.stack([np.array([k for k, _, _ in some], np.int64)[doc], first - before[doc] + np.array([x for _, _, x in some], np.int64)[doc]], axis=1)
                    start = starts[first]
                    length = ends[first + n + window - 2] - start
                    bucket = (mix(gram_hash) >> np.uint64(20)) % np.uint64(buckets)
                    rows = list(packed(buf, start, length + 1, bucket.astype(np.int64), of, 2))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in rows], pa.int32()), "text": [x[1] for x in rows], "places": [x[2] for x in rows]})

    return docs.mapInArrow(frugal(run), PACKED)


def _solver(window: int):
    def solve(rows):
        buf, start, length, members, of = unpacked(rows, 2)
        # equal strings of different chunks become one
        order, new = classes(buf, start, length)
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        head = order[new]
        count = np.bincount(string, weights=members, minlength=len(head)).astype(np.int64)
        who = np.repeat(string, members)
        by = np.argsort(who, kind="stable")
        of = of[:, by]
        text = np.concatenate([gathered(buf, start[head], length[head]), np.zeros(8, np.uint8)])
        ends = np.flatnonzero(text[:-8] == 32)
        starts = np.r_[0, ends[:-1] + 1]
        last = np.searchsorted(ends, np.cumsum(length[head]) - 1, side="right")  # words up to the end of each string
        words = np.diff(np.r_[0, last])
        windows = words - window + 1
        first = ranges(last - words, windows)
        string_of = np.repeat(np.arange(len(head)), windows)
        wp = prefix_hash(word_hashes(text, starts, ends), BASE_B)
        h = mix(span_hash(wp, first, first + window, BASE_B))
        got, fresh = classes(text, starts[first], ends[first + window - 1] - starts[first], h)
        seen = np.add.reduceat(count[string_of[got]], np.flatnonzero(fresh)) if len(got) else np.zeros(0, np.int64)
        twice = np.empty(len(got), bool)
        twice[got] = np.repeat(seen > 1, np.diff(np.r_[np.flatnonzero(fresh), len(got)]))
        # runs of windows to go, within each string
        edge = np.flatnonzero(np.diff(np.r_[False, twice, False].astype(np.int8)) != 0) if len(twice) else np.zeros(0, np.int64)
        a, b = _split_runs(edge[::2], edge[1::2], np.cumsum(windows))
        s = string_of[a]
        base = np.cumsum(windows) - windows
        times = count[s]
        row = ranges((np.cumsum(count) - count)[s], times)
        yield of[0][row], of[1][row] + np.repeat(a - base[s], times), of[1][row] + np.repeat(b - base[s] + window - 1, times)

    return solve


def _split_runs(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``[a, b)`` cut at the bounds between strings."""
    if not len(a):
        return a, b
    inner = bounds[(np.searchsorted(a, bounds, side="left") - 1 >= 0)]
    k = np.searchsorted(a, inner, side="left") - 1
    inner = inner[(inner > a[k]) & (inner < b[k])]
    return np.sort(np.r_[a, inner]), np.sort(np.r_[b, inner])


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row_key, start, end`` from the rows of keyed(): word intervals of the documents that repeated windows cover. They may overlap."""
    partitions, buckets = n_buckets(rows)
    return by_bucket(pack(rows, buckets, window, gram), _solver(window), partitions)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256, kept_text``."""

    def report(ids, texts, spans):
        n_words, n_removed, kept = [], [], []
        for text, (s, e) in zip(texts, spans, strict=True):
            words = text.encode("utf-8", "replace").split()
            n_words.append(len(words))
            n_removed.append(int((e - s).sum()))
            if len(s):
                words = [w for x, y in zip([0, *e.tolist()], [*s.tolist(), len(words)], strict=True) for w in words[x:y]]
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(hex_digests(kept), pa.string()), "kept_text": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()),
        })

    rows = keyed(docs)
    return without_spans(rows, repeated_spans(rows, window, gram), report, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
