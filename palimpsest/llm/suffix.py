"""Suffix-array deduplication: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id go.

The corpus is dealt into shards by super-k-mers of bytes, so that all places of a 50-byte string meet in one shard, as pieces of text.
Pieces whose minimiser never recurs in the shard with the same bytes beside it hold no repeated string and are set aside. Over the others a suffix array is built by
induced sorting: suffixes are classified as larger or smaller than their successor, the leftmost-smaller ones (those after a larger one) are
sorted by their substrings, then as a reduced string, and all others are induced from them in two linear passes. The passes work bucket by
bucket with whole arrays; the reduced string has too many letters for that and is sorted by doubling its ranks. Common prefixes with the
preceding suffix are computed in text order (permuted) up to the 50 bytes that matter, and suffixes that share these form a group, whose
smallest doc_id decides.

Null and empty texts have no bytes; texts under 50 bytes lose none. Rows with the same doc_id don't take from each other. A null doc_id counts as
larger than all others. Very long texts are cut into overlapping pieces. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import CHUNK_BYTES, chunks, frugal, hex_digests, mix, ranges
from palimpsest.llm.kmers import PACKED, by_bucket, classes, cut, frequent_minimisers, gathered, keyed, n_buckets, packed, same, short_hash, unpacked, without_spans

LENGTH, GRAM = 50, 12
NO_ID = np.int64(2**63 - 1)


# ---- induced sorting


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    n = len(t)
    rises = np.ones(n, np.int8)
    step = t[1:].astype(np.int32) - t[:-1].astype(np.int32)
    rises[:-1] = np.sign(step)
    # an equal pair takes the type of the next unequal one
    known = np.where(rises != 0, np.arange(n), n)
    return rises[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _induce(t: np.ndarray, smaller: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, in order, from the sorted leftmost-smaller ones. bounds: where the bucket of each letter begins."""
    n, letters = len(t), len(bounds) - 1
    sa = np.full(n, -1, np.int32)
    by = np.argsort(t[seeds], kind="stable")
    seed_bounds = np.searchsorted(t[seeds][by], np.arange(letters + 1))
    seeds = seeds[by]

    def scatter(fill: np.ndarray, found: np.ndarray, forward: bool) -> None:
        """Append suffixes, in the order in which the pass meets them, to their letters' buckets."""
        key = t[found]
        order = np.argsort(key, kind="stable")
        found, key = found[order], key[order]
        count = np.bincount(key, minlength=letters)
        rank = np.arange(len(found)) - (np.cumsum(count) - count)[key]
        sa[fill[key] + rank if forward else fill[key] - rank] = found
        fill += count if forward else -count

    # larger suffixes, from the fronts of the buckets
    head = bounds[:-1].copy()
    for c in range(letters):
        if bounds[c + 1] == bounds[c]:
            continue
        met, at = [], bounds[c]
        while head[c] > at:  # what the bucket itself induces stands behind what earlier ones did
            some = sa[at : head[c]]
            at = head[c]
            before = some[some > 0] - 1
            before = before[~smaller[before]]
            own = before[t[before] == c]
            met.append(before[t[before] > c])
            sa[at : at + len(own)] = own
            head[c] += len(own)
        some = seeds[seed_bounds[c] : seed_bounds[c + 1]]
        before = some[some > 0] - 1
        met.append(before[~smaller[before]])
        found = np.concatenate(met)
        if len(found):
            scatter(head, found, True)
    # smaller suffixes, from the backs; the seeds give way to them
    tail = bounds[1:] - 1
    sa[0] = n - 1  # the last suffix follows from no other
    for c in range(letters - 1, -1, -1):
        if bounds[c + 1] == bounds[c]:
            continue
        met, at = [], bounds[c + 1] - 1
        while tail[c] < at:
            some = sa[tail[c] + 1 : at + 1][::-1]
            at = tail[c]
            before = some[some > 0] - 1
            before = before[smaller[before]]
            own = before[t[before] == c]
            met.append(before[t[before] < c])
            sa[at - len(own) + 1 : at + 1] = own[::-1]
            tail[c] -= len(own)
        some = sa[bounds[c] : head[c]][::-1]  # the larger suffixes of this letter
        before = some[some > 0] - 1
        met.append(before[smaller[before]])
        found = np.concatenate(met)
        if len(found):
            scatter(tail, found, False)
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of numbers, by ranks of prefixes of length 1, 2, 4, ...; only unsettled ones are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    new = np.r_[True, sorted_names[1:] != sorted_names[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    size = 1
    while True:
        single = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order
        live = order[slots]
        key = rank[live] * (n + 1) + rank[np.minimum(live + size, n)] + 1
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        order[slots] = live
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[slots] = fresh
        rank[live] = np.maximum.accumulate(np.where(fresh, slots, 0))
        size *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of a sequence of small numbers whose last is the only 0."""
    t = t.astype(np.uint16)
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    letters = int(t.max()) + 1
    smaller = _types(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    bounds = np.r_[0, np.cumsum(np.bincount(t, minlength=letters))]
    sa = _induce(t, smaller, bounds, leftmost)
    # the leftmost-smaller suffixes now stand in the order of their substrings
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    in_order = sa[is_left[sa]]
    length = np.empty(n, np.int64)
    length[leftmost] = np.diff(np.r_[leftmost, n - 1]) + 1
    a, b = in_order[:-1].astype(np.int64), in_order[1:].astype(np.int64)
    equal = length[a] == length[b]
    raw = np.concatenate([t.view(np.uint8), np.zeros(8, np.uint8)])
    equal[equal] = same(raw, 2 * a[equal], 2 * b[equal], 2 * length[a[equal]])
    name = np.empty(n, np.int64)
    name[in_order] = np.r_[0, np.cumsum(~equal)]
    names = name[leftmost]
    distinct = name[in_order[-1]] + 1 == len(names)
    return _induce(t, smaller, bounds, in_order if distinct else leftmost[_doubled(names)])


def permuted_common(buf: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text, how many bytes (up to ``most``, in whole words of eight or to the end) its suffix shares with the one before it."""
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    view = np.ndarray((len(buf) - 7,), np.uint64, buf.data, strides=(1,))
    out = np.zeros(n, np.int32)
    live, done = np.flatnonzero(phi >= 0), 0
    while done < most and len(live):
        live = live[np.maximum(live, phi[live]) + done < n]
        take = min(8, most - done)
        equal = ((view[live + done] ^ view[phi[live] + done]) << np.uint64(8 * (8 - take))) == 0
        live = live[equal]
        done += take
        out[live] = done
    return out


# ---- shards


def _pack(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def cut_texts(texts):
        every = (x.encode("utf-8", "replace") for x in texts)
        raw = [x[i : i + CHUNK_BYTES + length - 1] for x in every for i in range(0, max(1, len(x) - length + 1), CHUNK_BYTES)]
        _, n, _, h = cut(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]), length, gram)
        return n, h

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_minimisers(docs, cut_texts, buckets))

    def run(batches):
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                keys = b.column("row_key").slice(at, len(ids)).to_numpy(zero_copy_only=False)
                doc_ids = b.column("known_id").slice(at, len(ids)).to_numpy(zero_copy_only=False)
                at += len(ids)
                raw = [x.encode("utf-8", "replace") for x in texts]
                if len(raw) == 1 and len(raw[0]) > 2 * CHUNK_BYTES:
                    parts = [([raw[0][i : i + CHUNK_BYTES + length - 1]], i) for i in range(0, len(raw[0]) - length + 1, CHUNK_BYTES)]
                else:
                    parts = [(raw, 0)]
                for some, offset in parts:
                    buf = np.frombuffer(b"".join([*some, b"\0" * 8]), np.uint8)
                    upto = np.cumsum([len(x) for x in some])
                    first, n, place, gram_hash = cut(buf[:-8], upto, length, gram, frequent.value)
                    if not len(first):
                        continue
                    doc = np.searchsorted(upto, first, side="right")
                    of = np.stack([keys[doc], doc_ids[doc], first - np.r_[0, upto[:-1]][doc] + offset, place - first], axis=1)
                    bucket = ((mix(gram_hash) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                    rows = list(packed(buf, first, n + length - 1, bucket, of, 4))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in rows], pa.int32()), "text": [x[1] for x in rows], "places": [x[2] for x in rows]})

    return docs.mapInArrow(frugal(run), PACKED)


def _may_repeat(buf: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, members: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Pieces that can hold a repeated string at all.

    Equal strings have their minimiser at the same place, and reach at least ``reach`` bytes beyond it on one side; so the minimiser with
    that many bytes before it, or after it, stands in another piece as well. (Equal hashes only keep more pieces.)
    """
    reach = (length - gram + 1) // 2
    out = members > 1
    at = start + place
    for able, begin in ((place >= reach, at - reach), (size - place >= gram + reach, at)):
        some = np.flatnonzero(able)
        if not len(some):
            continue
        _, where, n = np.unique(short_hash(buf, begin[some], gram + reach), return_inverse=True, return_counts=True)
        out[some] |= n[where] > 1
    return out


def _solver(length: int, gram: int):
    def solve(rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        buf, start, size, members, of = unpacked(rows, 4)
        first_member = np.cumsum(members) - members
        keep = np.flatnonzero(_may_repeat(buf, start, size, of[3][first_member], members, length, gram))
        if not len(keep):
            return
        of = of[:, ranges(first_member[keep], members[keep])]
        start, size, members = start[keep], size[keep], members[keep]
        # equal pieces of different chunks become one
        order, new = classes(buf, start, size)
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(new) - 1
        head = order[new]
        owner = np.repeat(piece, members)
        by = np.argsort(owner, kind="stable")
        of, owner = of[:, by], owner[by]
        least = np.minimum.reduceat(of[1], np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
        size = size[head]
        text = gathered(buf, start[head], size)
        at = np.cumsum(size) - size
        removed_from, removed_to, removed_piece = [], [], []
        if len(head) > 1:
            # the text with a separator after each piece, and a last letter below all
            gap = np.repeat(np.arange(len(head)), size)
            t = np.ones(len(text) + len(head) + 1, np.uint16)
            inside = np.arange(len(text)) + gap
            t[inside] = text.astype(np.uint16) + 2
            t[-1] = 0
            sa = suffix_array(t)
            plain = np.zeros(len(t) + 8, np.uint8)
            plain[inside] = text
            shared = permuted_common(plain, sa, length)
            window = np.zeros(len(t), bool)
            window[ranges(at + np.arange(len(head)), size - length + 1)] = True
            piece_at = np.zeros(len(t), np.int64)
            piece_at[inside] = gap
            run = np.cumsum(shared[sa] < length)
            real = window[sa]
            suffix, run = sa[real], run[real]
            fresh = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            lowest = np.minimum.reduceat(least[piece_at[suffix]], fresh)
            by_place = np.empty(len(t), np.int64)
            by_place[suffix] = np.repeat(lowest, np.diff(np.r_[fresh, len(suffix)]))
            gone = np.zeros(len(t) + 1, bool)
            gone[suffix] = by_place[suffix] < least[piece_at[suffix]]
            edge = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)) != 0)
            a, b = edge[::2], edge[1::2]  # the separators keep the pieces apart
            removed_piece = piece_at[a]
            base = at + np.arange(len(head))
            removed_from, removed_to = a - base[removed_piece], b - base[removed_piece] + length - 1
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[first, len(owner)])
        if len(removed_piece):  # repeats of an earlier document's bytes, in the members with the piece's least id
            row = ranges(first[removed_piece], count[removed_piece])
            which = np.repeat(np.arange(len(removed_piece)), count[removed_piece])
            own = of[1][row] == least[owner[row]]
            row, which = row[own], which[own]
            yield of[0][row], of[2][row] + removed_from[which], of[2][row] + removed_to[which]
        later = np.flatnonzero(of[1] > least[owner])  # whole pieces that an earlier document has too
        yield of[0][later], of[2][later], of[2][later] + size[owner[later]]

    return solve


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row_key, start, end`` from the rows of keyed(): byte intervals that go. They may overlap."""
    partitions, buckets = n_buckets(rows)
    known = rows.withColumn("known_id", F.coalesce("doc_id", F.lit(int(NO_ID))))
    return by_bucket(_pack(known, buckets, length, gram), _solver(length, gram), partitions)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes)."""

    def report(ids, texts, spans):
        n_bytes, kept = [], []
        for text, (s, e) in zip(texts, spans, strict=True):
            raw = text.encode("utf-8", "replace")
            n_bytes.append(len(raw))
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)) if len(s) else raw)
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array([int((e - s).sum()) for s, e in spans], pa.int64()),
            "n_spans": pa.array([len(s) for s, _ in spans], pa.int64()), "kept_sha256": pa.array(hex_digests(kept), pa.string()), "kept": pa.array(kept, pa.binary()),
        })

    rows = keyed(docs)
    return without_spans(rows, repeated_spans(rows, length, gram), report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
