"""Super-k-mers: consecutive windows that share a minimiser, cut out as one string, packed by bucket, and led back to their documents.

Both substring operators use this module; one counts windows of words, the other windows of bytes. A row of the shuffle holds all strings
that one chunk of the corpus sends to one bucket, compressed together. Equal strings of a chunk travel once, with the list of their places,
so that a group of copies costs a few bytes for each copy. A row is named by ``row_key``.

A minimiser that very many different strings share would make one bucket large. Those that do so in a sample are dealt further by a second minimiser,
the least under another hash. That moves equal windows together like the first one does, so the sample decides only where windows meet, not what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import byte_values, chunks, dropped, frugal, id_text, input_bytes, mix, mix_in_place, powers, prefix_hash, ranges, span_hash, with_key, written

#: Bases of the two hashes of a string; compared bytes decide, hashes only sort.
BASE_A, BASE_B = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D

#: Units of several documents that are hashed at once; more are halved.
CUT_UNITS = 1 << 20

#: Bytes of the sample in which frequent minimisers are looked for, or this share of the input if that is more; of its words or bytes, the part of an
#: average bucket from which a minimiser counts as frequent; and how many are told apart at most.
SAMPLE_BYTES, SAMPLE_SHARE, FREQUENT, MOST_FREQUENT = 16 << 20, 1e-4, 0.5, 100_000

PACKED = "bucket int, text binary, places binary"
SPANS = "row_key long, start int, end int"


#: Bytes of input to a bucket, all of which one worker holds with several arrays of that size.
BUCKET_BYTES = 5 << 18


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row_key``; row_key names each row, see with_key()."""
    named, key = with_key(docs)
    return id_text(named, F.col(key).alias("row_key"))


def n_buckets(docs: DataFrame) -> tuple[int, int]:
    """Partitions of the shuffle and buckets in all: enough for the bytes of the input, and eight buckets to a partition at least."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8 * n, min(-(-input_bytes(docs) // BUCKET_BYTES), 1 << 30))
    return max(n, buckets // 64), buckets


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive values."""
    if len(v) < w:
        return v[:0]
    size, out = 1, v
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - size :]) if size < w else out


def cut(values: np.ndarray, ends: np.ndarray, k: int, m: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a sequence of documents.

    values: a hash for each word, or the bytes; ends: where each document ends; frequent: sorted hashes of minimisers that are dealt further. Returns each
    super-k-mer's first window, number of windows, minimiser's place and the hash that deals it. Of equal minimisers of a window the first counts.
    """
    none = np.zeros(0, np.int64)
    if len(values) < k:
        return none, none, none, none.astype(np.uint64)
    if len(values) > CUT_UNITS and len(ends) > 1:  # half of the documents at a time
        half = min(max(1, int(np.searchsorted(ends, len(values) // 2))), len(ends) - 1)
        at = int(ends[half - 1])
        a, b = cut(values[:at], ends[:half], k, m, frequent), cut(values[at:], ends[half:] - at, k, m, frequent)
        return np.r_[a[0], b[0] + at], np.r_[a[1], b[1]], np.r_[a[2], b[2] + at], np.r_[a[3], b[3]]
    p = prefix_hash(byte_values(3)[values] if values.dtype == np.uint8 else values, BASE_A)
    n = len(values) - m + 1
    grams = p[m:] - p[:-m]
    grams *= powers(BASE_A, n)[1]
    mix_in_place(grams)

    def least_place(h: np.ndarray) -> np.ndarray:
        """Of each window the place of its least gram."""
        low = np.uint64((1 << 24) - 1)  # a chunk has under 2**24 units
        least = h & ~low
        least |= np.arange(n, dtype=np.uint64)
        return (sliding_min(least, k - m + 1) & low).astype(np.int32)

    place = least_place(grams)
    inside = np.ones(len(place), bool)  # the last k - 1 places of each document begin no window
    begins = np.maximum(np.r_[0, ends[:-1]], ends - k + 1)
    outside = ranges(begins, ends - begins)
    inside[outside[outside < len(place)]] = False
    starts = np.r_[True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])]
    first = np.flatnonzero(starts)
    dealt, again = None, None
    if frequent is not None and len(frequent):
        h = grams[place[first]]
        many = np.flatnonzero(frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h)
        if len(many):
            again = np.zeros(len(place), bool)
            again[ranges(first[many], np.diff(np.r_[first, len(place)])[many])] = True
            other = mix(grams ^ np.uint64(BASE_B))
            second = least_place(other)
            starts |= again & np.r_[True, second[1:] != second[:-1]]
            first = np.flatnonzero(starts)
            dealt = np.where(again[first], mix(grams[place[first]] ^ other[second[first]]), grams[place[first]])
    length = np.diff(np.r_[first, len(place)])
    good = inside[first]
    if dealt is None:
        dealt = grams[place[first]]
    return first[good], length[good], place[first[good]].astype(np.int64), dealt[good]


def frequent_minimisers(rows: DataFrame, cut_texts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], buckets: int) -> np.ndarray:
    """Sorted hashes of the minimisers that many windows of a sample share. ``cut_texts`` gives the number of windows and the hash of each super-k-mer."""
    spark, size = rows.sparkSession, input_bytes(rows)

    def run(batches):
        for _, texts in chunks(batches):
            n, h = cut_texts(texts)
            keys, where = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"minimiser": pa.array(keys.view(np.int64)), "n": pa.array(np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64))})

    share = min(1.0, max(SAMPLE_BYTES / size, SAMPLE_SHARE)) if size else 1.0
    some = rows.select("doc_id", "text").sample(share, seed=1).mapInArrow(frugal(run), "minimiser long, n long")
    counted = written(spark, some.groupBy("minimiser").agg(F.sum("n").alias("n")), "minimisers")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") > FREQUENT * total / buckets).orderBy(F.desc("n")).limit(MOST_FREQUENT).select("minimiser").toPandas()["minimiser"]
    dropped(spark, counted)
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; ``buf`` ends with eight spare bytes."""
    return np.ndarray((len(buf) - 7,), np.uint64, buf.data, strides=(1,))


def short_hash(buf: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of strings that all have ``length`` bytes, eight at least, taken in words of eight."""
    view = words8(buf)
    out = np.full(len(start), np.uint64(length))
    for at in [*range(0, length - 8, 8), length - 8]:
        out = mix(out ^ view[start + at])
    return out


def same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``buf[a:a+length] == buf[b:b+length]``, byte by byte; ``buf`` ends with eight spare bytes."""
    out = np.ones(len(a), bool)
    view = words8(buf)
    live, done = np.arange(len(a)), 0
    while len(live):
        rest = length[live] - done
        live, rest = live[rest > 0], rest[rest > 0]
        if not len(live):
            break
        differ = view[a[live] + done] ^ view[b[live] + done]
        shift = (8 * (8 - np.minimum(rest, 8))).astype(np.uint64)
        bad = (differ << shift) != 0
        out[live[bad]] = False
        live = live[~bad]
        done += 8
    return out


def string_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray, base: int, block: int = 1 << 20) -> np.ndarray:
    """Hashes of strings that begin in ascending order; the buffer is taken up block by block."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + block))
        low = start[i]
        p = prefix_hash(values[buf[low : end[i:j].max()]], base)
        out[i:j] = span_hash(p, start[i:j] - low, end[i:j] - low, base)
        i = j
    return out


def gathered(buf: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The strings one after the other; places are worked out for about ``block`` bytes at a time."""
    ends = np.cumsum(length)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(block, int(ends[-1]) if len(ends) else 0, block)), len(start)])
    return np.concatenate([buf[ranges(start[i:j], length[i:j])] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] or [buf[:0]])


def padded(*parts: bytes) -> np.ndarray:
    return np.frombuffer(b"".join([*parts, b"\0" * 8]), np.uint8)


def classes(buf: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort strings of ``buf``, which begin in ascending order; equal ones become neighbours.

    h: their hashes, where known. Returns the order, and for each place of it whether a new class of equal strings begins there. Hashes sort; bytes are then compared,
    and where two strings share a hash only, theirs are sorted anew by their bytes.
    """
    if h is None:
        h = mix(string_hash(buf, start, start + length, byte_values(2), BASE_B) + length.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    hs = h[order]
    twin = np.flatnonzero(hs[1:] == hs[:-1])
    new = np.ones(len(order), bool)
    a, b = order[twin], order[twin + 1]
    equal = (length[a] == length[b])
    equal[equal] = same(buf, start[a[equal]], start[b[equal]], length[a[equal]])
    new[twin + 1] = ~equal
    for bad in np.unique(hs[twin[~equal] + 1]):  # different strings with one hash
        i, j = np.searchsorted(hs, bad), np.searchsorted(hs, bad, side="right")
        text = {x: buf[start[x] : start[x] + length[x]].tobytes() for x in order[i:j].tolist()}
        order[i:j] = sorted(text, key=text.__getitem__)
        new[i + 1 : j] = [text[x] != text[y] for x, y in zip(order[i : j - 1].tolist(), order[i + 1 : j].tolist(), strict=True)]
    return order, new


def packed(buf: np.ndarray, start: np.ndarray, length: np.ndarray, bucket: np.ndarray, of: np.ndarray, numbers: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows ``bucket, text, places`` for the strings of a chunk. ``of``: the ``numbers`` int64 that each occurrence carries."""
    order, new = classes(buf, start, length)
    head = order[new]  # one string of each class
    members = np.diff(np.r_[np.flatnonzero(new), len(order)])
    first = np.flatnonzero(new)
    by = np.lexsort((head, bucket[head]))  # in a bucket as they stand in the corpus: their places then grow in small steps
    head, members, first = head[by], members[by], first[by]
    sorted_bucket = bucket[head]
    cuts = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]]) if len(head) else np.zeros(0, np.int64)
    z = zstandard.ZstdCompressor(level=3)
    for i, j in zip(cuts.tolist(), np.r_[cuts[1:], len(head)].tolist(), strict=True):
        text = gathered(buf, start[head[i:j]], length[head[i:j]]).tobytes()
        who = order[ranges(first[i:j], members[i:j])]
        steps = np.diff(of[who].T, axis=1, prepend=0)
        places = np.concatenate([[j - i], length[head[i:j]], members[i:j], steps.ravel()]).astype(np.int64)
        # bytes of equal weight together compress better
        yield int(sorted_bucket[i]), z.compress(text), z.compress(np.ascontiguousarray(places.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(rows: list[tuple[bytes, bytes]], numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of a bucket: bytes, start, length, number of occurrences of each, and the numbers of the occurrences."""
    z = zstandard.ZstdDecompressor()
    texts, length, members, of = [], [], [], []
    for text, places in rows:
        raw = np.frombuffer(z.decompress(places), np.uint8)
        x = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()
        n = int(x[0])
        texts.append(z.decompress(text))
        length.append(x[1 : n + 1])
        members.append(x[n + 1 : 2 * n + 1])
        of.append(np.cumsum(x[2 * n + 1 :].reshape(numbers, -1), axis=1))
    length = np.concatenate(length)
    return padded(*texts), np.cumsum(length) - length, length, np.concatenate(members), np.concatenate(of, axis=1)


def by_bucket(shuffled: DataFrame, solve: Callable[[list[tuple[bytes, bytes]]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], partitions: int) -> DataFrame:
    """Solve each bucket where its rows meet; ``solve`` yields row keys, starts and ends."""

    def run(batches):
        held: list[tuple[bytes, bytes]] = []
        now = None

        def flush():
            if held:
                for key, start, end in solve(held):
                    if len(key):
                        yield pa.RecordBatch.from_pydict({"row_key": pa.array(key, pa.int64()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32())})

        for b in batches:
            for bucket, text, places in zip(b.column("bucket").to_pylist(), b.column("text"), b.column("places"), strict=True):
                if bucket != now:
                    yield from flush()
                    held, now = [], bucket
                held.append((text.as_py(), places.as_py()))
        yield from flush()

    return shuffled.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(run), SPANS)


def merged_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint ones in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    first = np.flatnonzero(new)
    return start[first], end[np.r_[first[1:], len(end)] - 1]


#: Bits of the set that tells rows with spans from others. Of fixed size: if it fills up, more rows than needed are joined.
TOUCHED_BITS = 1 << 26


def _bit():
    return F.pmod(F.xxhash64("row_key"), F.lit(TOUCHED_BITS)).cast("long")


def without_spans(rows: DataFrame, spans: DataFrame, report: Callable[[pa.Array, list[str], list], pa.RecordBatch], schema: str) -> DataFrame:
    """``report(doc ids, texts, [(starts, ends)])`` of every row of keyed(), with the disjoint intervals that are to go.

    Only texts with spans are shuffled. A bit set of at most 8 MB, put together by the executors, names them (and a few others).
    """
    spark = rows.sparkSession
    lists = written(spark, spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    bit = lists.select((_bit() + 1).alias("bit"))  # the bitmap functions count from 1
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(TOUCHED_BITS // 8, np.uint8)
    for part, data in parts:
        at = (part - 1) * len(data)
        bits[at : at + len(data)] = np.frombuffer(data, np.uint8)
    sent = spark.sparkContext.broadcast(bits)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def touched(b) -> np.ndarray:
        at = b.column("bit").to_numpy()
        return (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def apart(batches):
        for b in batches:
            for ids, texts in chunks([b.filter(pa.array(~touched(b)))]):
                yield report(ids, texts, [none] * len(texts))

    def chosen(batches):
        for b in batches:
            yield b.filter(pa.array(touched(b))).select(["doc_id", "text", "row_key"])

    def cut_out(batches):
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                starts, ends = b.column("starts").slice(at, len(ids)), b.column("ends").slice(at, len(ids))
                at += len(ids)
                yield report(ids, texts, [merged_runs(s.values.to_numpy(), e.values.to_numpy()) if s.is_valid else none for s, e in zip(starts, ends, strict=True)])

    marked = rows.select("doc_id", "text", "row_key", _bit().alias("bit"))
    joined = marked.mapInArrow(frugal(chosen), "doc_id long, text string, row_key long").join(lists.hint("merge"), "row_key", "left")
    joined = joined.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return marked.mapInArrow(frugal(apart), schema).unionByName(joined.mapInArrow(frugal(cut_out), schema))
