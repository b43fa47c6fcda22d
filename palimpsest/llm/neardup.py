"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

Words are lower-cased (A-Z) runs of letters and digits; everything beyond ASCII belongs to words. A shingle is five consecutive words (the
whole text where it has fewer), its weight the number of times it stands in the text times the mean inverse document frequency of its words.
Document frequencies cover all documents and are kept for SLOTS hashed words, whatever the size of the corpus.

Texts with the same words are one node. Each node draws weighted samples, consistently: two nodes draw the same one with the
probability of their weighted Jaccard similarity. Bands of samples name the buckets it falls into. Pairs are verified by their weighted
Jaccard similarity, THRESHOLD or more, from their whole texts: first each member of a bucket with its lead, the least node; then, where
the others are of several components, every two members of different components. For that the texts of a bucket meet in blocks of
BLOCK_WORDS words, each two blocks in one task, which returns only links that join components. No pair of a bucket is left out. Members of buckets
that would take more than MOST_BLOCKS blocks are dealt anew by the narrower bands of the next of the LEVELS; buckets of the last are
judged however many blocks they have. Two texts of similarity 0.8 share no band of the first level in 4e-5 of cases, none of the second in 6e-4.

Null and empty texts, and texts without words, are classes of their own. Rows with the same words always share a class, so repeated rows do.
The class is named by its smallest doc_id (a null doc_id counts as larger than all). Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import byte_values, chunks, dropped, frugal, id_text, marked, mix, prefix_hash, ranges, span_hash, with_key, written
from palimpsest.llm.graph import components
from palimpsest.llm.kmers import BASE_A, BASE_B, keyed, string_hash

SHINGLE, THRESHOLD = 5, 0.8
#: Bands, and samples to a band, at each level.
LEVELS = ((14, 3), (40, 8))
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Words of a block of texts, and how many blocks a bucket may have before its members go to the next level.
BLOCK_WORDS, MOST_BLOCKS = 60_000, 32

_NORMAL = np.frombuffer(bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256)), np.uint8)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, and the number of words of each text."""
    buf = _NORMAL[np.frombuffer(b"".join(x + b"\n" for x in raw), np.uint8)]
    letter = buf != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    upto = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))
    h = mix(string_hash(buf, starts, ends, byte_values(5), BASE_A) + (ends - starts).astype(np.uint64))
    return h, np.diff(np.r_[0, upto])


def slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Weights:
    """Inverse document frequency of each slot."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf.astype(np.float32)

    def shingles(self, words: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text, sorted within it: hash, weight, and how many each text has."""
        size = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
        span = np.minimum(count, SHINGLE)
        start = ranges(np.cumsum(count) - count, size)
        width = np.repeat(span, size)
        text = np.repeat(np.arange(len(count)), size)
        h = mix(span_hash(prefix_hash(words, BASE_B), start, start + width, BASE_B) + width.astype(np.uint64))
        sums = np.concatenate([[0.0], np.cumsum(self.idf[slots(words)], dtype=np.float64)])
        idf = (sums[start + width] - sums[start]) / np.maximum(width, 1)
        order = np.lexsort((h, text))
        h, text, idf = h[order], text[order], idf[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(h)])
        return h[first], (times * idf[first]).astype(np.float32), np.bincount(text[first], minlength=len(count))


class Sampler:
    """Improved consistent weighted sampling. Gamma(2, 1) values come from a table that the bits of a hash point into."""

    def __init__(self):
        rng = np.random.default_rng(2010)
        self.r = rng.gamma(2, 1, 1 << 16).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)

    def bands(self, h: np.ndarray, weight: np.ndarray, count: np.ndarray, level: int = 0) -> np.ndarray:
        """[texts with shingles, bands] bucket names."""
        count, (bands, rows) = count[count > 0], LEVELS[level]
        if not len(count):
            return np.zeros((0, bands), np.int64)
        first = np.cumsum(count) - count
        text = np.repeat(np.arange(len(count)), count)
        log_w = np.log(weight)
        drawn = []
        low = np.uint64(0xFFFF)
        for k in range(bands * rows):
            x = (h ^ np.uint64((k + 1) * 0xA24BAED4963EE407 % (1 << 64))) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            r = self.r[(x >> np.uint64(48)).astype(np.int32)]
            beta = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[((x >> np.uint64(32)) & low).astype(np.int32)] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, first)
            at = np.flatnonzero(log_a == np.repeat(least, count))
            at = at[np.r_[True, text[at[1:]] != text[at[:-1]]]]
            drawn.append(mix(h[at] + mix(t[at].astype(np.int64).astype(np.uint64) + np.uint64(k))))
        out = np.empty((len(count), bands), np.uint64)
        for b in range(bands):
            name = np.full(len(count), np.uint64(1000 * level + b + 1))
            for k in range(rows):
                name = mix(name * np.uint64(31) + drawn[b * rows + k])
            out[:, b] = name
        return out.view(np.int64)


def document_frequencies(rows: DataFrame) -> Weights:
    """Over all documents; the driver gets one number for each slot."""

    def count(batches):
        seen, n = np.zeros(SLOTS, np.int64), 0
        for _, texts in chunks(batches):
            words, size = word_hashes([x.encode("utf-8", "replace") for x in texts])
            pairs = np.unique(np.repeat(np.arange(len(size)), size) * SLOTS + slots(words))
            seen += np.bincount(pairs % SLOTS, minlength=SLOTS)
            n += int((size > 0).sum())
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.r_[there, -1], pa.int32()), "n": pa.array(np.r_[seen[there], n], pa.int64())})

    got = rows.select("doc_id", "text").mapInArrow(frugal(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    slot, seen = got["slot"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    df = np.zeros(SLOTS)
    df[slot[slot >= 0]] = seen[slot >= 0]
    n = int(seen[slot < 0].sum())
    return Weights(1 + np.log((1 + n) / (1 + df)))


def sketches(rows: DataFrame, weights: Weights) -> DataFrame:
    """``row_key, doc_id, n_words, words_a, words_b, mass, bands`` of every row; two hashes name its sequence of words, mass is its whole weight."""
    idf = rows.sparkSession.sparkContext.broadcast(weights.idf)

    def run(batches):
        scale, sampler = Weights(idf.value), Sampler()
        for b in batches:
            at = 0
            for ids, texts in chunks([b], 2 << 20):
                keys = b.column("row_key").slice(at, len(ids))
                at += len(ids)
                words, n = word_hashes([x.encode("utf-8", "replace") for x in texts])
                ends = np.cumsum(n)
                a, c = (span_hash(prefix_hash(mix(words + np.uint64(s)), base), ends - n, ends, base).view(np.int64) for s, base in ((1, BASE_A), (2, BASE_B)))
                h, w, size = scale.shingles(words, n)
                mass = np.bincount(np.repeat(np.arange(len(n)), size), weights=w, minlength=len(n))
                bands = sampler.bands(h, w, size)
                flat = pa.array(bands.ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((n > 0) * LEVELS[0][0])], pa.int32()), flat)
                yield pa.RecordBatch.from_pydict({"row_key": keys, "doc_id": ids, "n_words": pa.array(n, pa.int64()), "words_a": pa.array(a), "words_b": pa.array(c), "mass": pa.array(mass, pa.float64()), "bands": lists})

    return rows.mapInArrow(frugal(run), "row_key long, doc_id long, n_words long, words_a long, words_b long, mass double, bands array<long>")


def _texts(rows: DataFrame) -> DataFrame:
    """``row_key, z``: whole texts, compressed for the way."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"row_key": b.column("row_key"), "z": pa.array([z.compress(x.as_py().encode("utf-8", "replace")) for x in b.column("text")], pa.binary())})

    return rows.select("row_key", "text").mapInArrow(frugal(run), "row_key long, z binary")


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """``a, b, similarity`` of the pairs, from their whole texts."""
    idf = pairs.sparkSession.sparkContext.broadcast(weights.idf)
    both = pairs.join(texts.withColumnsRenamed({"row_key": "a", "z": "z_a"}).hint("merge"), "a")
    both = both.join(texts.withColumnsRenamed({"row_key": "b", "z": "z_b"}).hint("merge"), "b").select("a", "b", "z_a", "z_b")

    def run(batches):
        scale, z = Weights(idf.value), zstandard.ZstdDecompressor()
        for batch in batches:
            some: list[bytes] = []
            size, start = 0, 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > 2 << 20:
                    if some:
                        yield judged(batch.slice(start, i - start), some, scale)
                    some, size, start = [], 0, i
                if i < batch.num_rows:
                    for name in ("z_a", "z_b"):
                        some.append(z.decompress(batch.column(name)[i].as_py()))
                        size += len(some[-1])

    def judged(batch, some, scale):
        h, w, n = scale.shingles(*word_hashes(some))
        text = np.repeat(np.arange(len(n)), n)
        total = np.bincount(text, weights=w, minlength=len(n))
        order = np.lexsort((h, text // 2))
        h, w, pair = h[order], w[order], (text // 2)[order]
        twin = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]))
        common = np.bincount(pair[twin], weights=np.minimum(w[twin], w[twin + 1]), minlength=len(n) // 2)
        union = total[::2] + total[1::2] - common
        similarity = np.where(union > 0, common / np.maximum(union, 1e-12), 0.0)
        return pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(similarity)})

    return both.mapInArrow(frugal(run), "a long, b long, similarity double")


def _narrower(texts: DataFrame, weights: Weights, level: int) -> DataFrame:
    """``node, bucket`` of whole texts at a further level."""
    idf = texts.sparkSession.sparkContext.broadcast(weights.idf)

    def run(batches):
        scale, sampler, z = Weights(idf.value), Sampler(), zstandard.ZstdDecompressor()
        for b in batches:
            for key, text in zip(b.column("row_key"), b.column("z"), strict=True):
                names = sampler.bands(*scale.shingles(*word_hashes([z.decompress(text.as_py())])), level).ravel()
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(names), key.as_py()), pa.int64()), "bucket": pa.array(names, pa.int64())})

    return texts.mapInArrow(frugal(run), "node long, bucket long")


def _company(member: DataFrame) -> DataFrame:
    """Members of buckets that have more than one."""
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return member.join(shared.hint("merge"), "bucket", "left_semi")


def joins(raw: list[bytes], node: np.ndarray, component: np.ndarray, block: np.ndarray, scale: Weights, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different components, as many as join what belongs together. With two blocks only pairs of both count."""
    h, w, n = scale.shingles(*word_hashes(raw))
    text, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    column = np.unique(h, return_inverse=True)[1]
    mass = np.bincount(text, weights=w, minlength=len(n))
    root = np.unique(component, return_inverse=True)[1]
    largest = root == np.bincount(root).argmax()  # its members are not compared with each other
    across, held = block.min() != block.max(), np.zeros(len(h), np.float32)
    open_, out = np.ones(len(n), bool), []
    for a in np.flatnonzero(~largest):
        open_[a] = False  # compared with all from here on
        able = open_ & (root != root[a]) & (np.minimum(mass, mass[a]) >= np.maximum(mass, mass[a]) * (threshold - 1e-4))
        if across:
            able &= block != block[a]
        if not able.any():
            continue
        own = slice(ends[a] - n[a], ends[a])
        held[column[own]] = w[own]
        common = np.bincount(text, weights=np.minimum(w, held[column]), minlength=len(n))
        held[column[own]] = 0
        for b in np.flatnonzero(able & (common >= (threshold - 1e-6) * (mass + mass[a] - common))):
            if root[b] != root[a]:
                out.append((int(node[a]), int(node[b])))
                root[root == root[b]] = root[a]
    return out


def _block_links(live: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """``a, b`` between components, from ``bucket, node, component, blocks``: each two blocks of a bucket meet in one task."""
    idf = live.sparkSession.sparkContext.broadcast(weights.idf)
    dealt = live.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "block")
    met = met.join(texts.withColumnRenamed("row_key", "node").hint("merge"), "node")

    def run(batches):
        scale, z = Weights(idf.value), zstandard.ZstdDecompressor()
        held: list[tuple] = []
        now = None

        def flush():
            if len(held) > 1:
                _, _, _, node, component, block, text = zip(*held, strict=True)
                found = joins([z.decompress(x) for x in text], *(np.array(x, np.int64) for x in (node, component, block)), scale, threshold)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([max(x) for x in found], pa.int64()), "b": pa.array([min(x) for x in found], pa.int64())})

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("bucket", "i", "j", "node", "component", "block", "z")), strict=True):
                if row[:3] != now:
                    yield from flush()
                    held, now = [], row[:3]
                held.append(row)
        yield from flush()

    n = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.select("bucket", "i", "j", "node", "component", "block", "z")
    return met.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(frugal(run), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept``; ``kept``: one row with the class's smallest doc_id."""
    return _classes(keyed(docs), threshold).drop("row_key")


def _linked(nodes: DataFrame, rows: DataFrame, weights: Weights, threshold: float, made: list[DataFrame]) -> DataFrame | None:
    """``node, component`` of the nodes that have links. made: gets the tables that are written on the way."""
    spark, found = rows.sparkSession, None
    keep = lambda df, what, narrow=False: made.append(written(spark, df, what, narrow)) or made[-1]
    size = nodes.select("node", "mass", "n_words")
    member = keep(_company(nodes.where("n_words > 0").select("node", F.explode("bands").alias("bucket"))).join(size.hint("merge"), "node"), "buckets")
    wanted = keep(member.select(F.col("node").alias("row_key")).distinct(), "wanted", narrow=True)
    some = marked(rows.select("row_key", "text"), wanted, "row_key").where("maybe")  # else all texts would be shuffled
    texts = keep(_texts(some).join(wanted.hint("merge"), "row_key", "left_semi"), "texts")
    for level in range(len(LEVELS)):
        lead = member.groupBy("bucket").agg(F.min(F.struct("node", "mass")).alias("lead"))
        heavy = F.least("mass", "lead.mass") >= F.greatest("mass", "lead.mass") * (threshold - 1e-4)  # else no similarity that counts
        pairs = member.join(lead.hint("merge"), "bucket").where((F.col("node") != F.col("lead.node")) & heavy)
        judged = verified(pairs.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct(), texts, weights)
        links = keep(judged.where(F.col("similarity") >= threshold - 1e-6).select("a", "b"), "links")
        found = _joined(found, links)
        # the leads have been compared with all that is left of their buckets
        rest = member.join(lead.select("bucket", F.col("lead.node").alias("node")).hint("merge"), ["bucket", "node"], "left_anti").select("bucket", "node", "n_words")
        if found is not None:
            rest = rest.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            rest = rest.withColumn("component", F.col("node"))
        state = rest.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.sum("n_words").alias("words"), F.count("*").alias("n"))
        state = state.where("least != most").select("bucket", F.least(F.ceil(F.col("words") / BLOCK_WORDS), "n").cast("int").alias("blocks"))
        live = keep(rest.join(state.hint("merge"), "bucket").select("bucket", "node", "component", "blocks"), "live", narrow=True)
        last = level + 1 == len(LEVELS)
        links = keep(_block_links(live if last else live.where(F.col("blocks") <= MOST_BLOCKS), texts, weights, threshold), "links")
        found = _joined(found, links)
        large = None if last else live.where(F.col("blocks") > MOST_BLOCKS).select(F.col("node").alias("row_key")).distinct()
        if large is None or not large.take(1):
            return found
        named = _narrower(texts.join(large.hint("merge"), "row_key", "left_semi"), weights, level + 1)
        member = keep(_company(keep(named, "narrower")).join(size.hint("merge"), "node"), "buckets")
    return found


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components with further links."""
    if not links.take(1):
        return found
    had = links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(had)


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    spark = rows.sparkSession
    weights = document_frequencies(rows)
    sketch = written(spark, sketches(rows, weights), "sketches")
    # texts with the same words are one node, named by its least key; texts without words stay apart
    named = sketch.withColumn("alone", F.when(F.col("n_words") == 0, F.col("row_key")))
    same = ["n_words", "words_a", "words_b", "alone"]
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row_key")).alias("first")
    nodes = named.groupBy(*same).agg(F.min("row_key").alias("node"), F.first("mass").alias("mass"), F.first("bands").alias("bands"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), first)
    nodes = written(spark, nodes, "nodes")
    made: list[DataFrame] = [nodes]
    found = _linked(nodes, rows, weights, threshold, made)
    part = nodes.select(*same, "node", "copies", "least_id", "first")
    if found is None:
        part = part.withColumn("component", F.col("node"))
    else:
        part = part.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = written(spark, part, "components")
    # classes are summed up over nodes, so a group of copies is one row; what follows joins tables as they are, and Spark splits hot keys
    summary = part.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("first"))
    summary = written(spark, summary, "summary", narrow=True)
    of = part.select(*same, "component").join(summary.hint("merge"), "component")
    of = written(spark, of.select("n_words", "words_a", "words_b", F.col("alone").alias("alone_"), "class_id", "class_size", F.col("first.row_key").alias("kept_key")), "classes")
    dropped(spark, *made, part, summary)
    out = named.join(of.hint("merge"), (named.n_words == of.n_words) & (named.words_a == of.words_a) & (named.words_b == of.words_b) & named.alone.eqNullSafe(of.alone_))
    return out.select("row_key", "doc_id", "class_id", "class_size", (F.col("row_key") == F.col("kept_key")).alias("kept"))


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns."""
    named, key = with_key(docs)
    kept = _classes(id_text(named, F.col(key).alias("row_key")), threshold).where("kept").select(F.col("row_key").alias(key))
    return named.join(kept.hint("merge"), key, "left_semi").drop(key)
