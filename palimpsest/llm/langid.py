"""Language identification with language-bitmask n-gram filters.

Letters are lower-cased, everything else becomes one boundary, and n-grams of two to four of these symbols are taken, short words with
their boundaries. A bit-sliced Bloom filter has one cell per hash value; bit ``l`` of a cell says that some n-gram of language ``l`` fell
there. The AND over an n-gram's cells is the set of all languages that (seem to) contain it, in one look-up for all languages together. A
document's count of each language's bits is corrected for the filter's false positives, ``(seen - n * p) / (1 - p)`` with ``p`` from the
share of set bits, and the language with the largest corrected count wins; the score is its share of them, sharpened.

The filter has a fixed size. It is fitted on a bounded sample: about ROWS_PER_LANGUAGE labelled rows of each language, drawn by hash.
N-grams in fewer than MIN_SHARE of a language's sample rows are left out, so that quotations from other languages don't count.

Null texts and texts without a letter give ``und`` with score 0. Ties go to the first language by name. Rows without a language are
scored but not learned from; with nothing to learn from, all is ``und``. Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, dropped, frugal, id_text, mix, written

ROWS_PER_LANGUAGE = 600
MIN_SHARE = 0.05
SIZES = (2, 3, 4)
CELL_BITS, HASHES = 21, 2
#: Power to which the corrected counts are raised before their shares are taken as the score.
SHARPNESS = 12

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the letters with 0 for boundaries (one at both ends of a text), the length of each text in them, and its number of letters."""
    low = [x.lower() for x in texts]
    raw = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "replace"), "<u4")
    letter = letters()[raw]
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1  # with the boundary after it
    owner_end = np.cumsum(size)  # the boundary that closes each text
    before = np.r_[False, letter[:-1]]
    keep = letter | before
    keep[0] = True
    keep[owner_end] = True
    first = np.r_[0, owner_end]
    kept = np.concatenate([[0], np.cumsum(keep)])
    counted = np.concatenate([[0], np.cumsum(letter)])
    codes = np.where(letter, raw, 0)[keep]
    return codes, kept[owner_end + 1] - kept[first[:-1]], counted[owner_end] - counted[first[:-1]]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n-gram that starts at each place (the last n - 1 places have none)."""
    out = codes[: len(codes) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out = (out << np.uint64(16)) ^ (out >> np.uint64(47)) ^ codes[i : len(codes) - n + 1 + i]
    return mix(out + np.uint64(n * 0x517CC1B727220A95 % (1 << 64)))


def text_grams(texts: list[str], sizes=SIZES):
    """For each n: the hashes of a chunk of texts one after the other, and each text's first place and number of them.

    Neighbouring texts share a boundary symbol; places whose n-gram would run into the next text belong to no text.
    """
    codes, length, _ = symbols(texts)
    # a text's symbols run from one boundary to the next, both included; the next text starts at the latter
    start = np.r_[0, np.cumsum(length - 1)[:-1]] if len(length) else length
    for n in sizes:
        yield n, (grams(codes, n) if len(codes) >= n else np.zeros(0, np.uint64)), start, np.maximum(length - n + 1, 0)


class Filter:
    """Bit-sliced Bloom filter: 64 languages per plane."""

    def __init__(self, languages: list[str], planes: np.ndarray):
        self.languages, self.planes = languages, planes
        self.false = np.array([self.share(i) ** HASHES for i in range(len(languages))])

    def share(self, i: int) -> float:
        return float(((self.planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) if self.planes.dtype == np.uint64 else float(((self.planes[0] >> i) & 1).mean())

    @staticmethod
    def cells(hashes: np.ndarray):
        for k in range(HASHES):
            yield (hashes >> np.uint64(64 - CELL_BITS * (k + 1))) & np.uint64((1 << CELL_BITS) - 1)

    @classmethod
    def fitted(cls, members: dict[str, np.ndarray]) -> Filter:
        languages = sorted(members)
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        planes = np.zeros((max(1, -(-len(languages) // 64)), 1 << CELL_BITS), kind)
        for i, language in enumerate(languages):
            for cell in cls.cells(members[language]):
                planes[i // 64][cell] |= kind(1 << (i % 64))
        return cls(languages, planes)

    def corrected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of the text's n-grams, and per text the number of letters."""
        total = np.zeros((len(texts), len(self.languages)))
        codes_n = np.zeros(len(texts))
        for _, hashes, start, count in text_grams(texts):
            codes_n += count
            for p, plane in enumerate(self.planes):
                mask = None
                for cell in self.cells(hashes):
                    mask = plane[cell] if mask is None else mask & plane[cell]
                for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                    bits = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                    upto = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
                    seen = upto[np.minimum(start + count, len(bits))] - upto[np.minimum(start, len(bits))]
                    total[:, i] += np.maximum(0, seen - count * self.false[i]) / (1 - self.false[i] if self.false[i] < 1 else 1)
        return total / np.maximum(codes_n, 1)[:, None], codes_n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n_letters = symbols(texts)[2]
        share, _ = self.corrected(texts)
        names, scores = [], []
        for row, n in zip(share, n_letters.tolist(), strict=True):
            if not n or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(row.argmax())
            names.append(self.languages[best])
            scores.append(min(1.0, float(1 / ((row / row[best]) ** SHARPNESS).sum())) if row[best] > 0 else 0.0)
        return names, scores


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Filter:
    """From ``doc_id, text, lang``. N-grams of the sample are counted by the executors; the driver gets those that go into the filter."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count("*")).collect()}
    if not sizes:
        return Filter.fitted({})
    share = F.create_map([x for k, n in sizes.items() for x in (F.lit(k), F.lit(rows_per_language / n))])
    unit = (F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    sample = labelled.where(unit < share[F.col("lang")]).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))

    def count(batches):
        held: dict[str, list] = defaultdict(list)
        rows: dict[str, int] = defaultdict(int)
        for b in batches:
            at = 0
            for ids, texts in chunks([b]):
                langs = b.column("lang").slice(at, len(ids)).to_pylist()
                at += len(ids)
                for text, lang in zip(texts, langs, strict=True):
                    rows[lang] += 1
                    held[lang] += [np.unique(h) for _, h, _, _ in text_grams([text])]
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            keys, n = np.r_[keys.view(np.int64), 0], np.r_[n, rows[lang]]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), "key": pa.array(keys), "n": pa.array(n), "is_gram": pa.array(np.r_[np.ones(len(n) - 1, bool), False])})

    counted = sample.mapInArrow(frugal(count), "lang string, key long, n long, is_gram boolean").groupBy("lang", "is_gram", "key").agg(F.sum("n").alias("n"))
    counted = written(labelled.sparkSession, counted, "grams", narrow=True)
    rows = {r[0]: r[1] for r in counted.where("not is_gram").select("lang", "n").collect()}
    # of the bounded sample only n-grams that enough of its rows share come to the driver
    members = {}
    for lang, n in rows.items():
        keys = counted.where(F.col("is_gram") & (F.col("lang") == lang) & (F.col("n") >= max(1, MIN_SHARE * n))).select("key").toPandas()["key"]
        members[lang] = keys.to_numpy(np.int64).view(np.uint64)
    dropped(labelled.sparkSession, counted)
    return Filter.fitted(members)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text; one narrow stage."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.planes))

    def run(batches):
        fitted = Filter(*sent.value)
        for ids, texts in chunks(batches, 2 << 20):
            names, scores = fitted.predict(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "lang_pred": names, "score": pa.array(scores, pa.float64())})

    return id_text(docs).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")


def held_out():
    """The rows that nothing is learned from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
