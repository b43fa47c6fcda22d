"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is what is learned for the word itself and the mean of what is learned for its character n-grams (ends included), side by
side; words and n-grams that stand in few texts of the sample are unknown and give nothing, so that no single text is learned by heart. The text is read in overlapping windows of WINDOW words, STEP apart, the last one flush with the end; all of them are scored. Two gated
recurrent layers read a window in both directions, attention weighs their states, and a logistic unit gives the window's logit. Only whole texts
are labelled, so after the first rounds the network looks at all windows of the sampled toxic texts, and a window counts as toxic only if the
network finds it so or it is the text's worst.
Finally a logistic regression on a text's worst, three worst and mean logits turns them into the score, with the share of toxic rows restored.

Training uses a bounded sample: about ROWS_PER_LABEL rows of each label, drawn by hash, and WINDOWS_PER_ROW windows of each, drawn at random at first,
later, for toxic texts, those with the highest scores. Null texts and
texts without words get the learned share of toxic rows. Rows without a label are scored but not learned from; with one label only, or none,
every score is the share of toxic rows (0 if there are none). Repeated rows are scored alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, filtered, frugal, id_text, mix, prefix_hash, ranges, span_hash

ROWS_PER_LABEL, WINDOWS_PER_ROW = 1200, 10
WINDOW, STEP = 24, 16
WORD_SLOTS, CHAR_SLOTS, DIM, HIDDEN = 512, 1024, 8, 8
#: Texts of the sample in which a word or n-gram must stand to be known at all.
LEAST_TEXTS = 3
#: Share of the sample on which the network is not trained, but its scores are calibrated.
CALIBRATION = 0.25
GRAMS = (3, 4)
#: Rounds over the sample, or more where it is small: LEAST_STEPS batches at least.
ROUNDS, LEAST_STEPS, BATCH, RATE, FADE = 4, 150, 256, 0.01, 0.1
REMEMBERED = 100_000
_BASE = 0x5851F42D4C957F2D

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, the hashes of all character n-grams one word after the other, and how many each word has."""
    raw = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    whole = span_hash(prefix_hash(mix(buf), _BASE), start, start + size, _BASE)
    parts, counts = [], []
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        at = ranges(start, count)
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + buf[at + i]
        parts.append(mix(h + np.uint64(n << 56)))
        counts.append(count)
    total = sum(counts)
    out = np.empty(int(total.sum()), np.uint64)
    first = np.cumsum(total) - total
    for part, count in zip(parts, counts, strict=True):
        out[ranges(first, count)] = part
        first = first + count
    return whole, out, total


def _slot(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in a sorted vocabulary, from 1 on; 0 for what it lacks."""
    if not len(known):
        return np.zeros(len(h), np.int32)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at + 1, 0).astype(np.int32)


def features(words: list[str], vocabulary: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's slot, the slots of its character n-grams one word after the other, and how many each word has."""
    whole, grams, count = hashed(words)
    return _slot(vocabulary[0], whole), _slot(vocabulary[1], grams), count


def vocabulary_of(texts: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words and n-grams of at least LEAST_TEXTS texts, the WORD_SLOTS and CHAR_SLOTS whose share differs most between the labels."""
    seen: tuple[list, list] = ([], [])
    for text in texts:
        whole, grams, _ = hashed(sorted(set(text)))
        seen[0].append(np.unique(whole))
        seen[1].append(np.unique(grams))
    out = []
    n1 = max(1.0, float((labels == 1).sum()))
    n0 = max(1.0, len(labels) - n1)
    for parts, most in zip(seen, (WORD_SLOTS, CHAR_SLOTS), strict=True):
        keys, where = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)
        toxic = np.bincount(where, weights=np.repeat(labels == 1, [len(x) for x in parts]), minlength=len(keys))
        n = np.bincount(where, minlength=len(keys))
        p = n / (n0 + n1)
        z = np.abs(toxic / n1 - (n - toxic) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
        able = np.flatnonzero(n >= LEAST_TEXTS)
        out.append(np.sort(keys[able[np.argsort(-z[able], kind="stable")[: most - 1]]]))
    return out[0], out[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """word [slots, D], char [slots, D], into [2, 2D, 3H], bias [2, 1, 3H], again [2, H, 3H], look [2H], out [2H], base [1]."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        h = HIDDEN
        return cls({
            "word": normal(WORD_SLOTS, DIM, scale=0.02), "char": normal(CHAR_SLOTS, DIM, scale=0.05), "into": normal(2, 2 * DIM, 3 * h, scale=0.3), "bias": np.zeros((2, 1, 3 * h), np.float32),
            "again": normal(2, h, 3 * h, scale=0.3), "look": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "base": np.zeros(1, np.float32),
        })

    def inputs(self, f: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """[words, 2D]: the word's own vector and the mean of its n-grams'."""
        word, gram, count = f
        if not len(word):
            return np.zeros((0, 2 * DIM), np.float32)
        sums = np.add.reduceat(self.p["char"][gram] * (gram > 0)[:, None], np.cumsum(count) - count, axis=0)
        return np.concatenate([self.p["word"][word] * (word > 0)[:, None], sums / count[:, None].astype(np.float32)], axis=1)

    def run(self, projected: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows. projected: [2, words, 3H]; ids: [windows, W] words; mask: [windows, W] of real ones, if any are not."""
        h, (b, w) = HIDDEN, ids.shape
        p = self.p
        state = np.zeros((2, b, h), np.float32)
        states = np.empty((w, 2, b, h), np.float32)
        trace = []
        for k in range(w):
            x = np.stack([projected[0][ids[:, k]], projected[1][ids[:, w - 1 - k]]])
            again = np.matmul(state, p["again"])
            zr = _sigmoid(x[:, :, : 2 * h] + again[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            n = np.tanh(x[:, :, 2 * h :] + r * again[:, :, 2 * h :])
            new = n + z * (state - n)
            if mask is not None:
                m = np.stack([mask[:, k], mask[:, w - 1 - k]])[:, :, None].astype(np.float32)
                new = m * new + (1 - m) * state
            else:
                m = None
            if keep:
                trace.append((state, z, r, n, again[:, :, 2 * h :], m))
            states[k] = state = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # [W, windows, 2H]
        seen = both @ p["look"]
        if mask is not None:
            seen = np.where(mask.T, seen, -1e9)
        weight = np.exp(seen - seen.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("wb,wbh->bh", weight, both)
        logit = pooled @ p["out"] + p["base"]
        return (logit, (trace, both, weight, pooled)) if keep else logit

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x[None], self.p["into"]) + self.p["bias"]

    def gradients(self, f, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of a batch; ``f`` are the features of the batch's distinct words."""
        h, (b, w), p = HIDDEN, ids.shape, self.p
        x = self.inputs(f)
        logit, (trace, both, attention, pooled) = self.run(self.project(x), ids, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d_logit = ((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        g["out"] = pooled.T @ d_logit
        g["base"] = d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_attention = np.einsum("bh,wbh->wb", d_pooled, both)
        d_seen = attention * (d_attention - (attention * d_attention).sum(0))
        g["look"] = np.einsum("wb,wbh->h", d_seen, both)
        d_both = attention[:, :, None] * d_pooled + d_seen[:, :, None] * p["look"]
        d_projected = np.zeros((2, len(x), 3 * h), np.float32)
        d_state = np.zeros((2, b, h), np.float32)
        for k in range(w - 1, -1, -1):
            state, z, r, n, again, m = trace[k]
            d_state = d_state + np.stack([d_both[k, :, :h], d_both[w - 1 - k, :, h:]])
            d_new = d_state * m
            d_state = d_state * (1 - m) + d_new * z
            a_n = d_new * (1 - z) * (1 - n * n)
            a_z = d_new * (state - n) * z * (1 - z)
            a_r = a_n * again * r * (1 - r)
            d_again = np.concatenate([a_z, a_r, a_n * r], axis=2)
            g["again"] += np.matmul(state.transpose(0, 2, 1), d_again)
            d_state = d_state + np.matmul(d_again, p["again"].transpose(0, 2, 1))
            d_x = np.concatenate([a_z, a_r, a_n], axis=2)
            np.add.at(d_projected[0], ids[:, k], d_x[0])
            np.add.at(d_projected[1], ids[:, w - 1 - k], d_x[1])
        g["bias"] = d_projected.sum(1, keepdims=True)
        g["into"] = np.matmul(x.T[None], d_projected)
        d_in = np.matmul(d_projected, p["into"].transpose(0, 2, 1)).sum(0)
        word, gram, count = f
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], word, d_in[:, :DIM])
        g["word"][0] = 0
        np.add.at(g["char"], gram, np.repeat(d_in[:, DIM:] / count[:, None].astype(np.float32), count, axis=0))
        g["char"][0] = 0
        return g


def windows(n: int) -> np.ndarray:
    """First words of the windows of a text of ``n`` words."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.unique(np.r_[np.arange(0, n - WINDOW, STEP), n - WINDOW])


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all windows of texts whose words stand one after the other, which of them are real, and each window's text."""
    first = np.cumsum(lengths) - lengths
    per = [windows(int(n)) for n in lengths]
    owner = np.repeat(np.arange(len(lengths)), [len(x) for x in per])
    start = np.concatenate([x + f for x, f in zip(per, first.tolist(), strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    at = start[:, None] + np.arange(WINDOW)
    mask = at < (first + lengths)[owner][:, None]
    return np.where(mask, at, start[:, None]), mask, owner


def summary(logit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[texts, 3]: a text's largest window logit, the mean of its three largest and the mean of all; NaN without windows."""
    out = np.full((n, 3), np.nan)
    if not len(logit):
        return out
    order = np.lexsort((-logit, owner))
    own, value = owner[order], logit[order].astype(np.float64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    count = np.diff(np.r_[first, len(own)])
    rank = np.arange(len(own)) - np.repeat(first, count)
    text = own[first]
    out[text, 0] = value[first]
    out[text, 1] = np.add.reduceat(np.where(rank < 3, value, 0), first) / np.minimum(count, 3)
    out[text, 2] = np.add.reduceat(value, first) / count
    return out


class Scorer:
    """Applies a fitted network; the inputs of words met before are remembered."""

    def __init__(self, network: Network, vocabulary: tuple[np.ndarray, np.ndarray], calibration: np.ndarray, share: float):
        self.network, self.vocabulary, self.calibration, self.share = network, vocabulary, calibration, share
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.known = np.zeros((0, 2 * DIM), np.float32)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.forget()
        numbers = self.numbers
        ids = []
        for text in texts:
            ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(text)), np.int64))
        if len(numbers) > len(self.known):
            new = list(numbers)[len(self.known) :]
            self.known = np.concatenate([self.known, self.network.inputs(features(new, self.vocabulary))])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        at, mask, owner = laid_out(np.array([len(x) for x in ids], np.int64))
        if not len(at):
            return np.zeros(0, np.float32), owner
        distinct, flat = np.unique(flat, return_inverse=True)
        projected = self.network.project(self.known[distinct])
        whole = mask.all(1)
        out = np.empty(len(at), np.float32)
        for rows, masked in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
            for i in range(0, len(rows), 4096):
                some = rows[i : i + 4096]
                out[some] = self.network.run(projected, flat[at[some]], mask[some] if masked else None)
        return out, owner

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.calibration):
            return np.full(len(texts), self.share)
        logit, owner = self.logits(texts)
        x = summary(logit, owner, len(texts))
        out = _sigmoid(x @ self.calibration[:3] + self.calibration[3])
        return np.where(np.isnan(x[:, 0]), self.share, out)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * p * (1 - p) + 1e-9
        grad = x.T @ (weight * (p - y)) + 1e-2 * beta
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-2 * np.eye(len(beta)), grad)
        beta -= np.clip(step, -2, 2)
    return beta


def train(texts: list[str], labels: np.ndarray, weight: np.ndarray, share: float, seed: int = 7) -> Scorer:
    """weight: rows that each sampled one stands for."""
    rng = np.random.default_rng(seed)
    network = Network.new(rng)
    if len(set(labels.tolist())) < 2:
        return Scorer(network, (np.zeros(0, np.uint64),) * 2, np.zeros(0), share)
    tokens = [words_of(x) for x in texts]
    aside = np.zeros(len(texts), bool)
    for k in (0, 1):
        rows = np.flatnonzero(labels == k)
        if len(rows) >= 8:
            aside[rng.choice(rows, int(CALIBRATION * len(rows)), replace=False)] = True
    learn = np.flatnonzero(~aside)
    known = vocabulary_of([tokens[i] for i in learn], labels[learn])
    numbers: dict[str, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in tokens[i]), np.int64) for i in learn]
    word, gram, count = features(list(numbers), known)
    first = np.cumsum(count) - count
    flat = np.concatenate(ids)
    at, mask, owner = laid_out(np.array([len(x) for x in ids], np.int64))
    chosen = []
    for rows in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        chosen.append(rng.choice(rows, WINDOWS_PER_ROW, replace=False) if len(rows) > WINDOWS_PER_ROW else rows)
    chosen = np.concatenate(chosen)
    target = labels[learn][owner].astype(np.float32)
    _informed(network, word, gram, count, first, flat, at[chosen], mask[chosen], target[chosen])
    m1 = {k: np.zeros_like(v) for k, v in network.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in network.p.items()}
    step, p_window, toxic = 0, np.ones(len(owner), np.float32), np.flatnonzero(target == 1)
    rounds = max(ROUNDS, -(-LEAST_STEPS // max(1, -(-len(chosen) // BATCH))))
    for turn in range(rounds):
        if 3 * turn >= rounds:  # of all windows of toxic texts those that look toxic, and the worst of each text; the others drop out
            for i in range(0, len(toxic), 4096):
                some = toxic[i : i + 4096]
                distinct, inner = np.unique(flat[at[some]], return_inverse=True)
                f = (word[distinct], gram[ranges(first[distinct], count[distinct])], count[distinct])
                p_window[some] = _sigmoid(network.run(network.project(network.inputs(f)), inner.reshape(len(some), WINDOW), mask[some]))
            by = toxic[np.lexsort((-p_window[toxic], owner[toxic]))]
            rank = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
            live = np.r_[chosen[target[chosen] == 0], by[(rank == 0) | (p_window[by] >= 0.5) & (rank < WINDOWS_PER_ROW)]]
        else:
            live = chosen
        live = rng.permutation(live)
        n1 = max(1.0, float(target[live].sum()))
        balance = np.where(target > 0, len(live) / (2 * n1), len(live) / (2 * max(1.0, len(live) - n1))).astype(np.float32)
        for i in range(0, len(live), BATCH):
            some = live[i : i + BATCH]
            distinct, inner = np.unique(flat[at[some]], return_inverse=True)
            f = (word[distinct], gram[ranges(first[distinct], count[distinct])], count[distinct])
            g = network.gradients(f, inner.reshape(len(some), WINDOW), mask[some], target[some], balance[some])
            step += 1
            rate = RATE / (1 + 5 * turn / rounds)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * np.float32(min(1.0, 5 / max(norm, 1e-12)))
                m1[k] += np.float32(0.1) * (v - m1[k])
                m2[k] += np.float32(0.001) * (v * v - m2[k])
                if k in ("word", "char"):  # what isn't needed fades
                    network.p[k] *= np.float32(1 - rate * FADE)
                network.p[k] -= np.float32(rate) * (m1[k] / np.float32(1 - 0.9**step)) / (np.sqrt(m2[k] / np.float32(1 - 0.999**step)) + np.float32(1e-7))
    scorer = Scorer(network, known, np.zeros(0), share)
    judged = np.flatnonzero(aside) if len(set(labels[aside].tolist())) == 2 else np.arange(len(texts))
    rows = []
    for i in range(0, len(judged), 100):
        some = [texts[k] for k in judged[i : i + 100]]
        rows.append(summary(*scorer.logits(some), len(some)))
    x = np.concatenate(rows)
    there = ~np.isnan(x[:, 0])
    return Scorer(network, known, _logistic(x[there], labels[judged][there], weight[judged][there]), share)


def _informed(network: Network, word, gram, count, first, flat, at, mask, target) -> None:
    """Begin with one input for the log-odds with which a slot's windows come from toxic texts, above those of a slot never seen."""
    n = [max(1.0, float((target == k).sum())) for k in (0, 1)]
    seen = {"word": np.zeros((2, WORD_SLOTS)), "char": np.zeros((2, CHAR_SLOTS))}
    for k in (0, 1):
        rows = np.flatnonzero(target == k)
        held = flat[at[rows]][mask[rows]]
        owner = np.broadcast_to(rows[:, None], mask[rows].shape)[mask[rows]]
        for name, slots, window, size in (("word", word[held], owner, WORD_SLOTS), ("char", gram[ranges(first[held], count[held])], np.repeat(owner, count[held]), CHAR_SLOTS)):
            once = np.unique(window.astype(np.int64) * size + slots)
            seen[name][k] = np.bincount(once % size, minlength=size)
    for name, (clean, toxic) in seen.items():
        odds = np.log((toxic + 1) / (n[1] + 2)) - np.log((clean + 1) / (n[0] + 2))
        network.p[name][:, 0] = 0.5 * (odds - (np.log(1 / (n[1] + 2)) - np.log(1 / (n[0] + 2))))


def held_out() -> Column:
    """The rows that no label is learned from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Scorer:
    """From ``doc_id, text`` and ``doc_id, toxic``; the driver gets the bounded sample and trains."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").agg(F.count("*")).collect()}
    unit = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    drawn = marked.where(unit < F.when(F.col("toxic") == 1, F.lit(rows_per_label / max(1, counts.get(1, 0)))).otherwise(F.lit(rows_per_label / max(1, counts.get(0, 0)))))
    wanted = drawn.withColumnRenamed("doc_id", "wanted_id")
    texts = id_text(docs)
    rows = sorted(texts.join(F.broadcast(wanted), texts.doc_id == wanted.wanted_id).select("doc_id", "text", "toxic").collect())
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    y = np.array([r[2] for r in rows], np.float64)
    sampled = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([counts.get(r[2], 0) / sampled[r[2]] for r in rows])
    return train([r[1] for r in rows], y, weight, share)


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; one narrow stage."""
    sent = docs.sparkSession.sparkContext.broadcast((model.network.p, model.vocabulary, model.calibration, model.share))

    def run(batches):
        scorer = Scorer(Network(sent.value[0]), *sent.value[1:])
        for ids, texts in chunks(batches, 2 << 20):
            found = scorer.score(texts).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))})

    return id_text(docs).mapInArrow(frugal(run), "doc_id long, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; one narrow stage."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.network.p, model.vocabulary, model.calibration, model.share))

    def run(batches):
        scorer = Scorer(Network(sent.value[0]), *sent.value[1:])
        yield from filtered(batches, lambda texts: scorer.score(texts) < 0.5)

    return docs.mapInArrow(frugal(run), docs.schema)
