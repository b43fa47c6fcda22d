"""Byte-level BPE encoding and decoding by merge replay over chunks of the corpus.

The pre-tokens of a chunk that its worker has not met yet are laid out as one linked sequence of tokens. An inverted index leads from each
adjacent pair (named by the rank of its concatenation) to the positions where it stands. The ranks come off a queue in order; each
is applied to all its positions at once, and only the pairs of the touched neighbours are looked up and indexed again.

A pair's rank is that of its joined bytes, as in tiktoken, so a merge may create a pair of *lower* rank than itself. Tokens that can do
this are known from the vocabulary; theirs are applied to the first place of each word only and queued again, which is exactly the
"lowest rank first, leftmost first" order of a word-by-word encoder. All other merges commute and take every place at once.

Null texts are empty; empty texts have no tokens; a text of one endless word is only a longer sequence. Rows with equal ids or texts
are encoded separately. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.common import chunks, frugal, hex_digests, id_text, model, ranges

NEVER = np.int32(2**31 - 1)
#: Pre-tokens that a worker remembers before it starts anew, and the text it encodes at once.
REMEMBERED, ENCODE_BYTES = 200_000, 4 << 20
#: Pre-tokens of more bytes are merged one by one with a heap, as tokens that must be taken place by place make the index slow there.
LONG_WORD = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.vocabulary[r] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = array("Q"), array("i")
        self.risky = np.zeros(len(self.vocabulary), bool)
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(r)
                    for part in (left, right):
                        if part > r:
                            self.risky[part] = True
        keys = np.frombuffer(keys, np.uint64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.frombuffer(values, np.int32)[order]
        lengths = np.array([len(x) for x in self.vocabulary], np.int64)
        self.token_length, self.token_start = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.vocabulary), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        if not len(self.pair_keys):
            return np.full(len(key), NEVER, np.int32)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one after the other, and how many each word has."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._replayed(words)
        tokens, count = self._replayed([b"" if len(w) > LONG_WORD else w for w in words])
        parts = np.split(tokens, np.cumsum(count)[:-1])
        for i in long:
            parts[i] = self.merged(words[i])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    @cached_property
    def by_pair(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))

    def merged(self, word: bytes) -> np.ndarray:
        """One long word: the pair of lowest rank, then the leftmost, is joined until there is none."""
        tok = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        known = self.by_pair
        heap = [(r, i) for i in range(n - 1) if (r := known.get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] < 0 or j < 0 or known.get(tok[i] << 32 | tok[j]) != r:
                continue  # one of the two has been joined with another since
            tok[i], tok[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] >= 0 and (r := known.get(tok[a] << 32 | tok[nxt[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([t for t in tok if t >= 0], np.int32)

    def _replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        if not n:
            return tok, lengths
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)[lengths > 0]
        nxt[ends - 1] = -1
        prv[ends[:-1]] = -1
        rank = np.full(n, NEVER, np.int32)  # of the pair that starts at a position
        at = np.flatnonzero(nxt >= 0)
        rank[at] = self.pair_rank(tok[at], tok[at + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Index positions under the ranks of their pairs."""
            r = rank[positions]
            order = np.argsort(r, kind="stable")
            r, positions = r[order], positions[order]
            cuts = np.flatnonzero(np.diff(r, prepend=-1)).tolist()
            for k, (start, value) in enumerate(zip(cuts, r[cuts].tolist(), strict=True)):
                part = positions[start : cuts[k + 1] if k + 1 < len(cuts) else None]
                if value in index:
                    index[value].append(part)
                else:
                    index[value] = [part]
                    heapq.heappush(queue, value)

        add(at[rank[at] < NEVER].astype(np.int32))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            pos = np.concatenate(parts) if len(parts) > 1 else parts[0]
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            if len(parts) > 1:
                pos = np.sort(pos)
            if len(pos) > 1:
                if self.risky[r]:
                    w = word[pos]
                    first = np.r_[True, w[1:] != w[:-1]]
                    if not first.all():
                        index[r] = [pos[~first]]
                        heapq.heappush(queue, r)
                        pos = pos[first]
                else:  # of pairs that overlap, as in "aaaa", every second one
                    linked = np.r_[False, nxt[pos[:-1]] == pos[1:]]
                    if linked.any():
                        k = np.arange(len(pos))
                        pos = pos[(k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0]
            right = nxt[pos]
            after = nxt[right]
            tok[pos], tok[right], rank[right], nxt[pos] = r, -1, NEVER, after
            has = after >= 0
            prv[after[has]] = pos[has]
            rank[pos] = NEVER
            left, before = pos[has], prv[pos]
            before = before[before >= 0]
            touched = np.concatenate([left, before])
            if len(touched):
                rank[touched] = self.pair_rank(tok[touched], tok[nxt[touched]])
                touched = touched[rank[touched] < NEVER]
                if len(touched) == 1:
                    add(touched)
                elif len(touched):
                    touched.sort()
                    add(touched[np.r_[True, touched[1:] != touched[:-1]]])
        live = tok >= 0
        return tok[live], np.bincount(word[live], minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ranges(self.token_start[ids], self.token_length[ids])].tobytes()


class _Words(dict):
    """Numbers pre-tokens as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """Encodes texts chunk by chunk; pre-tokens met before are not replayed again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.pattern = MergeReplay(ranks), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.tokens, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.words) > REMEMBERED:
            self.forget()
        known, find, number = len(self.words), self.pattern.findall, self.words.__getitem__
        numbered = [np.fromiter(map(number, find(x)), np.int32) for x in texts]
        if len(self.words) > known:
            new = [w.encode("utf-8", "replace") for w in list(self.words)[known:]]
            tokens, count = self.replay.encode(new)
            self.tokens, self.count = np.concatenate([self.tokens, tokens]), np.concatenate([self.count, count])
            self.start = np.cumsum(self.count) - self.count
        for x in numbered:
            yield self.tokens[ranges(self.start[x], self.count[x])] if len(x) else np.zeros(0, np.int32)


def encode(docs: DataFrame, tokenizer_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, and with ``with_ids`` the ``token_ids`` themselves.

    The vocabulary file (of a fixed size) is read by the driver and broadcast. One narrow stage: no shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast((tokenizer_path, read_ranks(tokenizer_path)))

    def run(batches):
        path, table = ranks.value
        coder = model(f"{path} {pattern}", lambda: Encoder(table, pattern))
        for ids, texts in chunks(batches, ENCODE_BYTES):
            counts, digests, back, every = [], [], [], []
            for tokens in coder.encode(texts):
                counts.append(len(tokens))
                digests.append(tokens.astype("<u4").tobytes())
                back.append(coder.replay.decode(tokens))
                if with_ids:
                    every.append(tokens)
            out = {"doc_id": ids, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hex_digests(digests)), "decoded_sha256": pa.array(hex_digests(back))}
            if with_ids:
                out["token_ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(np.concatenate(every), pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return id_text(docs).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, token_ids``; bytes that are not UTF-8 become U+FFFD. Null ids decode to the empty text."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(tokenizer_path))

    def run(batches):
        vocabulary = [b""] * (max(ranks.value.values()) + 1)
        for token, r in ranks.value.items():
            vocabulary[r] = token
        for b in batches:
            texts = [b"".join(map(vocabulary.__getitem__, x or ())).decode("utf-8", "replace") for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "token_ids").mapInArrow(frugal(run), "doc_id long, text string")
