"""The ten text operators on small tables against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontam, exact, graph, html, kmers, langid, neardup, secrets, suffix, superkmer, toxicity

EXTRA = "doc_id long, text string, lang string, row_key string, n_words int, kept string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def table(spark, rows):
    """doc_id and text, with columns whose names clash with outputs."""
    return spark.createDataFrame([(i, t, None, "x", 1, None) for i, t in rows], EXTRA).repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "é", "it's", "x1", "--", "\U0001f600"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "a" * 5000), (104, rows[5][1]), (105, rows[5][1] + " "), (None, "no id"), (7, rows[7][1]), (106, " ".join(map(str, range(3000))))]
    return rows


# ---- 1


def test_bpe_matches_a_plain_encoder(spark, odd):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = bpe.encode(table(spark, odd), path, public.PATTERN, with_ids=True)
    expected = []
    for i, t in odd:
        ids = plain.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert got(bpe.decode(out, path), "doc_id", "text") == sorted(((i, t or "") for i, t in odd), key=repr)
    assert bpe.encode(table(spark, []), path, public.PATTERN).count() == 0


def plain_merges(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        if not pairs or min(pairs)[0] == 10**9:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(20))
def test_merge_replay_on_random_vocabularies(seed):
    """Small alphabets make overlapping pairs, and random ranks make merges that create pairs of lower rank."""
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = set()
    for _ in range(30):
        a, b = (rng.choice([*tokens, b"a", b"b", b"c"]) for _ in "ab")
        if len(a + b) < 9:
            tokens.add(a + b)
    for r, t in enumerate(rng.sample(sorted(tokens), len(tokens)), 256):
        ranks[t] = r
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).encode() for _ in range(60)] + [b"a" * 33, b""]
    found, count = bpe.MergeReplay(ranks).encode(words)
    at = 0
    for w, n in zip(words, count.tolist(), strict=True):
        assert found[at : at + n].tolist() == plain_merges(w, ranks)
        at += n


def test_long_words_take_a_heap(monkeypatch):
    rng = random.Random(7)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"ba": 301, b"aba": 256, b"bab": 299, b"abab": 280, b"aa": 310}
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    plain = [t for w in words for t in plain_merges(w, ranks)]
    for limit in (10, 10_000):
        monkeypatch.setattr(bpe, "LONG_WORD", limit)
        assert bpe.MergeReplay(ranks).encode(words)[0].tolist() == plain


# ---- 2


def test_language(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["ção", "nh", "il"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(40)), k) for i, k in enumerate(list(syllables) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !?", "bb"), (902, rows[0][1], None), (903, rows[1][1] * 300, "bb")], "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out()))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert out[900] == out[901] == ("und", 0.0) and out[902][0] == "aa" and out[903][0] == "bb"
    assert np.mean([out[i][0] == k for i, _, k in rows]) > 0.98
    assert all(0 <= s <= 1 for _, s in out.values())
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def plain_grams(text, n):
    """N-grams of letters and boundaries, as strings."""
    out, boundary = [" "], True
    for c in text.lower() + " ":
        if c.isalpha():
            out.append(c)
        elif not boundary:
            out.append(" ")
        boundary = not c.isalpha()
    t = "".join(out)
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def test_language_against_plain_sets(spark):
    """Sets of n-grams in place of bit-sliced filters, counted one by one."""
    rng = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "er", "lo"], "cc": ["ção", "nh", "il", "ta"]}
    rows = []
    for i in range(90):
        k = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30))) + rng.choice(["", "!", " 12", " Ä"]), k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "held_out": F.lit(None)})
    docs = docs.unionByName(docs.limit(5))  # repeated rows
    out = langid.predict(docs, langid.fit(docs.where(~langid.held_out()))).collect()
    learned = [r for r in docs.where(~langid.held_out()).collect()]
    known = {}
    for k in syllables:
        n = len([1 for r in learned if r["lang"] == k])
        seen = Counter((g, size) for r in learned if r["lang"] == k for size in langid.SIZES for g in set(plain_grams(r["text"], size)))
        known[k] = {g for g, c in seen.items() if c >= max(1, langid.MIN_SHARE * n)}
    text = {i: t for i, t, _ in rows}
    for r in out:
        every = [(g, size) for size in langid.SIZES for g in plain_grams(text[r["doc_id"]], size)]
        share = {k: sum(g in known[k] for g in every) for k in known}
        assert share[r["lang_pred"]] == max(share.values()) and len(out) == 95


# ---- 3


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(g)[3], len(g), sha(k)) for k, g in groups.items() for *_, i in g), key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, odd, weak):
    rows = odd
    out = exact.dedup(table(spark, rows), (lambda c: F.substring(exact.sha256_hex(c), 1, 1)) if weak else exact.sha256_hex)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == plain_copies(rows)
    assert out.where("kept").count() == len({k for _, _, _, k in plain_copies(rows)})
    assert all(r["doc_id"] == r["keep_id"] for r in out.where("kept").collect())


def test_exact_copies_leave_one_row(spark, odd):
    docs = table(spark, odd)
    docs = docs.withColumns({"row": F.lit(1), "Row_Key": F.lit(2), "digest": F.lit("d"), "__id": F.lit(3)})  # names that the operator uses
    left = exact.without_copies(docs)
    assert left.columns == docs.columns and left.count() == len({re.sub(r"\s", "", t or "") for _, t in odd})
    assert exact.dedup(table(spark, [])).count() == 0


# ---- 4


def plain_classes(rows, threshold):
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            union = sum((sets[a] | sets[b]).values())
            if union and sum((sets[a] & sets[b]).values()) / union >= threshold:
                root[find(a)] = find(b)
    groups = {}
    for n, (i, _) in enumerate(rows):
        groups.setdefault(find(n), []).append(i)
    return sorted(((i, min(g), len(g)) for g in groups.values() for i in g), key=repr)


def near_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(150)]
        rows.append((len(rows), " ".join(words)))
        for edits in (0, 1, 1, 1, 40):
            some = list(words)
            for _ in range(edits):
                some[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(some)))
        del base
    return [*rows, (500, None), (501, ""), (502, "a b"), (503, "A  b!"), (504, "a c"), (505, rows[0][1] + " tail")]


def test_near_copies(spark):
    rows = near_rows()
    out = neardup.near_duplicates(table(spark, rows))
    assert got(out, "doc_id", "class_id", "class_size") == plain_classes(rows, 0.8)
    assert out.where("kept").count() == len({c for _, c, _ in plain_classes(rows, 0.8)})
    docs = table(spark, [*rows, rows[3], (None, "nobody's words here at all")])
    left = neardup.without_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len({c for _, c, _ in plain_classes(rows, 0.8)}) + 1
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def boilerplate_rows(n=120):
    """Texts of one form, about half alike, some of them twice with a few words changed."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(5000)]
    form = [rng.choice(vocabulary) for _ in range(300)]
    rows = []
    for k in range(n):
        own = [rng.choice(vocabulary) for _ in range(30)]
        rows.append((len(rows), " ".join(form + own)))
        if k % 3 == 0:
            for i in range(3):
                own[i * 2 + 10] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(form + own)))
    return rows


def weighted_similarities(spark, rows):
    weights = neardup.document_frequencies(table(spark, rows))
    sets = []
    for _, t in rows:
        h, w, _ = weights.shingles(*neardup.word_hashes([t.encode()]))
        sets.append(dict(zip(h.tolist(), w.tolist(), strict=True)))
    for a in range(len(rows)):
        for b in range(a):
            common = sum(min(w, sets[b][h]) for h, w in sets[a].items() if h in sets[b])
            yield a, b, common / (sum(sets[a].values()) + sum(sets[b].values()) - common)


def linked_classes(spark, rows):
    """Brute force with the operator's weights."""
    root = list(range(len(rows)))
    for a, b, x in weighted_similarities(spark, rows):
        if x >= 0.8:
            root = [root[b] if r == root[a] else r for r in root]
    return sorted(((i, min(j for j in range(len(rows)) if root[j] == root[i]), root.count(root[i])) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("block_words", [250_000, 3_000])
def test_every_pair_of_a_bucket_is_judged(spark, monkeypatch, block_words):
    """Also where the texts of a bucket meet in several blocks."""
    monkeypatch.setattr(neardup, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(neardup, "MOST_BLOCKS", 1000)
    rows = boilerplate_rows()
    classes = linked_classes(spark, rows)
    assert 10 < len({c for _, c, n in classes if n == 2})
    assert got(neardup.near_duplicates(table(spark, rows)), "doc_id", "class_id", "class_size") == classes


def test_large_buckets_go_to_narrower_bands(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_WORDS", 3_000)
    monkeypatch.setattr(neardup, "MOST_BLOCKS", 1)
    rows = boilerplate_rows(60)
    assert got(neardup.near_duplicates(table(spark, rows)), "doc_id", "class_id", "class_size") == linked_classes(spark, rows)


@pytest.mark.parametrize("edits", [4, 6])
def test_twins_of_one_form(spark, edits):
    """300 texts of one form of a thousand words, in 150 pairs of twins; links between families come as they may."""
    rng = random.Random(edits)
    vocabulary = ["".join(rng.choice("uvwxyzklm") for _ in range(7)) for _ in range(9000)]
    form = [rng.choice(vocabulary) for _ in range(1000)]
    rows = []
    for _ in range(150):
        one = list(form)
        for _ in range(45):
            one[rng.randrange(1000)] = rng.choice(vocabulary)
        for _ in range(2):
            twin = list(one)
            for _ in range(edits):
                twin[rng.randrange(1000)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(twin)))
    out = neardup.near_duplicates(table(spark, rows))
    assert got(out, "doc_id", "class_id", "class_size") == linked_classes(spark, rows)


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    same, h = 0, rng.integers(0, 1 << 63, 300).astype(np.uint64)
    w = rng.gamma(2, 1, 300).astype(np.float32) + 0.1
    v = np.where(np.arange(300) < 240, w, w * 0.2).astype(np.float32)
    similarity = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    trials = 60
    for k in range(trials):
        x = h ^ np.uint64(k * 7919)
        a, b = (neardup.Sampler().bands(np.sort(x), z[np.argsort(x)], np.array([300])) for z in (w, v))
        same += (a == b).mean()
    assert abs(same / trials - similarity ** neardup.LEVELS[0][1]) < 0.06


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 3)] + [(100 + i, 101 + i) for i in range(40)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: out[n] for n in (1, 2, 3, 10, 11, 12)} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} and all(out[100 + i] == 100 for i in range(41))


# ---- 5


def plain_hits(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            x = split(text)
            k = min(10, len(x))
            for s in range(len(x) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[s : s + k]:
                        hit |= set(range(p, p + k))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [500_000, 7])
def test_contamination(spark, odd, monkeypatch, group):
    monkeypatch.setattr(decontam, "GROUP_WINDOWS", group)
    items = [(1, "alpha BETA gamma"), (2, None), (3, "?!"), (4, odd[3][1][:300]), (5, odd[3][1][:300]), (10, "x1 it"), (6, " ".join(map(str, range(50, 90))))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(table(spark, odd), bench)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == plain_hits(odd, items)
    text = {i: t for i, t in odd}
    for r in out.where("contaminated").collect():
        assert all(text[r["doc_id"]][s["start"] : s["end"]].strip() for s in r["spans"])
    left = decontam.uncontaminated(table(spark, odd), bench)
    assert left.count() == sum(not x[-1] for x in plain_hits(odd, items)) and left.columns == table(spark, odd).columns
    assert decontam.contamination(table(spark, odd), bench.limit(0)).where("contaminated").count() == 0


# ---- 6


def toxic_table(spark, n=260):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 15):
                w.insert(rng.randrange(len(w)), rng.choice(["zubbax", "zubbol", "grixy"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = toxicity.Network.new(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f = (np.array([3, 4, 0]), np.array([5, 6, 0, 7]), np.array([2, 1, 1]))
    ids, mask = rng.integers(0, 3, (3, 6)), np.ones((3, 6), bool)
    mask[1, 4:] = False
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = 1 / (1 + np.exp(-net.run(net.project(net.inputs(f)), ids, mask)))
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    g = net.gradients(f, ids, mask, y, w)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = net.p[k][at]
        net.p[k][at] = was + 1e-3
        up = loss()
        net.p[k][at] = was - 1e-3
        assert abs((up - loss()) / 2e-3 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))
        net.p[k][at] = was


def test_toxicity_on_rows_held_out(spark):
    rows, labels = toxic_table(spark)
    docs = table(spark, [*rows, (900, None), (901, ""), (902, rows[1][1] * 200)])
    marks = spark.createDataFrame([*labels, (901, 0), (902, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where(~toxicity.held_out()))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r["doc_id"] for r in docs.where(toxicity.held_out()).collect() if r["doc_id"] < 900]
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["score"] == out[901]["score"] and out[902]["predicted"] == 0
    kept = toxicity.clean(docs, marks.where(~toxicity.held_out()))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]} and kept.columns == docs.columns
    none = toxicity.fit(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_scores_against_a_plain_network(spark):
    """A text's score with the network written out number by number."""
    from math import exp, tanh

    rows, labels = toxic_table(spark, 120)
    docs = table(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where(~toxicity.held_out()))
    p, h = {k: v.astype(float) for k, v in model.network.p.items()}, toxicity.HIDDEN
    s = lambda x: 1 / (1 + exp(-x))

    def vector(word):
        w, grams, _ = toxicity.features([word], model.vocabulary)
        mean = sum((p["char"][g] if g else np.zeros(toxicity.DIM) for g in grams.tolist()), np.zeros(toxicity.DIM)) / len(grams)
        return np.concatenate([p["word"][w[0]] if w[0] else np.zeros(toxicity.DIM), mean])

    def one_way(words, d):
        state, out = [0.0] * h, []
        for word in words:
            x = vector(word) @ p["into"][d] + p["bias"][d][0]
            again = np.array(state) @ p["again"][d]
            z, r = [s(x[i] + again[i]) for i in range(h)], [s(x[h + i] + again[h + i]) for i in range(h)]
            n = [tanh(x[2 * h + i] + r[i] * again[2 * h + i]) for i in range(h)]
            state = [(1 - z[i]) * n[i] + z[i] * state[i] for i in range(h)]
            out.append(state)
        return out

    def logit(words):
        both = [a + b for a, b in zip(one_way(words, 0), reversed(one_way(words[::-1], 1)), strict=True)]
        look = [exp(float(np.dot(b, p["look"]))) for b in both]
        pooled = sum((np.array(b) * (e / sum(look)) for b, e in zip(both, look, strict=True)), np.zeros(2 * h))
        return float(pooled @ p["out"] + p["base"][0])

    text = dict(rows)
    for r in toxicity.score(docs.where("doc_id in (0, 3, 8, 30, 77)"), model).collect():
        words = toxicity.words_of(text[r["doc_id"]])
        each = sorted((logit(words[a : a + toxicity.WINDOW]) for a in toxicity.windows(len(words)).tolist()), reverse=True)
        x = [each[0], sum(each[:3]) / len(each[:3]), sum(each) / len(each)]
        assert abs(s(sum(a * b for a, b in zip(x, model.calibration, strict=False)) + model.calibration[3]) - r["score"]) < 2e-3
    none = docs.limit(0)
    assert toxicity.score(none, model).count() == toxicity.clean(none, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_windows_cover_every_word():
    for n in range(0, 200):
        at = toxicity.windows(n)
        assert set(range(n)) == {k for s in at.tolist() for k in range(s, min(n, s + toxicity.WINDOW))}


# ---- 7


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain,  text", "plain, text"),
        ("<html><body><script>x</script></body></html>", ""),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One, two\n three.<p>Four<br>five &eacute;.</article><footer>f</footer></body>", "T & U\nOne, two three.\nFour five é."),
        ('<body><div class="ad">Buy, buy, buy.</div><div id=content><p>Long prose, with commas, and more of it.</p><div class="comments"><p>I, too, think so.</p></div><form><p>Sign up</p></form></div></body>', "Long prose, with commas, and more of it."),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- no --></article>", "a\nb\nc\nd"),
        ("<article><p><b>Open, bold<p>next, one</article>", "Open, bold\nnext, one"),
        # attributes count by name and value
        ('<article><p aria-hidden="false">One.</p><p title="a hidden gem">Two.</p><p data-id="sidebar">Three.</p><p hidden>No.</p><p style="color:red; display: none">No.</p></article>', "One.\nTwo.\nThree."),
        ("<article><p class=nav-x title='class=\"menu\"'>No.</p><p TITLE='id=menu'>Yes.</p><h2 class='section-header'>Yes</h2></article>", "Yes.\nYes"),
        # what stands beside the best container
        ("<body><h1>Short</h1>Bare <i>text</i>.<div id=content><p>Long prose, with commas, and more of it.</p></div><h3>Notes</h3><ul><li>one<li>two</ul><p>End.</p><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><div><p>Last words.</p></div></body>", "Short\nBare text.\nLong prose, with commas, and more of it.\nNotes\none\ntwo\nEnd.\nLast words."),
        ("<body><div id=content><p>Prose, prose, prose.</p></div>As <a href=/>he</a> has said many times.<p><a href=/>More</a></p></body>", "Prose, prose, prose.\nAs he has said many times."),
        # inline elements that browsers show
        ("<article><p>A <button>press</button>, <math><mi>x</mi></math>, <svg><text>y</text></svg>, <object>z</object>.</p></article>", "A press, x, y, z."),
        ("<article><p>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + ".</p>" + "<div>" * 3000 + "end</article>", "deep.\nend"),
        ("<div class=post><p>One, two.</p></div><div class=post><p>One, two.</p></div>", "One, two.\nOne, two."),
        ("<p>" + "word, " * 50_000 + "</p>", ("word, " * 50_000).strip()),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("seed", range(25))
def test_main_text_of_made_up_pages(seed):
    """Articles of known blocks, in wrappers, among all that is to go."""
    rng = random.Random(seed)
    words = lambda n: [rng.choice("lorem ipsum dolor sit amet magna aliqua erat sed diam été naïve x&y 1<2".split()) for _ in range(n)]
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("é", rng.choice(["&eacute;", "&#233;", "é"]))

    def prose(n):
        return ", ".join(" ".join(words(rng.randint(3, 9))) for _ in range(n)) + "."

    def marked(text):
        """A few words of a block in inline elements, and odd white space."""
        out = []
        for w in text.split(" "):
            tag = rng.choice(["b", "i", "em", "span", "code", "a href='/x'", *[""] * 12])
            out.append(f"<{tag}>{escaped(w)}</{tag.split()[0]}>" if tag else escaped(w))
        return "".join(x + rng.choice([" ", "\n ", "\t"]) for x in out)

    links = lambda: "".join(f"<li><a href='/{w}'>{escaped(w)}</a>" for w in words(5))
    noise = [
        lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<div class='site-header'>{escaped(prose(1))}</div>", lambda: f"<aside><p>{escaped(prose(2))}</p></aside>", lambda: f"<div id=sidebar><h3>More</h3><ul>{links()}</ul></div>",
        lambda: f"<div class='ad'>{escaped(prose(1))}</div>", lambda: f"<div class='cookie notice'><p>{escaped(prose(1))}</p></div>", lambda: f"<form><p>{escaped(prose(1))}</p><input><select><option>a<option>b</select></form>", lambda: "<script>var p = '<p>no</p>';</script><style>p{}</style>",
        lambda: f"<!-- <p>{escaped(prose(1))}</p> -->", lambda: f"<section class=comments><p>{escaped(prose(3))}</p></section>", lambda: f"<ul>{links()}</ul>", lambda: f"<div hidden><p>{escaped(prose(2))}</p></div>",
    ]
    expected, body = [], []
    for k in range(rng.randint(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "blockquote", "table"]) if k else "h1"
        if kind in ("ul", "table"):
            parts = [prose(1) for _ in range(3)]
            expected += parts
            open_, close = ("<ul><li>", "</ul>") if kind == "ul" else ("<table><tr><td>", "</table>")
            body.append(open_ + (open_[4:] if kind == "ul" else "<td>").join(marked(x) for x in parts) + close)
        else:
            text = " ".join(words(4)) if kind[0] == "h" else prose(rng.randint(3, 6))
            expected.append(text)
            body.append(f"<{kind}>{marked(text)}" + ("" if kind == "p" and rng.random() < 0.3 else f"</{kind}>"))
        if rng.random() < 0.2 and k:
            body.append(rng.choice(noise[:10])())
    inner = "<article>" + "".join(body) + "</article>" if rng.random() < 0.5 else "<div class='post content'>" + "".join(body) + "</div>"
    for _ in range(rng.randint(0, 3)):
        inner = "<div>" + "".join(rng.choice(noise)() for _ in range(rng.randint(0, 2))) + inner + rng.choice(noise)() + "</div>"
    page = f"<!DOCTYPE html><html><head><title>{escaped(prose(1))}</title></head><body>{''.join(f() for f in rng.sample(noise, 4))}{inner}<footer>{escaped(prose(1))}</footer></body></html>"
    assert html.extract(page) == "\n".join(expected)


def test_main_text_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é, a</p>", 3), (2, None, None, 4), (2, None, None, 4)], "page_id long, url string, html string, n_chars int")
    assert got(html.main_text(pages), "page_id", "url", "text", "n_chars") == [(1, "u", "é, a", 4), (2, None, "", 0), (2, None, "", 0)]
    assert html.main_text(pages.limit(0)).count() == 0


# ---- 8


def plain_windows(rows, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = {q for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for q in range(j, j + k)}
        out.append((i, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [0.5, 0.0])
def test_repeated_windows(spark, odd, monkeypatch, frequent):
    """Also where all minimisers count as frequent."""
    monkeypatch.setattr(kmers, "FREQUENT", frequent)
    rng = random.Random(9)
    rows = odd + [(200 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(80)]
    out = superkmer.without_repeats(table(spark, rows), window=8, gram=3)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_windows(rows, 8)
    unique = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}]
    assert got(superkmer.without_repeats(table(spark, unique), window=8, gram=3), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_windows(unique, 8)
    assert superkmer.without_repeats(table(spark, [])).count() == 0


def test_long_texts_come_in_pieces():
    text = " ".join(map(str, range(3000))).encode() + b"  end"
    parts = list(superkmer.pieces(text, 7, 500))
    assert len(parts) > 3
    for piece, number in parts:
        assert piece.split() == text.split()[number : number + len(piece.split())]
    covered = {tuple(p.split()[j : j + 8]) for p, _ in parts for j in range(len(p.split()) - 7)}
    assert covered == {tuple(text.split()[j : j + 8]) for j in range(len(text.split()) - 7)}


# ---- 9


def plain_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark, odd):
    hexes, access = "0123456789abcdef" * 2, "AKIA" + "A1" * 10
    texts = ["Password: hunter22", "token=abc token = abcdefg", "password: a token=abcdefgh", "secret:token : abcdefgh", f"é {hexes}{hexes[:3]} g{hexes}", access, f"api_key='{hexes}' APIKEY=\"{access}\"", "AKIA" * 3, f"x{hexes[:23]}", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "z" * 36, f"token={access};passwd:{hexes}", "passwordpassword=======abcdefgh", "é token=abcdefg" * 700]
    texts.append("x eyJhbGci.eyJzdWIi.c2ln y")
    rows = [r for r in odd if r[0] is not None] + [(300 + i, t) for i, t in enumerate(texts)] + [(300, texts[0]), (None, texts[2])]
    out = {}
    for r in secrets.report(secrets.scan(table(spark, rows))).collect():
        out.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        spans = plain_secrets(t or "")
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        for r in out[i]:
            assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (*(sum(k == n for _, n, _ in spans) for k in range(3)), sha(shown))
    assert out[300 + len(texts) - 1][0]["spans"] == "jwt:2:24" and out[309][0]["spans"] == "pem:0:31" and out[310][0]["spans"] == "github:0:40" and len(out[300]) == 2
    assert secrets.scan(table(spark, [])).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == ()
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ((frozenset({"aki", "kia"}),),)
    assert secrets.trigram_query("(abcd|xyz)+q") == ((frozenset({"abc", "bcd"}), frozenset({"xyz"})),)
    assert secrets.trigram_query("ab?c") == () and secrets.trigram_query("x*abc") == ((frozenset({"abc"}),),)


def test_secrets_stay_in_the_jvm(spark, odd):
    plan = secrets.scan(table(spark, odd))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 10


def plain_bytes(rows, k):
    first = {}
    raw = [(i, 2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for _, q, w in raw:
        for j in range(len(w) - k + 1):
            first[w[j : j + k]] = min(q, first.get(w[j : j + k], q))
    out = []
    for i, q, w in raw:
        gone = bytearray(len(w))
        for j in range(len(w) - k + 1):
            if first[w[j : j + k]] < q:
                gone[j : j + k] = b"\1" * k
        out.append((i, len(w), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [0.5, 0.0])
def test_repeated_bytes(spark, odd, monkeypatch, frequent):
    monkeypatch.setattr(kmers, "FREQUENT", frequent)
    rng = random.Random(4)
    rows = odd + [(200 + i, "".join(rng.choice("abé") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    out = suffix.without_repeats(table(spark, rows), length=12, gram=4)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_bytes(rows, 12)
    assert suffix.without_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays(seed):
    rng = random.Random(seed)
    s = [rng.randint(1, rng.choice([1, 2, 4, 250])) for _ in range(rng.randint(0, 90))] * rng.choice([1, 1, 3]) + [3] * rng.choice([0, 0, 20])
    t = np.array([*s, 0])
    sa = suffix.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    buf = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    common = suffix.permuted_common(buf, sa, 10)
    for before, i in zip(sa, sa[1:], strict=False):
        n = 0
        while n < len(t) - max(i, before) and t[i + n] == t[before + n]:
            n += 1
        assert (common[i] >= 10) == (n >= 10)
