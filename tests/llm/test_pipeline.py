"""The pipeline on a small fixture against plain versions of its stages."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from palimpsest.llm import bpe  # noqa: E402


def fixture(spark, folder):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    docs, labels, item = [], [], prose(14)
    for i in range(240):
        w, toxic = prose(rng.randint(40, 160)), i % 4 == 3
        if toxic:
            for _ in range(2 + len(w) // 12):
                w.insert(rng.randrange(len(w)), rng.choice(["zubbax", "zubbol", "grixy"]))
        docs.append((i, " ".join(w), "en", "src", 0))
        labels.append((i, 0, int(toxic)))
    text = {i: t for i, t, *_ in docs}
    more = {300: text[0], 301: text[4] + "  ", 302: text[8] + " one more", 303: " ".join([*text[12].split()[:20], *item, *prose(30)]), 304: "", 305: None}
    docs += [(i, t, "en", "src", 0) for i, t in more.items()]
    for name, rows, shape in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, " ".join(item))], "item_id long, text string")):
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    return {i for i, _, toxic in labels if toxic}, {i: t for i, t, *_ in docs}


def test_pipeline(spark, tmp_path):
    toxic, text = fixture(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r["doc_id"] for r in out}
    clean = set(text) - toxic
    # the longer of equal texts stays, of near copies and of empty texts the first; the contaminated one goes
    expected = clean - {300, 4, 302, 303, 305}
    assert len(left & toxic) <= 0.1 * len(toxic) and len(expected - left) <= 0.03 * len(expected) and not left - toxic - expected
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame([(r["doc_id"], r["token_ids"]) for r in out], "doc_id long, token_ids array<int>"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for r in out:
        assert decoded[r["doc_id"]] == (text[r["doc_id"]] or "") and r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["token_ids"])


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]


def test_odd_tables(spark, tmp_path):
    """Repeated and null doc_ids, columns whose names the stages use, no labels and no benchmark; then no documents at all."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row_key int, __key int, component string, kept boolean, text_sha256 string, void string"
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text under the same number"), (None, "a text without a number"), (None, None), (7, ""), (8, "one  two three four five six"), (9, "one two three four five six " * 4000)]
    rows = [(i, t, "en", "s", 0, 1, 2, "c", True, "x", None) for i, t in texts]
    for folder, some in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{folder}"
        spark.createDataFrame(some, names).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, docs, at).columns == docs.columns
        out = [(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, at).collect()]
        # of equal texts the longest stays: number 8 has one more space; of the empty ones the row with a number
        kept = [(1, texts[2][1]), (None, texts[3][1]), (7, ""), (8, texts[6][1]), (9, texts[7][1])] if some else []
        assert sorted(out, key=repr) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept), key=repr)


@pytest.mark.parametrize("stage", [1, 2, 3])
def test_a_stage_works_on_all_that_is_left(spark, tmp_path, stage):
    """Each stage alone against a plain version of it."""
    _, text = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path)).collect()}
    gone = {1: {300, 4, 305}, 2: {300, 301, 302}, 3: {303}}[stage]
    assert left == set(text) - gone
