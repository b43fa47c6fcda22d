"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from palimpsest.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.exact import dedup

    return dedup(table(spark, sf_dir, "documents")).drop("locator")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~toxicity.held_out())))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.superkmer import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.secrets import report, scan

    return report(scan(table(spark, sf_dir, "documents")))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.suffix import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_html": op7_html,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secrets": op9_secrets,
    "op10_suffix_array": op10_suffix_array,
}

ORACLES: dict[str, str] = {}


_DIGITS_AND_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

ORACLES["op5_decontamination"] = rf"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '{_DIGITS_AND_WORDS}') AS w FROM documents, up),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '{_DIGITS_AND_WORDS}') AS w FROM benchmark, up),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)
),
found AS (SELECT p.doc_id, p.s, p.k, x.item_id FROM places p JOIN windows x ON p.k = x.k AND p.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 34), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT win FROM places GROUP BY win HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS g FROM (SELECT doc_id, unnest(range(s, s + 35)) AS place FROM places SEMI JOIN again USING (win)) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN (SELECT doc_id, unnest(g) AS place FROM gone) USING (doc_id, place)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op10_suffix_array"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM d WHERE length(h) >= 100)),
least AS (SELECT win, min(doc_id) AS lowest FROM places GROUP BY win),
gone AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s FROM places JOIN least USING (win) WHERE lowest < doc_id)),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM gone GROUP BY doc_id, run),
linked AS (SELECT *, coalesce(a > lag(b) OVER (PARTITION BY doc_id ORDER BY a), true) AS fresh FROM runs),
numbered AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM linked),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last FROM spans GROUP BY doc_id),
parts AS (
  SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS part
  FROM spans JOIN d USING (doc_id)
),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS t FROM parts GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
