"""A training-data pipeline of five operators: toxic documents, exact copies, near copies and contaminated documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Between stages the rows are
written to the shared folder and read again, so a lost executor never costs more than the running stage.

Null and empty texts are equal: one such document stays, is never toxic by itself, and has no tokens. Rows that repeat doc_id and text leave one
row; rows that repeat only doc_id are documents of their own, as are those with a null doc_id. Columns beyond those of documents are carried
along up to the last stage, whatever they are called. Empty documents, labels or benchmark tables give an empty result, no toxic or no contaminated
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, decontam, exact, neardup, toxicity
from palimpsest.llm.common import table, written

#: Classification and tokenising have no SQL; tests compare run() with a plain version of each stage.
ORACLE_SQL: str | None = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go. It learns from the labels that op6 learns from."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the longest, then the one with the smallest doc_id, stays."""
    return exact.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays."""
    return neardup.without_near_copies(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter one) go."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number and digest, and the digest of the bytes they decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxic), ("exact_dedup", copies), ("near_dedup", near_copies), ("decontamination", contaminated), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
