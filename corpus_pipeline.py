"""A corpus in four stages: quality, near-duplicates, mixing, tokens.

Each stage takes what the one before it kept. The driver of a run writes every stage's result and reads it
again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfall.llm.bpe import encode_documents, vocabulary
from inkfall.llm.common import table, written
from inkfall.llm.mixing import mixed_documents
from inkfall.llm.near_dup import one_of_each
from inkfall.llm.quality import kept_documents, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from a bounded sample of the labelled ones.

    Null and empty texts are scored as such; rows that repeat are judged alike. Without labelled documents nothing goes.
    """
    return kept_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class.

    Texts without words, null and empty ones too, are like no other; of rows that repeat a doc_id one stays, of rows
    without one those with unlike texts.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: none, once or twice. A null source is one of its own; null and empty texts have no words."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the decoded text of every row; null and empty texts have no tokens."""
    return encode_documents(docs, vocabulary(), decoded="digest").withColumnRenamed("decoded", "decoded_sha256")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]
#: No stage but the mixing can be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
