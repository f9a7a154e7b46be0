"""The corpus pipeline: stages applied one after another to ``documents``.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet below
the shared checkpoint folder and read again as the next stage's documents.

Cases: a null text is an empty one, and an empty document is kept by every stage
(it is not toxic, near nothing and not contaminated); of rows that repeat doc_id
and text one stays (those without words all stay), rows without a doc_id are judged by
their text alone; an empty
table goes through as one; other columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import bpe, decontaminate, jaccard_join, toxicity
from rankweave.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model rejects (score of one half or more) go."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.clean_documents(docs, toxicity.fit(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle Jaccard similarity of 0.8 or more the one
    with the smallest doc_id stays."""
    return jaccard_join.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark windows go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, digests of the ids and of the decoded bytes, and the ids."""
    # workers come here with what earlier stages left in them: smaller batches and cache
    return bpe.encode_documents(docs, with_ids=True, batch_chars=2_000_000, cache_units=100_000)


STAGES = [("toxicity", without_toxic), ("jaccard_join", one_of_each), ("decontamination", without_benchmark),
          ("byte_bpe", encoded)]

ORACLE_SQL = None  # toxicity and byte-level BPE are not SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
