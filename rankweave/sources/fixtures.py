"""Fixture views over the driver's Parquet tables (see FIXTURES.md).

They turn the generic tables into the retrieval data model: documents with
url/title/body, text queries, judgements by exact containment, and vector
queries / documents / passages with label-based judgements. Each view is a
lazy DataFrame built from the tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators.joins import salted_join
from rankweave.operators.textmatch import contains_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sid(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs(doc_id, url, title, body): every document with its whole text."""
    return docs_view(table(spark, sf_dir, "documents"))


def docs_view(d: DataFrame) -> DataFrame:
    """The docs view over a ``documents`` frame (batch or streaming)."""
    return d.select(
        _sid("D", "doc_id").alias("doc_id"),
        F.concat(F.lit("http://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("title"),
        F.col("text").alias("body"),
    )


def untitled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The docs view with titles that are missing or empty in two of the languages,
    so that preparing the documents with their titles removes those."""
    lang = F.element_at(F.split("title", " "), -1)
    title = F.when(lang == "de", F.lit(None).cast("string")).when(lang == "fr", F.lit("")).otherwise(F.col("title"))
    return docs(spark, sf_dir).withColumn("title", title)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(_sid("Q", "item_id").alias("query_id"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qrels(query_id, doc_id, relevance): the benchmark text occurs verbatim in the
    document; grade 2 when the document is labelled good quality, else 1."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contains_join(d, b, doc_key="doc_id", doc_text="text", pat_key="item_id", pat_text="text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (hits.join(lab, "doc_id", "left")
            .select(_sid("Q", "item_id").alias("query_id"), _sid("D", "doc_id").alias("doc_id"),
                    (F.lit(1) + F.coalesce(F.col("quality"), F.lit(0))).cast("int").alias("relevance")))


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 50 == 0).select(_sid("V", "vec_id").alias("query_id"), "embedding", "label")


def vec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a document; a query's own one is left out where pairs are made."""
    return table(spark, sf_dir, "embeddings").select(_sid("D", "vec_id").alias("doc_id"), "embedding", "label")


def vec_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document with the query's label is relevant (grade 1).

    A label holds about a tenth of all rows, so the join on label is salted:
    the document side is split by a hash of doc_id, the query side copied per salt.
    """
    # made before the join: there are many more pairs than queries and documents
    q = vec_queries(spark, sf_dir).select("query_id", "label", F.substring("query_id", 2, 20).alias("_q"))
    d = vec_docs(spark, sf_dir).select("doc_id", "label", F.substring("doc_id", 2, 20).alias("_d"))
    pairs = salted_join(d, q, "label", unique_col="doc_id", spread=True).where(~(F.col("_q") == F.col("_d")))
    return pairs.select("query_id", "doc_id", F.lit(1).alias("relevance"))


def vec_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of growing length: vector v belongs to document floor(sqrt(v))."""
    e = table(spark, sf_dir, "embeddings")
    g = F.floor(F.sqrt(F.col("vec_id"))).cast("bigint")
    a = e.select(g.alias("g"), "vec_id", "embedding", "label")
    w = Window.partitionBy("g").orderBy("vec_id")
    b = a.withColumn("i", F.row_number().over(w) - 1)
    return b.select(
        _sid("D", "g").alias("doc_id"), F.col("i").cast("int").alias("passage_idx"),
        F.concat(F.lit("D"), F.col("g").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("passage_id"),
        F.col("embedding").alias("passage_embedding"), "label")


def vec_doc_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade = number of the document's passages with the query's label, at most 3."""
    q = vec_queries(spark, sf_dir).select("query_id", "label")
    # a document's passages of one label count once before they meet the queries of it
    p = vec_passages(spark, sf_dir).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return (salted_join(p, q, "label", unique_col="doc_id").groupBy("query_id", "doc_id")
            .agg(F.least(F.sum("n"), F.lit(3)).cast("int").alias("relevance")))
