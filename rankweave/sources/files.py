"""Readers and writers: TSV queries/documents, qrels, TREC runs, Parquet tables.

All readers take explicit schemas (no inference); text files are read with
quoting off, so bare quotes in MS MARCO text stay as they are; an empty field
reads as null. ``ingest`` is the way for large or dirty files: lines are read
once, spread (a ``.gz`` comes from one task), and written as splittable Parquet,
and those that do not fit the schema are kept apart with file and place.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES_SCHEMA = "query_id STRING, text STRING"
DOCS_SCHEMA = "doc_id STRING, url STRING, title STRING, body STRING"
QRELS_SCHEMA = "query_id STRING, iter STRING, doc_id STRING, relevance INT"
RUN_COLUMNS = ("query_id", "iter", "doc_id", "rank", "score", "name")


def _tsv(spark: SparkSession, schema: str, paths, sep: str = "\t") -> DataFrame:
    return (spark.read.schema(schema).option("sep", sep).option("quote", "").option("escape", "")
            .option("header", "false").option("mode", "PERMISSIVE").csv(paths))


def read_queries(spark: SparkSession, paths: dict[str, str] | str) -> DataFrame:
    """Headerless TSV (query_id, text); a dict {split: path} adds a ``split`` column."""
    if isinstance(paths, str):
        return _tsv(spark, QUERIES_SCHEMA, paths)
    parts = [_tsv(spark, QUERIES_SCHEMA, p).withColumn("split", F.lit(s)) for s, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def read_docs(spark: SparkSession, paths) -> DataFrame:
    """Headerless TSV (doc_id, url, title, body); ``.gz`` is read natively."""
    return _tsv(spark, DOCS_SCHEMA, paths)


def ingest(spark: SparkSession, paths, out: str, schema: str = DOCS_SCHEMA, *, sep: str = "\t",
           partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of delimited text files, read in one pass and written below ``out``.

    good: the lines with as many fields as ``schema`` and values that fit their
    types (an empty field is null). bad: (file, block_start, line, text) of all
    others; ``line`` counts from 1 in the split of the file that starts at byte
    ``block_start`` (0 for a file that cannot be split, as a ``.gz``). Both are Parquet
    of as many files as their size asks for, or ``partitions``."""
    fields = T.StructType.fromDDL(schema).fields
    names = ("_file", "_block", "_mid", "_line")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("_line"),
        F.split("value", _literal(sep), -1).alias("_parts"))
    raw = [F.nullif(F.get("_parts", F.lit(i)), F.lit("")) for i in range(len(fields))]
    cast = [r if isinstance(f.dataType, T.StringType) else r.try_cast(f.dataType) for r, f in zip(raw, fields)]
    fits = reduce(lambda a, b: a & b, [r.isNull() | c.isNotNull() for r, c in zip(raw, cast)],
                  F.size("_parts") == len(fields))
    own = lines.select(*[F.when(fits, c).alias(f.name) for c, f in zip(cast, fields)], "_file", "_block", "_mid",
                       F.when(~fits, F.col("_line")).alias("_line"), (~fits).alias("bad"))
    spread = own.repartition(partitions) if partitions else own.hint("rebalance")
    spread.write.partitionBy("bad").parquet(out)
    read = spark.read.schema(T.StructType([*fields, *own.select(*names, "bad").schema.fields])).parquet(out)
    # a split's lines follow one another, so its first one tells their places
    first = read.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"))
    bad = read.where("bad").join(first, ["_file", "_block"]).select(
        F.col("_file").alias("file"), F.col("_block").alias("block_start"),
        (F.col("_mid") - F.col("_first") + 1).alias("line"), F.col("_line").alias("text"))
    return read.where("not bad").select(*[f.name for f in fields]), bad


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def _whitespace_fields(spark: SparkSession, paths, n: int) -> DataFrame:
    parts = F.split(F.trim(F.col("value")), r"\s+", -1)
    lines = spark.read.text(paths).where(F.trim(F.col("value")) != "")
    return lines.select(*[F.element_at(parts, i + 1).alias(f"_{i}") for i in range(n)])


def read_qrels(spark: SparkSession, paths: dict[str, str] | str, fmt: str = "msmarco") -> DataFrame:
    """(query_id, iter, doc_id, relevance). ``msmarco``: single-space separated;
    ``trec``: any whitespace. A dict {split: path} adds a ``split`` column."""
    if isinstance(paths, dict):
        parts = [read_qrels(spark, p, fmt).withColumn("split", F.lit(s)) for s, p in paths.items()]
        return reduce(DataFrame.unionByName, parts)
    if fmt == "msmarco":
        return _tsv(spark, QRELS_SCHEMA, paths, sep=" ")
    if fmt == "trec":
        f = _whitespace_fields(spark, paths, 4)
        return f.select(F.col("_0").alias("query_id"), F.col("_1").alias("iter"), F.col("_2").alias("doc_id"),
                        F.col("_3").cast("int").alias("relevance"))
    raise ValueError("fmt must be 'msmarco' or 'trec'")


def read_run(spark: SparkSession, paths, *, id_col: str = "doc_id") -> DataFrame:
    """TREC run: first six whitespace-separated fields
    (query_id, iter, <id_col>, rank INT, score DOUBLE, name)."""
    f = _whitespace_fields(spark, paths, 6)
    return f.select(F.col("_0").alias("query_id"), F.col("_1").alias("iter"), F.col("_2").alias(id_col),
                    F.col("_3").cast("int").alias("rank"), F.col("_4").cast("double").alias("score"),
                    F.col("_5").alias("name"))


def run_lines(run: DataFrame, name: str | None = None, *, id_col: str = "doc_id", digits: int | None = None) -> DataFrame:
    """One TREC line per row: ``query_id \\t 0 \\t id \\t rank \\t score \\t name``
    (column ``line``, plus query_id and rank for ordering). Scores are written
    in full, so that a run read back is the run written, or to ``digits``."""
    label = F.lit(name) if name is not None else F.col("name")
    score = F.col("score").cast("string") if digits is None else F.round("score", digits)
    fmt = "%s\t0\t%s\t%d\t%s\t%s" if digits is None else f"%s\t0\t%s\t%d\t%.{digits}f\t%s"
    return run.select("query_id", "rank", F.format_string(fmt, F.col("query_id"), F.col(id_col), F.col("rank"),
                                                          score, label).alias("line"))


def write_run(run: DataFrame, path: str, name: str | None = None, *, id_col: str = "doc_id",
              digits: int | None = None, mode: str = "errorifexists") -> None:
    """Write a TREC run as text, ordered by query_id then rank: range-partitioned
    on (query_id, rank), so even a query with most of the rows is split over
    several files, then sorted within partitions (no single-task sort)."""
    lines = run_lines(run, name, id_col=id_col, digits=digits)
    (lines.repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank").select("line")
     .write.mode(mode).text(path))


def read_table(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*(path if isinstance(path, (list, tuple)) else [path]))
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by: list[str] | None = None,
                cluster_by: list[str] | None = None, sort_by: list[str] | None = None, buckets: int | None = None) -> None:
    """Write Parquet, plain, in partition folders, or clustered: ``buckets`` files by
    the hash of ``cluster_by`` (default: as many as shuffle partitions), sorted by
    ``sort_by`` inside (default: ``cluster_by``). ``read_clustered`` gives such a
    table back so that joins and aggregates by ``cluster_by`` need no exchange of it."""
    w = df.write.mode(mode)
    if not cluster_by:
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return
    if partition_by:
        raise ValueError("a table is partitioned or clustered")
    spark = df.sparkSession
    if mode == "errorifexists" and _exists(spark, path):
        raise ValueError(f"{path} exists")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order, name = list(sort_by or cluster_by), _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # its name in this session; files stay
    # dealt by the buckets' own hash, so that each bucket is one file
    (df.repartition(n, *cluster_by).write.mode("overwrite" if mode == "errorifexists" else mode).format("parquet")
     .bucketBy(n, *cluster_by).sortBy(*order).option("path", path).saveAsTable(name))
    layout = json.dumps({"buckets": n, "cluster_by": list(cluster_by), "sort_by": order, "schema": df.schema.toDDL()})
    spark.range(1).select(F.lit(layout).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/_layout")


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """A table written with ``cluster_by``, with its layout (from ``_layout`` beside
    the files, so in any session) known to Spark's planner."""
    own = json.loads(spark.read.text(f"{path}/_layout").first()["value"])
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    by, order = (", ".join(f"`{c}`" for c in own[k]) for k in ("cluster_by", "sort_by"))
    spark.sql(f"CREATE TABLE {name} ({own['schema']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) "
              f"INTO {own['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return "rankweave_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_variant(df: DataFrame, base: str, **params) -> None:
    """Write df as the variant ``params`` of the dataset at ``base``: one partition
    (folders ``k=v`` in sorted order) of it. The variant is replaced if it is there,
    others stay."""
    if not params or any(v is None for v in params.values()):
        raise ValueError("a variant needs parameters, none of them null")
    own = df.withColumns({k: F.lit(v) for k, v in params.items()})
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*sorted(params)).parquet(base)


def read_variants(spark: SparkSession, base: str, schema: str, params: str, **selected) -> DataFrame:
    """All variants below ``base`` as one table with their parameters as columns,
    or those with the parameters ``selected`` (only their folders are read). The
    schemas of the rows and of the parameters are given, nothing is inferred."""
    df = spark.read.schema(f"{schema}, {params}").parquet(base)
    for k, v in selected.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def variant_path(base: str, hive: bool = False, **params) -> str:
    """Output folder keyed by parameters: ``k=v`` pairs in sorted order joined
    by ``+`` (one folder), or by ``/`` (Hive-style partition folders)."""
    parts = sorted(f"{k}={v}" for k, v in params.items())
    return base.rstrip("/") + "/" + ("/".join(parts) if hive else "+".join(parts))


def union_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All shard tables as one DataFrame (columns matched by name)."""
    if not paths:
        raise ValueError("no shard paths")
    frames = [spark.read.parquet(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), frames)
