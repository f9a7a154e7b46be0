"""Exact top-k over a stored index that skips blocks.

``build`` clusters the corpus by the nearest of some sampled pivots and writes it
as one Parquet table partitioned by block (each row a pack of vectors), with one
summary row for each block: rows, centroid, radius, largest norm, and centroid and
radius of the normalised rows. ``search`` visits a query's blocks in the order of a
bound that no row of the block can pass

* L2: distance to the centroid less the radius (triangle inequality),
* inner product: product with the centroid plus the query's norm times the radius,
  and the query's norm times the largest norm,
* cosine: the same over normalised vectors,

and stops when the bound falls under the query's k-th score; a bound equal to it is
visited, so ties are kept. All queries go on together in a few rounds: the first
blocks of each, then ``GROW`` times as many, and so on; a round's blocks are a
partition filter, so others are not read. Scores are those of ``search.top_k``,
row by row in double precision, and so are the rows.

Size: pivots and summaries are bounded (``MAX_PIVOTS``, ``PIVOT_BYTES``) whatever the
corpus; a block that holds much of the corpus is written by as many tasks as its size
asks for (rebalanced by Spark), and no query set passes through the driver. The
corpus frame is read three times while the index is built.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.vectors import list_column_to_matrix, normalize_rows
from rankweave.operators.packs import pack, rows_of_pack, unpack_matrix
from rankweave.operators.search import PACK_QUERIES, PackedQueries, _check, _default_buckets, _final_rank
from rankweave.operators.search import MAX_STATE_CANDIDATES, SCORE_CELLS
from rankweave.session import written

MAX_PIVOTS = 4096
PIVOT_BYTES = 64 << 20
BLOCK_PACK = 2048    # vectors of a stored pack
FIRST, GROW = 4, 16  # blocks of a query in the first round, and how they grow
SLACK = 1e-12        # relative rounding error allowed for in a bound
SUMMARY = ("block int, n bigint, centroid array<double>, radius double, unit_centroid array<double>, "
           "unit_radius double, norm double")
ROWS = "first string, n int, data binary, block int"


def pivot_count(rows: int, dim: int, pivots: int | None = None) -> int:
    """About the square root of the rows, or as many as asked for, within the bounds."""
    return max(1, min(pivots or math.isqrt(rows), MAX_PIVOTS, PIVOT_BYTES // (8 * max(1, dim))))


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    half = (pivots * pivots).sum(axis=1) / 2
    out = np.empty(len(x), np.int32)
    step = max(1, SCORE_CELLS // len(pivots))
    for i in range(0, len(x), step):
        out[i:i + step] = (half - x[i:i + step] @ pivots.T).argmin(axis=1)
    return out


def build(corpus: DataFrame, path: str, *, corpus_id: str = "doc_id", corpus_vec: str = "embedding",
          pivots: int | None = None) -> None:
    """Write the index of corpus below ``path``. Rows without an id or a vector take no part."""
    spark = corpus.sparkSession
    sel = corpus.select(F.col(corpus_id).cast("string").alias("id"), F.col(corpus_vec).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull())
    kind = sel.schema["vec"].dataType.simpleString()
    size = sel.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    dim = size["d"] or 0
    sample = sel.orderBy(F.xxhash64("id"), "id").limit(pivot_count(size["n"], dim, pivots)).toArrow()
    bc = spark.sparkContext.broadcast(np.unique(list_column_to_matrix(sample.column("vec")), axis=0))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(nearest_pivot(list_column_to_matrix(b.column(1)), bc.value))],
                    names=["id", "vec", "block"])

    placed = sel.mapInArrow(place, f"id string, vec {kind}, block int")
    placed = placed.hint("rebalance", "block").sortWithinPartitions("block")
    pack(placed, rows_of_pack(dim, BLOCK_PACK), by="block").write.partitionBy("block").parquet(f"{path}/rows")
    _summaries(spark, path).coalesce(1).write.parquet(f"{path}/blocks")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def _summaries(spark: SparkSession, path: str) -> DataFrame:
    def sums(batches):
        for b in batches:
            out = [(u.sum(axis=0), v.sum(axis=0), float(np.sqrt((v * v).sum(axis=1)).max()))
                   for _, v in map(unpack_matrix, b.column(2)) for u in [normalize_rows(v)]]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([v.tolist() for _, v, _ in out]),
                     pa.array([u.tolist() for u, _, _ in out]), pa.array([n for _, _, n in out])],
                    names=["block", "n", "v", "u", "norm"])

    def of(c):
        return vector_to_array(Summarizer.sum(array_to_vector(F.col(c))))

    own = _stored(spark, path).select("block", "n", "data").mapInArrow(
        _buffers(sums), "block int, n int, v array<double>, u array<double>, norm double")
    totals = written(own.groupBy("block").agg(F.sum("n").alias("n"), of("v").alias("v"), of("u").alias("u"),
                                              F.max("norm").alias("norm")), "block_sums")
    held = totals.toArrow()  # a row for each pivot
    n = held["n"].to_numpy()[:, None]
    centers = {b: i for i, b in enumerate(held["block"].to_pylist())}
    shape = (len(centers), -1)
    bc = totals.sparkSession.sparkContext.broadcast((centers, *(
        (np.array(held[c].to_pylist(), dtype=np.float64).reshape(shape) / n if len(centers) else None) for c in "vu")))

    def radii(batches):
        at, centroid, unit = bc.value
        for b in batches:
            out = []
            for i, (_, v) in enumerate(map(unpack_matrix, b.column(2))):
                k = at[b.column(0)[i].as_py()]
                out.append([float(np.sqrt(((x - c) ** 2).sum(axis=1)).max())
                            for x, c in ((v, centroid[k]), (normalize_rows(v), unit[k]))])
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r) for r in zip(*out))],
                                                 names=["block", "radius", "unit_radius"])

    reach = _stored(spark, path).select("block", "n", "data").mapInArrow(
        _buffers(radii), "block int, radius double, unit_radius double").groupBy("block").agg(
        F.max("radius").alias("radius"), F.max("unit_radius").alias("unit_radius"))
    # the centroids that the radii were measured from, not the same sums divided again
    _, centroid, unit = bc.value
    centers_df = spark.createDataFrame([(b, centroid[i].tolist(), unit[i].tolist()) for b, i in centers.items()],
                                       "block int, centroid array<double>, unit_centroid array<double>")
    return totals.select("block", "n", "norm").join(F.broadcast(centers_df), "block").join(reach, "block").select(
        "block", "n", "centroid", "radius", "unit_centroid", "unit_radius", "norm")


def _buffers(fn):
    """fn with the binary third column as a list of buffers."""
    class Held:
        def __init__(self, b):
            self.b, self.num_rows = b, b.num_rows

        def column(self, i):
            return [x.as_buffer() for x in self.b.column(2)] if i == 2 else self.b.column(i)

    def run(batches):
        yield from fn(Held(b) for b in batches)
    return run


def bounds(q: np.ndarray, metric: str, centroid: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query and block a score that no row of the block can pass. For cosine all
    arguments are those of the normalised vectors."""
    qn, cn = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((centroid * centroid).sum(axis=1))[None, :]
    dots = q @ centroid.T
    if metric == "l2":
        apart = np.sqrt(np.maximum(qn * qn + cn * cn - 2 * dots - SLACK * (qn + cn) ** 2, 0.0))
        return -np.maximum(apart - radius * (1 + SLACK) - SLACK * (qn + cn), 0.0) ** 2
    return np.minimum(dots + qn * radius, qn * norm) + SLACK * qn * (cn + radius + norm)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, metric: str = "ip", *,
           query_id: str = "query_id", query_vec: str = "embedding", id_name: str = "doc_id",
           reduce_buckets: int | None = None, visited: list | None = None) -> DataFrame:
    """Top-k rows of the index at ``path`` for each query, as ``search.top_k`` over its
    corpus: (query_id, <id_name>, rank INT, score DOUBLE). ``visited``, if given, gets the
    number of (query, corpus row) pairs read in each round."""
    _check(k, metric)
    buckets = _default_buckets(spark) if reduce_buckets is None else max(1, reduce_buckets)
    held = spark.read.schema(SUMMARY).parquet(f"{path}/blocks").toArrow()  # a row for each pivot
    empty = spark.createDataFrame([], f"query_id string, {id_name} string, score double")
    q = written(queries.select(F.col(query_id).cast("string").alias("query_id"), F.col(query_vec).alias("v"))
                .where(F.col("query_id").isNotNull() & F.col("v").isNotNull())
                .groupBy("query_id").agg(F.min("v").alias("v")), "queries")
    if not held.num_rows:
        return _final_rank(empty, k, id_name)
    unit = "unit_" if metric == "cosine" else ""
    block = held["block"].to_numpy()
    centroid = np.array(held[f"{unit}centroid"].to_pylist())
    bc = spark.sparkContext.broadcast((block, centroid, held[f"{unit}radius"].to_numpy(),
                                       np.ones(len(block)) if unit else held["norm"].to_numpy()))
    dim, sizes = centroid.shape[1], dict(zip(block.tolist(), held["n"].to_pylist()))
    kind = q.schema["v"].dataType.simpleString()
    best, low, high = None, 0, FIRST
    while low < len(block):
        asked = q.withColumn("floor", F.lit(float("-inf"))) if best is None else q.join(
            best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "query_id", "left").select(
            "query_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        todo = asked.mapInArrow(_choose(bc, metric, low, high), f"query_id string, v {kind}, floor double, block int")
        todo = written(pack(todo.hint("rebalance", "block").sortWithinPartitions("block"),
                            rows_of_pack(dim, min(PACK_QUERIES, max(1, MAX_STATE_CANDIDATES // k))), by="block"), "visits")
        counts = {r["block"]: r["n"] for r in todo.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # one a pivot
        if not counts:
            break
        if visited is not None:
            visited.append(sum(sizes[b] * c for b, c in counts.items()))
        cells = _stored(spark, path).where(F.col("block").isin(sorted(counts))).select(
            "block", F.col("data").alias("corpus")).join(
            todo.select("block", "first", F.col("data").alias("queries")), "block")
        found = cells.select("block", "first", "queries", "corpus").mapInArrow(
            _score_cells(k, metric, id_name), f"query_id string, {id_name} string, score double")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = written(_final_rank(found, k, id_name, buckets), "found")
        low, high = high, high * GROW
    return best if best is not None else _final_rank(empty, k, id_name)


def _choose(bc, metric: str, low: int, high: int):
    """Of each query the blocks at places low to high - 1 in the order of their
    bounds, as far as the bound reaches the query's floor."""
    def run(batches):
        block, centroid, radius, norm = bc.value
        for whole in batches:
            step = max(1, SCORE_CELLS // len(block))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                v = list_column_to_matrix(b.column(1))
                if v.shape[1] != centroid.shape[1]:
                    raise ValueError(f"query dimension {v.shape[1]} != corpus dimension {centroid.shape[1]}")
                bound = bounds(normalize_rows(v) if metric == "cosine" else v, metric, centroid, radius, norm)
                order = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                keep = np.take_along_axis(bound, order, axis=1) >= b.column(2).to_numpy()[:, None]
                rows, places = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in b.columns),
                     pa.array(block[order[rows, places]].astype(np.int32))],
                    names=["query_id", "v", "floor", "block"])
    return run


def _score_cells(k: int, metric: str, id_name: str):
    def run(batches):
        packs = PackedQueries(k, metric, id_name)
        for b in batches:
            for i in range(b.num_rows):
                packs.score((b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_buffer(),
                            b.column(3)[i].as_buffer())
                yield from packs.emit(MAX_STATE_CANDIDATES)
        yield from packs.emit()
    return run
