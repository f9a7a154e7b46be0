"""Operator 7: approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``prefix`` nearest pivots. Every
vector is indexed: each batch of vectors posts (vector, position) to the
inverted file of each pivot of its prefix. A query reads only the files of its
own prefix; what it adds up there gives the footrule distance of the prefixes
(a pivot missing from one counts as standing behind its end), the nearest
``share`` of the batch (``least`` vectors anyway) are ranked by their Euclidean
distance in double precision, and a task keeps each query's ``k`` best. No tie is
broken before that: all vectors as near by footrule as the last of the share are
candidates, and of equal vectors of a batch only those with the smallest ids,
which alone can be among the k best, take up room. So the corpus stays where it
is read, queries go to it in blocks of about ``block`` rows and at most
``LENGTHS`` lengths (bounded bytes, one pass over the corpus each, results
written), and only k rows for each query and task are shuffled.

Pivots are a bounded sample: of the different vectors of one length, the
``pivots`` first by the hash of their least vec_id (copies count once, as pivots
that are equal tell nothing apart), written as a table over all lengths.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part; a query is compared with vectors of its own length; a row is no
neighbour of rows with its own vec_id; repeated rows of another id count each;
ties go to the smaller vec_id; with fewer than k candidates all are returned;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LENGTHS = 16  # lengths of vectors whose pivots are held together


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).where(
        F.exists("v", lambda x: x != 0))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vectors in the batch."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)  # not cut to the batch, as the offsets are not
    length = np.diff(ends)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield ids[rows], flat[ends[rows][:, None] + np.arange(n)]


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, the nearest first."""
    d = (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class Postings:
    """Inverted files of the pivots over the rows of one matrix."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.prefix = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // self.prefix).astype(np.int32)
        self.places = (by % self.prefix).astype(np.int32)
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=pivots))))
        self.n = n

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of the query's prefix to that of every row."""
        near = np.zeros(self.n)
        for place, pivot in enumerate(query):
            a, b = self.ends[pivot], self.ends[pivot + 1]
            near[self.rows[a:b]] += self.prefix - np.maximum(self.places[a:b], place)
        return self.prefix * (self.prefix + 1) - 2 * near


def first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The rows without those that k rows of smaller ids equal, whichever id is
    the query's own (which may be on several rows)."""
    whole = np.ascontiguousarray(x + 0.0)  # no negative zeros
    _, group = np.unique(whole.view(f"V{whole.shape[1] * whole.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    sizes = np.bincount(group)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[place < k + np.unique(ids, return_counts=True)[1].max(initial=0)])


def candidates(far: np.ndarray, others: np.ndarray, take: int) -> np.ndarray:
    """The ``take`` nearest rows among the others, and all that tie with the last of them."""
    rows = np.flatnonzero(others)
    if take < len(rows):
        far = far[rows]
        rows = rows[far <= np.partition(far, take - 1)[take - 1]]
    return rows


def blocks_of(counts: Iterable, block: int) -> Iterator[tuple[int, int, int, int]]:
    """(least length, largest length, parts, part) of blocks of queries; counts: n,
    queries in order of n. A length of more than ``block`` queries is cut into parts."""
    low = high = None
    held = lengths = 0
    for n, queries in counts:
        if lengths and (held + queries > block or lengths == LENGTHS):
            yield low, high, 1, 0
            held = lengths = 0
        if queries > block:
            of = -(-queries // block)
            yield from ((n, n, of, part) for part in range(of))
            continue
        low, high = n if not lengths else low, n
        held, lengths = held + queries, lengths + 1
    if lengths:
        yield low, high, 1, 0


def different(vectors: DataFrame, most: int) -> DataFrame:
    """n, place, v: at most ``most`` different vectors of each length n. Only
    digests are shuffled to choose them; they are written, so that the join knows
    how few they are."""
    own = vectors.select(F.size("v").alias("n"), F.xxhash64("v").alias("digest"), "vec_id", "v")
    first = Window.partitionBy("n").orderBy(F.xxhash64("least"), "least", "digest")
    chosen = written(own.groupBy("n", "digest").agg(F.min("vec_id").alias("least")).withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= most).drop("least"), "chosen")
    return own.join(chosen, ["n", "digest"]).groupBy("n", "place").agg(F.first("v").alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 256, prefix: int = 64,
           share: float = 0.15, least: int = 100, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance); both frames are vec_id, v."""
    spark = vectors.sparkSession
    sample = written(different(vectors, pivots), "pivots")
    queries = queries.withColumn("n", F.size("v"))
    counts = written(queries.groupBy("n").agg(F.count(F.lit(1)).alias("queries")), "lengths")
    schema = "query_id bigint, vec_id bigint, score double"
    parts = [spark.createDataFrame([], schema)]
    for low, high, of, b in blocks_of(counts.orderBy("n").toLocalIterator(), block):
        own = F.col("n").between(low, high)
        chosen: dict[int, list] = {}
        for r in sample.where(own).orderBy("n", "place").toLocalIterator():
            chosen.setdefault(r["n"], []).append(np.array(r["v"]))
        asked: dict[int, tuple] = {}
        mine = queries.where(own & (F.pmod(F.xxhash64("vec_id"), F.lit(of)) == b))
        got = mine.select("vec_id", "v").orderBy("vec_id").collect()  # about `block` rows
        for n in {len(r["v"]) for r in got} & set(chosen):
            own = [r for r in got if len(r["v"]) == n]
            asked[n] = (np.array([r["vec_id"] for r in own]), np.array([r["v"] for r in own]), np.array(chosen[n]))
        shared = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, best = shared.value, {}
            for batch in batches:
                for ids, x in matrices(batch):
                    if x.shape[1] not in asked:
                        continue
                    names, q, piv = asked[x.shape[1]]
                    take = max(k, least, int(np.ceil(share * len(x))))
                    keep = first_copies(ids, x, k)
                    ids, x = ids[keep], x[keep]
                    files = Postings(prefixes(x, piv, prefix), len(piv))
                    mine = prefixes(q, piv, prefix)
                    for i in range(len(q)):
                        near = candidates(files.footrule(mine[i]), ids != names[i], take)
                        d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                        held = best.get((x.shape[1], i))
                        who = ids[near]
                        if held is not None:
                            d, who = np.concatenate((held[0], d)), np.concatenate((held[1], who))
                        top = np.lexsort((who, d))[:k]
                        best[x.shape[1], i] = d[top], who[top]
            for (n, i), (d, who) in best.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(d), asked[n][0][i], np.int64)), pa.array(who.astype(np.int64)), pa.array(d)],
                    names=["query_id", "vec_id", "score"])

        parts.append(written(vectors.select("vec_id", "v").mapInArrow(run, schema), "neighbours"))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
