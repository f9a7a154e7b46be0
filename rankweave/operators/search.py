"""Exact top-k nearest-neighbour search (inner product, cosine, L2).

Plan shape:

    corpus scan (column-pruned) -> mapInArrow: batch matrix x broadcast query matrix,
    running per-task top-k per query -> Exchange hashpartitioning(query_id)
    -> WindowGroupLimit / Window row_number() -> rank <= k

The corpus is never shuffled or sorted; the shuffle carries at most
``k x Q`` candidate rows per task. The query matrix is collected once with a
row and byte bound checked before it is broadcast.

A query side beyond the bound makes a grid instead, in one job: both sides are
written once to the shared checkpoint folder as packs (one row is a block of
vectors), every pack of queries meets every pack of the corpus, tasks read their
packs from there, and a task keeps k rows for each query it has seen. Nothing of
the query side passes through the driver, and neither lineage runs twice. The
rows are those of the single broadcast.

Scores are exact: the matrix product only admits candidates, with a margin
that bounds its rounding error (that of the expanded L2 distance included);
those few are scored again in double precision, row by row, so that a score
depends on the two vectors alone and equal vectors tie exactly.

Two exact reductions of the shuffle for large corpora:

* threshold pruning (``prune_fraction``): the k-th best score of a query over
  any subset of the corpus is a lower bound of its k-th best over the whole
  corpus. A first top-k over a Bernoulli sample gives one threshold per query;
  the main pass admits only candidates at or above it, so the shuffle carries
  about ``k / fraction`` rows per query instead of ``k`` per task and query.
  Scores being exact, the threshold is a true bound and loses no row.
  On by default when ``Q x k`` is large.
* tree reduction (``reduce_buckets``): candidates are first reduced per
  (query, hash bucket of the id), then per query, so no single task merges the
  candidates of every corpus task for a query. Defaults to one bucket per
  eight cores of the cluster (1 locally, which skips the level).

Ties are broken by the smaller id; ``rank`` starts at 1; with fewer than k
corpus rows a query gets all of them. L2 scores are written as ``-d^2`` so
that larger is always better.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.vectors import list_column_to_matrix, normalize_rows
from rankweave.operators.packs import pack, rows_of_pack, unpack_matrix
from rankweave.session import written

METRICS = ("ip", "cosine", "l2")

# bounds of the broadcast path
MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 256 << 20
MAX_STATE_CANDIDATES = 20_000_000  # k x Q kept per task
SCORE_CELLS = 4_000_000  # batch rows x query chunk scored at once
PACK_QUERIES = 4096  # queries of a pack, at most
PACK_ROWS = 8192  # corpus rows of a pack, at most
AUTO_PRUNE_CANDIDATES = 1_000_000  # Q x k from which the sample threshold pass is on
AUTO_PRUNE_FRACTION = 0.01


class _TopK:
    """Running top-k per query over (query index, score, id) candidates."""

    def __init__(self, k: int, nq: int, floor: np.ndarray | None = None):
        self.k = k
        self.nq = nq
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.limit = max(2 * k * nq, 1 << 20)
        # admission threshold per query: a known lower bound of its k-th best
        # score (from a sample pass), raised to the k-th best kept once the
        # query holds k candidates
        self.floor = np.full(nq, -np.inf) if floor is None else np.asarray(floor, dtype=np.float64)
        self.thr = self.floor.copy()

    def add(self, qidx: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.thr[qidx]
        if not keep.all():
            qidx, scores, ids = qidx[keep], scores[keep], ids[keep]
        if len(qidx) == 0:
            return
        self.parts.append((qidx, scores, ids))
        self.size += len(qidx)
        if self.size > self.limit:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=object)
        q = np.concatenate([p[0] for p in self.parts])
        s = np.concatenate([p[1] for p in self.parts])
        ids = np.concatenate([p[2] for p in self.parts])
        order = np.lexsort((-s, q))
        qs, ss = q[order], s[order]
        if np.any((qs[1:] == qs[:-1]) & (ss[1:] == ss[:-1])):
            # exact score ties inside a query: order them by id (string order)
            _, codes = np.unique(ids, return_inverse=True)
            order = np.lexsort((codes, -s, q))
            qs = q[order]
        pos = np.arange(len(order)) - np.searchsorted(qs, qs, side="left")
        keep = order[pos < self.k]
        q, s, ids = q[keep], s[keep], ids[keep]
        self.parts = [(q, s, ids)]
        self.size = len(q)
        # queries with a full list: their last kept score is the admission threshold
        counts = np.bincount(q, minlength=self.nq)
        last = np.searchsorted(q, np.arange(self.nq), side="right") - 1
        full = counts >= self.k
        self.thr[full] = np.maximum(self.floor[full], s[last[full]])
        return q, s, ids


def _prepare_queries(qmat: np.ndarray, metric: str):
    if metric == "cosine":
        qmat = normalize_rows(qmat)
    return qmat, (qmat * qmat).sum(axis=1)


def _exact(vecs: np.ndarray, qmat: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Scores of (row, query) pairs in double precision, each summed on its own."""
    out = np.empty(len(rows))
    step = max(1, SCORE_CELLS // max(1, vecs.shape[1]))
    for i in range(0, len(rows), step):
        v, q = vecs[rows[i:i + step]], qmat[cols[i:i + step]]
        out[i:i + step] = -((v - q) ** 2).sum(axis=1) if metric == "l2" else (v * q).sum(axis=1)
    return out


def _score_block(ids: pa.Array, vecs: np.ndarray, qmat: np.ndarray, qsq: np.ndarray, metric: str,
                 k: int, state: _TopK, compute_dtype: str = "float64") -> None:
    """Admit every row that can be in the top-k of a query, scored exactly."""
    if metric == "cosine":
        vecs = normalize_rows(vecs)
    vsq = (vecs * vecs).sum(axis=1)
    fast_v, fast_q = vecs.astype(compute_dtype, copy=False), qmat.astype(compute_dtype, copy=False)
    # bound of the rounding error of a score, for each query
    unit = 4 * (vecs.shape[1] + 16) * float(np.finfo(compute_dtype).eps)
    most = float(vsq.max(initial=0.0))
    margin = unit * ((most + qsq) if metric == "l2" else np.sqrt(most * qsq))
    n = len(ids)
    step = max(1, SCORE_CELLS // max(1, n))
    for q0 in range(0, qmat.shape[0], step):
        span = slice(q0, q0 + step)
        s = fast_v @ fast_q[span].T
        if metric == "l2":
            s = 2 * s - vsq.astype(compute_dtype)[:, None] - qsq[span].astype(compute_dtype)[None, :]
        least = state.thr[span] - margin[span]
        if n > k:
            least = np.maximum(least, np.partition(s, n - k, axis=0)[n - k] - 2 * margin[span])
        rows, cols = np.nonzero(s >= least[None, :])
        cols = cols.astype(np.int64) + q0
        if len(rows):  # only admitted ids become Python strings
            hit, at = np.unique(rows, return_inverse=True)
            names = np.asarray(ids.take(pa.array(hit)).to_pylist(), dtype=object)
            state.add(cols, _exact(vecs, qmat, rows, cols, metric), names[at])


def _emit(qids: np.ndarray, state: _TopK, id_name: str):
    q, s, ids = state.reduce()
    schema = pa.schema([("query_id", pa.string()), (id_name, pa.string()), ("score", pa.float64())])
    step = 65536
    for i in range(0, len(q), step):
        yield pa.record_batch([pa.array(qids[q[i:i + step]], pa.string()), pa.array(ids[i:i + step], pa.string()),
                               pa.array(s[i:i + step], pa.float64())], schema=schema)


def _check(k: int, metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
    if k < 1:
        raise ValueError("k must be >= 1")


def _final_rank(cands: DataFrame, k: int, id_name: str, reduce_buckets: int = 1) -> DataFrame:
    order = [F.col("score").desc(), F.col(id_name).asc()]
    if reduce_buckets > 1:
        bucket = F.pmod(F.xxhash64(F.col(id_name)), F.lit(reduce_buckets))
        w1 = Window.partitionBy("query_id", "_b").orderBy(*order)
        cands = (cands.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w1))
                 .where(F.col("_r") <= k).drop("_b", "_r"))
    w = Window.partitionBy("query_id").orderBy(*order)
    return (cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", id_name, F.col("rank").cast("int").alias("rank"), "score"))


def _default_buckets(spark) -> int:
    return max(1, spark.sparkContext.defaultParallelism // 8)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", *,
          query_id: str = "query_id", query_vec: str = "embedding",
          corpus_id: str = "doc_id", corpus_vec: str = "embedding",
          max_broadcast_rows: int = MAX_BROADCAST_ROWS,
          max_broadcast_bytes: int = MAX_BROADCAST_BYTES, prune_fraction: float | str | None = "auto",
          reduce_buckets: int | None = None, seed: int = 17, compute_dtype: str = "float64") -> DataFrame:
    """Top-k corpus rows per query: ``(query_id, <corpus_id>, rank INT, score DOUBLE)``.

    ``compute_dtype="float32"`` finds candidates in single precision (half the
    memory traffic); scores are double precision either way. Rows without an id
    or a vector take no part; repeated query ids count as one query.
    """
    _check(k, metric)
    if compute_dtype not in ("float64", "float32"):
        raise ValueError("compute_dtype must be float64 or float32")
    spark = corpus.sparkSession
    buckets = _default_buckets(spark) if reduce_buckets is None else max(1, reduce_buckets)
    corpus_sel = (corpus.select(F.col(corpus_id).cast("string").alias(corpus_id), F.col(corpus_vec).alias("_vec"))
                  .where(F.col("_vec").isNotNull() & F.col(corpus_id).isNotNull()))
    q = (queries.select(F.col(query_id).cast("string").alias("q"), F.col(query_vec).alias("v"))
         .where(F.col("q").isNotNull() & F.col("v").isNotNull()).groupBy("q").agg(F.min("v").alias("v")))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return _final_rank(spark.createDataFrame([], f"query_id string, {corpus_id} string, score double"), k, corpus_id)
    fits = max(1, min(max_broadcast_bytes // (8 * max(1, size["d"])), MAX_STATE_CANDIDATES // k))
    if size["n"] > min(fits, max(1, max_broadcast_rows)):
        # a pack is as large as a task can hold, not as small as the broadcast's bound in rows:
        # a block of the corpus goes to a task once for each pack of queries
        return _grid_top_k(q, corpus_sel, k, metric, corpus_id, size["d"], min(fits, PACK_QUERIES), buckets,
                           compute_dtype)
    fraction = prune_fraction
    if fraction == "auto":
        fraction = AUTO_PRUNE_FRACTION if size["n"] * k >= AUTO_PRUNE_CANDIDATES else None
    table = q.toArrow()
    qmat = list_column_to_matrix(table.column("v"))
    floor = (_sample_thresholds(spark, table, qmat, corpus_sel, k, metric, corpus_id, float(fraction), seed,
                                compute_dtype) if fraction else None)
    return _broadcast_top_k(spark, table, qmat, corpus_sel, k, metric, corpus_id, floor, buckets, compute_dtype)


class PackedQueries:
    """Packs of queries a task has met, each with its running top-k; the lists
    are handed on early when they hold ``MAX_STATE_CANDIDATES``."""

    def __init__(self, k: int, metric: str, id_name: str, compute_dtype: str = "float64"):
        self.k, self.metric, self.id_name, self.compute_dtype = k, metric, id_name, compute_dtype
        self.met: dict = {}

    def of(self, key, data):
        if key not in self.met:
            t, qmat = unpack_matrix(data)
            floor = t.column("floor").to_numpy() if "floor" in t.column_names else None
            self.met[key] = (np.asarray(t.column(0).to_pylist(), dtype=object), *_prepare_queries(qmat, self.metric),
                             _TopK(self.k, t.num_rows, floor))
        return self.met[key]

    def score(self, key, queries, corpus) -> None:
        _, qmat, qsq, state = self.of(key, queries)
        rows, vecs = unpack_matrix(corpus)
        if vecs.shape[1] != qmat.shape[1]:
            raise ValueError(f"corpus dimension {vecs.shape[1]} != query dimension {qmat.shape[1]}")
        _score_block(rows.column(0).chunk(0), vecs, qmat, qsq, self.metric, self.k, state, self.compute_dtype)

    def emit(self, least: int = 0):
        if sum(state.size for *_, state in self.met.values()) >= least:
            for qids, _, _, state in self.met.values():
                yield from _emit(qids, state, self.id_name)
            self.met = {}


def _grid_top_k(q: DataFrame, corpus_sel: DataFrame, k: int, metric: str, corpus_id: str, dim: int, rows: int,
                buckets: int, compute_dtype: str) -> DataFrame:
    """Every pack of queries against every pack of the corpus, in one job."""
    asked = written(pack(q.select("q", "v"), rows_of_pack(dim, rows)), "queries")
    stored = written(pack(corpus_sel, rows_of_pack(dim, PACK_ROWS)), "corpus")
    # blocks of a stated query set against blocks of the corpus, not rows against rows
    grid = stored.select(F.col("data").alias("corpus")).crossJoin(asked.select("first", F.col("data").alias("queries")))

    def score_cells(batches):
        packs = PackedQueries(k, metric, corpus_id, compute_dtype)
        for b in batches:
            for i in range(b.num_rows):
                packs.score(b.column(1)[i].as_py(), b.column(2)[i].as_buffer(), b.column(0)[i].as_buffer())
                yield from packs.emit(MAX_STATE_CANDIDATES)
        yield from packs.emit()

    cands = grid.select("corpus", "first", "queries").mapInArrow(
        score_cells, f"query_id string, {corpus_id} string, score double")
    return _final_rank(cands, k, corpus_id, buckets)


def _sample_thresholds(spark, table: pa.Table, qmat: np.ndarray, corpus_sel: DataFrame, k: int, metric: str,
                       corpus_id: str, fraction: float, seed: int, compute_dtype: str) -> np.ndarray:
    """Per query, the k-th best score over a Bernoulli sample of the corpus
    (-inf when the sample holds fewer than k rows): a lower bound of the k-th
    best score over the whole corpus, whatever rows the sample holds."""
    sample = _broadcast_top_k(spark, table, qmat, corpus_sel.sample(fraction=fraction, seed=seed), k, metric,
                              corpus_id, None, 1, compute_dtype)
    kth = sample.where(F.col("rank") == k).select("query_id", "score").toArrow()
    by_q = dict(zip(kth.column("query_id").to_pylist(), kth.column("score").to_pylist()))
    return np.array([by_q.get(q, -np.inf) for q in table.column("q").to_pylist()], dtype=np.float64)


def _broadcast_top_k(spark, table: pa.Table, qmat: np.ndarray, corpus_sel: DataFrame, k: int, metric: str,
                     corpus_id: str, floor: np.ndarray | None = None, buckets: int = 1,
                     compute_dtype: str = "float64") -> DataFrame:
    qids = np.asarray(table.column("q").to_pylist(), dtype=object)
    qmat, qsq = _prepare_queries(qmat, metric)
    bc = spark.sparkContext.broadcast((qids, qmat, qsq, floor))

    def score_partition(batches):
        qids_, qmat_, qsq_, floor_ = bc.value
        state = _TopK(k, len(qids_), floor_)
        for b in batches:
            if b.num_rows == 0:
                continue
            vecs = list_column_to_matrix(b.column(1))
            if vecs.shape[1] != qmat_.shape[1]:
                raise ValueError(f"corpus dimension {vecs.shape[1]} != query dimension {qmat_.shape[1]}")
            _score_block(b.column(0), vecs, qmat_, qsq_, metric, k, state, compute_dtype)
        yield from _emit(qids_, state, corpus_id)

    cands = corpus_sel.mapInArrow(score_partition, f"query_id string, {corpus_id} string, score double")
    return _final_rank(cands, k, corpus_id, buckets)
