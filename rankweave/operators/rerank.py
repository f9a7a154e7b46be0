"""Passage run -> document run: MaxP, and Sum/Mean over all passages of each
retrieved document.

``max_p``: per query keep each document's best-ranked passage, renumber the
documents 1..n in that order (the passage's own rank is kept as
``passage_rank``). One shuffle on query_id (none when the run already comes
hash-partitioned by query_id from ``search.top_k``); a run holds at most k
rows per query.

``score_aggregate``: for every distinct (query, document) of the run, score
*all* passages of the document against the query and sum / average. The
candidate documents (at most k per query) filter the passage table with a
broadcast semi-join when their count is under a checked bound (else a
shuffle join); each passage row carries the list of queries that retrieved
its document (as positions), and one ``mapInArrow`` task computes all those dot products
against the broadcast query matrix, ``PRODUCTS`` at a time, and sums them over the
passages of a document that follow one another. No vector is copied per (query,
passage) pair and only (query_id, doc_id, sum, count) rows reach the aggregate.

Queries beyond the broadcast bounds are scored in buckets of documents
(``_bucketed``): a bucket gets each query vector it needs once, as a dictionary,
then its (query, document) pairs, then its passages, and the products are made
inside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.vectors import list_column_to_matrix
from rankweave.operators.passages import split_passage_id
from rankweave.session import written

MAX_CANDIDATE_PAIRS = 2_000_000  # (query, doc) pairs behind the broadcast (doc_id, query list) table
MAX_CANDIDATE_DOCS = 5_000_000  # distinct candidate doc ids broadcast as a semi-join filter
MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 256 << 20
BUCKET_PAIRS = 20_000  # (query, doc) pairs of a bucket, about; bounds its query dictionary
PRODUCTS = 20_000  # products made at once, about
PASSAGE_PARTS = 4  # parts of a bucket's passages, which each get the dictionary
AGGREGATIONS = ("sum", "mean")


def max_p(run: DataFrame, *, passage_id: str = "passage_id", max_queries: int | None = None) -> DataFrame:
    """(query_id, doc_id, passage_idx, passage_rank, rank INT, score) from a passage run."""
    r = run if {"doc_id", "passage_idx"} <= set(run.columns) else split_passage_id(run, passage_id)
    if max_queries is not None:
        r = written(r, "run")  # the search behind it runs once
        first = r.select("query_id").distinct().orderBy("query_id").limit(max_queries)
        r = r.join(first, "query_id", "left_semi")
    r = r.repartition("query_id")
    w_doc = Window.partitionBy("query_id", "doc_id").orderBy(F.col("rank").asc(), F.col("score").desc(),
                                                             F.col("passage_idx").asc())
    best = r.withColumn("_n", F.row_number().over(w_doc)).where(F.col("_n") == 1)
    w_q = Window.partitionBy("query_id").orderBy(F.col("rank").asc(), F.col("doc_id").asc())
    return best.select("query_id", "doc_id", "passage_idx", F.col("rank").cast("int").alias("passage_rank"),
                       F.row_number().over(w_q).cast("int").alias("rank"), F.col("score").cast("double").alias("score"))


def doc_scores(run: DataFrame, passages: DataFrame, queries: DataFrame, *, passage_vec: str = "passage_embedding",
               query_vec: str = "embedding", passage_id: str = "passage_id",
               max_candidate_pairs: int = MAX_CANDIDATE_PAIRS, max_candidate_docs: int = MAX_CANDIDATE_DOCS,
               max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(query_id, doc_id, sum_score, mean_score, n_passages) over all passages of
    each (query, document) pair of the run."""
    spark = run.sparkSession
    r = run if "doc_id" in run.columns else split_passage_id(run, passage_id)
    # queries without an id or a vector score nothing; a repeated id is one query
    q = (queries.select(F.col("query_id").cast("string").alias("query_id"), F.col(query_vec).alias("_qvec"))
         .where(F.col("query_id").isNotNull() & F.col("_qvec").isNotNull())
         .groupBy("query_id").agg(F.min("_qvec").alias("_qvec")))
    # at most Q x k rows; written so the run behind it is computed once for the
    # size checks and the joins
    cand = written(r.select(F.col("query_id").cast("string").alias("query_id"), "doc_id").distinct()
                   .join(q.select("query_id"), "query_id", "left_semi"), "candidates")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qvec")).alias("d")).first()
    pv = passages.select("doc_id", F.col(passage_vec).alias("_pvec")).where(F.col("_pvec").isNotNull())
    if size["n"] <= max_broadcast_queries and size["n"] * (size["d"] or 0) * 8 <= max_broadcast_bytes:
        qt = q.orderBy("query_id").toArrow()
        qids = qt.column("query_id").to_pylist()
        qmat = list_column_to_matrix(qt.column("_qvec"))
        # each candidate document with the positions of the queries that retrieved it
        places = spark.createDataFrame(list(zip(qids, range(len(qids)))), "query_id string, _pos int")
        by_doc = (cand.join(F.broadcast(places), "query_id").groupBy("doc_id")
                  .agg(F.collect_list("_pos").alias("_qpos")))
        # the broadcast table holds one entry per (query, doc) pair: bound that count
        n_pairs = cand.count()
        if n_pairs <= max_candidate_pairs:
            p = pv.join(F.broadcast(by_doc), "doc_id")
        else:
            # too many pairs for the lists: filter the passages in place by the
            # candidate ids when those fit, then shuffle only what is left
            docs = cand.select("doc_id").distinct()
            n_docs = docs.count()
            kept = pv.join(F.broadcast(docs), "doc_id", "left_semi") if n_docs <= max_candidate_docs else pv
            p = kept.join(by_doc, "doc_id")
        bc = spark.sparkContext.broadcast((qids, qmat))

        def score(batches):
            qids_, qmat_ = bc.value
            names = pa.array(qids_, pa.string())
            for b in batches:
                if b.num_rows == 0:
                    continue
                vecs, docs, lists = list_column_to_matrix(b.column(1)), b.column(0), b.column(2)
                cuts = np.flatnonzero(pc.not_equal(docs.slice(1), docs.slice(0, len(docs) - 1)).to_numpy(False)) + 1
                ends, asked = lists.offsets.to_numpy(), lists.values.to_numpy()
                held, n = [], 0
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                    qi = asked[ends[x]:ends[x + 1]]  # the same list in every row of a document
                    held.append((x, y - x, qi, _summed(vecs[x:y], qmat_, qi)))
                    n += len(qi)
                    if n >= PRODUCTS:
                        yield _sums(names, docs, held)
                        held, n = [], 0
                if held:
                    yield _sums(names, docs, held)

        scored = p.select(F.col("doc_id").cast("string").alias("doc_id"), "_pvec", "_qpos").mapInArrow(
            score, "query_id string, doc_id string, score double, n bigint")
    else:
        scored = _bucketed(pv, cand, q, bucket_pairs, max_candidate_docs).withColumn("n", F.lit(1).cast("bigint"))
    sums = scored.groupBy("query_id", "doc_id").agg(F.sum("score").alias("sum_score"), F.sum("n").alias("n_passages"))
    return sums.select("query_id", "doc_id", "sum_score", (F.col("sum_score") / F.col("n_passages")).alias("mean_score"),
                       "n_passages")


def _summed(vecs: np.ndarray, qmat: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """The scores of the queries at ``qi`` with each row, summed over the rows; each
    product is made on its own, ``PRODUCTS`` at a time."""
    out = np.zeros(len(qi))
    for at in range(0, len(qi), PRODUCTS):
        own = qmat[qi[at:at + PRODUCTS]]
        step = max(1, PRODUCTS // max(1, len(own)))
        for i in range(0, len(vecs), step):
            out[at:at + PRODUCTS] += (vecs[i:i + step, None, :] * own[None, :, :]).sum(axis=2).sum(axis=0)
    return out


def _sums(names: pa.Array, docs: pa.Array, held: list) -> pa.RecordBatch:
    """Rows (query_id, doc_id, score, n) of runs of one document's passages, given as
    (first row, rows, places of the queries, their summed scores)."""
    sizes = [len(qi) for _, _, qi, _ in held]
    at, n = (np.repeat(np.array([h[i] for h in held], np.int64), sizes) for i in (0, 1))
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(np.concatenate([h[2] for h in held]))), docs.take(pa.array(at)),
         pa.array(np.concatenate([h[3] for h in held])), pa.array(n)], names=["query_id", "doc_id", "score", "n"])


def _bucketed(pv: DataFrame, cand: DataFrame, q: DataFrame, bucket_pairs: int, max_candidate_docs: int) -> DataFrame:
    """(query_id, doc_id, score) of every passage (doc_id, _pvec) of the pairs cand
    (query_id, doc_id, written) with their queries (query_id, _qvec).

    A cell is a bucket of documents, as many as give each about ``bucket_pairs`` pairs; a
    document with more pairs than that is spread over parts of its queries, and its
    passages go to each of them. A cell's passages are split once more by a hash of the
    vector, so a document that holds much of the corpus is not one task. Cells get the
    query vectors once each, the pairs and the passages in one exchange; a task reads
    them in that order and holds the dictionary and the pairs of one cell only."""
    n_docs = written(cand.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")), "candidate_docs")
    size = n_docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pairs")).first()
    buckets = max(1, -(-size["pairs"] // bucket_pairs))
    if size["docs"] <= max_candidate_docs:  # passages of no candidate stay where they are
        pv = pv.join(F.broadcast(n_docs.select("doc_id")), "doc_id", "left_semi")
    # fewer documents than pairs / bucket_pairs have parts
    several = n_docs.where(F.col("_n") > bucket_pairs).select("doc_id", F.ceil(F.col("_n") / bucket_pairs).alias("_parts"))
    if buckets <= max(MAX_CANDIDATE_DOCS, 1):
        several = F.broadcast(several)
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    splits = F.array(*[F.lit(i) for i in range(PASSAGE_PARTS)])
    doc, query, vec = (F.col(c) for c in ("doc_id", "query_id", "_vec"))
    cand = cand.join(several, "doc_id", "left").select(
        "doc_id", "query_id", bucket.alias("_bucket"), F.pmod(F.xxhash64("query_id", F.lit(7)), parts).alias("_part"))
    pairs = cand.select("_bucket", "_part", F.explode(splits).alias("_split"), doc.cast("string").alias("doc_id"), query)
    asked = cand.select("_bucket", "_part", "query_id").distinct().join(q, "query_id")
    asked = asked.select("_bucket", "_part", F.explode(splits).alias("_split"), "query_id",
                         F.col("_qvec").cast("array<double>").alias("_vec"))
    held = pv.join(several, "doc_id", "left").select(
        bucket.alias("_bucket"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_part"),
        F.pmod(F.xxhash64("_pvec"), F.lit(PASSAGE_PARTS)).cast("int").alias("_split"),
        doc.cast("string").alias("doc_id"), F.col("_pvec").cast("array<double>").alias("_vec"))
    none = F.lit(None)
    cells = (asked.select("_bucket", "_part", "_split", F.lit(0).alias("_kind"), none.cast("string").alias("doc_id"),
                          query, vec)
             .unionByName(pairs.select("_bucket", "_part", "_split", F.lit(1).alias("_kind"), doc, query,
                                       none.cast("array<double>").alias("_vec")))
             .unionByName(held.select("_bucket", "_part", "_split", F.lit(2).alias("_kind"), doc,
                                      none.cast("string").alias("query_id"), vec)))
    cells = cells.repartition("_bucket", "_part", "_split").sortWithinPartitions("_bucket", "_part", "_split", "_kind")
    schema = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])

    def score(batches):
        cell, at, ids, vecs, wanted, matrix = None, {}, [], [], {}, None
        for b in batches:
            kinds = np.stack([b.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((kinds[:, 1:] != kinds[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if cell != tuple(kinds[:3, x]):
                    cell, at, ids, vecs, wanted, matrix = tuple(kinds[:3, x]), {}, [], [], {}, None
                run = b.slice(x, y - x)
                if kinds[3, x] == 0:
                    vecs.append(list_column_to_matrix(run.column(6)))
                    ids += run.column(5).to_pylist()
                elif kinds[3, x] == 1:
                    at = at or {i: k for k, i in enumerate(ids)}
                    for d, i in zip(run.column(4).to_pylist(), run.column(5).to_pylist()):
                        wanted.setdefault(d, []).append(at[i])
                elif wanted:
                    matrix = np.concatenate(vecs) if matrix is None else matrix
                    vectors, docs = list_column_to_matrix(run.column(6)), run.column(4).to_pylist()
                    for rows, qi in products([wanted.get(d, ()) for d in docs]):
                        s = (vectors[rows] * matrix[qi]).sum(axis=1)
                        yield pa.record_batch([pa.array([ids[k] for k in qi], pa.string()),
                                               run.column(4).take(pa.array(rows)), pa.array(s)], schema=schema)

    def products(wanted):
        """(rows, queries) of all products, some passages at a time."""
        rows, queries = [], []
        for i, own in enumerate(wanted):
            rows += [i] * len(own)
            queries += own
            if len(rows) >= PRODUCTS or i == len(wanted) - 1 and rows:
                yield np.array(rows), np.array(queries)
                rows, queries = [], []

    return cells.select("_bucket", "_part", "_split", "_kind", "doc_id", "query_id", "_vec").mapInArrow(
        score, "query_id string, doc_id string, score double")


def score_aggregate(run: DataFrame, passages: DataFrame, queries: DataFrame, how: str = "sum", **kw) -> DataFrame:
    """Document run (query_id, doc_id, rank INT, score) ranked by the sum or the
    mean of the query's scores over all passages of each retrieved document."""
    if how not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {how!r}; use sum or mean")
    ds = doc_scores(run, passages, queries, **kw)
    return rank_docs(ds, f"{how}_score")


def rank_docs(ds: DataFrame, score_col: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col(score_col).desc(), F.col("doc_id").asc())
    return ds.select("query_id", "doc_id", F.row_number().over(w).cast("int").alias("rank"),
                     F.col(score_col).alias("score"))
