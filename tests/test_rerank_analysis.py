import math

from rankweave.operators import analysis, rerank, search
from rankweave.sources import fixtures as fx
from tests.conftest import SF


def test_maxp_edge(spark):
    run = spark.createDataFrame([("q1", "A_2", 1, 0.9), ("q1", "B_0", 2, 0.8), ("q1", "A_0", 3, 0.7),
                                 ("q2", "A_1", 1, 0.5)], "query_id string, passage_id string, rank int, score double")
    got = sorted((r.query_id, r.doc_id, r.passage_idx, r.rank) for r in rerank.max_p(run).collect())
    assert got == [("q1", "A", 2, 1), ("q1", "B", 0, 2), ("q2", "A", 1, 1)]
    assert rerank.max_p(run, max_queries=1).select("query_id").distinct().count() == 1


def test_maxp_score_is_best_passage(spark):
    run = search.top_k(fx.vec_queries(spark, SF), fx.vec_passages(spark, SF), 50, corpus_id="passage_id",
                       corpus_vec="passage_embedding")
    mp = {(r.query_id, r.doc_id): r.score for r in rerank.max_p(run).collect()}
    best = {}
    for r in run.collect():
        key = (r.query_id, r.passage_id.split("_")[0])
        best[key] = max(best.get(key, -1e9), r.score)
    assert mp == best


def test_sum_mean_brute_force(spark):
    vp = fx.vec_passages(spark, SF)
    vq = fx.vec_queries(spark, SF)
    run = search.top_k(vq, vp, 30, corpus_id="passage_id", corpus_vec="passage_embedding")
    ds = {(r.query_id, r.doc_id): (r.sum_score, r.mean_score, r.n_passages)
          for r in rerank.doc_scores(run, vp, vq).collect()}
    qv = {r.query_id: r.embedding for r in vq.collect()}
    pv = {}
    for r in vp.collect():
        pv.setdefault(r.doc_id, []).append(r.passage_embedding)
    cands = {(r.query_id, r.passage_id.split("_")[0]) for r in run.collect()}
    assert set(ds) == cands
    for (q, d), (s, m, n) in ds.items():
        scores = [sum(a * b for a, b in zip(qv[q], p)) for p in pv[d]]
        assert n == len(scores) and math.isclose(s, sum(scores), abs_tol=1e-9)
        assert math.isclose(m, sum(scores) / len(scores), abs_tol=1e-9)
    # the fallback (query side over the broadcast bound) gives the same table
    ds2 = {(r.query_id, r.doc_id): r.sum_score for r in rerank.doc_scores(run, vp, vq, max_broadcast_queries=2,
                                                                          max_candidate_pairs=1).collect()}
    assert ds2.keys() == ds.keys() and all(math.isclose(ds2[k], ds[k][0], abs_tol=1e-9) for k in ds)
    # pairs over the bound, documents under it: broadcast id filter, then a shuffle join
    ds3 = {(r.query_id, r.doc_id): r.sum_score for r in rerank.doc_scores(run, vp, vq, max_candidate_pairs=1).collect()}
    assert ds3.keys() == ds.keys() and all(math.isclose(ds3[k], ds[k][0], abs_tol=1e-9) for k in ds)
    ds4 = {(r.query_id, r.doc_id): r.sum_score for r in rerank.doc_scores(
        run, vp, vq, max_candidate_pairs=1, max_candidate_docs=1).collect()}
    assert ds4.keys() == ds.keys()


def test_hist_edge(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (9,)], "p int")
    h = [(r.bin, r["count"]) for r in analysis.position_histogram(df, "p", 3).orderBy("bin").collect()]
    assert h == [(0, 3), (1, 0), (2, 1)]


def test_hist_sum_is_rows_and_constant_column(spark):
    df = spark.range(0, 97).selectExpr("id % 13 AS p")
    h = analysis.position_histogram(df, "p", 50).collect()
    assert len(h) == 50 and sum(r["count"] for r in h) == 97
    const = analysis.position_histogram(spark.createDataFrame([(4,), (4,)], "p int"), "p", 2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r["count"]) for r in const] == [(3.5, 4.0, 0), (4.0, 4.5, 2)]


def test_both_branches_of_doc_scores_agree(spark):
    run = spark.createDataFrame([("1", "a_0", 1, 0.5), ("1", "b_0", 2, 0.4), ("2", "a_0", 1, 0.3), ("3", "b_0", 1, 0.1)],
                                "query_id string, passage_id string, rank int, score double")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [0.5, 0.0]), ("b", [3.0, 1.0]), ("b", None), ("c", [1.0, 1.0])],
                                    "doc_id string, passage_embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 2.0])],
                                    "query_id bigint, embedding array<double>")
    rows = [sorted(map(tuple, rerank.doc_scores(run, vectors, queries, **kw).collect()))
            for kw in ({}, {"max_broadcast_queries": 0}, {"max_broadcast_bytes": 1}, {"max_candidate_pairs": 0},
                       {"max_candidate_pairs": 0, "max_candidate_docs": 0})]
    assert rows[0] == [("1", "a", 3.5, 1.75, 2), ("1", "b", 4.0, 4.0, 1), ("3", "b", 2.0, 2.0, 1)]
    assert all(r == rows[0] for r in rows)
    assert rerank.doc_scores(run, vectors, queries.limit(0)).collect() == []


def test_buckets_of_documents_give_the_same_scores(spark):
    """Queries beyond the broadcast bounds: buckets, parts of a document's queries, splits of its passages."""
    vp, vq = fx.vec_passages(spark, SF), fx.vec_queries(spark, SF)
    run = search.top_k(vq, vp, 30, corpus_id="passage_id", corpus_vec="passage_embedding")
    base = {(r.query_id, r.doc_id): r for r in rerank.doc_scores(run, vp, vq).collect()}
    for kw in (dict(bucket_pairs=1), dict(bucket_pairs=3, max_candidate_docs=0), dict(bucket_pairs=10_000)):
        got = {(r.query_id, r.doc_id): r for r in rerank.doc_scores(run, vp, vq, max_broadcast_queries=0, **kw).collect()}
        assert got.keys() == base.keys()
        for key, r in got.items():
            assert r.n_passages == base[key].n_passages
            assert math.isclose(r.sum_score, base[key].sum_score, abs_tol=1e-9)


def test_buckets_move_no_vector_for_each_pair(spark):
    vp, vq = fx.vec_passages(spark, SF), fx.vec_queries(spark, SF)
    run = search.top_k(vq, vp, 30, corpus_id="passage_id", corpus_vec="passage_embedding")
    df = rerank.doc_scores(run, vp, vq, max_broadcast_queries=0, max_candidate_docs=0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_pvec" in line and "_qvec" in line]
    assert not joins and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rerank.doc_scores(run.limit(0), vp, vq, max_broadcast_queries=0).collect() == []


def test_scores_of_hot_documents_stay_bounded(spark, monkeypatch):
    """Every query retrieves every document: products are made some at a time, and
    only sums of a document's neighbouring passages leave the task."""
    import tracemalloc

    import numpy as np

    from rankweave.operators import rerank
    rng = np.random.default_rng(3)
    vecs, qmat, qi = rng.normal(size=(1500, 16)), rng.normal(size=(1500, 16)), np.arange(1500)[::-1]
    tracemalloc.start()
    got = rerank._summed(vecs, qmat, qi)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # all products at once: 288 MB
    assert np.allclose(got, (qmat[qi] @ vecs.T).sum(axis=1))

    passages = [(f"D{i % 3}", rng.normal(size=4).tolist()) for i in range(40)] + [("D1", [1.0, 0.0, 0.0, 0.0])] * 9
    asked = [(f"q{i}", rng.normal(size=4).tolist()) for i in range(11)]
    pv = spark.createDataFrame(passages, "doc_id string, passage_embedding array<double>")
    vq = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    run = spark.createDataFrame([(q, f"D{i}") for q, _ in asked for i in range(3)], "query_id string, doc_id string")
    for products in (rerank.PRODUCTS, 5):
        monkeypatch.setattr(rerank, "PRODUCTS", products)
        ds = {(r.query_id, r.doc_id): (r.sum_score, r.mean_score, r.n_passages)
              for r in rerank.doc_scores(run, pv, vq).collect()}
        assert len(ds) == 33
        for (q, d), (s, m, n) in ds.items():
            scores = [float(np.dot(dict(asked)[q], p)) for e, p in passages if e == d]
            assert n == len(scores) and math.isclose(s, sum(scores), abs_tol=1e-9)
            assert math.isclose(m, s / n, abs_tol=1e-9)
