import numpy as np
import pytest

from rankweave.operators import pooling, search
from rankweave.sources import fixtures as fx
from tests.conftest import SF


def _rows(df, id_col="doc_id"):
    return sorted((r.query_id, r[id_col], r.rank, round(r.score, 9)) for r in df.collect())


def test_topk_edge_ties_and_short_corpus(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.5, 0.0])],
                              "doc_id string, embedding array<float>")
    out = _rows(search.top_k(q, c, 5))
    assert [(r[1], r[2]) for r in out] == [("a", 1), ("b", 2), ("c", 3)]


def _brute(qs, cs, k, metric):
    out = []
    for qid, qv in qs:
        scored = []
        for cid, cv in cs:
            a, b = np.asarray(qv, float), np.asarray(cv, float)
            if metric == "ip":
                s = a @ b
            elif metric == "cosine":
                na, nb = np.linalg.norm(a), np.linalg.norm(b)
                s = (a / (na or 1)) @ (b / (nb or 1))
            else:
                s = -((a - b) ** 2).sum()
            scored.append((-s, cid))
        scored.sort()
        out += [(qid, cid, i + 1, round(-ns, 9)) for i, (ns, cid) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_matches_brute_force(spark, metric):
    rng = np.random.default_rng(7)
    qs = [(f"q{i}", rng.normal(size=6).tolist()) for i in range(5)]
    cs = [(f"d{i:03d}", (rng.normal(size=6) * rng.uniform(0.1, 3)).tolist()) for i in range(300)] + [("zero", [0.0] * 6)]
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>")
    c = spark.createDataFrame(cs, "doc_id string, embedding array<double>").repartition(7)
    got = _rows(search.top_k(q, c, 10, metric))
    assert got == _brute(qs, cs, 10, metric)
    blocks = _rows(search.top_k(q, c, 10, metric, max_broadcast_rows=2))
    assert blocks == got


def test_metrics_give_different_orders(spark):
    vp = fx.vec_passages(spark, SF)
    docs = pooling.pool(vp, "sum")
    q = fx.vec_queries(spark, SF)
    runs = {m: _rows(search.top_k(q, docs, 20, m, corpus_vec="doc_embedding")) for m in ("ip", "cosine", "l2")}
    orders = {m: [(r[0], r[1], r[2]) for r in v] for m, v in runs.items()}
    assert orders["ip"] != orders["cosine"] and orders["ip"] != orders["l2"]


def test_partition_count_does_not_change_result(spark):
    vp = fx.vec_passages(spark, SF)
    q = fx.vec_queries(spark, SF)
    a = _rows(search.top_k(q, vp.repartition(1), 15, corpus_id="passage_id", corpus_vec="passage_embedding"),
              "passage_id")
    b = _rows(search.top_k(q, vp.repartition(13), 15, corpus_id="passage_id", corpus_vec="passage_embedding"),
              "passage_id")
    assert a == b


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_query_blocks_give_the_same_rows_over_many_partitions(spark, metric):
    vp = fx.vec_passages(spark, SF).repartition(9)
    q = fx.vec_queries(spark, SF)
    kw = dict(corpus_id="passage_id", corpus_vec="passage_embedding")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = _rows(search.top_k(q, vp, 7, metric, **kw), "passage_id")
        assert len(a) == 70
        assert _rows(search.top_k(q, vp, 7, metric, max_broadcast_rows=3, **kw), "passage_id") == a
        assert _rows(search.top_k(q, vp, 7, metric, max_broadcast_bytes=1000, **kw), "passage_id") == a
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("dtype", ["float64", "float32"])
def test_equal_vectors_tie_by_id_whatever_the_partitions(spark, metric, dtype):
    rng = np.random.default_rng(5)
    v = rng.normal(size=33)
    cs = [(f"d{i:04d}", v.tolist()) for i in range(997)] + [(f"x{i}", rng.normal(size=33).tolist()) for i in range(50)]
    qs = [(f"q{i}", (v + 0.01 * rng.normal(size=33)).tolist()) for i in range(12)]
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>")
    c = spark.createDataFrame(cs, "doc_id string, embedding array<double>")
    for parts, prune in ((1, None), (7, 0.3), (50, None)):
        got = search.top_k(q, c.repartition(parts), 20, metric, compute_dtype=dtype, prune_fraction=prune).collect()
        for i in range(12):
            assert sorted((r.rank, r.doc_id) for r in got if r.query_id == f"q{i}") == [
                (j + 1, f"d{j:04d}") for j in range(20)]


@pytest.mark.parametrize("dtype", ["float64", "float32"])
def test_near_copies_under_l2(spark, dtype):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64) * 100
    cs = [(f"d{i:04d}", (base + 1e-4 * rng.normal(size=64)).tolist()) for i in range(2000)]
    qs = [(f"q{i}", (base + 1e-4 * rng.normal(size=64)).tolist()) for i in range(8)]
    got = search.top_k(spark.createDataFrame(qs, "query_id string, embedding array<double>"),
                       spark.createDataFrame(cs, "doc_id string, embedding array<double>").repartition(6), 10, "l2",
                       compute_dtype=dtype)
    expect = [(a, b, r) for a, b, r, _ in _brute(qs, cs, 10, "l2")]
    assert sorted((r.query_id, r.doc_id, r.rank) for r in got.collect()) == expect


def test_plan_shape(spark):
    vp = fx.vec_passages(spark, SF)
    run = search.top_k(fx.vec_queries(spark, SF), vp, 10, corpus_id="passage_id", corpus_vec="passage_embedding")
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_bad_arguments(spark):
    q = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>")
    with pytest.raises(ValueError):
        search.top_k(q, q.withColumnRenamed("query_id", "doc_id"), 0)
    with pytest.raises(ValueError):
        search.top_k(q, q.withColumnRenamed("query_id", "doc_id"), 3, "hamming")


def test_pruning_and_tree_reduction_are_exact(spark):
    rng = np.random.default_rng(3)
    qs = [(f"q{i}", rng.normal(size=8).tolist()) for i in range(6)]
    cs = [(f"d{i:04d}", rng.normal(size=8).tolist()) for i in range(3000)] + [("dup", cs_v) for cs_v in []]
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>")
    c = spark.createDataFrame(cs, "doc_id string, embedding array<double>").repartition(6)
    base = _rows(search.top_k(q, c, 25, prune_fraction=None, reduce_buckets=1))
    assert base == _brute(qs, cs, 25, "ip")
    assert _rows(search.top_k(q, c, 25, prune_fraction=0.2, reduce_buckets=1)) == base
    assert _rows(search.top_k(q, c, 25, prune_fraction=None, reduce_buckets=5)) == base
    assert _rows(search.top_k(q, c, 25, "l2", prune_fraction=0.05, reduce_buckets=3)) == _brute(qs, cs, 25, "l2")


def test_pruning_keeps_ties(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    rows = [(f"d{i:03d}", [1.0, 0.0]) for i in range(200)] + [(f"e{i:03d}", [0.5, 0.0]) for i in range(200)]
    c = spark.createDataFrame(rows, "doc_id string, embedding array<double>").repartition(4)
    got = _rows(search.top_k(q, c, 10, prune_fraction=0.5, reduce_buckets=2))
    assert [r[1] for r in got] == [f"d{i:03d}" for i in range(10)]


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_float32_scoring_same_ranking(spark, metric):
    vp = fx.vec_passages(spark, SF)
    q = fx.vec_queries(spark, SF)
    kw = dict(corpus_id="passage_id", corpus_vec="passage_embedding")
    a = [(r[0], r[1], r[2]) for r in _rows(search.top_k(q, vp, 10, metric, **kw), "passage_id")]
    b_rows = _rows(search.top_k(q, vp, 10, metric, compute_dtype="float32", **kw), "passage_id")
    assert [(r[0], r[1], r[2]) for r in b_rows] == a


def test_pruning_float32_is_exact_on_fixture(spark):
    vp = fx.vec_passages(spark, SF)
    q = fx.vec_queries(spark, SF)
    kw = dict(corpus_id="passage_id", corpus_vec="passage_embedding", compute_dtype="float32")
    a = _rows(search.top_k(q, vp, 20, prune_fraction=None, **kw), "passage_id")
    b = _rows(search.top_k(q, vp, 20, prune_fraction=0.3, reduce_buckets=3, **kw), "passage_id")
    assert a == b


def test_auto_pruning_trigger(spark, monkeypatch):
    rng = np.random.default_rng(11)
    qs = [(f"q{i}", rng.normal(size=4).tolist()) for i in range(3)]
    cs = [(f"d{i:04d}", rng.normal(size=4).tolist()) for i in range(4000)]
    q = spark.createDataFrame(qs, "query_id string, embedding array<double>")
    c = spark.createDataFrame(cs, "doc_id string, embedding array<double>").repartition(5)
    base = _rows(search.top_k(q, c, 8, prune_fraction=None))
    monkeypatch.setattr(search, "AUTO_PRUNE_CANDIDATES", 1)
    monkeypatch.setattr(search, "AUTO_PRUNE_FRACTION", 0.1)
    assert _rows(search.top_k(q, c, 8)) == base == _brute(qs, cs, 8, "ip")


def test_grid_reads_each_side_once(spark):
    """More query blocks than one: the corpus lineage runs once, whatever their number."""
    rng = np.random.default_rng(9)
    n = 400
    c = spark.createDataFrame([(f"d{i:03d}", rng.normal(size=5).tolist()) for i in range(n)],
                              "doc_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{i:02d}", rng.normal(size=5).tolist()) for i in range(24)],
                              "query_id string, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    base = _rows(search.top_k(q, c, 6))
    got = _rows(search.top_k(q, c.mapInArrow(count, c.schema), 6, max_broadcast_rows=2))
    assert got == base and seen.value == n


def test_grid_of_small_packs_and_early_lists(spark, monkeypatch):
    monkeypatch.setattr(search, "PACK_ROWS", 16)
    monkeypatch.setattr(search, "MAX_STATE_CANDIDATES", 60)
    vp, q = fx.vec_passages(spark, SF).repartition(5), fx.vec_queries(spark, SF)
    kw = dict(corpus_id="passage_id", corpus_vec="passage_embedding")
    got = _rows(search.top_k(q, vp, 9, "cosine", max_broadcast_rows=3, reduce_buckets=3, **kw), "passage_id")
    monkeypatch.undo()
    assert got == _rows(search.top_k(q, vp, 9, "cosine", **kw), "passage_id")


def test_packs_keep_rows_and_blocks(spark):
    from rankweave.operators.packs import pack, unpack
    df = spark.createDataFrame([(f"r{i}", [float(i)], i // 7) for i in range(100)], "id string, vec array<double>, block int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        plain = pack(df.select("id", "vec").coalesce(1), 30).collect()
        by = pack(df.repartition(3, "block").sortWithinPartitions("block"), 5, by="block").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [p.n for p in plain] == [30, 30, 30, 10]
    assert [i for p in plain for i in unpack(p.data)["id"].to_pylist()] == [f"r{i}" for i in range(100)]
    got = sorted((p.block, i) for p in by for i in unpack(p.data)["id"].to_pylist())
    assert got == sorted((i // 7, f"r{i}") for i in range(100)) and max(p.n for p in by) == 5 and len(by) == 29


def test_packs_of_queries_do_not_shrink_with_the_broadcast_bound(spark, monkeypatch):
    """The grid sends a block of the corpus once for each pack of queries, so a small broadcast
    bound does not make one pack of each query."""
    q, c = fx.vec_queries(spark, SF), fx.vec_docs(spark, SF).limit(60)
    packs, real = {}, search.written

    def count(df, what):
        out = real(df, what)
        packs[what] = out.agg({"n": "max"}).first()[0]
        return out

    want = _rows(search.top_k(q, c, 6))
    monkeypatch.setattr(search, "written", count)
    assert _rows(search.top_k(q.coalesce(1), c, 6, max_broadcast_rows=1)) == want
    assert packs["queries"] > 1
    monkeypatch.setattr(search, "PACK_QUERIES", 2)
    assert _rows(search.top_k(q, c, 6, max_broadcast_rows=1)) == want
    assert packs["queries"] <= 2
