import math

import pytest

from rankweave.operators import metrics

RUN_SCHEMA = "query_id string, doc_id string, rank int, score double"
QRELS_SCHEMA = "query_id string, doc_id string, relevance int"


def _eval(spark, run, qrels, names=metrics.DEFAULT_METRICS):
    r = spark.createDataFrame(run, RUN_SCHEMA)
    q = spark.createDataFrame(qrels, QRELS_SCHEMA)
    return {row.metric: row.value for row in metrics.evaluate(r, q, list(names)).collect()}


def test_metric_edge(spark):
    run = [("q1", "d2", 1, 3.0), ("q1", "d1", 2, 2.0), ("q1", "d3", 3, 1.0)]
    qrels = [("q1", "d1", 1), ("q1", "d3", 1)]
    ev = _eval(spark, run, qrels)
    assert math.isclose(ev["RR@10"], 0.5)
    assert math.isclose(ev["AP@100"], 7 / 12)
    assert math.isclose(ev["R@1000"], 1.0)
    ndcg = (1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3))
    assert math.isclose(ev["nDCG@10"], ndcg) and abs(ndcg - 0.6934) < 1e-4


def test_metric_missing(spark):
    run = [("q1", "d2", 1, 3.0), ("q1", "d1", 2, 2.0), ("q1", "d3", 3, 1.0), ("q3", "d9", 1, 1.0)]
    qrels = [("q1", "d1", 1), ("q1", "d3", 1), ("q2", "d5", 1)]
    ev = _eval(spark, run, qrels)
    assert math.isclose(ev["RR@10"], 0.25)


def test_perfect_and_empty(spark):
    run = [("q1", "a", 1, 2.0), ("q1", "b", 2, 1.0)]
    assert all(math.isclose(v, 1.0) for v in _eval(spark, run, [("q1", "a", 1), ("q1", "b", 1)]).values())
    assert all(v == 0.0 for v in _eval(spark, run, [("q1", "z", 1)]).values())
    # judgements all 0 -> every metric 0
    assert all(v == 0.0 for v in _eval(spark, run, [("q1", "a", 0)]).values())


def test_first_relevant_at_three(spark):
    run = [("q", "a", 1, 3.0), ("q", "b", 2, 2.0), ("q", "c", 3, 1.0)]
    assert math.isclose(_eval(spark, run, [("q", "c", 1)], ["RR@10"])["RR@10"], 1 / 3)
    assert _eval(spark, run, [("q", "c", 1)], ["RR@2"])["RR@2"] == 0.0


def test_score_order_and_graded_ndcg(spark):
    # ranks in the run are ignored: rows are ranked by score desc, doc_id desc
    run = [("q", "a", 1, 1.0), ("q", "b", 2, 5.0), ("q", "c", 3, 1.0)]
    qrels = [("q", "a", 2), ("q", "c", 1)]
    ev = _eval(spark, run, qrels, ["nDCG@10", "RR@10"])
    # order: b, c, a
    dcg = 1 / math.log2(3) + 2 / math.log2(4)
    idcg = 2 / math.log2(2) + 1 / math.log2(3)
    assert math.isclose(ev["nDCG@10"], dcg / idcg)
    assert math.isclose(ev["RR@10"], 0.5)


def test_report_and_parse(spark):
    r = spark.createDataFrame([("RR@10", 0.123456)], "metric string, value double")
    assert metrics.report(r, percent=True).first().value == 12.35
    assert metrics.report(r).first().value == 0.1235
    with pytest.raises(ValueError):
        metrics.parse_metric("MAP")


def test_loss_edge(spark):
    rows = [(0, [1.0, 0.0], [1.0, 0.0]), (0, [0.0, 1.0], [0.0, 1.0])]
    df = spark.createDataFrame(rows, "batch long, query_embedding array<float>, doc_embedding array<float>")
    out = metrics.in_batch_loss(df).first()
    assert out.n == 2 and math.isclose(out.loss, math.log(1 + math.exp(-1)), rel_tol=1e-9)


def test_duplicate_judgements_count_once(spark):
    run = [("q", "a", 1, 2.0), ("q", "b", 2, 1.0)]
    ev = _eval(spark, run, [("q", "a", 1), ("q", "a", 2), ("q", "b", 0)], ["R@1000", "nDCG@10"])
    assert math.isclose(ev["R@1000"], 1.0) and math.isclose(ev["nDCG@10"], 1.0)


def test_join_paths_agree(spark):
    from rankweave.operators import pooling, search
    from rankweave.sources import fixtures as fx
    from tests.conftest import SF
    run = search.top_k(fx.vec_queries(spark, SF), pooling.pool(fx.vec_passages(spark, SF), "mean"), 50,
                       corpus_vec="doc_embedding")
    qrels = fx.vec_doc_qrels(spark, SF)
    a = {r.metric: r.value for r in metrics.evaluate(run, qrels).collect()}
    b = {r.metric: r.value for r in metrics.evaluate(run, qrels, max_broadcast_judgements=0).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_loss_of_numbered_pairs(spark, monkeypatch):
    """Pairs that hold numbers give the losses of pairs that hold vectors, whatever the cells
    and however Spark's batches cut them; an exchange moves a vector once for each cell."""
    import numpy as np
    rng = np.random.default_rng(5)
    qs = [(i, rng.normal(size=3).tolist()) for i in range(4)]
    ds = [(i, rng.normal(size=3).tolist()) for i in range(9)]
    pairs = [(k // 5, i, j) for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(9) if i != j)]
    q = spark.createDataFrame(qs, "query_no long, query_embedding array<float>")
    d = spark.createDataFrame(ds, "doc_no long, doc_embedding array<float>")
    p = spark.createDataFrame(pairs, "batch long, query_no long, doc_no long").repartition(5)
    want = {r.batch: (r.n, r.loss) for r in metrics.in_batch_loss(p.join(q, "query_no").join(d, "doc_no")).collect()}
    assert len(want) == 7 and want[6][0] == 2
    monkeypatch.setattr(metrics, "LOSS_ROWS", 11)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for cell_bytes, records in ((1 << 20, 10000), (1, 10000), (300, 3), (1 << 20, 4)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            got = metrics.in_batch_loss(p, queries=q, docs=d, cell_bytes=cell_bytes).collect()
            assert len(got) == len(want)
            assert all(r.n == want[r.batch][0] and math.isclose(r.loss, want[r.batch][1], abs_tol=1e-9) for r in got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert metrics.in_batch_loss(p.where("batch < 0"), queries=q, docs=d).collect() == []


def _losses_by_hand(q, d, batches):
    import numpy as np
    out = {}
    for no, rows in batches.items():
        logits = np.array([q[i] for i, _ in rows]) @ np.array([d[j] for _, j in rows]).T
        mx = logits.max(axis=1, keepdims=True)
        lse = mx[:, 0] + np.log(np.exp(logits - mx).sum(axis=1))
        out[no] = (len(rows), float((lse - np.diagonal(logits)).mean()))
    return out


def test_loss_of_listed_pairs(spark):
    """Batches given as lists, of one query, of several, and with rows that come twice, give the
    same losses whatever the ranges of a cell; a vector that no pair has may be null."""
    import numpy as np
    rng = np.random.default_rng(11)
    q, d = rng.normal(size=(6, 4)), rng.normal(size=(40, 4))
    pairs = sorted((i, int(j)) for i in range(6) for j in rng.integers(0, 40, 30 if i else 90))
    batches = {k: pairs[k * 16:k * 16 + 16] for k in range(-(-len(pairs) // 16))}
    batches[99] = [(int(i), int(j)) for i, j in zip(rng.integers(0, 6, 16), rng.integers(0, 40, 16))]
    want = _losses_by_hand(q, d, batches)
    lists = spark.createDataFrame([(k, *map(list, zip(*v))) for k, v in batches.items()],
                                  "batch long, query_no array<long>, doc_no array<long>").repartition(3)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_no long, query_embedding array<double>")
    ds = spark.createDataFrame([*((j, v.tolist()) for j, v in enumerate(d)), (40, None), (41, [1.0])],
                               "doc_no long, doc_embedding array<double>")
    for cell_bytes in (1 << 20, 2000, 1):
        got = metrics.in_batch_loss(lists, queries=qs, docs=ds, cell_bytes=cell_bytes).collect()
        assert len(got) == len(want)
        assert all(r.n == want[r.batch][0] and math.isclose(r.loss, want[r.batch][1], abs_tol=1e-9) for r in got)
    bad = ds.where("doc_no <> 3"), ds.selectExpr("doc_no", "if(doc_no = 3, null, doc_embedding) AS doc_embedding")
    for docs, said in zip(bad, ("not in its table", "null vector")):
        with pytest.raises(Exception, match=said):
            metrics.in_batch_loss(lists, queries=qs, docs=docs).collect()


def test_loss_query_writes_little(spark, tmp_path):
    """Pairs take a byte or two of scratch and exchange files, not tens, and a vector goes to a
    few cells, not to all that have pairs with it; the losses are those of all pairs."""
    import os
    import numpy as np
    from rankweave.plans import catalog
    from rankweave.session import ensure_checkpoint_dir
    rng = np.random.default_rng(3)
    v, labels = rng.normal(size=(6000, 8)).astype(np.float32), rng.integers(0, 4, 6000)
    spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, labels))],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def files():
        shuffled = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [shuffled.apply(i).getPath() for i in range(shuffled.size())]
        kept = ensure_checkpoint_dir(spark).removeprefix("file:")
        found += [f"{at}/{f}" for at, _, names in os.walk(kept) for f in names]
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    before = files()
    got = {r.batch: (r.n, r.loss) for r in catalog.queries()["in_batch_loss"](spark, str(tmp_path)).collect()}
    size = sum(n for f, n in files().items() if f not in before)
    pairs = sorted((f"V{i}", f"D{j}") for i in range(0, 6000, 50) for j in np.flatnonzero(labels == labels[i]) if i != j)
    order = [(int(i[1:]), int(j[1:])) for i, j in pairs]
    want = _losses_by_hand(v.astype(float), v.astype(float), {k: order[k * 64:k * 64 + 64] for k in range(-(-len(order) // 64))})
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and math.isclose(got[k][1], x, abs_tol=2e-6) for k, (n, x) in want.items())
    print(f"{size / len(order):.1f} bytes a pair, {len(order)} pairs")
    assert size < 12 * len(order)
