"""The block index against the plain search, and that it skips blocks."""
import os

import numpy as np
import pytest

from rankweave.operators import block_index, search
from rankweave.sources import fixtures as fx
from tests.conftest import SF


def rows(df, id_col="doc_id"):
    return sorted((r.query_id, r[id_col], r["rank"], r.score) for r in df.collect())


def clustered(spark, n=1500, groups=30, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim)) * 10
    vecs = np.concatenate([centers[i % groups] + rng.normal(size=dim) * 0.3 for i in range(n)]).reshape(n, dim)
    docs = [(f"d{i:05d}", v.tolist()) for i, v in enumerate(vecs)]
    asks = [(f"q{i}", (vecs[i * 7 % n] + rng.normal(size=dim) * 0.1).tolist()) for i in range(20)]
    return (spark.createDataFrame(docs, "doc_id string, embedding array<double>").repartition(5),
            spark.createDataFrame(asks, "query_id string, embedding array<double>"))


@pytest.mark.parametrize("metric", search.METRICS)
def test_clustered_corpus_gives_the_same_rows_and_skips_blocks(spark, tmp_path, metric):
    docs, asks = clustered(spark)
    path = str(tmp_path / "index")
    block_index.build(docs, path, pivots=60)
    visited = []
    got = block_index.search(spark, path, asks, 10, metric, visited=visited)
    assert rows(got) == rows(search.top_k(asks, docs, 10, metric))
    # 20 queries x 1,500 rows; inner product follows the norms, so it skips less
    assert sum(visited) <= 20 * 1500 * (0.75 if metric == "ip" else 0.2)


@pytest.mark.parametrize("metric", search.METRICS)
def test_given_vectors_give_the_same_rows(spark, tmp_path, metric):
    path = str(tmp_path / "index")
    block_index.build(fx.vec_docs(spark, SF), path)
    got = block_index.search(spark, path, fx.vec_queries(spark, SF), 25, metric)
    assert rows(got) == rows(search.top_k(fx.vec_queries(spark, SF), fx.vec_docs(spark, SF), 25, metric))


@pytest.mark.parametrize("metric", search.METRICS)
def test_ties_zeros_copies_and_few_rows(spark, tmp_path, metric):
    docs = [(f"c{i:03d}", [1.0, 2.0, 0.0]) for i in range(300)] + [("zero", [0.0] * 3), ("z2", [0.0] * 3)]
    docs += [(f"s{i}", [float(i), -1.0, 5.0]) for i in range(40)] + [(None, [1.0] * 3), ("none", None)]
    asks = [("a", [1.0, 2.0, 0.0]), ("b", [0.0] * 3), ("c", [-1.0, 0.0, 1.0]), ("a", [1.0, 2.0, 0.0]), ("d", None)]
    d = spark.createDataFrame(docs, "doc_id string, embedding array<double>").repartition(4)
    q = spark.createDataFrame(asks, "query_id string, embedding array<double>")
    path = str(tmp_path / "index")
    block_index.build(d, path)
    for k in (1, 20, 1000):
        assert rows(block_index.search(spark, path, q, k, metric)) == rows(search.top_k(q, d, k, metric))


def test_empty_sides(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id string, embedding array<double>")
    one = spark.createDataFrame([("x", [1.0])], "query_id string, embedding array<double>")
    block_index.build(d, str(tmp_path / "a"))
    assert rows(block_index.search(spark, str(tmp_path / "a"), one, 3)) == []
    block_index.build(one.withColumnRenamed("query_id", "doc_id"), str(tmp_path / "b"))
    assert rows(block_index.search(spark, str(tmp_path / "b"), one.limit(0), 3)) == []
    assert rows(block_index.search(spark, str(tmp_path / "b"), one, 3)) == [("x", "x", 1, 1.0)]


def test_a_block_of_much_of_the_corpus_and_small_packs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(block_index, "BLOCK_PACK", 16)
    monkeypatch.setattr(block_index, "PACK_QUERIES", 3)
    monkeypatch.setattr(block_index, "MAX_STATE_CANDIDATES", 40)
    docs, asks = clustered(spark, n=400, groups=2)
    path = str(tmp_path / "index")
    block_index.build(docs, path, pivots=5)
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.agg({"n": "max"}).first()[0] <= 16 and stored.agg({"n": "sum"}).first()[0] == 400
    assert rows(block_index.search(spark, path, asks, 7, "l2")) == rows(search.top_k(asks, docs, 7, "l2"))


def test_only_the_blocks_of_a_round_are_read(spark, tmp_path):
    docs, _ = clustered(spark)
    path = str(tmp_path / "index")
    block_index.build(docs, path, pivots=40)
    assert len([x for x in os.listdir(f"{path}/rows") if x.startswith("block=")]) >= 25
    plan = block_index._stored(spark, path).where("block in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in plan


def test_bounds_hold(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, q = rng.normal(size=(40, 8)) * rng.uniform(0.1, 50), rng.normal(size=(5, 8))
        c = x.mean(axis=0)[None]
        r, n = np.sqrt(((x - c) ** 2).sum(axis=1)).max()[None], np.sqrt((x * x).sum(axis=1)).max()[None]
        assert (block_index.bounds(q, "ip", c, r, n)[:, 0] >= (q @ x.T).max(axis=1)).all()
        near = -((q[:, None] - x[None]) ** 2).sum(axis=2).min(axis=1)
        assert (block_index.bounds(q, "l2", c, r, n)[:, 0] >= near).all()


def test_bad_dimension(spark, tmp_path):
    docs, _ = clustered(spark, n=50)
    block_index.build(docs, str(tmp_path / "i"))
    q = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    with pytest.raises(Exception, match="dimension"):
        block_index.search(spark, str(tmp_path / "i"), q, 3).collect()
