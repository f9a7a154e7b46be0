import os

import pytest

from rankweave.operators import partitioning
from rankweave.sources import files


def test_dense_index(spark):
    df = spark.range(0, 1000).selectExpr("CAST(id * 7 % 1000 AS STRING) AS k").repartition(9)
    rows = partitioning.dense_index(df, "k").collect()
    assert sorted(r.row_idx for r in rows) == list(range(1000))
    assert [r.k for r in sorted(rows, key=lambda r: r.row_idx)] == sorted(r.k for r in rows)


def _balanced(n_rows, n):
    div, mod = divmod(n_rows, n)
    out = []
    for k in range(n):
        start = div * k + min(k, mod)
        out += [k] * (div + (1 if k < mod else 0))
    return out


def _proportional(n_rows, n):
    out = []
    for k in range(n):
        out += [k] * (int((k + 1) / n * n_rows) - int(k / n * n_rows))
    return out


@pytest.mark.parametrize("n_rows,n", [(10, 3), (100, 7), (5, 8), (57, 57)])
def test_shards(spark, n_rows, n):
    df = spark.range(n_rows).selectExpr("id AS k").repartition(3)
    for rule, ref in (("balanced", _balanced), ("proportional", _proportional)):
        got = [r.shard for r in partitioning.contiguous_shard(df, n, "k", rule=rule).orderBy("k").collect()]
        assert got == ref(n_rows, n), rule
    assert partitioning.take_shard(df, n, 0, "k").count() == _balanced(n_rows, n).count(0)


def test_batches(spark):
    df = spark.range(130).selectExpr("id AS k")
    sizes = sorted(r["count"] for r in partitioning.assign_batches(df, 64, "k").groupBy("batch").count().collect())
    assert sizes == [2, 64, 64]


def test_number_packs():
    import numpy as np
    from rankweave.operators.packs import pack_numbers, unpack_numbers
    for columns in ([], [[]], [[5]], [[2**62, -2**62, 7], list(range(9))], [[2**63 - 1, -2**63, 0]], [[0] * 5, [3, -3, 1]]):
        got = unpack_numbers(pack_numbers([np.array(c, np.int64) for c in columns]))
        assert [c.tolist() for c in got] == columns
    assert len(pack_numbers([np.full(10_000, 7), np.arange(10_000) * 9])) < 1000


def test_batches_in_lists(spark, monkeypatch):
    """A row per batch holds what the rows of the batch hold, in order, whatever the parts and
    packs; rows may come twice, and one leading number may have most rows."""
    rows = [(i * i % 7 if i % 3 else 4, -(i * 5 % 11), i % 2, i // 2 % 9) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c int, d long").repartition(3)
    want = sorted(rows)
    monkeypatch.setattr(partitioning, "HELD_ROWS", 50)
    for size, part_rows, pack_rows in ((64, 1 << 20, 1 << 16), (7, 60, 13), (64, 30, 10), (1, 100, 16), (500, 90, 9)):
        monkeypatch.setattr(partitioning, "PACK_ROWS", pack_rows)
        got = partitioning.assign_batches(df, size, ["a", "b", "c", "d"], lists=["d", "b", "a"], part_rows=part_rows)
        assert got.columns == ["batch", "d", "b", "a"]
        got = {r.batch: (r.d, r.b, r.a) for r in got.collect()}
        assert len(got) == -(-400 // size)
        for n, lists in got.items():
            assert list(zip(*lists)) == [(d, b, a) for a, b, c, d in want[n * size:(n + 1) * size]]
    assert partitioning.assign_batches(df.where("a < 0"), 7, "a", lists=["a"]).collect() == []
    with pytest.raises(Exception, match="null among the numbers"):
        partitioning.assign_batches(df.selectExpr("nullif(a, 4) AS a"), 7, "a", lists=["a"]).collect()


def test_run_file_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q1", "d1", 1, 0.5), ("q1", "d2", 2, 0.25), ("q2", "d3", 1, 0.125)],
                                "query_id string, doc_id string, rank int, score double")
    path = str(tmp_path / "run")
    files.write_run(run, path, "myrun", digits=6)
    lines = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert lines.splitlines() == ["q1\t0\td1\t1\t0.500000\tmyrun", "q1\t0\td2\t2\t0.250000\tmyrun",
                                  "q2\t0\td3\t1\t0.125000\tmyrun"]
    back = files.read_run(spark, path).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.rank, r.score, r.name) for r in back] == [
        ("q1", "d1", 1, 0.5, "myrun"), ("q1", "d2", 2, 0.25, "myrun"), ("q2", "d3", 1, 0.125, "myrun")]


def test_text_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('1\twhat is "x\n2\tsecond query\n')
    (tmp_path / "d.tsv").write_text('D1\thttp://a\tTitle\tbody with " quote\nD2\thttp://b\t\tbody two\n')
    (tmp_path / "qrels.txt").write_text("1 0 D1 1\n2 0 D2 1\n")
    (tmp_path / "trec.txt").write_text("1  Q0\tD1   2\n")
    q = files.read_queries(spark, {"dev": str(tmp_path / "q.tsv")}).orderBy("query_id").collect()
    assert [(r.query_id, r.text, r.split) for r in q] == [("1", 'what is "x', "dev"), ("2", "second query", "dev")]
    d = files.read_docs(spark, str(tmp_path / "d.tsv")).orderBy("doc_id").collect()
    assert d[0].body == 'body with " quote' and d[1].title is None
    qr = files.read_qrels(spark, str(tmp_path / "qrels.txt")).orderBy("query_id").collect()
    assert [(r.query_id, r.doc_id, r.relevance) for r in qr] == [("1", "D1", 1), ("2", "D2", 1)]
    tr = files.read_qrels(spark, str(tmp_path / "trec.txt"), fmt="trec").collect()
    assert [(r.query_id, r.iter, r.doc_id, r.relevance) for r in tr] == [("1", "Q0", "D1", 2)]


def test_tables_and_paths(spark, tmp_path):
    p = files.variant_path(str(tmp_path), passage_size=512, tokenization_method="spaces")
    assert p.endswith("/passage_size=512+tokenization_method=spaces")
    assert files.variant_path("/b", True, b=1, a=2) == "/b/a=2/b=1"
    df = spark.range(5).selectExpr("id", "CAST(id AS STRING) AS s")
    files.write_table(df.where("id < 2"), str(tmp_path / "s0"))
    files.write_table(df.where("id >= 2"), str(tmp_path / "s1"))
    u = files.union_shards(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")])
    assert sorted(r.id for r in u.collect()) == list(range(5))
    assert files.read_table(spark, str(tmp_path / "s0"), ["s"]).columns == ["s"]


def test_run_scores_are_written_in_full(spark, tmp_path):
    rows = [("q1", "d1", 1, 0.1 + 0.2), ("q1", "d2", 2, 1e-17 / 3), ("q2", "d1", 1, -123456.7890123456789)]
    run = spark.createDataFrame(rows, "query_id string, doc_id string, rank int, score double")
    files.write_run(run, str(tmp_path / "run"), "full")
    back = files.read_run(spark, str(tmp_path / "run")).select("query_id", "doc_id", "rank", "score")
    assert sorted(map(tuple, back.collect())) == rows
