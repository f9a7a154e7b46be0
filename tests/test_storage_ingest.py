"""Clustered tables, variants as partitions, dirty files, encoder batches, replayed streams, several runs."""
import gzip
import os

import numpy as np
import pytest

from rankweave.operators import embed, metrics, passages, pooling, training
from rankweave.sources import files
from rankweave.sources import fixtures as fx
from rankweave.streaming import batches
from rankweave.streaming.passages import stream_passages
from tests.conftest import SF


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-*()0123456789"))


def exchanged(df, what: str) -> bool:
    """Whether an exchange stands above a scan that ``what`` names."""
    lines = plan(df)
    for i, line in enumerate(lines):
        if "Exchange" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                if what in below:
                    return True
    return False


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clustered_tables_are_not_exchanged(spark, tmp_path, no_broadcast):
    vp, path = fx.vec_passages(spark, SF), str(tmp_path / "t")
    files.write_table(vp, path, cluster_by=["doc_id"], sort_by=["doc_id", "passage_idx"], buckets=4)
    back = files.read_clustered(spark, path)
    assert back.dtypes == vp.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, vp.collect()))
    pooled = pooling.pool(back, "mean")
    assert any("Bucketed: true" in x for x in plan(pooled)) and not any("Exchange" in x for x in plan(pooled))
    pairs = training.pairs(fx.vec_queries(spark, SF), fx.vec_doc_qrels(spark, SF), back)
    assert any("Bucketed: true" in x for x in plan(pairs)) and not exchanged(pairs, "Bucketed: true")
    # the same chain over the plain table is exchanged: the check can tell
    files.write_table(vp, str(tmp_path / "plain"))
    plain = files.read_table(spark, str(tmp_path / "plain"))
    assert exchanged(pooling.pool(plain, "mean"), "FileScan parquet")
    key = lambda r: (r.doc_id, [round(x, 9) for x in r.doc_embedding])
    assert sorted(map(key, pooled.collect())) == sorted(map(key, pooling.pool(plain, "mean").collect()))


def test_clustered_tables_are_rewritten_only_when_asked(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, `odd name` string")
    files.write_table(a, path, cluster_by=["k"], buckets=3)
    with pytest.raises(ValueError):
        files.write_table(a, path, cluster_by=["k"], buckets=3)
    files.write_table(a.limit(5), path, mode="overwrite", cluster_by=["k"], buckets=2)
    assert files.read_clustered(spark, path).count() == 5 == files.read_table(spark, path).count()
    with pytest.raises(ValueError):
        files.write_table(a, path, cluster_by=["k"], partition_by=["k"])


def test_variants_are_partitions(spark, tmp_path):
    base = str(tmp_path / "v")
    for k in (1, 2, 10):
        files.write_variant(spark.createDataFrame([(f"r{k}", k)], "id string, x int"), base, size=k, model="m n")
    files.write_variant(spark.createDataFrame([("new", 0)], "id string, x int"), base, size=2, model="m n")
    got = files.read_variants(spark, base, "id STRING, x INT", "model STRING, size INT")
    assert sorted((r.id, r.size, r.model) for r in got.collect()) == [
        ("new", 2, "m n"), ("r1", 1, "m n"), ("r10", 10, "m n")]
    one = files.read_variants(spark, base, "id STRING, x INT", "model STRING, size INT", size=10)
    assert [r.id for r in one.collect()] == ["r10"]
    text = "\n".join(plan(one))
    assert "PartitionFilters: [isnotnull(size" in text and "PushedFilters: []" in text
    with pytest.raises(ValueError):
        files.write_variant(got, base, size=None)


def test_ingest_keeps_bad_lines_with_their_places(spark, tmp_path):
    text = tmp_path / "in"
    text.mkdir()
    good = [f"D{i}\thttp://x/{i}\tt{i}\t{i}" for i in range(50)]
    lines = list(good)
    for at, bad in ((3, "short\tline"), (10, ""), (20, "D9\tu\tt\t5\tmore"), (30, "D8\tu\tt\tnot a number")):
        lines.insert(at, bad)
    with gzip.open(text / "a.tsv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    (text / "b.tsv").write_text("D100\tu\t\t7\r\nD101\tu\tt\t\nbad\n")
    g, b = files.ingest(spark, str(text), str(tmp_path / "out"), "doc_id STRING, url STRING, title STRING, n INT", partitions=4)
    assert sorted(r.n for r in g.collect() if r.n is not None) == sorted([*range(50), 7])
    assert {r.doc_id: (r.title, r.n) for r in g.collect()}["D100"] == (None, 7) and g.count() == 52
    got = sorted((r.file.rsplit("/", 1)[1], r.block_start, r.line, r.text) for r in b.collect())
    assert got == [("a.tsv.gz", 0, 4, "short\tline"), ("a.tsv.gz", 0, 11, ""), ("a.tsv.gz", 0, 21, "D9\tu\tt\t5\tmore"),
                   ("a.tsv.gz", 0, 31, "D8\tu\tt\tnot a number"), ("b.tsv", 0, 3, "bad")]
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:  # one gzip file is one task; what was ingested from it is not
        assert spark.read.text(str(text / "a.tsv.gz")).rdd.getNumPartitions() == 1 < g.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "x.tsv").write_text("")
    g, b = files.ingest(spark, str(empty), str(tmp_path / "out2"))
    assert g.count() == 0 == b.count()


def test_batches_by_length_give_the_same_vectors_and_pad_less(spark):
    rows = [(i, "w " * ((i * 37) % 101) if i % 17 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)

    def factory():
        hashed = embed.hashed_encoder(8)

        def encode(texts):
            width = max(len(t or "") for t in texts)
            padded = np.array([[width - len(t or "")] for t in texts], np.float32)
            return np.hstack((hashed(texts), padded))
        return encode

    def run(**kw):
        out = embed.embed(df, "text", factory, batch_size=8, drop_text=False, **kw).collect()
        assert [r.text for r in out] == [t for _, t in rows]
        return [r.embedding[:8] for r in out], sum(r.embedding[8] for r in out)
    plain, plain_pad = run()
    by, by_pad = run(by_length=True)
    assert by == plain and by_pad < plain_pad / 5


def test_the_profile_reaches_the_stage(spark, monkeypatch):
    df, got = spark.createDataFrame([("a",)], "text string"), {}
    kind = type(df)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, schema, **kw: got.update(kw) or self)
    embed.embed(df, "text", lambda: embed.hashed_encoder(4), profile="gpu")
    assert got == {"profile": "gpu"}


def test_columns_and_arguments_reach_the_function(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "s string, n int, t string")
    out = embed.map_columns(df, ["s", "n"], lambda: lambda s, n, end: [x * k + end for x, k in zip(s, n)], "r", "string",
                            fn_kwargs={"end": "!"}, drop_inputs=True, batch_size=1)
    assert out.columns == ["t", "r"] and sorted(r.r for r in out.collect()) == ["a!", "bb!"]
    with pytest.raises(Exception, match="one value per input"):
        embed.map_columns(df, ["s"], lambda: lambda s: [], "r", "string").collect()


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", f"one two three {i}") for i in range(6)], "doc_id long, title string, body string")
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    docs.where("doc_id < 3").coalesce(1).write.parquet(src)

    def view(d):
        from pyspark.sql import functions as F
        return d.select(F.concat(F.lit("D"), d.doc_id.cast("string")).alias("doc_id"), "title", "body")

    def drain():
        stream = stream_passages(spark, src, docs.schema, passage_size=2, view=view)
        batches.drain(stream, batches.passage_vectors(lambda: embed.hashed_encoder(4), dim=4), out, ckpt)
        return spark.read.parquet(out)

    first = drain()
    assert first.count() == 3 * 2 and first.select("batch_id").distinct().count() == 1
    before = sorted(map(repr, first.collect()))
    again = passages.split_passages(view(spark.read.parquet(src)), 2, True, keep=[])
    batches.write_batch(again, 0, out, batches.passage_vectors(lambda: embed.hashed_encoder(4), dim=4))  # batch 0 replayed
    assert sorted(map(repr, spark.read.parquet(out).collect())) == before
    docs.where("doc_id >= 3").coalesce(1).write.mode("append").parquet(src)
    last = drain()
    assert last.count() == 12 and sorted(r.batch_id for r in last.select("batch_id").distinct().collect()) == [0, 1]
    assert drain().count() == 12
    names = {x for x in os.listdir(out) if x.startswith("batch_id=")}
    assert names == {"batch_id=0", "batch_id=1"}


def test_runs_are_evaluated_by_name(spark):
    run = spark.createDataFrame([("q1", "a", 2.0, "x"), ("q1", "b", 1.0, "x"), ("q1", "b", 2.0, "y"), ("q2", "c", 1.0, "x")],
                                "query_id string, doc_id string, score double, name string")
    qrels = spark.createDataFrame([("q1", "b", 1), ("q2", "c", 1)], "query_id string, doc_id string, relevance int")
    got = {(r.name, r.metric): r.value for r in metrics.evaluate(run, qrels, ["RR@10"], by=["name"]).collect()}
    assert got == {("x", "RR@10"): 0.75, ("y", "RR@10"): 0.5}
    for name in ("x", "y"):
        alone = metrics.evaluate(run.where(run.name == name), qrels, ["RR@10", "AP@100"]).collect()
        assert {r.metric: r.value for r in alone}["RR@10"] == got[name, "RR@10"]
    rows = metrics.per_query(run, qrels, by=["name"])
    assert rows.columns[:2] == ["name", "query_id"] and rows.count() == 4
