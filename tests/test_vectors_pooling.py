import math

import pytest
from pyspark.sql import functions as F

from rankweave.functions import vectors as V
from rankweave.operators import embed, passages, pooling


def _edge(spark):
    rows = [("d", 0, [3.0, 4.0]), ("d", 1, [0.0, 0.0]), ("d", 2, [1.0, 0.0])]
    return spark.createDataFrame(rows, "doc_id string, passage_idx int, passage_embedding array<float>")


def test_l2_normalize_edge(spark):
    df = _edge(spark).withColumn("n", V.l2_normalize("passage_embedding"))
    got = {r.passage_idx: [round(x, 9) for x in r.n] for r in df.collect()}
    assert got == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [1.0, 0.0]}


@pytest.mark.parametrize("method,expected", [
    ("masked_mean", [2.0, 2.0]), ("mean", [4 / 3, 4 / 3]), ("sum", [4.0, 4.0]), ("max", [3.0, 4.0]),
    ("first", [3.0, 4.0])])
def test_pool_edge(spark, method, expected):
    r = pooling.pool(_edge(spark), method).first()
    assert [round(x, 9) for x in r.doc_embedding] == [round(x, 9) for x in expected]


@pytest.mark.parametrize("method", ["mean", "sum", "max", "first", "masked_mean"])
def test_nested_equals_flat(spark, method):
    df = _edge(spark).union(_edge(spark).withColumn("doc_id", F.lit("e")).where("passage_idx > 0"))
    flat = {r.doc_id: [round(x, 9) for x in r.doc_embedding] for r in pooling.pool(df, method).collect()}
    nested = passages.nest(df, fields=["passage_idx", "passage_embedding"])
    nst = {r.doc_id: [round(x, 9) for x in r.doc_embedding] for r in pooling.pool_nested(nested, method).collect()}
    assert flat == nst


def test_masked_mean_all_padding_has_no_row(spark):
    df = spark.createDataFrame([("z", 0, [0.0, 0.0])], "doc_id string, passage_idx int, passage_embedding array<float>")
    assert pooling.pool(df, "masked_mean").count() == 0
    assert embed.embed_documents(df).count() == 0


def test_mean_times_n_is_sum(spark):
    from tests.conftest import SF
    from rankweave.sources import fixtures as fx
    vp = fx.vec_passages(spark, SF)
    n = vp.groupBy("doc_id").count()
    mean = pooling.pool(vp, "mean").join(n, "doc_id")
    s = pooling.pool(vp, "sum").withColumnRenamed("doc_embedding", "s")
    for r in mean.join(s, "doc_id").collect():
        assert all(math.isclose(a * r["count"], b, abs_tol=1e-9) for a, b in zip(r.doc_embedding, r.s))


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        pooling.pool(_edge(spark), "median")


def test_embed_documents_matches_masked_mean(spark):
    a = {r.doc_id: [round(x, 9) for x in r.doc_embedding] for r in embed.embed_documents(_edge(spark)).collect()}
    assert a == {"d": [2.0, 2.0]}


def test_hashed_encoder_host(spark):
    df = spark.createDataFrame([("q1", "a b a"), ("q2", None)], "query_id string, text string")
    out = {r.query_id: r.embedding for r in embed.embed(df, "text", lambda: embed.hashed_encoder(8), dim=8).collect()}
    assert len(out["q1"]) == 8 and math.isclose(sum(x * x for x in out["q1"]), 1.0, rel_tol=1e-6)
    assert out["q2"] == [0.0] * 8
    with pytest.raises(Exception, match="dimension"):
        embed.embed(df, "text", lambda: embed.hashed_encoder(8), dim=4).collect()


def test_tokenizer_host_and_token_split(spark):
    vocab = {w: i for i, w in enumerate("T a b c d e x y".split())}
    inv = {i: w for w, i in vocab.items()}

    def tok_factory():
        return lambda texts: [None if t is None else [vocab[w] for w in t.split(" ") if w] for t in texts]

    def dec_factory():
        return lambda ids: [" ".join(inv[i] for i in row) for row in ids]

    docs = spark.createDataFrame([("A", "T", "a b c d e"), ("C", None, "x y")], "doc_id string, title string, body string")
    t = embed.tokenize(embed.tokenize(docs, "title", tok_factory, "title_tokens"), "body", tok_factory, "body_tokens")
    assert dict(t.dtypes)["body_tokens"] == "array<int>"
    p = passages.split_token_passages(t, 23, True, margin=20)  # chunk = 23 - 1 - 20 = 2 with a title
    out = embed.detokenize(p, "passage_tokens", dec_factory, "passage_text")
    got = sorted((r.doc_id, r.passage_idx, r.passage_text) for r in out.collect())
    assert got == [("A", 0, "T a b"), ("A", 1, "T c d"), ("A", 2, "T e"), ("C", 0, "x y")]


def test_hosted_functions_get_a_batch_in_pieces(spark):
    """A function's own memory, such as a tokenizer's, follows the piece and not Spark's batch."""
    from rankweave.operators import embed

    def sizes():
        import pyarrow as pa
        return lambda texts: pa.array([texts.nbytes] * len(texts), pa.int64())

    docs = spark.range(0, 600, 1, 1).selectExpr("id", "if(id = 7, null, repeat('ab', 10000 + cast(id as int))) as body")
    seen = embed.map_columns(docs, ["body"], sizes, "seen", "bigint", arrow=True).collect()
    assert [r.id for r in seen] == list(range(600)) and [len(r.body or "") // 2 for r in seen][6:9] == [10006, 0, 10008]
    assert max(r.seen for r in seen) <= embed.PIECE_BYTES  # 600 rows: 12 MB
    long = spark.range(0, 3, 1, 1).selectExpr("id", f"repeat('x', {2 * embed.PIECE_BYTES}) as body")
    assert embed.map_columns(long, ["body"], sizes, "seen", "bigint", arrow=True, drop_inputs=True).count() == 3
