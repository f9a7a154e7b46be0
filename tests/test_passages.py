import pytest
from pyspark.sql import functions as F

from rankweave.operators import passages


def _docs(spark):
    rows = [("A", "T", "a b c d e"), ("B", None, "a  b "), ("C", "", "x y"), ("D", "T", None), ("E", "T", "")]
    return spark.createDataFrame(rows, "doc_id string, title string, body string")


def _collect(df):
    return sorted((r.doc_id, r.passage_idx, r.passage_id, r.passage_body) for r in df.collect())


def test_docs_edge_with_filter(spark):
    out = passages.split_passages(passages.drop_empty(_docs(spark)), 2, True, keep=[])
    assert _collect(out) == [
        ("A", 0, "A_0", "T a b"), ("A", 1, "A_1", "T c d"), ("A", 2, "A_2", "T e"),
        ("B", 0, "B_0", "a "), ("B", 1, "B_1", "b "),
        ("C", 0, "C_0", "x y"),
    ]


def test_docs_edge_without_filter(spark):
    out = _collect(passages.split_passages(_docs(spark), 2, True, keep=[]))
    assert [r for r in out if r[0] == "D"] == []
    assert [r for r in out if r[0] == "E"] == [("E", 0, "E_0", "T ")]


def test_no_title_concatenation_gives_body(spark):
    docs = spark.createDataFrame([("X", "t", "w1 w2  w3 w4 w5 "), ("Y", "t", "one")], "doc_id string, title string, body string")
    flat = passages.split_passages(docs, 2, False)
    nested = passages.nest(flat, fields=["passage_idx", "passage_body"])
    joined = nested.select("doc_id", F.array_join(F.transform("passages", lambda p: p["passage_body"]), " ").alias("b"))
    got = {r.doc_id: r.b for r in joined.collect()}
    assert got == {"X": "w1 w2  w3 w4 w5 ", "Y": "one"}


def test_nested_equals_flat(spark):
    docs = _docs(spark)
    flat = _collect(passages.split_passages(docs, 2, True, keep=[]))
    nested = passages.flatten(passages.split_passages(docs, 2, True, keep=[], nested=True))
    assert _collect(nested) == flat


def test_order_edge_numeric_order(spark):
    rows = [("D", i, f"D_{i}", [float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id string, passage_idx int, passage_id string, passage_embedding array<float>")
    n = passages.nest(df, fields=["passage_idx", "passage_embedding"]).first()
    assert [p["passage_idx"] for p in n.passages] == list(range(12))


def test_split_passage_id(spark):
    df = spark.createDataFrame([("D12_3",), ("D7_10",)], "passage_id string")
    got = sorted((r.doc_id, r.passage_idx) for r in passages.split_passage_id(df).collect())
    assert got == [("D12", 3), ("D7", 10)]


def _tok(spark, title_n, body_n):
    title = [f"t{i}" for i in range(title_n)] if title_n is not None else None
    body = [f"b{i}" for i in range(body_n)]
    return spark.createDataFrame([("A", title, body)], "doc_id string, title_tokens array<string>, body_tokens array<string>")


def test_tokens_edge(spark):
    out = passages.split_token_passages(_tok(spark, 60, 200), 128, True, title_cap=50).orderBy("passage_idx").collect()
    assert len(out) == 4  # title cut to 50, chunk 58
    assert out[0].passage_tokens[:50] == [f"t{i}" for i in range(50)]
    assert out[0].passage_tokens[50:] == [f"b{i}" for i in range(58)]
    assert len(out[-1].passage_tokens) == 50 + 200 - 3 * 58


def test_tokens_edge_no_room(spark):
    with pytest.raises(Exception, match="no room for passage text"):
        passages.split_token_passages(_tok(spark, 60, 200), 70, True, title_cap=50).collect()


def test_tokens_edge_no_title(spark):
    out = passages.split_token_passages(_tok(spark, None, 200), 128, True).collect()
    assert len(out) == 2  # chunk 108
    out2 = passages.split_token_passages(_tok(spark, 60, 200), 128, False).collect()
    assert len(out2) == 2 and not any(t.startswith("t") for t in out2[0].passage_tokens)


def test_cap_passages(spark):
    rows = [("D", i) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, passage_idx int")
    assert passages.cap_passages(df, 3).count() == 3
