import random

from rankweave.operators.textmatch import contains_join
from rankweave.sources import fixtures as fx
from tests.conftest import SF, SF01


def test_contains_join_brute_force(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a dog"), (3, None), (4, "cat dog cat")],
                                 "doc_id long, text string")
    pats = spark.createDataFrame([(10, "cat"), (11, "dog"), (12, "at s"), (13, "zebra"), (14, "cat")],
                                 "item_id long, text string")
    expected = sorted((d, p) for d, dt in [(1, "the cat sat"), (2, "a dog"), (4, "cat dog cat")]
                      for p, pt in [(10, "cat"), (11, "dog"), (12, "at s"), (13, "zebra"), (14, "cat")] if pt in dt)
    kw = dict(doc_key="doc_id", doc_text="text", pat_key="item_id", pat_text="text")
    got = sorted((r.doc_id, r.item_id) for r in contains_join(docs, pats, **kw).collect())
    assert got == expected


def test_empty_and_null_patterns_follow_contains(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "doc_id long, text string")
    pats = spark.createDataFrame([(10, ""), (11, None), (12, "b")], "item_id long, text string")
    kw = dict(doc_key="doc_id", doc_text="text", pat_key="item_id", pat_text="text")
    expected = [(1, 10), (1, 12), (2, 10)]
    assert sorted((r.doc_id, r.item_id) for r in contains_join(docs, pats, **kw).collect()) == expected


def test_contains_join_random_patterns_over_many_partitions(spark):
    rng = random.Random(4)
    vocab = ["a", "ab", "abc", "", "É😀", "x\ny", "longerword", "b"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(30)))) for i in range(60)] + [(3, "a b"), (None, "ab a")]
    pats = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    pats += [(200 + i, d[1][k:k + n]) for i, (d, k, n) in enumerate(
        (rng.choice(docs), rng.randrange(20), rng.randrange(1, 40)) for _ in range(80))] + [(7, pats[8][1])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = contains_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                            spark.createDataFrame(pats, "item_id long, text string").repartition(3),
                            doc_key="doc_id", doc_text="text", pat_key="item_id", pat_text="text").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = [(d, p) for d, t in docs for p, s in dict.fromkeys(pats) if s in t]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_patterns_in_blocks_and_no_text_leaves_its_row(spark):
    rng = random.Random(8)
    vocab = ["a", "ab", "abc", "", "word", "more"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(20)))) for i in range(80)]
    pats = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 6)))) for i in range(150)]
    kw = dict(doc_key="doc_id", doc_text="text", pat_key="item_id", pat_text="text")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    p = spark.createDataFrame(pats, "item_id long, text string")
    expected = sorted((i, k) for i, t in docs for k, s in pats if s in t)
    for bounds in ({}, dict(max_patterns=20), dict(max_bytes=100)):
        assert sorted((r.doc_id, r.item_id) for r in contains_join(d, p, **kw, **bounds).collect()) == expected
    plan = contains_join(d.where("doc_id >= 0"), p, **kw)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning")


def test_no_patterns_and_string_keys(spark):
    d = spark.createDataFrame([("x", "abc")], "doc_id string, text string")
    p = spark.createDataFrame([("p", "b"), ("q", "")], "item_id string, text string")
    kw = dict(doc_key="doc_id", doc_text="text", pat_key="item_id", pat_text="text")
    assert contains_join(d, p.limit(0), **kw).collect() == []
    assert sorted(map(tuple, contains_join(d, p, **kw).collect())) == [("x", "p"), ("x", "q")]


def test_untitled_documents_are_removed(spark):
    from rankweave.operators import training
    assert 0 < training.removed_docs(fx.untitled_docs(spark, SF01)).count() < 1000


def test_fixture_sizes(spark):
    # measured sizes from FIXTURES.md
    assert fx.docs(spark, SF01).count() == 1000
    assert fx.qrels(spark, SF01).count() == 26
    assert fx.qrels(spark, SF01).where("relevance = 2").count() == 11
    assert fx.vec_queries(spark, SF).count() == 10
    assert fx.vec_qrels(spark, SF).count() == fx.vec_queries(spark, SF).join(
        fx.vec_docs(spark, SF), "label").count() - 10
    assert fx.vec_doc_qrels(spark, SF).count() == 189
    assert fx.vec_passages(spark, SF).count() == 500
