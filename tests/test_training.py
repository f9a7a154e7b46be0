import pytest

from rankweave.operators import training

QR = "query_id string, doc_id string, relevance int"


def test_roll_edge(spark):
    q = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1), ("q3", "c", 1)], QR)
    out = training.rolled_negatives(q, 2).collect()
    got = {(r.pos, r.neg_no): r.neg for r in out}
    assert [got[(p, 1)] for p in "abc"] == ["c", "a", "b"]
    assert [got[(p, 2)] for p in "abc"] == ["b", "c", "a"]


def test_roll_wraps_more_than_n(spark):
    q = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1)], QR)
    out = {(r.pos, r.neg_no): r.neg for r in training.rolled_negatives(q, 5).collect()}
    assert [out[("a", i)] for i in range(1, 6)] == ["b", "a", "b", "a", "b"]
    assert training.rolled_negatives(q, 5, exclude_positives=True).where("neg = pos").count() == 0


def test_triplet_edge(spark):
    q = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1), ("q3", "c", 1)], QR)
    negs = training.rolled_negatives(q, 2)
    prepared = spark.createDataFrame([(d, f"text {d}") for d in "abc"], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"query {i}") for i in (1, 2, 3)], "query_id string, text string")
    pick = {}
    for e in (1, 2, 3):
        rows = training.triplets(negs, prepared, queries, e, n_negatives=2).where("query_id = 'q1'").collect()
        pick[e] = rows[0].neg
    assert pick == {1: "c", 2: "b", 3: "b"}
    cyc = training.triplets(negs, prepared, queries, 3, n_negatives=2, on_exhaust="cycle").where("query_id = 'q1'")
    assert cyc.first().neg == "c"
    # without n_negatives the count comes from the table
    assert training.triplets(negs, prepared, queries, 3).where("query_id = 'q1'").first().neg == "b"


def test_prepared_edge(spark):
    docs = spark.createDataFrame([("1", "T", "b"), ("2", "T", None), ("3", "", "b"), ("4", "T", "x" * 2000)],
                                 "doc_id string, title string, body string")
    got = {r.doc_id: r.text for r in training.prepare_docs(docs, max_chars=1000).collect()}
    assert got.keys() == {"1", "4"} and got["1"] == "Tb" and len(got["4"]) == 1000
    assert sorted(r.doc_id for r in training.removed_docs(docs).collect()) == ["2", "3"]
    assert training.prepare_docs(docs, prepend_title=False).count() == 4
    qrels = spark.createDataFrame([("q", d, 1) for d in "1234"], QR)
    cleaned = sorted(r.doc_id for r in training.clean_qrels(qrels, training.removed_docs(docs)).collect())
    assert cleaned == ["1", "4"]


def test_pairs_and_unmatched(spark):
    qe = spark.createDataFrame([("q1", [1.0]), ("q2", [2.0]), ("q3", [3.0])], "query_id string, embedding array<float>")
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d9", 1), ("q3", "d1", 0)], QR)
    ps = spark.createDataFrame([("d1", i, [float(i)]) for i in (2, 0, 10, 1)],
                               "doc_id string, passage_idx int, passage_embedding array<float>")
    p = training.pairs(qe, qrels, ps).collect()
    assert len(p) == 1 and p[0].query_id == "q1"
    assert [v[0] for v in p[0].doc_passage_embeddings] == [0.0, 1.0, 2.0, 10.0]
    assert sorted(r.query_id for r in training.unmatched(qe, qrels, ps).collect()) == ["q2", "q3"]


def test_sample_corpus(spark):
    queries = spark.createDataFrame([(f"Q{i}", "t") for i in (1, 2, 10, 3)], "query_id string, text string")
    qrels = spark.createDataFrame([("Q1", "D5", 1), ("Q1", "D2", 1), ("Q10", "D7", 1), ("Q3", "D8", 1),
                                   ("Q2", "D7", 1)], QR)
    docs = spark.createDataFrame([(f"D{i}", "u", "t", "b") for i in range(10)],
                                 "doc_id string, url string, title string, body string")
    sq, sd, sqr = training.sample_corpus(queries, qrels, docs, 2)
    assert sorted(r.query_id for r in sq.collect()) == ["Q1", "Q10"]
    assert sorted(r.doc_id for r in sd.collect()) == ["D2", "D7"]
    assert sorted((r.query_id, r.doc_id) for r in sqr.collect()) == [("Q1", "D2"), ("Q10", "D7"), ("Q2", "D7")]


def test_save_load(spark, tmp_path):
    t = {"docs_prepped": spark.createDataFrame([("a", "x")], "doc_id string, text string")}
    training.save(t, str(tmp_path / "tr"))
    back = training.load(spark, str(tmp_path / "tr"), ["docs_prepped"])
    assert back["docs_prepped"].collect()[0].text == "x"


def test_bad_options(spark):
    with pytest.raises(ValueError):
        training.negative_for_epoch(0, 5)
    with pytest.raises(ValueError):
        training.negative_for_epoch(1, 5, "reset")


def test_wide_negatives(spark):
    q = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 1), ("q3", "c", 1)], QR)
    wide = training.wide_negatives(training.rolled_negatives(q, 2), 2)
    assert wide.columns == ["query_id", "pos", "neg_1", "neg_2"]
    got = {r.pos: (r.neg_1, r.neg_2) for r in wide.collect()}
    assert got == {"a": ("c", "b"), "b": ("a", "c"), "c": ("b", "a")}


def _rolled_plainly(rows, n):
    rows = sorted(rows)
    return sorted((q, d, i, rows[(r - i) % len(rows)][1]) for r, (q, d) in enumerate(rows) for i in range(1, n + 1))


@pytest.mark.parametrize("rows, n", [(1, 3), (2, 5), (7, 50), (100, 3), (100, 40), (100, 250)])
def test_halo_gives_the_rolled_rows(spark, rows, n):
    """Halos over several partitions, larger than a partition, and larger than the table."""
    data = [(f"q{i % 13:02d}", f"d{i:03d}") for i in range(rows)]
    q = spark.createDataFrame([(*r, 1) for r in data], QR).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for bound in (1_000_000, 0):
            got = training.rolled_negatives(q, n, max_halo_rows=bound)
            assert sorted(map(tuple, got.collect())) == _rolled_plainly(data, n)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_halo_in_place_has_no_exchange_after_the_order(spark):
    data = [(f"q{i % 13:02d}", f"d{i:03d}", 1) for i in range(50)]
    q = spark.createDataFrame(data, QR)
    plan = training.rolled_negatives(q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    apart = training.rolled_negatives(q, 5, max_halo_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert apart.count("REPARTITION_BY_NUM") == 1  # the rows and their halos meet once
    assert training.rolled_negatives(q.limit(0), 5).collect() == []


def test_halo_keeps_missing_documents_and_repeated_rows(spark):
    data = [("a", None, 1), ("a", "x", 1), ("a", "x", 1), (None, "y", 1)]
    got = training.rolled_negatives(spark.createDataFrame(data, QR), 2).collect()
    assert len(got) == 8 and sum(r.neg is None for r in got) == 2 and sum(r.pos is None for r in got) == 2


def test_pairs_make_digests_once_for_each_vector(spark):
    """What is made of a document's vectors is made for the document, not for each of its pairs."""
    from pyspark.sql import functions as F
    made = spark.sparkContext.accumulator(0)

    @F.udf("int", useArrow=False)
    def count(m):
        made.add(1)
        return len(m)

    qe = spark.createDataFrame([(f"q{i}", [float(i)]) for i in range(30)], "query_id string, embedding array<float>")
    qrels = spark.createDataFrame([(f"q{i}", f"d{j}", 1) for i in range(30) for j in range(4)], QR)
    ps = spark.createDataFrame([(f"d{j}", i, [float(i)]) for j in range(3) for i in range(j + 1)],
                               "doc_id string, passage_idx int, passage_embedding array<float>")
    p = training.pairs(qe, qrels, ps, query_cols={"first": F.element_at("query_embedding", 1)},
                       doc_cols={"n": count("doc_passage_embeddings")})
    assert p.columns == ["query_id", "doc_id", "first", "n"]
    got = sorted(tuple(r) for r in p.collect())
    assert got == sorted((f"q{i}", f"d{j}", float(i), j + 1) for i in range(30) for j in range(3))
    assert 3 <= made.value <= 6
