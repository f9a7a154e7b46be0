from rankweave.operators import passages
from rankweave.sources import fixtures as fx
from rankweave.streaming.passages import run_available_now, stream_passages
from tests.conftest import SF


def test_stream_equals_batch(spark):
    path = f"{SF}/documents.parquet"
    schema = spark.read.parquet(path).schema
    stream = stream_passages(spark, path, schema, passage_size=400, view=fx.docs_view)
    assert stream.isStreaming
    out = run_available_now(stream)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("doc_id", "passage_idx", "passage_id",
                                                                    "passage_body").collect())
    batch = passages.split_passages(passages.drop_empty(fx.docs(spark, SF)), 400, True, keep=[])
    assert got == sorted(tuple(r) for r in batch.collect())
    assert len(got) == 303  # FIXTURES.md: passages of docs at sf0.001


def test_stream_reads_a_table_of_part_files(spark, tmp_path):
    """A table is a folder of part files as soon as it has more than one task's rows; a neighbour
    with a longer name is not read."""
    from rankweave.plans import catalog
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows.write.parquet(f"{tmp_path}/documents.parquet.old")
    for query in (catalog.q_stream_passages_title, catalog.q_stream_embed_flatten):
        got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
        assert got and got == sorted(tuple(r) for r in query(spark, SF).collect())
