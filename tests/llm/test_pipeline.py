"""The pipeline against a plain version of its stages, on a small fixture."""
import base64
import hashlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rankweave.llm import bpe, toxicity
from tests.llm.test_free_style import components_of, corpus
from tests.llm.test_native import judged, words_of

rng = random.Random(21)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    base = corpus(260)
    docs = [(i, t, "en", "src", len(t)) for i, t, _, _ in base]
    labels = [(i, 1, y) for i, _, y, _ in base]
    clean = [d for d in docs if d[0] % 4]
    items = [(k, " ".join(f"item{k}w{j}" for j in range(20))) for k in range(5)] + [(9, None)]
    for k in range(40):  # exact and near copies, contaminated documents, nulls
        i, t = rng.choice(clean)[:2]
        words = t.split()
        if k % 3 == 0 and len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        if k % 4 == 0:
            words[3:3] = words_of(items[k % 5][1])[:rng.choice([12, 13, 20])]
        docs.append((1000 + k, " ".join(words), "en", "src", 1))
    docs += [(2000, None, None, None, None), (2001, "", "en", "src", 0), (None, "nobody knows my number", "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3) \
        .write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return sf_dir, docs, items


def test_pipeline_equals_its_plain_version(spark, tables):
    tiktoken = pytest.importorskip("tiktoken")
    sf_dir, docs, items = tables
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    reader = toxicity.Reader(model.measure)
    scores = [model.score(s) for s in reader.sentences([d[1] or "" for d in docs])]
    one = [d for d, s in zip(docs, scores) if s < 0.5]
    assert 0 < len(one) < len(docs)
    two = [d for d, (i, _, c) in zip(one, components_of([d[:3] for d in one], 5, 80)) if i is None or i == c]
    windows = []
    for i, t in items:
        w = words_of(t)
        windows += [(w[k:k + 13], i) for k in range(max(1, len(w) - 12))] if w else []
    three = [d for d in two if not judged(d[1], windows)[4]]
    assert len(three) < len(two) < len(one)
    with open(bpe.vocabulary_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=ranks, special_tokens={})
    expect = []
    for d in three:
        ids = library.encode_ordinary(d[1] or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        expect.append((d[0], len(ids), hashlib.sha256(packed).hexdigest(),
                       hashlib.sha256((d[1] or "").encode()).hexdigest(), ids))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expect))


def test_stages_keep_columns_and_survive_empty_tables(spark, tables):
    sf_dir, _, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_entry_lists_the_queries():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
