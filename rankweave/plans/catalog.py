"""Query catalogue: every operator as a named query over the driver tables,
with an equivalent DuckDB SQL oracle (same column names and types).

Floats are rounded to 6 decimals in both (4 for checksums); every ranking has
a deterministic tie-break (score desc, id asc); vectors are compared
exploded to (id, dim, value) rows.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.defaults import FIRST_POSITIONS, HISTOGRAM_BINS, LOSS_BATCH, N_NEGATIVES, SAMPLE_QUERIES
from rankweave.operators import (analysis, block_index, embed, metrics, partitioning, passages, pooling, rerank, search,
                                 training)
from rankweave.sources import files
from rankweave.sources import fixtures as fx

TAB = "\t"
K_DOCS = 20          # top-k of the document searches
K_VECTORS = 10       # top-k over all vectors
K_DEEP = 1000        # depth of the run behind R@1000
DEEP_PASSAGE_SIZE = 50  # words per passage of that run
K_PASSAGES = 100     # depth of the passage run behind MaxP / Sum / Mean
PASSAGE_SIZE = 400   # words per passage in the text queries
TOKEN_PASSAGE_SIZE = 128
CODE_POINTS = 1024   # tokens of a passage where every code point is a token
EMBED_DIM = 64
MAX_BROADCAST_IDS = 2_000_000  # numbered ids that a join broadcasts
RUN_NAME = "rankweave-ip"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def exploded(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "value")).select(
        id_col, F.col("dim").cast("int").alias("dim"), r6(F.col("value").cast("double")).alias("value"))


def ranked(run: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return run.select("query_id", id_col, F.col("rank").cast("int").alias("rank"), r6("score").alias("score"))


# ---------------------------------------------------------------- Spark side

def _docs(s, d):
    return fx.docs(s, d)


def q_passages_spaces(s, d, title=False):
    return passages.split_passages(passages.drop_empty(_docs(s, d)), PASSAGE_SIZE, title, keep=[])


def q_passages_spaces_title(s, d):
    return q_passages_spaces(s, d, True)


def _token_docs(s, d):
    docs = passages.drop_empty(_docs(s, d))
    title_ok = F.col("title").isNotNull() & (F.col("title") != "")
    return docs.select("doc_id", F.when(title_ok, F.split("title", " ", -1)).alias("title_tokens"),
                       F.split("body", " ", -1).alias("body_tokens"))


def q_passages_tokens_title(s, d):
    p = passages.split_token_passages(_token_docs(s, d), TOKEN_PASSAGE_SIZE, True)
    return p.select("doc_id", "passage_idx", "passage_id", F.size("passage_tokens").cast("int").alias("n_tokens"),
                    F.array_join("passage_tokens", " ").alias("passage_text"))


def q_passages_nest_roundtrip(s, d):
    flat = q_passages_spaces_title(s, d)
    nested = passages.nest(flat, fields=["passage_idx", "passage_id", "passage_body"])
    return passages.flatten(nested).select("doc_id", "passage_idx", "passage_id", "passage_body")


def q_passages_capped(s, d):
    return passages.cap_passages(fx.vec_passages(s, d), 16).select("doc_id", "passage_idx", "passage_id")


def _pool(method):
    def q(s, d):
        return exploded(pooling.pool(fx.vec_passages(s, d), method), "doc_id", "doc_embedding")
    return q


def q_pool_nested_mean(s, d):
    vp = fx.vec_passages(s, d)
    nested = passages.nest(vp, fields=["passage_idx", "passage_embedding"])
    return exploded(pooling.pool_nested(nested, "mean"), "doc_id", "doc_embedding")


def q_embed_documents_masked_mean(s, d):
    return exploded(embed.embed_documents(fx.vec_passages(s, d)), "doc_id", "doc_embedding")


def _sum_pooled(s, d):
    return pooling.pool(fx.vec_passages(s, d), "sum")


def q_l2_normalize(s, d):
    return exploded(pooling.l2_normalize(_sum_pooled(s, d)), "doc_id", "norm_embedding")


def _topk(metric, **bounds):
    def q(s, d):
        run = search.top_k(fx.vec_queries(s, d), _sum_pooled(s, d), K_DOCS, metric, corpus_id="doc_id",
                           corpus_vec="doc_embedding", **bounds)
        return ranked(run)
    return q


def _vector_topk(metric, **bounds):
    """The search over every vector as a document."""
    def q(s, d):
        return ranked(search.top_k(fx.vec_queries(s, d), fx.vec_docs(s, d), K_VECTORS, metric, **bounds))
    return q


def q_topk_index(s, d):
    """One block index over every vector, searched by each metric."""
    path, queries = _scratch(s), fx.vec_queries(s, d)
    block_index.build(fx.vec_docs(s, d), path)
    runs = [ranked(block_index.search(s, path, queries, K_VECTORS, m)).withColumn("metric", F.lit(m))
            for m in search.METRICS]
    return reduce(DataFrame.unionByName, runs)


def _passage_run(s, d, k):
    return search.top_k(fx.vec_queries(s, d), fx.vec_passages(s, d), k, "ip", corpus_id="passage_id",
                        corpus_vec="passage_embedding")


def q_topk_passages(s, d):
    return ranked(_passage_run(s, d, K_DOCS), "passage_id")


def q_rerank_max(s, d):
    mp = rerank.max_p(_passage_run(s, d, K_PASSAGES))
    return mp.select("query_id", "doc_id", "passage_idx", "passage_rank", "rank", r6("score").alias("score"))


def _rerank(how):
    def q(s, d):
        run = rerank.score_aggregate(_passage_run(s, d, K_PASSAGES), fx.vec_passages(s, d), fx.vec_queries(s, d), how)
        return ranked(run)
    return q


def q_rerank_sum_buckets(s, d):
    run = rerank.score_aggregate(_passage_run(s, d, K_PASSAGES), fx.vec_passages(s, d), fx.vec_queries(s, d), "sum",
                                 max_broadcast_queries=0, max_candidate_pairs=0, max_candidate_docs=0, bucket_pairs=25)
    return ranked(run)


def _histogram(bins, first=None):
    def q(s, d):
        mp = rerank.max_p(_passage_run(s, d, K_PASSAGES))
        where = F.col("passage_idx") < first if first is not None else None
        h = analysis.position_histogram(mp, "passage_idx", bins, where=where)
        return h.select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "count")
    return q


def _doc_run(s, d):
    return search.top_k(fx.vec_queries(s, d), pooling.pool(fx.vec_passages(s, d), "mean"), K_PASSAGES, "ip",
                        corpus_id="doc_id", corpus_vec="doc_embedding")


def q_eval_per_query(s, d):
    pq = metrics.per_query(_doc_run(s, d), fx.vec_doc_qrels(s, d))
    return pq.select("query_id", *[r6(c).alias(c) for c in pq.columns if c != "query_id"])


def _eval(metric_names, run_fn=_doc_run):
    def q(s, d):
        ev = metrics.evaluate(run_fn(s, d), fx.vec_doc_qrels(s, d), list(metric_names))
        return ev.select("metric", r6("value").alias("value"))
    return q


def _maxp_run(s, d):
    return rerank.max_p(_passage_run(s, d, K_PASSAGES)).select("query_id", "doc_id", "rank", "score")


def q_training_pairs(s, d):
    dpe = F.col("doc_passage_embeddings")
    zero = F.lit(0.0).cast("double")
    weighted = F.aggregate(F.transform(dpe, lambda v, i: F.aggregate(
        F.transform(v, lambda x, j: x.cast("double") * (j + 1)), zero, lambda a, b: a + b) * (i + 1)),
        zero, lambda a, b: a + b)
    qsum = F.aggregate(F.transform("query_embedding", lambda x, j: x.cast("double") * (j + 1)), zero,
                       lambda a, b: a + b)
    p = training.pairs(fx.vec_queries(s, d), fx.vec_doc_qrels(s, d), fx.vec_passages(s, d),
                       query_cols={"query_checksum": r6(qsum)},
                       doc_cols={"n_passages": F.size(dpe).cast("int"), "checksum": F.round(weighted, 4)})
    return p.select("query_id", "doc_id", "n_passages", "checksum", "query_checksum")


def _text_query_vecs(s, d):
    return embed.embed(fx.queries(s, d), "text", lambda: embed.hashed_encoder(EMBED_DIM), dim=EMBED_DIM)


def q_training_unmatched(s, d):
    docs = _docs(s, d)
    p = passages.split_passages(passages.drop_empty(docs), PASSAGE_SIZE, True, keep=[])
    return training.unmatched(_text_query_vecs(s, d), fx.qrels(s, d), p)


def q_prepared_docs(s, d):
    return training.prepare_docs(_docs(s, d))


def _clean_qrels(s, d):
    docs = _docs(s, d)
    return training.clean_qrels(fx.qrels(s, d), training.removed_docs(docs))


def q_clean_qrels(s, d):
    return _clean_qrels(s, d).select("query_id", "doc_id", "relevance")


def q_clean_qrels_untitled(s, d):
    removed = training.removed_docs(fx.untitled_docs(s, d))
    return training.clean_qrels(fx.qrels(s, d), removed).select("query_id", "doc_id", "relevance")


def q_prepared_docs_untitled(s, d):
    return training.prepare_docs(fx.untitled_docs(s, d))


def q_prepared_docs_body_only(s, d):
    return training.prepare_docs(fx.untitled_docs(s, d), prepend_title=False)


def q_sample_corpus_docs(s, d):
    _, kd, _ = training.sample_corpus(fx.queries(s, d), fx.qrels(s, d), _docs(s, d), SAMPLE_QUERIES)
    return kd.select("doc_id", "url", "title", "body")


def q_sample_corpus_qrels(s, d):
    _, _, kq = training.sample_corpus(fx.queries(s, d), fx.qrels(s, d), _docs(s, d), SAMPLE_QUERIES)
    return kq.select("query_id", "doc_id", "relevance")


def _negatives(s, d):
    return training.rolled_negatives(_clean_qrels(s, d), N_NEGATIVES)


def q_rolled_negatives(s, d):
    return _negatives(s, d)


def _triplets(epoch):
    def q(s, d):
        return training.triplets(_negatives(s, d), training.prepare_docs(_docs(s, d)), fx.queries(s, d), epoch,
                                 n_negatives=N_NEGATIVES)
    return q


def _numbered(vecs, id_col):
    """The vectors with a number of their own in the order of ``id_col``; the ids with it and
    the number at which they begin; and how many there are."""
    df, n = partitioning.indexed_with_count(vecs, id_col, out_col="no")
    first = df.groupBy(id_col).agg(F.min("no").alias("first"))
    return df, df.select(id_col, "no").join(first, id_col), n


def q_in_batch_loss(s, d):
    """The pairs are ordered and batched as numbers, a row per batch; the vectors meet whole batches."""
    sides = {"query": fx.vec_queries(s, d), "doc": fx.vec_docs(s, d)}
    pairs, vecs = fx.vec_qrels(s, d), {}
    for side, df in sides.items():
        own, numbers, n = _numbered(df.select(f"{side}_id", F.col("embedding").alias(f"{side}_embedding")), f"{side}_id")
        vecs[side] = own.select(F.col("no").alias(f"{side}_no"), f"{side}_embedding")
        numbers = numbers.select(f"{side}_id", F.col("no").alias(f"{side}_no"), F.col("first").alias(f"{side}_first"))
        pairs = pairs.join(F.broadcast(numbers) if n <= MAX_BROADCAST_IDS else numbers, f"{side}_id")
    # the order of (query_id, doc_id)
    order = ["query_first", "doc_first", "query_no", "doc_no"]
    batched = partitioning.assign_batches(pairs.select(*order), LOSS_BATCH, order, lists=["query_no", "doc_no"])
    loss = metrics.in_batch_loss(batched, queries=vecs["query"], docs=vecs["doc"])
    return loss.select("batch", "n", r6("loss").alias("loss"))


def q_run_trec_lines(s, d):
    run = search.top_k(fx.vec_queries(s, d), _sum_pooled(s, d), K_DOCS, "ip", corpus_id="doc_id",
                       corpus_vec="doc_embedding")
    return files.run_lines(run, RUN_NAME, digits=6).select("line")


def q_contiguous_shards(s, d):
    return partitioning.contiguous_shard(_docs(s, d).select("doc_id"), 3, "doc_id", rule="balanced")


def q_contiguous_shards_proportional(s, d):
    return partitioning.contiguous_shard(_docs(s, d).select("doc_id"), 7, "doc_id", rule="proportional")


def q_embed_hashed_queries(s, d):
    e = exploded(_text_query_vecs(s, d), "query_id", "embedding")
    return e.where(F.col("value") != 0)


def _text_passage_vecs(s, d):
    p = passages.split_passages(passages.drop_empty(_docs(s, d)), PASSAGE_SIZE, True, keep=[])
    return embed.embed(p, "passage_body", lambda: embed.hashed_encoder(EMBED_DIM), out_col="passage_embedding",
                       dim=EMBED_DIM, partitions=s.sparkContext.defaultParallelism)


def _text_passage_run(s, d):
    return search.top_k(_text_query_vecs(s, d), _text_passage_vecs(s, d), 10, "ip", corpus_id="passage_id",
                        corpus_vec="passage_embedding")


def q_topk_text_passages(s, d):
    return ranked(_text_passage_run(s, d), "passage_id")


def q_eval_text_maxp_report(s, d):
    run = rerank.max_p(_text_passage_run(s, d)).select("query_id", "doc_id", "rank", "score")
    ev = metrics.evaluate(run, fx.qrels(s, d))
    return ev.select("metric", r6("value").alias("value"))


def q_eval_text_recall1000(s, d):
    """R@1000 of a run 1,000 deep over short passages, every passage of a judged
    document being relevant: there are more passages than that, so some are missed."""
    p = passages.split_passages(passages.drop_empty(_docs(s, d)), DEEP_PASSAGE_SIZE, False, keep=[])
    judged = fx.qrels(s, d).join(p.select("doc_id", "passage_id"), "doc_id").select(
        "query_id", F.col("passage_id").alias("doc_id"), "relevance")
    vecs = embed.embed(p, "passage_body", lambda: embed.hashed_encoder(EMBED_DIM), out_col="passage_embedding",
                       dim=EMBED_DIM, partitions=s.sparkContext.defaultParallelism)
    run = search.top_k(_text_query_vecs(s, d), vecs, K_DEEP, "ip", corpus_id="passage_id", corpus_vec="passage_embedding")
    ev = metrics.evaluate(run.withColumnRenamed("passage_id", "doc_id"), judged, ["R@1000"])
    return ev.select("metric", r6("value").alias("value"))


def q_stream_passages_title(s, d):
    from rankweave.streaming.passages import run_available_now, stream_passages
    path = f"{d.rstrip('/')}/documents.parquet"
    stream = stream_passages(s, path, fx.table(s, d, "documents").schema, passage_size=PASSAGE_SIZE,
                             view=fx.docs_view)
    return s.read.parquet(run_available_now(stream)).select("doc_id", "passage_idx", "passage_id", "passage_body")


def _scratch(s) -> str:
    import uuid
    from rankweave.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/catalog-{uuid.uuid4().hex}"


def q_run_file_roundtrip(s, d):
    run = search.top_k(fx.vec_queries(s, d), _sum_pooled(s, d), K_DOCS, "ip", corpus_id="doc_id",
                       corpus_vec="doc_embedding")
    path = _scratch(s)
    files.write_run(run, path, RUN_NAME)
    back = files.read_run(s, path)
    return back.select("query_id", "doc_id", "rank", r6("score").alias("score"), "name")


def q_qrels_file_roundtrip(s, d):
    path = _scratch(s)
    q = fx.vec_doc_qrels(s, d)
    q.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("relevance").cast("string"))).write.text(path)
    return files.read_qrels(s, path).select("query_id", "iter", "doc_id", "relevance")


def q_topk_normalized_l2(s, d):
    docs = pooling.l2_normalize(_sum_pooled(s, d))
    queries = pooling.l2_normalize(fx.vec_queries(s, d), "embedding", "norm_embedding")
    run = search.top_k(queries, docs, K_DOCS, "l2", query_vec="norm_embedding", corpus_id="doc_id",
                       corpus_vec="norm_embedding")
    return ranked(run)


def _agg_run(how):
    def run(s, d):
        return rerank.score_aggregate(_passage_run(s, d, K_PASSAGES), fx.vec_passages(s, d), fx.vec_queries(s, d), how)
    return run


def q_rerank_max_first5(s, d):
    mp = rerank.max_p(_passage_run(s, d, K_PASSAGES), max_queries=5)
    return mp.select("query_id", "doc_id", "passage_idx", "passage_rank", "rank", r6("score").alias("score"))


def q_rolled_negatives_no_positives(s, d):
    return training.rolled_negatives(_clean_qrels(s, d), N_NEGATIVES, exclude_positives=True)


def q_triplets_cycle_epoch60(s, d):
    return training.triplets(_negatives(s, d), training.prepare_docs(_docs(s, d)), fx.queries(s, d), 60,
                             n_negatives=N_NEGATIVES, on_exhaust="cycle")


def q_conversation_pool_mean(s, d):
    """Conversations as documents whose ordered turns are the passages: each
    turn is encoded by the hosted encoder, turns are mean-pooled per conversation."""
    turns = fx.table(s, d, "conversations").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.col("turn").cast("int").alias("passage_idx"), "text")
    vecs = embed.embed(turns, "text", lambda: embed.hashed_encoder(EMBED_DIM), out_col="passage_embedding",
                       dim=EMBED_DIM)
    return exploded(pooling.pool(vecs, "mean"), "doc_id", "doc_embedding")


def q_negatives_wide(s, d):
    return training.wide_negatives(_negatives(s, d), N_NEGATIVES)


def _one_line(c):
    return F.translate(c, "\n\r\t", "   ")


def q_docs_file_roundtrip(s, d):
    path = _scratch(s)
    _docs(s, d).select(F.concat_ws(TAB, "doc_id", "url", "title", _one_line(F.col("body")))).write.text(path)
    return files.read_docs(s, path)


def q_queries_file_splits(s, d):
    q = fx.queries(s, d).withColumn("text", _one_line(F.col("text")))
    path = _scratch(s)
    first = F.col("query_id") < "Q2"
    for name, own in (("train", q.where(first)), ("dev", q.where(~first))):
        own.select(F.concat_ws(TAB, "query_id", "text")).write.text(f"{path}/{name}")
    return files.read_queries(s, {"train": f"{path}/train", "dev": f"{path}/dev"})


def q_qrels_trec_roundtrip(s, d):
    path = _scratch(s)
    fx.vec_doc_qrels(s, d).select(F.concat(F.lit(" "), F.col("query_id"), F.lit("  0\t"), F.col("doc_id"), F.lit("   "),
                                           F.col("relevance").cast("string"))).write.text(path)
    return files.read_qrels(s, path, fmt="trec")


def q_eval_report_percent(s, d):
    return metrics.report(metrics.evaluate(_doc_run(s, d), fx.vec_doc_qrels(s, d)), percent=True)


def q_table_shards_roundtrip(s, d):
    path = _scratch(s)
    p = q_passages_spaces(s, d)
    shards = [files.variant_path(path, shard=i, size=PASSAGE_SIZE) for i in range(3)]
    for i, shard in enumerate(shards):
        files.write_table(p.where(F.pmod(F.crc32("doc_id"), F.lit(3)) == i), shard)
    return files.union_shards(s, shards)


def q_maxp_run_file_report(s, d):
    path = _scratch(s)
    files.write_run(_maxp_run(s, d), path, RUN_NAME)
    ev = metrics.evaluate(files.read_run(s, path), fx.vec_doc_qrels(s, d))
    return ev.select("metric", r6("value").alias("value"))


def q_pool_masked_mean_padding(s, d):
    zeros = F.transform("passage_embedding", lambda x: x * 0)
    padded = fx.vec_passages(s, d).withColumn(
        "passage_embedding", F.when(F.col("passage_idx") % 3 == 1, zeros).otherwise(F.col("passage_embedding")))
    return exploded(pooling.pool(padded, "masked_mean"), "doc_id", "doc_embedding")


def _clustered_passages(s, d):
    path = _scratch(s)
    files.write_table(fx.vec_passages(s, d), path, cluster_by=["doc_id"], sort_by=["doc_id", "passage_idx"], buckets=8)
    return files.read_clustered(s, path)


def q_clustered_pool_mean(s, d):
    return exploded(pooling.pool(_clustered_passages(s, d), "mean"), "doc_id", "doc_embedding")


def q_clustered_pairs(s, d):
    return training.pairs(fx.vec_queries(s, d), fx.vec_doc_qrels(s, d), _clustered_passages(s, d), query_cols={},
                          doc_cols={"n_passages": F.size("doc_passage_embeddings").cast("int")})


def q_variants_read_one(s, d):
    """Three pooled variants in one dataset; one of them is read back."""
    path, vp = _scratch(s), fx.vec_passages(s, d)
    for method in ("mean", "sum", "max"):
        files.write_variant(pooling.pool(vp, method), path, method=method, size=PASSAGE_SIZE)
    back = files.read_variants(s, path, "doc_id STRING, doc_embedding ARRAY<DOUBLE>", "method STRING, size INT", method="sum")
    return exploded(back, "doc_id", "doc_embedding")


def q_docs_ingest_dirty(s, d):
    """The documents as one gzip text with every seventh line cut short: good rows and bad lines."""
    path = _scratch(s)
    short = F.substring("doc_id", 2, 20).cast("bigint") % 7 == 0
    lines = _docs(s, d).select(F.when(short, F.concat_ws(TAB, "doc_id", "url", "title")).otherwise(
        F.concat_ws(TAB, "doc_id", "url", "title", _one_line(F.col("body")))).alias("value"))
    lines.write.option("compression", "gzip").text(f"{path}/text")
    good, bad = files.ingest(s, f"{path}/text", f"{path}/table", partitions=8)
    return good.select("doc_id", F.lit(True).alias("ok"), F.length("body").cast("int").alias("n_chars")).unionByName(
        bad.select(F.split_part("text", F.lit(TAB), F.lit(1)).alias("doc_id"), F.lit(False).alias("ok"),
                   F.lit(None).cast("int").alias("n_chars")))


def _leads():
    def lead(titles, bodies, words, sep):
        return [f"{t}{sep}{' '.join(b.split(' ')[:words])}" for t, b in zip(titles, bodies)]
    return lead


def q_map_columns_kwargs(s, d):
    docs = embed.map_columns(_docs(s, d), ["title", "body"], _leads, "lead", "string", drop_inputs=True,
                             fn_kwargs={"words": 5, "sep": ": "})
    return docs.select("doc_id", "lead")


def q_stream_embed_flatten(s, d):
    from rankweave.streaming.batches import drain, passage_vectors
    from rankweave.streaming.passages import stream_passages
    stream = stream_passages(s, f"{d.rstrip('/')}/documents.parquet", fx.table(s, d, "documents").schema,
                             passage_size=PASSAGE_SIZE, view=fx.docs_view)
    out = drain(stream, passage_vectors(lambda: embed.hashed_encoder(EMBED_DIM), dim=EMBED_DIM))
    vecs = s.read.parquet(out).select("passage_id", F.posexplode("norm_embedding").alias("dim", "value"))
    return vecs.where("value <> 0").select("passage_id", F.col("dim").cast("int").alias("dim"), r6("value").alias("value"))


def q_eval_two_runs(s, d):
    """Two runs in one frame, evaluated by name."""
    runs = _doc_run(s, d).select("query_id", "doc_id", "score").withColumn("name", F.lit("pooled")).unionByName(
        _maxp_run(s, d).select("query_id", "doc_id", "score").withColumn("name", F.lit("maxp")))
    ev = metrics.evaluate(runs, fx.vec_doc_qrels(s, d), by=["name"])
    return ev.select("name", "metric", r6("value").alias("value"))


def q_training_save_load(s, d):
    path = _scratch(s)
    training.save({"docs_prepped": training.prepare_docs(_docs(s, d)), "train_indexes": _negatives(s, d)}, path)
    back = training.load(s, path, ("docs_prepped", "train_indexes"))
    texts = back["docs_prepped"].select(F.col("doc_id").alias("neg"), F.col("text").alias("neg_text"))
    return back["train_indexes"].join(texts, "neg").select("query_id", "pos", "neg_no", "neg",
                                                           F.length("neg_text").cast("int").alias("neg_chars"))


def _code_points():
    """A batch tokenizer whose tokens are code points: Arrow strings to Arrow lists of ids."""
    def encode(texts: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
        ids = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le"), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids))
    return encode


def _from_code_points():
    def decode(rows: pa.Array) -> pa.Array:
        ends = np.asarray(rows.offsets)
        text = np.asarray(rows.values)[ends[0]:ends[-1]].astype("<i4").tobytes().decode("utf-32-le")
        return pa.array([text[a:b] for a, b in zip(ends - ends[0], ends[1:] - ends[0])], pa.string())
    return decode


def q_tokenize_split_detokenize(s, d):
    docs = _docs(s, d).select("doc_id", "body")
    ids = embed.tokenize(docs, "body", _code_points, "body_tokens", arrow=True)
    ids = ids.withColumn("title_tokens", F.lit(None).cast("array<int>"))
    p = passages.split_token_passages(ids, CODE_POINTS, False)
    text = embed.detokenize(p, "passage_tokens", _from_code_points, "passage_text", arrow=True)
    return text.select("doc_id", "passage_idx", "passage_id", "passage_text")


def _spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "passages_spaces": q_passages_spaces,
        "passages_spaces_title": q_passages_spaces_title,
        "passages_tokens_title": q_passages_tokens_title,
        "passages_nest_roundtrip": q_passages_nest_roundtrip,
        "passages_capped": q_passages_capped,
        "pool_mean": _pool("mean"),
        "pool_sum": _pool("sum"),
        "pool_max": _pool("max"),
        "pool_first": _pool("first"),
        "pool_masked_mean": _pool("masked_mean"),
        "pool_nested_mean": q_pool_nested_mean,
        "embed_documents_masked_mean": q_embed_documents_masked_mean,
        "l2_normalize": q_l2_normalize,
        "topk_ip": _topk("ip"),
        "topk_l2": _topk("l2"),
        "topk_cosine": _topk("cosine"),
        "topk_ip_blocks": _topk("ip", max_broadcast_rows=1),
        "topk_vectors_ip": _vector_topk("ip"),
        "topk_vectors_l2": _vector_topk("l2"),
        "topk_vectors_cosine": _vector_topk("cosine"),
        "topk_vectors_grid": _vector_topk("ip", max_broadcast_rows=1),
        "topk_index": q_topk_index,
        "topk_passages": q_topk_passages,
        "rerank_max": q_rerank_max,
        "rerank_sum": _rerank("sum"),
        "rerank_mean": _rerank("mean"),
        "rerank_sum_buckets": q_rerank_sum_buckets,
        "position_histogram_50": _histogram(HISTOGRAM_BINS),
        "position_histogram_first10": _histogram(FIRST_POSITIONS, first=FIRST_POSITIONS),
        "eval_rr10": _eval(["RR@10"]),
        "eval_rr100": _eval(["RR@100"]),
        "eval_ndcg10": _eval(["nDCG@10"]),
        "eval_recall1000": _eval(["R@1000"]),
        "eval_ap100": _eval(["AP@100"]),
        "eval_report": _eval(metrics.DEFAULT_METRICS),
        "eval_per_query": q_eval_per_query,
        "eval_maxp_report": _eval(metrics.DEFAULT_METRICS, _maxp_run),
        "training_pairs": q_training_pairs,
        "training_unmatched": q_training_unmatched,
        "prepared_docs": q_prepared_docs,
        "clean_qrels": q_clean_qrels,
        "clean_qrels_untitled": q_clean_qrels_untitled,
        "prepared_docs_untitled": q_prepared_docs_untitled,
        "prepared_docs_body_only": q_prepared_docs_body_only,
        "sample_corpus_docs": q_sample_corpus_docs,
        "sample_corpus_qrels": q_sample_corpus_qrels,
        "rolled_negatives": q_rolled_negatives,
        "triplets_epoch1": _triplets(1),
        "triplets_epoch60": _triplets(60),
        "in_batch_loss": q_in_batch_loss,
        "run_trec_lines": q_run_trec_lines,
        "contiguous_shards": q_contiguous_shards,
        "contiguous_shards_proportional": q_contiguous_shards_proportional,
        "embed_hashed_queries": q_embed_hashed_queries,
        "topk_text_passages": q_topk_text_passages,
        "eval_text_maxp_report": q_eval_text_maxp_report,
        "eval_text_recall1000": q_eval_text_recall1000,
        "stream_passages_title": q_stream_passages_title,
        "run_file_roundtrip": q_run_file_roundtrip,
        "qrels_file_roundtrip": q_qrels_file_roundtrip,
        "topk_normalized_l2": q_topk_normalized_l2,
        "eval_sum_report": _eval(metrics.DEFAULT_METRICS, _agg_run("sum")),
        "eval_mean_report": _eval(metrics.DEFAULT_METRICS, _agg_run("mean")),
        "rerank_max_first5": q_rerank_max_first5,
        "rolled_negatives_no_positives": q_rolled_negatives_no_positives,
        "triplets_cycle_epoch60": q_triplets_cycle_epoch60,
        "negatives_wide": q_negatives_wide,
        "conversation_pool_mean": q_conversation_pool_mean,
        "docs_file_roundtrip": q_docs_file_roundtrip,
        "queries_file_splits": q_queries_file_splits,
        "qrels_trec_roundtrip": q_qrels_trec_roundtrip,
        "eval_report_percent": q_eval_report_percent,
        "table_shards_roundtrip": q_table_shards_roundtrip,
        "maxp_run_file_report": q_maxp_run_file_report,
        "pool_masked_mean_padding": q_pool_masked_mean_padding,
        "training_save_load": q_training_save_load,
        "clustered_pool_mean": q_clustered_pool_mean,
        "clustered_pairs": q_clustered_pairs,
        "variants_read_one": q_variants_read_one,
        "docs_ingest_dirty": q_docs_ingest_dirty,
        "map_columns_kwargs": q_map_columns_kwargs,
        "stream_embed_flatten": q_stream_embed_flatten,
        "eval_two_runs": q_eval_two_runs,
        "tokenize_split_detokenize": q_tokenize_split_detokenize,
    }


# ---------------------------------------------------------------- DuckDB side

VIEWS = {
    "docs": """SELECT concat('D', CAST(doc_id AS VARCHAR)) AS doc_id,
       concat('http://', source, '/', CAST(doc_id AS VARCHAR)) AS url,
       concat(source, ' ', lang) AS title,
       text AS body
FROM documents""",
    "tq": "SELECT concat('Q', CAST(item_id AS VARCHAR)) AS query_id, text FROM benchmark",
    "tqrels": """SELECT concat('Q', CAST(b.item_id AS VARCHAR)) AS query_id, concat('D', CAST(d.doc_id AS VARCHAR)) AS doc_id,
       CAST(1 + coalesce(l.quality, 0) AS INTEGER) AS relevance
FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "vq": "SELECT concat('V', CAST(vec_id AS VARCHAR)) AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0",
    "vd": "SELECT concat('D', CAST(vec_id AS VARCHAR)) AS doc_id, embedding, label FROM embeddings",
    "vqr": """SELECT q.query_id, d.doc_id, 1 AS relevance FROM vq q JOIN vd d ON q.label = d.label
WHERE substring(q.query_id, 2) <> substring(d.doc_id, 2)""",
    "udocs": """SELECT doc_id, body, CASE WHEN title LIKE '% de' THEN NULL WHEN title LIKE '% fr' THEN '' ELSE title END AS title
FROM docs""",
    "uremoved": "SELECT doc_id FROM udocs WHERE NOT (title IS NOT NULL AND title <> '' AND body IS NOT NULL AND body <> '')",
    "vp": """SELECT concat('D', CAST(g AS VARCHAR)) AS doc_id, CAST(i AS INTEGER) AS passage_idx,
       concat('D', CAST(g AS VARCHAR), '_', CAST(i AS VARCHAR)) AS passage_id, embedding AS passage_embedding, label
FROM (SELECT g, embedding, label, row_number() OVER (PARTITION BY g ORDER BY vec_id) - 1 AS i
      FROM (SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS g, vec_id, embedding, label FROM embeddings) a) b""",
    "vdq": """SELECT q.query_id, p.doc_id, CAST(least(count(*), 3) AS INTEGER) AS relevance
FROM vq q JOIN vp p ON q.label = p.label GROUP BY q.query_id, p.doc_id""",
    "pe": """SELECT doc_id, passage_idx, unnest(passage_embedding) AS v, unnest(range(0, len(passage_embedding))) AS dim FROM vp""",
    "sumpool": """SELECT doc_id, list(v ORDER BY dim) AS emb FROM
      (SELECT doc_id, dim, sum(CAST(v AS DOUBLE)) AS v FROM pe GROUP BY doc_id, dim) s GROUP BY doc_id""",
    "meanpool": """SELECT doc_id, list(v ORDER BY dim) AS emb FROM
      (SELECT doc_id, dim, avg(CAST(v AS DOUBLE)) AS v FROM pe GROUP BY doc_id, dim) s GROUP BY doc_id""",
    "removed": """SELECT doc_id FROM docs
      WHERE NOT (title IS NOT NULL AND title <> '' AND body IS NOT NULL AND body <> '')""",
    "prepared": """SELECT doc_id, concat(title, body) AS text FROM docs
      WHERE title IS NOT NULL AND title <> '' AND body IS NOT NULL AND body <> ''""",
    "cq": """SELECT query_id, doc_id, relevance FROM tqrels r WHERE NOT EXISTS (SELECT 1 FROM removed x WHERE x.doc_id = r.doc_id)""",
    "negs": f"""SELECT ex.query_id, ex.pos, CAST(ex.neg_no AS INTEGER) AS neg_no, s.doc_id AS neg
FROM (SELECT ix.query_id, ix.doc_id AS pos, ix.r, unnest(range(1, {N_NEGATIVES} + 1)) AS neg_no
      FROM (SELECT query_id, doc_id, row_number() OVER (ORDER BY query_id, doc_id) - 1 AS r FROM cq) ix) ex
CROSS JOIN (SELECT count(*) AS n FROM cq) nn
JOIN (SELECT doc_id, row_number() OVER (ORDER BY query_id, doc_id) - 1 AS r FROM cq) s
  ON s.r = ((ex.r - ex.neg_no) % nn.n + nn.n) % nn.n""",
    "prun": f"""SELECT * FROM (SELECT q.query_id, p.passage_id, p.doc_id, p.passage_idx,
        list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.passage_embedding AS DOUBLE[])) AS score,
        row_number() OVER (PARTITION BY q.query_id ORDER BY
          list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.passage_embedding AS DOUBLE[])) DESC, p.passage_id) AS prank
      FROM vq q CROSS JOIN vp p) t WHERE prank <= {K_PASSAGES}""",
    "maxp": """SELECT query_id, doc_id, passage_idx, CAST(prank AS INTEGER) AS passage_rank,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY prank, doc_id) AS INTEGER) AS rank, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY prank) AS n FROM prun) t WHERE n = 1""",
    "cand_scores": """SELECT c.query_id, c.doc_id,
       sum(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.passage_embedding AS DOUBLE[]))) AS sum_score,
       avg(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.passage_embedding AS DOUBLE[]))) AS mean_score
FROM (SELECT DISTINCT query_id, doc_id FROM prun) c JOIN vp p ON p.doc_id = c.doc_id JOIN vq q ON q.query_id = c.query_id
GROUP BY c.query_id, c.doc_id""",
    "sumrun": "SELECT query_id, doc_id, sum_score AS score FROM cand_scores",
    "meanrun": "SELECT query_id, doc_id, mean_score AS score FROM cand_scores",
    "docrun": f"""SELECT query_id, doc_id, score FROM (SELECT q.query_id, p.doc_id,
        list_dot_product(CAST(q.embedding AS DOUBLE[]), p.emb) AS score,
        row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), p.emb) DESC,
                           p.doc_id) AS rk
      FROM vq q CROSS JOIN meanpool p) t WHERE rk <= {K_PASSAGES}""",
    "maxprun": "SELECT query_id, doc_id, score FROM maxp",
    "tqv_tok": "SELECT query_id, unnest(string_split(text, ' ')) AS t FROM tq",
    "tqv": f"""SELECT b.query_id, b.dim, CAST(CAST(b.c / n.nrm AS FLOAT) AS DOUBLE) AS value
FROM (SELECT query_id, CAST(('0x' || left(md5(t), 8))::BIGINT % {EMBED_DIM} AS INTEGER) AS dim, count(*) AS c
      FROM tqv_tok GROUP BY ALL) b
JOIN (SELECT query_id, sqrt(sum(c * c)) AS nrm FROM (SELECT query_id, CAST(('0x' || left(md5(t), 8))::BIGINT % {EMBED_DIM} AS INTEGER) AS dim, count(*) AS c
      FROM tqv_tok GROUP BY ALL) x GROUP BY query_id) n USING (query_id)""",
    "tp": f"""SELECT doc_id, CAST(st // {PASSAGE_SIZE} AS INTEGER) AS passage_idx,
       concat(doc_id, '_', CAST(st // {PASSAGE_SIZE} AS VARCHAR)) AS passage_id,
       concat(CASE WHEN title IS NOT NULL AND title <> '' THEN concat(title, ' ') ELSE '' END,
              array_to_string(toks[st + 1 : st + {PASSAGE_SIZE}], ' ')) AS passage_body
FROM (SELECT doc_id, title, toks, unnest(range(0, len(toks), {PASSAGE_SIZE})) AS st
      FROM (SELECT doc_id, title, string_split(body, ' ') AS toks FROM docs WHERE body IS NOT NULL AND body <> '') d) s""",
    "tpv_tok": "SELECT passage_id, unnest(string_split(passage_body, ' ')) AS t FROM tp",
    "tpv": f"""SELECT b.passage_id, b.dim, CAST(CAST(b.c / n.nrm AS FLOAT) AS DOUBLE) AS value
FROM (SELECT passage_id, CAST(('0x' || left(md5(t), 8))::BIGINT % {EMBED_DIM} AS INTEGER) AS dim, count(*) AS c
      FROM tpv_tok GROUP BY ALL) b
JOIN (SELECT passage_id, sqrt(sum(c * c)) AS nrm FROM (SELECT passage_id, CAST(('0x' || left(md5(t), 8))::BIGINT % {EMBED_DIM} AS INTEGER) AS dim, count(*) AS c
      FROM tpv_tok GROUP BY ALL) x GROUP BY passage_id) n USING (passage_id)""",
    "ct": "SELECT concat('C', CAST(conv_id AS VARCHAR)) AS doc_id, turn, text FROM conversations",
    "cb": f"""SELECT doc_id, turn, CAST(('0x' || left(md5(t), 8))::BIGINT % {EMBED_DIM} AS INTEGER) AS dim, count(*) AS c
FROM (SELECT doc_id, turn, unnest(string_split(text, ' ')) AS t FROM ct) x GROUP BY doc_id, turn, dim""",
    "tqd": f"""SELECT q.query_id, list(coalesce(v.value, CAST(0 AS DOUBLE)) ORDER BY g.dim) AS emb
FROM (SELECT DISTINCT query_id FROM tq) q CROSS JOIN (SELECT CAST(range AS INTEGER) AS dim FROM range({EMBED_DIM})) g
LEFT JOIN tqv v ON v.query_id = q.query_id AND v.dim = g.dim GROUP BY q.query_id""",
    "tpd": f"""SELECT p.passage_id, list(coalesce(v.value, CAST(0 AS DOUBLE)) ORDER BY g.dim) AS emb
FROM tp p CROSS JOIN (SELECT CAST(range AS INTEGER) AS dim FROM range({EMBED_DIM})) g
LEFT JOIN tpv v ON v.passage_id = p.passage_id AND v.dim = g.dim GROUP BY p.passage_id""",
    "tprun": """SELECT * FROM (SELECT query_id, passage_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rk
      FROM (SELECT q.query_id, p.passage_id, list_dot_product(q.emb, p.emb) AS score FROM tqd q CROSS JOIN tpd p) u) t
WHERE rk <= 10""",
    "lossp": f"""SELECT r.query_id, r.doc_id, q.embedding AS qe, d.embedding AS de,
      (row_number() OVER (ORDER BY r.query_id, r.doc_id) - 1) // {LOSS_BATCH} AS batch
  FROM vqr r JOIN vq q ON q.query_id = r.query_id JOIN vd d ON d.doc_id = r.doc_id""",
    "losslg": """SELECT a.batch, a.query_id, a.doc_id, list_dot_product(CAST(a.qe AS DOUBLE[]), CAST(b.de AS DOUBLE[])) AS logit,
       (a.query_id = b.query_id AND a.doc_id = b.doc_id) AS diag FROM lossp a JOIN lossp b ON a.batch = b.batch""",
}

DEPS = {
    "udocs": ["docs"], "uremoved": ["udocs"],
    "vqr": ["vq", "vd"], "vdq": ["vq", "vp"], "pe": ["vp"], "sumpool": ["pe"], "meanpool": ["pe"],
    "removed": ["docs"], "prepared": ["docs"], "cq": ["tqrels", "removed"], "negs": ["cq"],
    "prun": ["vq", "vp"], "maxp": ["prun"], "cand_scores": ["prun", "vp", "vq"], "docrun": ["vq", "meanpool"],
    "maxprun": ["maxp"], "sumrun": ["cand_scores"], "meanrun": ["cand_scores"], "tqv_tok": ["tq"], "tqv": ["tqv_tok"], "tp": ["docs"], "tpv_tok": ["tp"],
    "tpv": ["tpv_tok"], "tqd": ["tq", "tqv"], "tpd": ["tp", "tpv"], "tprun": ["tqd", "tpd"],
    "lossp": ["vqr", "vq", "vd"], "losslg": ["lossp"], "cb": ["ct"],
}


def sql(body: str, *views: str) -> str:
    order: list[str] = []

    def visit(v):
        for dep in DEPS.get(v, []):
            visit(dep)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order) + "\n" + body


def _passages_sql(title: bool) -> str:
    prefix = "CASE WHEN title IS NOT NULL AND title <> '' THEN concat(title, ' ') ELSE '' END" if title else "''"
    return sql(f"""SELECT doc_id, CAST(st // {PASSAGE_SIZE} AS INTEGER) AS passage_idx,
       concat(doc_id, '_', CAST(st // {PASSAGE_SIZE} AS VARCHAR)) AS passage_id,
       concat({prefix}, array_to_string(toks[st + 1 : st + {PASSAGE_SIZE}], ' ')) AS passage_body
FROM (SELECT doc_id, title, toks, unnest(range(0, len(toks), {PASSAGE_SIZE})) AS st
      FROM (SELECT doc_id, title, string_split(body, ' ') AS toks FROM docs WHERE body IS NOT NULL AND body <> '') d) s""",
               "docs")


def _pool_sql(method: str) -> str:
    if method == "first":
        return sql("SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CAST(v AS DOUBLE), 6) AS value FROM pe "
                   "WHERE passage_idx = 0", "pe")
    agg = {"mean": "avg", "sum": "sum", "max": "max", "masked_mean": "avg"}[method]
    where = ""
    if method == "masked_mean":
        where = ("WHERE doc_id || '_' || CAST(passage_idx AS VARCHAR) IN (SELECT passage_id FROM vp "
                 "WHERE list_max(list_transform(passage_embedding, lambda x: abs(x))) > 0)")
    return sql(f"SELECT doc_id, CAST(dim AS INTEGER) AS dim, round({agg}(CAST(v AS DOUBLE)), 6) AS value FROM pe "
               f"{where} GROUP BY doc_id, dim", "pe", "vp")


def _topk_sql(metric: str) -> str:
    a = "CAST(q.embedding AS DOUBLE[])"
    score = {"ip": f"list_dot_product({a}, p.emb)",
             "cosine": f"list_cosine_similarity({a}, p.emb)",
             "l2": f"-list_sum(list_transform(list_zip({a}, p.emb), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"}[metric]
    return sql(f"""SELECT query_id, doc_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
      FROM (SELECT q.query_id, p.doc_id, {score} AS score FROM vq q CROSS JOIN sumpool p) s) t
WHERE rk <= {K_DOCS}""", "vq", "sumpool")


def _vector_topk_sql(metric: str) -> str:
    a, b = "CAST(q.embedding AS DOUBLE[])", "CAST(p.embedding AS DOUBLE[])"
    score = {"ip": f"list_dot_product({a}, {b})", "cosine": f"list_cosine_similarity({a}, {b})",
             "l2": f"-list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"}[metric]
    return sql(f"""SELECT query_id, doc_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
      FROM (SELECT q.query_id, p.doc_id, {score} AS score FROM vq q CROSS JOIN vd p) s) t
WHERE rk <= {K_VECTORS}""", "vq", "vd")


def _text_recall_sql() -> str:
    """The deep passage run and its document run, from the token counts of short passages."""
    base = sql("SELECT 1", "docs", "tqd", "tqrels")
    with_clause = base[: base.rindex("\nSELECT 1")]
    bucket = f"CAST(('0x' || left(md5(t), 8))::BIGINT % {EMBED_DIM} AS INTEGER)"
    return f"""{with_clause},
sp AS (SELECT doc_id, concat(doc_id, '_', CAST(st // {DEEP_PASSAGE_SIZE} AS VARCHAR)) AS passage_id, toks[st + 1 : st + {DEEP_PASSAGE_SIZE}] AS own
  FROM (SELECT doc_id, toks, unnest(range(0, len(toks), {DEEP_PASSAGE_SIZE})) AS st
        FROM (SELECT doc_id, string_split(body, ' ') AS toks FROM docs WHERE body IS NOT NULL AND body <> '') d) s),
sb AS (SELECT passage_id, {bucket} AS dim, count(*) AS c FROM (SELECT passage_id, unnest(own) AS t FROM sp) x GROUP BY ALL),
sv AS (SELECT sb.passage_id, sb.dim, CAST(CAST(sb.c / n.nrm AS FLOAT) AS DOUBLE) AS value
  FROM sb JOIN (SELECT passage_id, sqrt(sum(c * c)) AS nrm FROM sb GROUP BY passage_id) n USING (passage_id)),
sd AS (SELECT p.passage_id, list(coalesce(v.value, CAST(0 AS DOUBLE)) ORDER BY g.dim) AS emb
  FROM sp p CROSS JOIN (SELECT CAST(range AS INTEGER) AS dim FROM range({EMBED_DIM})) g
  LEFT JOIN sv v ON v.passage_id = p.passage_id AND v.dim = g.dim GROUP BY p.passage_id),
srun AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rk
  FROM (SELECT q.query_id, p.passage_id, list_dot_product(q.emb, p.emb) AS score FROM tqd q CROSS JOIN sd p) u),
srun2 AS (SELECT query_id, passage_id AS doc_id, score FROM srun WHERE rk <= {K_DEEP}),
sqrels AS (SELECT r.query_id, sp.passage_id AS doc_id, r.relevance FROM tqrels r JOIN sp ON sp.doc_id = r.doc_id),
{_per_query_sql('srun2', 'sqrels')}
SELECT 'R@1000' AS metric, round(avg(recall_1000), 6) AS value FROM pq"""


def _hist_sql(bins: int, first: int | None) -> str:
    where = f"WHERE passage_idx < {first}" if first is not None else ""
    return sql(f"""SELECT g.bin, round(b.lo + g.bin * ((b.hi - b.lo) / {bins}.0), 6) AS lower,
       round(b.lo + (g.bin + 1) * ((b.hi - b.lo) / {bins}.0), 6) AS upper, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g
CROSS JOIN (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
            FROM (SELECT min(CAST(passage_idx AS DOUBLE)) AS lo0, max(CAST(passage_idx AS DOUBLE)) AS hi0
                  FROM maxp {where}) m) b
LEFT JOIN (SELECT CAST(least(floor((CAST(passage_idx AS DOUBLE) - bb.lo) * ({bins}.0 / (bb.hi - bb.lo))), {bins - 1}) AS INTEGER) AS bin,
                  count(*) AS cnt
           FROM (SELECT * FROM maxp {where}) x
           CROSS JOIN (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
                       FROM (SELECT min(CAST(passage_idx AS DOUBLE)) AS lo0, max(CAST(passage_idx AS DOUBLE)) AS hi0
                             FROM maxp {where}) m) bb
           GROUP BY 1) c ON c.bin = g.bin""", "maxp")


_D = "CAST(0 AS DOUBLE)"


def _per_query_sql(run_view: str, qrels_view: str) -> str:
    """Per-query metric table ``pq`` over a run view (query_id, doc_id, score)."""
    return f"""rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rk
      FROM {run_view}),
j AS (SELECT rr.query_id, rr.doc_id, rr.rk, coalesce(qr.relevance, 0) AS rel
      FROM rr LEFT JOIN {qrels_view} qr ON qr.query_id = rr.query_id AND qr.doc_id = rr.doc_id WHERE rr.rk <= 1000),
jh AS (SELECT *, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rk
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM j),
pr AS (SELECT query_id,
   max(CASE WHEN rk <= 10 AND rel >= 1 THEN CAST(1 AS DOUBLE) / rk ELSE {_D} END) AS rr10,
   max(CASE WHEN rk <= 100 AND rel >= 1 THEN CAST(1 AS DOUBLE) / rk ELSE {_D} END) AS rr100,
   sum(CASE WHEN rk <= 10 THEN CAST(greatest(rel, 0) AS DOUBLE) / log2(rk + 1) ELSE {_D} END) AS dcg10,
   sum(CASE WHEN rk <= 1000 AND rel >= 1 THEN CAST(1 AS DOUBLE) ELSE {_D} END) AS hit1000,
   sum(CASE WHEN rk <= 100 AND rel >= 1 THEN CAST(hits AS DOUBLE) / rk ELSE {_D} END) AS ap100s
  FROM jh GROUP BY query_id),
iq AS (SELECT query_id, relevance AS rel, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS ir
       FROM {qrels_view}),
jd AS (SELECT query_id, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS nrel,
   sum(CASE WHEN ir <= 10 THEN CAST(greatest(rel, 0) AS DOUBLE) / log2(ir + 1) ELSE {_D} END) AS idcg10
  FROM iq GROUP BY query_id),
pq AS (SELECT jd.query_id,
   coalesce(rr10, {_D}) AS rr_10, coalesce(rr100, {_D}) AS rr_100,
   CASE WHEN idcg10 > 0 THEN coalesce(dcg10, {_D}) / idcg10 ELSE {_D} END AS ndcg_10,
   CASE WHEN nrel > 0 THEN coalesce(hit1000, {_D}) / nrel ELSE {_D} END AS recall_1000,
   CASE WHEN nrel > 0 THEN coalesce(ap100s, {_D}) / nrel ELSE {_D} END AS ap_100
  FROM jd LEFT JOIN pr ON pr.query_id = jd.query_id)"""


_METRIC_COLS = {"RR@10": "rr_10", "RR@100": "rr_100", "nDCG@10": "ndcg_10", "R@1000": "recall_1000", "AP@100": "ap_100"}


def _eval_sql(names, run_view: str = "docrun", qrels_view: str = "vdq", views=("docrun", "vdq")) -> str:
    base = sql("SELECT 1", *views)
    with_clause = base[: base.rindex("\nSELECT 1")]
    union = "\nUNION ALL\n".join(f"SELECT '{m}' AS metric, round(avg({_METRIC_COLS[m]}), 6) AS value FROM pq" for m in names)
    return f"{with_clause},\n{_per_query_sql(run_view, qrels_view)}\n{union}"


def _eval_per_query_sql() -> str:
    base = sql("SELECT 1", "docrun", "vdq")
    with_clause = base[: base.rindex("\nSELECT 1")]
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in _METRIC_COLS.values())
    return f"{with_clause},\n{_per_query_sql('docrun', 'vdq')}\nSELECT query_id, {cols} FROM pq"


def _triplets_sql(epoch: int) -> str:
    return sql(f"""SELECT n.query_id, n.pos, n.neg, q.text AS query_text, p.text AS pos_text, x.text AS neg_text
FROM negs n JOIN tq q ON q.query_id = n.query_id JOIN prepared p ON p.doc_id = n.pos JOIN prepared x ON x.doc_id = n.neg
WHERE n.neg_no = least({epoch}, {N_NEGATIVES})""", "negs", "tq", "prepared")


def _oracle_sql() -> dict[str, str]:
    first_docs = f"""(SELECT DISTINCT doc_id FROM (SELECT r.query_id, r.doc_id,
        row_number() OVER (PARTITION BY r.query_id ORDER BY r.doc_id) AS n FROM tqrels r
        WHERE r.query_id IN (SELECT query_id FROM tq ORDER BY query_id LIMIT {SAMPLE_QUERIES})) t WHERE n = 1)"""
    return {
        "docs_file_roundtrip": sql("SELECT doc_id, url, title, translate(body, chr(10) || chr(13) || chr(9), '   ') AS body FROM docs",
                                   "docs"),
        "queries_file_splits": sql("""SELECT query_id, translate(text, chr(10) || chr(13) || chr(9), '   ') AS text,
       CASE WHEN query_id < 'Q2' THEN 'train' ELSE 'dev' END AS split FROM tq""", "tq"),
        "qrels_trec_roundtrip": sql("SELECT query_id, '0' AS iter, doc_id, relevance FROM vdq", "vdq"),
        "eval_report_percent": _eval_sql(list(_METRIC_COLS)).replace("round(avg(", "round(100 * avg(").replace(
            "), 6) AS value", "), 2) AS value"),
        "table_shards_roundtrip": _passages_sql(False),
        "maxp_run_file_report": _eval_sql(list(_METRIC_COLS), "maxprun", "vdq", ("maxprun", "vdq")),
        "pool_masked_mean_padding": sql("""SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS value
FROM pe WHERE passage_idx % 3 <> 1 GROUP BY doc_id, dim""", "pe"),
        "training_save_load": sql("""SELECT n.query_id, n.pos, n.neg_no, n.neg, CAST(length(p.text) AS INTEGER) AS neg_chars
FROM negs n JOIN prepared p ON p.doc_id = n.neg""", "negs", "prepared"),
        "tokenize_split_detokenize": sql(f"""SELECT doc_id, CAST(st // {CODE_POINTS - 20} AS INTEGER) AS passage_idx,
       concat(doc_id, '_', CAST(st // {CODE_POINTS - 20} AS VARCHAR)) AS passage_id,
       substring(body, CAST(st AS BIGINT) + 1, {CODE_POINTS - 20}) AS passage_text
FROM (SELECT doc_id, body, unnest(range(0, length(body), {CODE_POINTS - 20})) AS st FROM docs) c""", "docs"),
        "clustered_pool_mean": _pool_sql("mean"),
        "clustered_pairs": sql("""SELECT r.query_id, r.doc_id, CAST(n.n AS INTEGER) AS n_passages
FROM (SELECT DISTINCT query_id, doc_id FROM vdq WHERE relevance >= 1) r
JOIN (SELECT doc_id, count(*) AS n FROM vp GROUP BY doc_id) n ON n.doc_id = r.doc_id""", "vdq", "vp"),
        "variants_read_one": _pool_sql("sum"),
        "docs_ingest_dirty": sql("""SELECT doc_id, CAST(substring(doc_id, 2) AS BIGINT) % 7 <> 0 AS ok,
       CASE WHEN CAST(substring(doc_id, 2) AS BIGINT) % 7 <> 0 THEN CAST(length(body) AS INTEGER) END AS n_chars FROM docs""",
                                 "docs"),
        "map_columns_kwargs": sql("""SELECT doc_id, concat(title, ': ', array_to_string(string_split(body, ' ')[1:5], ' ')) AS lead
FROM docs""", "docs"),
        "stream_embed_flatten": sql("""SELECT t.passage_id, t.dim, round(t.value / n.nrm, 6) AS value
FROM tpv t JOIN (SELECT passage_id, sqrt(sum(value * value)) AS nrm FROM tpv GROUP BY passage_id) n USING (passage_id)
WHERE t.value <> 0""", "tpv"),
        "eval_two_runs": "\nUNION ALL\n".join(
            f"SELECT '{name}' AS name, metric, value FROM ({_eval_sql(list(_METRIC_COLS), view, 'vdq', (view, 'vdq'))})"
            for name, view in (("pooled", "docrun"), ("maxp", "maxprun"))),
        "passages_spaces": _passages_sql(False),
        "passages_spaces_title": _passages_sql(True),
        "passages_tokens_title": sql(f"""SELECT doc_id, CAST(st // chunk AS INTEGER) AS passage_idx,
       concat(doc_id, '_', CAST(st // chunk AS VARCHAR)) AS passage_id,
       CAST(len(list_concat(tt, bt[st + 1 : st + chunk])) AS INTEGER) AS n_tokens,
       array_to_string(list_concat(tt, bt[st + 1 : st + chunk]), ' ') AS passage_text
FROM (SELECT doc_id, tt, bt, chunk, unnest(range(0, len(bt), chunk)) AS st
      FROM (SELECT doc_id, tt, bt, {TOKEN_PASSAGE_SIZE} - len(tt) - 20 AS chunk
            FROM (SELECT doc_id,
                    CASE WHEN title IS NOT NULL AND title <> '' THEN string_split(title, ' ') ELSE []::VARCHAR[] END AS tt,
                    string_split(body, ' ') AS bt FROM docs WHERE body IS NOT NULL AND body <> '') a) b) c""", "docs"),
        "passages_nest_roundtrip": _passages_sql(True),
        "stream_passages_title": _passages_sql(True),
        "run_file_roundtrip": sql(f"""SELECT query_id, doc_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score,
       '{RUN_NAME}' AS name
FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
      FROM (SELECT q.query_id, p.doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), p.emb) AS score
            FROM vq q CROSS JOIN sumpool p) s) t WHERE rk <= {K_DOCS}""", "vq", "sumpool"),
        "qrels_file_roundtrip": sql("SELECT query_id, '0' AS iter, doc_id, relevance FROM vdq", "vdq"),
        "topk_normalized_l2": sql(f"""SELECT query_id, doc_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
      FROM (SELECT q.query_id, p.doc_id,
                   -list_sum(list_transform(list_zip(q.nv, p.nv), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS score
            FROM (SELECT query_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN n = 0 THEN x ELSE x / n END) AS nv
                  FROM (SELECT query_id, embedding,
                               sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM vq) a) q
            CROSS JOIN (SELECT doc_id, list_transform(emb, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END) AS nv
                  FROM (SELECT doc_id, emb, sqrt(list_sum(list_transform(emb, lambda x: x * x))) AS n FROM sumpool) b) p) s) t
WHERE rk <= {K_DOCS}""", "vq", "sumpool"),
        "eval_sum_report": _eval_sql(list(_METRIC_COLS), "sumrun", "vdq", ("sumrun", "vdq")),
        "eval_mean_report": _eval_sql(list(_METRIC_COLS), "meanrun", "vdq", ("meanrun", "vdq")),
        "rerank_max_first5": sql("""SELECT query_id, doc_id, passage_idx, passage_rank, rank, round(score, 6) AS score FROM maxp
WHERE query_id IN (SELECT DISTINCT query_id FROM prun ORDER BY query_id LIMIT 5)""", "maxp", "prun"),
        "rolled_negatives_no_positives": sql("""SELECT n.query_id, n.pos, n.neg_no, n.neg FROM negs n
WHERE NOT EXISTS (SELECT 1 FROM cq c WHERE c.query_id = n.query_id AND c.doc_id = n.neg)""", "negs", "cq"),
        "conversation_pool_mean": sql(f"""SELECT d.doc_id, r.dim, round(coalesce(v.sv, CAST(0 AS DOUBLE)) / d.nt, 6) AS value
FROM (SELECT doc_id, count(*) AS nt FROM ct GROUP BY doc_id) d
CROSS JOIN (SELECT CAST(range AS INTEGER) AS dim FROM range({EMBED_DIM})) r
LEFT JOIN (SELECT b.doc_id, b.dim, sum(CAST(CAST(b.c / n.nrm AS FLOAT) AS DOUBLE)) AS sv
           FROM cb b JOIN (SELECT doc_id, turn, sqrt(sum(c * c)) AS nrm FROM cb GROUP BY doc_id, turn) n
             ON n.doc_id = b.doc_id AND n.turn = b.turn
           GROUP BY b.doc_id, b.dim) v ON v.doc_id = d.doc_id AND v.dim = r.dim""", "ct", "cb"),
        "negatives_wide": sql("SELECT query_id, pos, " + ", ".join(
            f"max(CASE WHEN neg_no = {i} THEN neg END) AS neg_{i}" for i in range(1, N_NEGATIVES + 1))
            + " FROM negs GROUP BY query_id, pos", "negs"),
        "triplets_cycle_epoch60": _triplets_sql(60).replace(f"WHERE n.neg_no = least(60, {N_NEGATIVES})",
                                                            f"WHERE n.neg_no = ((60 - 1) % {N_NEGATIVES}) + 1"),
        "passages_capped": sql("SELECT doc_id, passage_idx, passage_id FROM vp WHERE passage_idx < 16", "vp"),
        "pool_mean": _pool_sql("mean"),
        "pool_sum": _pool_sql("sum"),
        "pool_max": _pool_sql("max"),
        "pool_first": _pool_sql("first"),
        "pool_masked_mean": _pool_sql("masked_mean"),
        "pool_nested_mean": _pool_sql("mean"),
        "embed_documents_masked_mean": _pool_sql("masked_mean"),
        "l2_normalize": sql("""SELECT s.doc_id, CAST(s.dim AS INTEGER) AS dim,
       round(CASE WHEN n.nrm = 0 THEN s.v ELSE s.v / n.nrm END, 6) AS value
FROM (SELECT doc_id, dim, sum(CAST(v AS DOUBLE)) AS v FROM pe GROUP BY doc_id, dim) s
JOIN (SELECT doc_id, sqrt(sum(v * v)) AS nrm FROM (SELECT doc_id, dim, sum(CAST(v AS DOUBLE)) AS v FROM pe GROUP BY doc_id, dim) x
      GROUP BY doc_id) n ON n.doc_id = s.doc_id""", "pe"),
        "topk_ip": _topk_sql("ip"),
        "topk_l2": _topk_sql("l2"),
        "topk_cosine": _topk_sql("cosine"),
        "topk_ip_blocks": _topk_sql("ip"),
        "topk_vectors_grid": _vector_topk_sql("ip"),
        **{f"topk_vectors_{m}": _vector_topk_sql(m) for m in search.METRICS},
        "topk_index": "\nUNION ALL\n".join(f"SELECT *, '{m}' AS metric FROM ({_vector_topk_sql(m)})" for m in search.METRICS),
        "topk_passages": sql(f"""SELECT query_id, passage_id, CAST(prank AS INTEGER) AS rank, round(score, 6) AS score
FROM prun WHERE prank <= {K_DOCS}""", "prun"),
        "rerank_max": sql("SELECT query_id, doc_id, passage_idx, passage_rank, rank, round(score, 6) AS score FROM maxp",
                          "maxp"),
        "rerank_sum": sql("""SELECT query_id, doc_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY sum_score DESC, doc_id) AS INTEGER) AS rank,
       round(sum_score, 6) AS score FROM cand_scores""", "cand_scores"),
        "rerank_sum_buckets": sql("""SELECT query_id, doc_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY sum_score DESC, doc_id) AS INTEGER) AS rank,
       round(sum_score, 6) AS score FROM cand_scores""", "cand_scores"),
        "rerank_mean": sql("""SELECT query_id, doc_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY mean_score DESC, doc_id) AS INTEGER) AS rank,
       round(mean_score, 6) AS score FROM cand_scores""", "cand_scores"),
        "position_histogram_50": _hist_sql(HISTOGRAM_BINS, None),
        "position_histogram_first10": _hist_sql(FIRST_POSITIONS, FIRST_POSITIONS),
        "eval_rr10": _eval_sql(["RR@10"]),
        "eval_rr100": _eval_sql(["RR@100"]),
        "eval_ndcg10": _eval_sql(["nDCG@10"]),
        "eval_recall1000": _eval_sql(["R@1000"]),
        "eval_ap100": _eval_sql(["AP@100"]),
        "eval_report": _eval_sql(list(_METRIC_COLS)),
        "eval_per_query": _eval_per_query_sql(),
        "eval_maxp_report": _eval_sql(list(_METRIC_COLS), "maxprun", "vdq", ("maxprun", "vdq")),
        "training_pairs": sql("""SELECT r.query_id, r.doc_id, CAST(cs.n_passages AS INTEGER) AS n_passages,
       round(cs.checksum, 4) AS checksum, round(qc.qsum, 6) AS query_checksum
FROM (SELECT DISTINCT query_id, doc_id FROM vdq WHERE relevance >= 1) r
JOIN (SELECT query_id, sum(CAST(x AS DOUBLE) * (j + 1)) AS qsum FROM
        (SELECT query_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS j FROM vq) e GROUP BY query_id) qc
  ON qc.query_id = r.query_id
JOIN (SELECT doc_id, count(DISTINCT passage_idx) AS n_passages,
             sum(CAST(v AS DOUBLE) * (dim + 1) * (passage_idx + 1)) AS checksum FROM pe GROUP BY doc_id) cs
  ON cs.doc_id = r.doc_id""", "vdq", "vq", "pe"),
        "training_unmatched": sql("""SELECT q.query_id FROM tq q WHERE NOT EXISTS (
  SELECT 1 FROM tqrels r JOIN docs d ON d.doc_id = r.doc_id
  WHERE r.query_id = q.query_id AND r.relevance >= 1 AND d.body IS NOT NULL AND d.body <> '')""", "tq", "tqrels", "docs"),
        "prepared_docs": sql("SELECT doc_id, text FROM prepared", "prepared"),
        "clean_qrels_untitled": sql("""SELECT query_id, doc_id, relevance FROM tqrels
WHERE doc_id NOT IN (SELECT doc_id FROM uremoved)""", "tqrels", "uremoved"),
        "prepared_docs_untitled": sql("""SELECT doc_id, concat(title, body) AS text FROM udocs
WHERE doc_id NOT IN (SELECT doc_id FROM uremoved)""", "udocs", "uremoved"),
        "prepared_docs_body_only": sql("SELECT doc_id, body AS text FROM udocs", "udocs"),
        "clean_qrels": sql("SELECT query_id, doc_id, relevance FROM cq", "cq"),
        "sample_corpus_docs": sql(f"SELECT doc_id, url, title, body FROM docs WHERE doc_id IN {first_docs}",
                                  "docs", "tq", "tqrels"),
        "sample_corpus_qrels": sql(f"SELECT query_id, doc_id, relevance FROM tqrels WHERE doc_id IN {first_docs}",
                                   "tq", "tqrels"),
        "rolled_negatives": sql("SELECT query_id, pos, neg_no, neg FROM negs", "negs"),
        "triplets_epoch1": _triplets_sql(1),
        "triplets_epoch60": _triplets_sql(60),
        "in_batch_loss": sql("""SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, round(avg(loss), 6) AS loss FROM (
  SELECT l.batch, l.query_id, l.doc_id, m.mx + ln(sum(exp(l.logit - m.mx))) - m.dl AS loss
  FROM losslg l JOIN (SELECT batch, query_id, doc_id, max(logit) AS mx, max(CASE WHEN diag THEN logit END) AS dl
                      FROM losslg GROUP BY batch, query_id, doc_id) m
    ON m.batch = l.batch AND m.query_id = l.query_id AND m.doc_id = l.doc_id
  GROUP BY l.batch, l.query_id, l.doc_id, m.mx, m.dl) t GROUP BY batch""", "losslg"),
        "run_trec_lines": sql(f"""SELECT printf('%s{TAB}0{TAB}%s{TAB}%d{TAB}%.6f{TAB}%s', query_id, doc_id, rk, round(score, 6),
       '{RUN_NAME}') AS line
FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk
      FROM (SELECT q.query_id, p.doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), p.emb) AS score
            FROM vq q CROSS JOIN sumpool p) s) t WHERE rk <= {K_DOCS}""", "vq", "sumpool"),
        "contiguous_shards": sql("""SELECT doc_id, CAST(CASE WHEN r < (n % 3) * (n // 3 + 1) THEN r // (n // 3 + 1)
       ELSE (n % 3) + (r - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS shard
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM docs) ix""", "docs"),
        "contiguous_shards_proportional": sql("""SELECT ix.doc_id, CAST(max(b.k) AS INTEGER) AS shard
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM docs) ix
JOIN (SELECT range AS k FROM range(7)) b
  ON CAST(floor(CAST(b.k AS DOUBLE) / CAST(7 AS DOUBLE) * CAST(ix.n AS DOUBLE)) AS BIGINT) <= ix.r
GROUP BY ix.doc_id""", "docs"),
        "embed_hashed_queries": sql("SELECT query_id, dim, round(value, 6) AS value FROM tqv WHERE value <> 0", "tqv"),
        "topk_text_passages": sql("""SELECT query_id, passage_id, CAST(rk AS INTEGER) AS rank, round(score, 6) AS score
FROM tprun""", "tprun"),
        "eval_text_recall1000": _text_recall_sql(),
        "eval_text_maxp_report": _eval_sql(
            list(_METRIC_COLS), "tmaxp", "tqrels", ("tprun", "tqrels")).replace(
            "\nrr AS (", """
tmaxp AS (SELECT query_id, doc_id, score FROM (SELECT query_id, split_part(passage_id, '_', 1) AS doc_id, score,
           row_number() OVER (PARTITION BY query_id, split_part(passage_id, '_', 1) ORDER BY rk) AS n FROM tprun) t
          WHERE n = 1),
rr AS (""", 1),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _spark_queries()


def oracle_sql() -> dict[str, str]:
    return _oracle_sql()
