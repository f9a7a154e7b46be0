"""End-to-end chains, each one lazy plan from the tables to the result.

* passage representation: documents -> non-empty -> passages -> vectors
* pooled document ranking: passage vectors -> document vectors -> top-k -> evaluation
* passage ranking: passage top-k -> MaxP / Sum / Mean document runs -> evaluation
* training tables: prepared documents -> cleaned judgements -> rolled negatives -> triplets
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankweave.defaults import (N_NEGATIVES, PASSAGE_SIZE, QUERY_ENCODE_BATCH, TOP_K_DOCS,
                                TOP_K_PASSAGES)
from rankweave.operators import embed, metrics, passages, pooling, rerank, search, training


def passage_vectors(docs: DataFrame, encoder_factory, *, passage_size: int = PASSAGE_SIZE, prepend_title: bool = True,
                    batch_size: int = QUERY_ENCODE_BATCH) -> DataFrame:
    """(doc_id, passage_idx, passage_id, passage_embedding): one narrow stage, no shuffle."""
    p = passages.split_passages(passages.drop_empty(docs), passage_size, prepend_title, keep=[])
    return embed.embed(p, "passage_body", encoder_factory, out_col="passage_embedding", batch_size=batch_size)


def pooled_ranking(passage_vecs: DataFrame, query_vecs: DataFrame, k: int = TOP_K_DOCS, *, method: str = "mean",
                   metric: str = "ip", normalize: bool = False) -> DataFrame:
    """Document run (query_id, doc_id, rank, score) over pooled document vectors."""
    docs = pooling.pool(passage_vecs, method)
    col = "doc_embedding"
    if normalize:
        docs = pooling.l2_normalize(docs, col, "norm_embedding")
        col = "norm_embedding"
    return search.top_k(query_vecs, docs, k, metric, corpus_id="doc_id", corpus_vec=col)


def passage_ranking(passage_vecs: DataFrame, query_vecs: DataFrame, k: int = TOP_K_PASSAGES, *,
                    metric: str = "ip") -> DataFrame:
    """Passage run (query_id, passage_id, rank, score)."""
    return search.top_k(query_vecs, passage_vecs, k, metric, corpus_id="passage_id", corpus_vec="passage_embedding")


def doc_runs_from_passages(passage_run: DataFrame, passage_vecs: DataFrame, query_vecs: DataFrame) -> dict:
    """MaxP, SumP and MeanP document runs from one passage run."""
    maxp = rerank.max_p(passage_run).select("query_id", "doc_id", "rank", "score")
    ds = rerank.doc_scores(passage_run, passage_vecs, query_vecs)
    return {"max": maxp, "sum": rerank.rank_docs(ds, "sum_score"), "mean": rerank.rank_docs(ds, "mean_score")}


def evaluation_report(run: DataFrame, qrels: DataFrame, metrics_=metrics.DEFAULT_METRICS) -> DataFrame:
    return metrics.evaluate(run, qrels, metrics_)


def training_tables(docs: DataFrame, queries: DataFrame, qrels: DataFrame, *, n_negatives: int = N_NEGATIVES,
                    prepend_title: bool = True, max_chars: int | None = None) -> dict:
    """Prepared documents, cleaned judgements and rolled negatives."""
    prepared = training.prepare_docs(docs, prepend_title, max_chars)
    cleaned = training.clean_qrels(qrels, training.removed_docs(docs, prepend_title))
    negatives = training.rolled_negatives(cleaned, n_negatives)
    return {"docs_prepped": prepared, "queries": queries, "qrels": cleaned, "indexes": negatives}
