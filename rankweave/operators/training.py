"""Training tables: (query vector, passage vectors) pairs, prepared document
texts, cleaned judgements, rolled negatives, triplets and the small sample.

All of them are joins, windows and aggregates, but the rolled negatives ("the
n-th negative is the document n rows back, wrapping round"): there the rows are
range-partitioned in their order once, every partition gets the last n rows
before its first one (a halo), and one pass over each partition makes the
negatives in place. No position is joined, no row is exploded before it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.defaults import N_NEGATIVES, SAMPLE_QUERIES
from rankweave.operators.partitioning import ordered_parts
from rankweave.operators.passages import nest
from rankweave.session import written

ON_EXHAUST = ("stick", "cycle")
MAX_BROADCAST_IDS = 2_000_000  # document ids broadcast as a semi-join filter
MAX_HALO_ROWS = 1_000_000  # halo rows (partitions x negatives) that are broadcast; more are shuffled to their partition
NEGATIVE_ROWS = 100_000  # rows of an output batch


# ------------------------------------------------------------------ pairs

def relevant_pairs(qrels: DataFrame) -> DataFrame:
    return qrels.where(F.col("relevance") >= 1).select("query_id", "doc_id").distinct()


def pairs(query_embeddings: DataFrame, qrels: DataFrame, passages: DataFrame, *, query_vec: str = "embedding",
          passage_vec: str = "passage_embedding", max_passages: int | None = None,
          query_cols: dict[str, Column] | None = None, doc_cols: dict[str, Column] | None = None) -> DataFrame:
    """One row per judged-relevant (query, document) with a known query vector and
    a document with passages:
    (query_id, doc_id, query_embedding, doc_passage_embeddings ARRAY<ARRAY<FLOAT>>)
    with the passage vectors in passage order.

    ``query_cols`` and ``doc_cols`` (name: expression over ``query_embedding`` or
    ``doc_passage_embeddings``) replace those columns: what is made of one query's or one
    document's vectors is made once for it and not once for each pair, and the vectors
    themselves meet no pair."""
    rel = relevant_pairs(qrels)
    # only judged documents are nested: the passage table is semi-joined to
    # their ids first, so the nesting shuffle carries just those passages
    needed = passages.select("doc_id", "passage_idx", passage_vec).join(
        rel.select("doc_id").distinct(), "doc_id", "left_semi")
    nested = nest(needed, fields=["passage_idx", passage_vec], out_col="_ps", max_passages=max_passages)
    docs = nested.select("doc_id", F.transform("_ps", lambda p: p[passage_vec]).alias("doc_passage_embeddings"))
    q = query_embeddings.select("query_id", F.col(query_vec).alias("query_embedding"))
    if query_cols is not None:
        q = q.select("query_id", *[c.alias(n) for n, c in query_cols.items()])
    if doc_cols is not None:
        docs = docs.select("doc_id", *[c.alias(n) for n, c in doc_cols.items()])
    return rel.join(q, "query_id").join(docs, "doc_id").select("query_id", "doc_id", *q.columns[1:], *docs.columns[1:])


def unmatched(query_embeddings: DataFrame, qrels: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries with a vector but no usable pair (no relevant judgement, or only
    documents without passages): (query_id)."""
    rel = relevant_pairs(qrels)
    # documents with passages, looked up only for judged documents
    have_docs = passages.select("doc_id").join(rel.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    usable = rel.join(have_docs, "doc_id", "left_semi").select("query_id")
    return query_embeddings.select("query_id").join(usable, "query_id", "left_anti")


# ------------------------------------------------------------------ documents

def prepare_docs(docs: DataFrame, prepend_title: bool = True, max_chars: int | None = None) -> DataFrame:
    """(doc_id, text). With the title: only documents with a non-empty title
    and body; text = title || body (no separator), whole or cut to ``max_chars``
    characters. Without: text = body, uncut, every document."""
    if not prepend_title:
        return docs.select("doc_id", F.col("body").alias("text"))
    ok = F.col("title").isNotNull() & (F.col("title") != "") & F.col("body").isNotNull() & (F.col("body") != "")
    text = F.concat("title", "body")
    return docs.where(ok).select("doc_id", (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"))


def removed_docs(docs: DataFrame, prepend_title: bool = True) -> DataFrame:
    """Documents that ``prepare_docs`` drops: (doc_id)."""
    if not prepend_title:
        return docs.select("doc_id").where(F.lit(False))
    ok = F.col("title").isNotNull() & (F.col("title") != "") & F.col("body").isNotNull() & (F.col("body") != "")
    return docs.where(~ok).select("doc_id")


def clean_qrels(qrels: DataFrame, removed: DataFrame) -> DataFrame:
    """Judgements whose document was not removed (null-safe anti join)."""
    return qrels.join(removed.select("doc_id"), "doc_id", "left_anti").select(*qrels.columns)


# ------------------------------------------------------------------ sample

def sample_corpus(queries: DataFrame, qrels: DataFrame, docs: DataFrame, n: int = SAMPLE_QUERIES, *,
                  order_by: str = "query_id", qrel_order: list[str] | str = "doc_id"):
    """The small development set: the first ``n`` queries (in ``order_by``
    order), the first judged document of each (in ``qrel_order``), the
    documents in that set, and every judgement of those documents.

    Returns (queries, docs, qrels)."""
    sampled = queries.orderBy(order_by).limit(n)
    keys = [qrel_order] if isinstance(qrel_order, str) else list(qrel_order)
    # first judgement per query as a partially aggregated min_by (no window on a possibly hot query)
    first = (qrels.join(sampled.select("query_id"), "query_id", "left_semi").groupBy("query_id")
             .agg(F.min_by("doc_id", F.struct(*[F.col(c) for c in keys])).alias("doc_id"))
             .select("doc_id").distinct())
    kept_docs = docs.join(first, "doc_id", "left_semi")
    kept_qrels = qrels.join(first, "doc_id", "left_semi")
    return sampled, kept_docs, kept_qrels


# ------------------------------------------------------------------ negatives

def rolled_negatives(qrels: DataFrame, n_negatives: int = N_NEGATIVES, *, order_by=("query_id", "doc_id"),
                     exclude_positives: bool = False, max_halo_rows: int = MAX_HALO_ROWS) -> DataFrame:
    """Long form (query_id, pos, neg_no INT, neg): with the judgement rows in
    ``order_by`` order, row r's i-th negative is the document of row (r - i) mod N.

    With ``exclude_positives`` a negative that is a relevant document of the
    same query is dropped (the reference keeps them)."""
    if n_negatives < 1:
        raise ValueError("n_negatives must be >= 1")
    if exclude_positives:
        qrels = written(qrels, "qrels")  # read twice
    out = _rolled(qrels.select("query_id", "doc_id"), n_negatives, list(order_by), max_halo_rows)
    if exclude_positives:
        rel = qrels.select("query_id", F.col("doc_id").alias("neg"))
        out = out.join(rel, ["query_id", "neg"], "left_anti")
    return out


def halo_sources(parts: list[tuple[int, int, int]], n: int) -> dict[int, list[tuple[int, int]]]:
    """For each partition the (partition, place) of the n rows before its first
    one, the nearest last, going round from the first row to the last."""
    out = {}
    for k, (pid, _, _) in enumerate(parts):
        held: list[tuple[int, int]] = []
        j = k
        while len(held) < n:
            j = (j - 1) % len(parts)
            p, _, size = parts[j]
            held += [(p, i) for i in range(size - 1, max(-1, size - 1 - (n - len(held))), -1)]
        out[pid] = held[::-1]
    return out


def _rolled(rows: DataFrame, n: int, order_by: list[str], max_halo_rows: int) -> DataFrame:
    """(query_id, pos, neg_no, neg): rows (query_id, doc_id) in order, each with the n documents before it."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    schema = f"query_id {kinds['query_id']}, pos {kinds['doc_id']}, neg_no int, neg {kinds['doc_id']}"
    ordered, parts = ordered_parts(rows, order_by)
    spark = rows.sparkSession
    if not parts:
        return spark.createDataFrame([], schema)
    numbers = np.arange(1, n + 1)

    def negatives(before: pa.Array, query: pa.Array, doc: pa.Array):
        whole = pa.concat_arrays([before, doc])
        step = max(1, NEGATIVE_ROWS // n)
        for at in range(0, len(doc), step):
            m = min(step, len(doc) - at)
            own = np.repeat(np.arange(at, at + m), n)
            yield pa.RecordBatch.from_arrays(
                [query.take(pa.array(own)), doc.take(pa.array(own)), pa.array(np.tile(numbers, m), pa.int32()),
                 whole.take(pa.array(n + own - np.tile(numbers, m)))], names=["query_id", "pos", "neg_no", "neg"])

    # the last rows of every partition are all that any halo holds
    last = spark.createDataFrame([(pid, max(0, size - n)) for pid, _, size in parts], "_pid long, _from long")
    ends = ordered.join(F.broadcast(last), "_pid").where("_pos >= _from").select("_pid", "_pos", "doc_id")
    if len(parts) * n <= max_halo_rows:
        held = ends.toArrow()
        at = {key: i for i, key in enumerate(zip(held["_pid"].to_pylist(), held["_pos"].to_pylist()))}
        ids = held["doc_id"].combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        bc = spark.sparkContext.broadcast((ids, {pid: [at[s] for s in sources]
                                                 for pid, sources in halo_sources(parts, n).items()}))

        def in_place(batches):
            before = None
            for b in batches:
                if not b.num_rows:
                    continue
                if before is None:
                    ids, sources = bc.value
                    before = ids.take(pa.array(sources[b.column(2)[0].as_py()]))
                yield from negatives(before, b.column(0), b.column(1))
                before = pa.concat_arrays([before, b.column(1)]).slice(b.num_rows)

        return ordered.select("query_id", "doc_id", "_pid").mapInArrow(in_place, schema)

    # more halo rows than a broadcast should hold: the rows and the halos meet in one
    # exchange by partition, halo rows first (their places are negative)
    sources = [(pid, i - n, p, pos) for pid, held in halo_sources(parts, n).items() for i, (p, pos) in enumerate(held)]
    wanted = spark.createDataFrame(sources, "_to long, _place long, _pid long, _pos long")
    halo = ends.join(wanted, ["_pid", "_pos"]).select(
        F.col("_to").alias("_pid"), F.col("_place").alias("_pos"), F.lit(None).cast(kinds["query_id"]).alias("query_id"),
        "doc_id")
    both = ordered.select("_pid", "_pos", "query_id", "doc_id").unionByName(halo)
    both = both.repartition(len(parts), "_pid").sortWithinPartitions("_pid", "_pos")

    def after_halo(batches):
        before = current = None
        for b in batches:
            pid, pos = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(pid[1:] != pid[:-1]) + 1).tolist(), len(pid)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if pid[x] != current:
                    current, before = pid[x], b.column(3).slice(0, 0)
                ahead = int((pos[x:y] < 0).sum())
                before = pa.concat_arrays([before, b.column(3).slice(x, ahead)])
                query, doc = b.column(2).slice(x + ahead, y - x - ahead), b.column(3).slice(x + ahead, y - x - ahead)
                if len(doc):
                    yield from negatives(before, query, doc)
                    before = pa.concat_arrays([before, doc]).slice(len(doc))

    return both.mapInArrow(after_halo, schema)


def wide_negatives(negatives: DataFrame, n_negatives: int) -> DataFrame:
    """Wide form of the rolled negatives: (query_id, pos, neg_1 .. neg_n), one
    row per judgement. A pivot with the values given, so no job is run to find
    them; each (query, pos, neg_no) holds one negative."""
    if n_negatives < 1:
        raise ValueError("n_negatives must be >= 1")
    wide = negatives.groupBy("query_id", "pos").pivot("neg_no", list(range(1, n_negatives + 1))).agg(
        F.first("neg"))
    return wide.select("query_id", "pos", *[F.col(str(i)).alias(f"neg_{i}") for i in range(1, n_negatives + 1)])


def negative_for_epoch(epoch: int, n_negatives, on_exhaust: str = "stick"):
    """Number of the negative used on the ``epoch``-th visit (1-based) of a row:
    1, 2, ..., n, then n again ("stick") or 1, 2, ... again ("cycle")."""
    if on_exhaust not in ON_EXHAUST:
        raise ValueError(f"on_exhaust must be one of {ON_EXHAUST}")
    if epoch < 1:
        raise ValueError("epoch is 1-based")
    n = F.lit(n_negatives) if isinstance(n_negatives, int) else n_negatives
    if on_exhaust == "stick":
        return F.least(F.lit(epoch), n)
    return F.pmod(F.lit(epoch - 1), n) + 1


def triplets(negatives: DataFrame, prepared: DataFrame, queries: DataFrame, epoch: int = 1, *,
             n_negatives: int | None = None, on_exhaust: str = "stick",
             max_broadcast_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """(query_id, pos, neg, query_text, pos_text, neg_text) for one epoch.

    Rows whose query, positive or negative text is unknown are dropped (the
    reference's dictionaries would fail on them). The prepared documents are
    joined twice; Spark reuses the one exchange of that side."""
    n = n_negatives if n_negatives is not None else negatives.select(F.max("neg_no")).scalar()
    # ids only, written once: the joins behind the negatives are not repeated
    pick = written(negatives.where(F.col("neg_no") == negative_for_epoch(epoch, n, on_exhaust))
                   .select("query_id", "pos", "neg"), "triplets")
    # only documents used as a positive or negative are joined: the prepared
    # texts are filtered by those ids in place (broadcast, size checked)
    # before the two shuffle joins
    used = written(pick.select(F.col("pos").alias("doc_id")).union(pick.select(F.col("neg").alias("doc_id"))).distinct(),
                   "used")
    if used.count() <= max_broadcast_ids:
        prepared = prepared.join(F.broadcast(used), "doc_id", "left_semi")
    qt = queries.select("query_id", F.col("text").alias("query_text"))
    pt = prepared.select(F.col("doc_id").alias("pos"), F.col("text").alias("pos_text"))
    nt = prepared.select(F.col("doc_id").alias("neg"), F.col("text").alias("neg_text"))
    return (pick.join(qt, "query_id").join(pt, "pos").join(nt, "neg")
            .select("query_id", "pos", "neg", "query_text", "pos_text", "neg_text"))


# ------------------------------------------------------------------ save / load

TRAINING_TABLES = ("docs_prepped", "train_queries", "dev_queries", "train_indexes", "dev_indexes")


def save(tables: dict[str, DataFrame], path: str, *, mode: str = "errorifexists") -> None:
    """Write the training tables as Parquet under one directory."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def load(spark, path: str, names=TRAINING_TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}
