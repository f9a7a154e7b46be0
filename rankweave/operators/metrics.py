"""Run evaluation: RR@k, nDCG@k, R@k, AP@k per query and their mean; in-batch loss.

Pinned semantics:
  * run rows are ranked by score descending, then doc_id descending (the
    trec_eval convention) and ranks are recomputed; ``order_by="rank"`` keeps
    the run's own order;
  * relevant means relevance >= 1; nDCG uses linear gain ``rel / log2(rank+1)``
    with the ideal ranking taken from the judgements (all of them, not only the
    retrieved ones);
  * R@k and AP@k divide by the number of relevant judgements of the query;
  * queries in the run without judgements are ignored; judged queries absent
    from the run score 0; a query whose judgements are all 0 scores 0.

Every step is a shuffle on query_id (a run holds at most k rows per query) or
an aggregate with partial aggregation; nothing is collected.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rankweave.defaults import METRICS, PERCENT_DIGITS, REPORT_DIGITS
from rankweave.functions.vectors import list_column_to_matrix
from rankweave.operators.packs import pack_numbers, unpack_numbers
from rankweave.session import ensure_checkpoint_dir, written

DEFAULT_METRICS = METRICS
MAX_BROADCAST_JUDGEMENTS = 2_000_000  # (query, doc, grade) rows broadcast into the run join
LOSS_CELL_BYTES = 256 << 20  # vectors of a cell of batches, at most
MAX_CELL_TASKS = 2000
CELLS_PER_CORE = 2  # ranges of document numbers
PACK_PAIRS = 1 << 21  # pairs that are dealt to cells and packed at once, about
LOSS_ROWS = 4096  # rows of the batches whose logits are made at once, about


def parse_metric(name: str) -> tuple[str, int]:
    m = re.fullmatch(r"(RR|nDCG|R|AP)@(\d+)", name.strip())
    if not m:
        raise ValueError(f"unknown metric {name!r}; use RR@k, nDCG@k, R@k or AP@k")
    return m.group(1), int(m.group(2))


def column_name(name: str) -> str:
    fam, k = parse_metric(name)
    return {"RR": "rr", "nDCG": "ndcg", "R": "recall", "AP": "ap"}[fam] + f"_{k}"


def rank_run(run: DataFrame, *, query_id: str = "query_id", doc_id: str = "doc_id", order_by: str = "score",
             by: list[str] | tuple = ()) -> DataFrame:
    """([by,] query_id, doc_id, rank INT) with ranks recomputed per query (and run)."""
    if order_by == "score":
        order = [F.col("score").desc(), F.col(doc_id).desc()]
    elif order_by == "rank":
        order = [F.col("rank").asc(), F.col(doc_id).asc()]
    else:
        raise ValueError("order_by must be 'score' or 'rank'")
    w = Window.partitionBy(*by, query_id).orderBy(*order)
    return run.select(*by, F.col(query_id).alias("query_id"), F.col(doc_id).alias("doc_id"),
                      F.row_number().over(w).cast("int").alias("rank"))


def per_query(run: DataFrame, qrels: DataFrame, metrics=DEFAULT_METRICS, *, order_by: str = "score",
              max_broadcast_judgements: int = MAX_BROADCAST_JUDGEMENTS, by: list[str] | tuple = ()) -> DataFrame:
    """One row per judged query: (query_id, <metric columns>) as DOUBLE. With ``by``
    (such as ``["name"]``) the frame holds several runs, each evaluated on its own:
    a row per run and judged query, led by the columns of ``by``."""
    by = list(by)
    if by:
        run = written(run, "runs")  # read for the names of the runs, too
    parsed = [(m, *parse_metric(m)) for m in metrics]
    kmax = max(k for _, _, k in parsed)
    ranked = rank_run(run, order_by=order_by, by=by).where(F.col("rank") <= kmax)
    # one judgement per (query, doc): the highest grade (partial aggregate)
    q = qrels.groupBy("query_id", "doc_id").agg(F.max(F.col("relevance").cast("int")).alias("rel"))
    # judgements are small next to a corpus: under the checked bound they are
    # broadcast, so the run keeps its query_id partitioning for the window and
    # the per-query aggregates below; above it, a shuffle join
    # used three times below and counted now: materialised once (reliable
    # checkpoint folder) so a derived judgement table is not recomputed
    ensure_checkpoint_dir(run.sparkSession)
    q = q.checkpoint(eager=True)
    side = F.broadcast(q) if q.count() <= max_broadcast_judgements else q
    j = ranked.join(side, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    is_rel = F.col("rel") >= 1
    hits_w = Window.partitionBy(*by, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("_hits", F.sum(is_rel.cast("int")).over(hits_w))

    # judgement side: number of relevant docs (plain aggregate) and ideal DCG
    # from the best ``k`` judgements per query (row_number <= k is planned as a
    # WindowGroupLimit before the shuffle, so a query with many judgements
    # sends only k rows per task)
    nrel = q.groupBy("query_id").agg(F.sum((F.col("rel") >= 1).cast("long")).alias("_nrel"))
    ideal_ks = sorted({k for _, fam, k in parsed if fam == "nDCG"})
    judged = nrel
    if ideal_ks:
        iw = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), F.col("doc_id"))
        qi = q.withColumn("_ir", F.row_number().over(iw)).where(F.col("_ir") <= max(ideal_ks))
        gain = F.when(F.col("rel") > 0, F.col("rel")).otherwise(F.lit(0)).cast("double")
        idcg = qi.groupBy("query_id").agg(*[
            F.sum(F.when(F.col("_ir") <= k, gain / F.log2(F.col("_ir") + 1)).otherwise(F.lit(0.0))).alias(f"_idcg_{k}")
            for k in ideal_ks])
        judged = nrel.join(idcg, "query_id", "left")

    run_aggs = []
    for _, fam, k in parsed:
        inside = F.col("rank") <= k
        if fam == "RR":
            run_aggs.append(F.max(F.when(inside & is_rel, 1.0 / F.col("rank")).otherwise(F.lit(0.0))).alias(f"_m_rr_{k}"))
        elif fam == "R":
            run_aggs.append(F.sum(F.when(inside & is_rel, F.lit(1.0)).otherwise(F.lit(0.0))).alias(f"_m_r_{k}"))
        elif fam == "AP":
            run_aggs.append(F.sum(F.when(inside & is_rel, F.col("_hits") / F.col("rank")).otherwise(F.lit(0.0)))
                            .alias(f"_m_ap_{k}"))
        elif fam == "nDCG":
            g = F.when(F.col("rel") > 0, F.col("rel")).otherwise(F.lit(0)).cast("double")
            run_aggs.append(F.sum(F.when(inside, g / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0)))
                            .alias(f"_m_ndcg_{k}"))
    per_run = j.groupBy(*by, "query_id").agg(*run_aggs)
    if by:  # every run has a row for every judged query
        runs = run.select(*by).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        judged = judged.crossJoin(F.broadcast(runs))  # the names of the runs, a few rows
        per_run = per_run.withColumnsRenamed({"query_id": "_q", **{c: f"_by_{c}" for c in by}})
        both = judged.join(per_run, [F.col("query_id") == F.col("_q"), *same], "left")
    else:
        both = judged.join(per_run, "query_id", "left")
    nrel = F.col("_nrel").cast("double")
    out = [*map(F.col, by), F.col("query_id")]
    for name, fam, k in parsed:
        col = column_name(name)
        if fam == "RR":
            v = F.coalesce(F.col(f"_m_rr_{k}"), F.lit(0.0))
        elif fam == "R":
            v = F.when(nrel > 0, F.coalesce(F.col(f"_m_r_{k}"), F.lit(0.0)) / nrel).otherwise(F.lit(0.0))
        elif fam == "AP":
            v = F.when(nrel > 0, F.coalesce(F.col(f"_m_ap_{k}"), F.lit(0.0)) / nrel).otherwise(F.lit(0.0))
        else:
            idcg = F.col(f"_idcg_{k}")
            v = F.when(idcg > 0, F.coalesce(F.col(f"_m_ndcg_{k}"), F.lit(0.0)) / idcg).otherwise(F.lit(0.0))
        out.append(v.cast("double").alias(col))
    return both.select(*out)


def evaluate(run: DataFrame, qrels: DataFrame, metrics=DEFAULT_METRICS, *, order_by: str = "score",
             max_broadcast_judgements: int = MAX_BROADCAST_JUDGEMENTS, by: list[str] | tuple = ()) -> DataFrame:
    """Mean of each metric over judged queries: rows ([by,] metric STRING, value DOUBLE)."""
    by = list(by)
    pq = per_query(run, qrels, metrics, order_by=order_by, max_broadcast_judgements=max_broadcast_judgements, by=by)
    means = (pq.groupBy(*by) if by else pq).agg(*[F.avg(column_name(m)).alias(column_name(m)) for m in metrics])
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(column_name(m)), F.lit(0.0))
                                           .alias("value")) for m in metrics]))
    return means.select(*by, stacked.alias("s")).select(*by, "s.metric", "s.value")


def report(evaluation: DataFrame, *, percent: bool = False) -> DataFrame:
    """Rounded report: 4 decimals, or x100 with 2 decimals when ``percent``."""
    if percent:
        return evaluation.select("metric", F.round(F.col("value") * 100, PERCENT_DIGITS).alias("value"))
    return evaluation.select("metric", F.round("value", REPORT_DIGITS).alias("value"))


def _losses(qm: np.ndarray, dm: np.ndarray) -> np.ndarray:
    """The loss of each of the batches (batches, rows, dimensions); one query (batches, 1,
    dimensions) stands for equal ones in all rows, which have the same logits."""
    logits = qm.astype(np.float64) @ dm.astype(np.float64).transpose(0, 2, 1)
    mx = logits.max(axis=2, keepdims=True)
    lse = mx[..., 0] + np.log(np.exp(logits - mx).sum(axis=2))
    own = logits[:, 0] if logits.shape[1] == 1 else np.diagonal(logits, axis1=1, axis2=2)
    return (lse - own).mean(axis=1)


def in_batch_loss(pairs: DataFrame, *, query_vec: str = "query_embedding", doc_vec: str = "doc_embedding",
                  batch_col: str = "batch", queries: DataFrame | None = None, docs: DataFrame | None = None,
                  query_no: str = "query_no", doc_no: str = "doc_no", cell_bytes: int = LOSS_CELL_BYTES) -> DataFrame:
    """In-batch contrastive loss per batch: logits = Q . D^T inside the batch,
    cross-entropy with the diagonal (each query's own document) as label, mean
    over the batch. Rows (batch, n, loss).

    Each batch is one group of ``applyInPandas`` (batches come from
    ``partitioning.assign_batches`` so their size is bounded); only one row per
    batch leaves the task, the batch x batch logits never become rows.

    With ``queries`` (``query_no``, ``query_vec``) and ``docs`` (``doc_no``, ``doc_vec``)
    the pairs hold only those numbers (unique in their table) and the batch, or are a row
    per batch with ARRAYs of the numbers (``assign_batches`` with ``lists``). A cell is then
    a range of query numbers against a range of document numbers, whose vectors it gets
    once; it does the batches whose first pair lies in it, and gets the vectors it lacks
    for them besides: vectors of ``cell_bytes`` at most.
    """
    if queries is not None and docs is not None:
        own = pairs.select(F.col(batch_col).cast("long").alias("batch"), F.col(query_no).alias("_q"),
                           F.col(doc_no).alias("_d"))
        if not isinstance(own.schema["_q"].dataType, ArrayType):
            own = own.groupBy("batch").agg(F.collect_list(F.struct("_q", "_d")).alias("_p"))
            own = own.select("batch", F.col("_p._q").alias("_q"), F.col("_p._d").alias("_d"))
        return _loss_in_cells(own, queries.select(F.col(query_no).cast("long").alias("_no"), F.col(query_vec).alias("_vec")),
                              docs.select(F.col(doc_no).cast("long").alias("_no"), F.col(doc_vec).alias("_vec")),
                              cell_bytes)
    import pandas as pd

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        value = _losses(np.stack(pdf[query_vec].to_numpy())[None], np.stack(pdf[doc_vec].to_numpy())[None])
        return pd.DataFrame({"batch": [int(pdf[batch_col].iloc[0])], "n": [len(pdf)], "loss": [float(value[0])]})

    sel = pairs.select(F.col(batch_col).cast("long").alias(batch_col), query_vec, doc_vec)
    return sel.groupBy(batch_col).applyInPandas(loss, "batch long, n long, loss double")


def _loss_in_cells(lists: DataFrame, queries: DataFrame, docs: DataFrame, cell_bytes: int) -> DataFrame:
    """(batch, n, loss) of batches (batch, _q ARRAY, _d ARRAY) with vectors (_no, _vec): a cell's
    vectors come first, then its batches, packed, and a task holds the vectors of one cell."""
    schema = "batch long, n long, loss double"
    sides, tasks = (queries, docs), lists.sparkSession.sparkContext.defaultParallelism
    kinds = {t.schema["_vec"].dataType.simpleString() for t in sides}
    kind = kinds.pop() if len(kinds) == 1 else "array<double>"
    of = [t.agg(F.min("_no"), F.max("_no"), F.max(F.size("_vec"))).first() for t in sides]
    if any(r[0] is None for r in of):
        return lists.sparkSession.createDataFrame([], schema)
    wide = max(1, *(r[2] for r in of)) * (4 if kind == "array<float>" else 8)
    # a quarter of a cell for its queries, a quarter for its documents, half for what they lack
    low, step = [r[0] for r in of], [max(1, cell_bytes // (4 * wide))] * 2
    step[1] = min(step[1], -(-(of[1][1] - low[1] + 1) // (CELLS_PER_CORE * tasks)))
    n_ranges = (of[1][1] - low[1]) // step[1] + 1

    def placed(b: pa.RecordBatch, split: dict[int, int]):
        """The batches' numbers, sizes, pairs (two columns), first pairs' places, cells and parts of cells."""
        batch, rows = b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())
        pairs = [b.column(i).flatten().to_numpy() for i in (1, 2)]
        first = np.cumsum(rows) - rows
        ranges = [(c[first] - x) // y for c, x, y in zip(pairs, low, step)]
        cell = ranges[0] * n_ranges + ranges[1]
        part = np.zeros(len(cell), np.int64)
        for c in np.unique(cell).tolist() if split else ():
            if c in split:
                part[cell == c] = batch[cell == c] % split[c]
        return batch, rows, pairs, first, cell, part

    def needs(split: dict[int, int]):
        """Rows (_cell, _part, _side, _no, _n): cells (_side 2) and the numbers outside their
        ranges (0 of queries, 1 of documents), and how many pairs have them."""
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                _, rows, pairs, first, cell, part = placed(b, split)
                found = [(cell, part, np.full(len(cell), 2), np.zeros(len(cell), np.int64))]
                for side in (0, 1):
                    own = (pairs[side] - low[side]) // step[side]
                    out = np.flatnonzero(own != np.repeat(own[first], rows))
                    own = np.searchsorted(first, out, "right") - 1
                    found.append((cell[own], part[own], np.full(len(out), side), pairs[side][out]))
                t = pa.table([np.concatenate(c) for c in zip(*found)], names=["_cell", "_part", "_side", "_no"])
                t = t.append_column("_n", pa.array(np.ones(t.num_rows, np.int64)))
                keys = ["_cell", "_part", "_side", "_no"]
                t = t.group_by(keys).aggregate([("_n", "sum")]).rename_columns({"_n_sum": "_n"})
                yield from t.select([*keys, "_n"]).combine_chunks().to_batches()

        found = lists.mapInArrow(run, "_cell long, _part long, _side long, _no long, _n long")
        return written(found.groupBy("_cell", "_part", "_side", "_no").agg(F.sum("_n").alias("_n")), "cells")

    needed, split = needs({}), {}
    # a cell that lacks too many vectors is split by batches, so that half a cell holds them
    lacks = F.sum(F.when(F.col("_side") < 2, 1).otherwise(0))
    for r in needed.groupBy("_cell").agg(lacks.alias("few"), F.sum(F.when(F.col("_side") < 2, F.col("_n"))
                                                                   .otherwise(0)).alias("most")).where(
            F.col("few") * wide > cell_bytes // 2).collect():
        split[r["_cell"]] = -(-r["most"] * wide // max(1, cell_bytes // 2))
    if split:
        needed = needs(split)
    cells = needed.where("_side = 2").select(
        "_cell", "_part", F.expr(f"_cell div {n_ranges}").alias("_r0"), F.expr(f"_cell % {n_ranges}").alias("_r1"))
    n_cells = cells.count()
    none = F.lit(None).cast("binary").alias("_pairs")
    rows = []
    for side, t in enumerate(sides):
        t = t.withColumn("_vec", F.col("_vec").cast(kind))
        ranged = t.withColumn(f"_r{side}", F.expr(f"(_no - {low[side]}) div {step[side]}"))
        for own in (ranged.join(F.broadcast(cells.select("_cell", "_part", f"_r{side}")), f"_r{side}"),
                    needed.where(F.col("_side") == side).select("_cell", "_part", "_no").join(t, "_no")):
            rows.append(own.select("_cell", "_part", F.lit(side).alias("_side"), "_no", "_vec", none))

    def packed(batches):
        held, n = [], 0

        def out():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            batch, rows, pairs, first, cell, part = placed(whole, split)
            by = np.lexsort((batch, part, cell))
            at = np.flatnonzero(np.diff(cell[by], prepend=-1) | np.diff(part[by], prepend=-1))
            for own in np.split(by, at[1:]):
                place = np.repeat(first[own] - np.cumsum(rows[own]) + rows[own], rows[own]) + np.arange(rows[own].sum())
                data = pack_numbers([batch[own], rows[own], *(c[place] for c in pairs)])
                yield pa.RecordBatch.from_arrays([pa.array([cell[own[0]]]), pa.array([part[own[0]]]),
                                                  pa.array([data], pa.binary())], names=["_cell", "_part", "_pairs"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += len(b.column(1).flatten())
            if n >= PACK_PAIRS:
                yield from out()
                n = 0
        if held:
            yield from out()

    rows.append(lists.mapInArrow(packed, "_cell long, _part long, _pairs binary").select(
        "_cell", "_part", F.lit(2).alias("_side"), F.lit(None).cast("long").alias("_no"),
        F.lit(None).cast(kind).alias("_vec"), "_pairs"))
    rows = reduce(DataFrame.unionByName, rows).repartition(max(1, min(2 * n_cells, MAX_CELL_TASKS)), "_cell", "_part")
    rows = rows.sortWithinPartitions("_cell", "_part", "_side")

    def by_number(parts):
        """The numbers in order, where each one's vector is, and the vectors."""
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), None
        no = np.concatenate([p[0] for p in parts])
        order = np.argsort(no)
        return no[order], order, pa.concat_arrays([p[1] for p in parts])

    def places(held, numbers):
        """Where the vectors of the numbers are."""
        at = np.searchsorted(held[0], numbers)
        if len(held[0]) == 0 or (held[0][np.minimum(at, len(held[0]) - 1)] != numbers).any():
            raise ValueError("a pair's number is not in its table")
        return held[1][at]

    def matrix(held, at):
        return list_column_to_matrix(held[2].take(pa.array(at.ravel())), held[2].type.value_type.to_pandas_dtype()
                                     ).reshape(*at.shape, -1)

    def done(data, vectors):
        """The losses of packed batches."""
        ids, n, *pairs = unpack_numbers(data)
        at = [places(v, c) for v, c in zip(vectors, pairs)]
        first, value = np.cumsum(n) - n, np.empty(len(ids))
        one = np.add.reduceat(np.diff(pairs[0], prepend=pairs[0][:1]) != 0, first)
        one -= np.diff(pairs[0], prepend=pairs[0][:1])[first] != 0  # the step from the batch before
        for rows_in, alone in {*zip(n.tolist(), (one == 0).tolist())}:
            own = np.flatnonzero((n == rows_in) & ((one == 0) == alone))
            step = max(1, LOSS_ROWS // rows_in)
            for i in range(0, len(own), step):
                place = first[own[i:i + step], None] + np.arange(rows_in)
                value[own[i:i + step]] = _losses(matrix(vectors[0], at[0][place[:, :1] if alone else place]),
                                                 matrix(vectors[1], at[1][place]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(value)],
                                          names=["batch", "n", "loss"])

    def losses(batches):
        cell, parts, vectors = None, ([], []), None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if tuple(keys[:2, x]) != cell:
                    cell, parts, vectors = tuple(keys[:2, x]), ([], []), None
                run, side = b.slice(x, y - x), int(keys[2, x])
                if side < 2:
                    parts[side].append((run.column(3).to_numpy(), run.column(4)))
                    continue
                if vectors is None:
                    vectors, parts = [by_number(p) for p in parts], ([], [])
                for data in run.column(5):
                    yield done(data.as_buffer(), vectors)

    return rows.select("_cell", "_part", "_side", "_no", "_vec", "_pairs").mapInArrow(losses, schema)
