"""Passage vectors -> one vector per document.

Flat input (one row per passage) is pooled with ``pyspark.ml.stat.Summarizer``
(mean, sum, max): a JVM aggregate with partial aggregation, so each task
sends one buffer per document to the shuffle on doc_id, however many passages
a (hot) document has. ``first`` is ``min_by(vector, passage_idx)``, also
partially aggregated. ``masked_mean`` drops all-zero (padding) passage
vectors, then takes the mean; a document with only padding has no row.

Nested input (a document's passages in one array) is folded in place with
``aggregate(zip_with(...))``: no shuffle at all.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.vectors import is_zero

METHODS = ("mean", "sum", "max", "first", "masked_mean")


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown pooling method {method!r}; use one of {METHODS}")


def pool(df: DataFrame, method: str = "mean", *, doc_id: str = "doc_id", order: str = "passage_idx",
         vec: str = "passage_embedding", out_col: str = "doc_embedding") -> DataFrame:
    """(doc_id, out_col ARRAY<DOUBLE>) from flat passages."""
    _check(method)
    if method == "first":
        v = F.transform(F.min_by(F.col(vec), F.col(order)), lambda x: x.cast("double"))
        return df.groupBy(doc_id).agg(v.alias(out_col))
    src = df.where(~is_zero(vec)) if method == "masked_mean" else df
    features = array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double")))
    metric = {"mean": Summarizer.mean, "masked_mean": Summarizer.mean, "sum": Summarizer.sum,
              "max": Summarizer.max}[method]
    return src.groupBy(doc_id).agg(vector_to_array(metric(features)).alias(out_col))


def pool_nested(df: DataFrame, method: str = "mean", *, passages: str = "passages", vec: str = "passage_embedding",
                order: str = "passage_idx", out_col: str = "doc_embedding") -> DataFrame:
    """Pool a nested passages array per row, without a shuffle."""
    _check(method)
    arr = F.col(passages)
    vecs = F.transform(arr, lambda p: F.transform(p[vec], lambda x: x.cast("double")))
    if method == "masked_mean":
        vecs = F.filter(vecs, lambda v: ~F.forall(v, lambda x: x == 0))
    if method == "first":
        first = F.array_sort(arr, lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1)
                             .otherwise(0))
        out = F.transform(F.element_at(first, 1)[vec], lambda x: x.cast("double"))
    else:
        head = F.element_at(vecs, 1)
        rest = F.slice(vecs, 2, F.greatest(F.size(vecs) - 1, F.lit(0)))
        if method == "max":
            folded = F.aggregate(rest, head, lambda acc, v: F.zip_with(acc, v, lambda x, y: F.greatest(x, y)))
        else:
            folded = F.aggregate(rest, head, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
        if method in ("mean", "masked_mean"):
            # the count is bound once, as a one-element array, not once for each element
            one = F.transform(F.array(F.size(vecs)), lambda n: F.transform(folded, lambda x: x / n))
            folded = F.element_at(one, 1)
        out = folded
    res = df.withColumn(out_col, out).drop(passages)
    return res.where(F.col(out_col).isNotNull())


def l2_normalize(df: DataFrame, col: str = "doc_embedding", out_col: str = "norm_embedding") -> DataFrame:
    """Add ``out_col`` = col / ||col|| (a zero vector stays zero)."""
    from rankweave.functions.vectors import l2_normalize as expr
    return df.withColumn(out_col, expr(col))
