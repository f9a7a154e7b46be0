"""Positional bias of the winning passage: an equal-width histogram.

Bins run from the minimum to the maximum value (a constant column gets the
range ``[v - 0.5, v + 0.5]``); the last bin is closed; empty bins are kept.
Minimum and maximum are read from the checkpointed per-value counts (two
numbers); the bins are an aggregate over that table joined to the bin grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.defaults import HISTOGRAM_BINS
from rankweave.session import ensure_checkpoint_dir


def position_histogram(df: DataFrame, col: str = "passage_idx", bins: int = HISTOGRAM_BINS, *, where=None) -> DataFrame:
    """Rows (bin INT, lower DOUBLE, upper DOUBLE, count BIGINT), one per bin.

    The input is read once: counts per distinct value (a partially aggregated
    table, as small as the number of distinct values) are checkpointed to the
    session's reliable checkpoint folder and feed both the range (its minimum
    and maximum, two numbers) and the bins.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    src = df.where(where) if where is not None else df
    vals = (src.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
            .groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    ensure_checkpoint_dir(df.sparkSession)
    vals = vals.checkpoint(eager=True)
    # two numbers from the checkpointed table
    lo0, hi0 = vals.agg(F.min("x"), F.max("x")).first()
    if lo0 is None:
        lo0 = hi0 = 0.0
    lo_v, hi_v = (lo0 - 0.5, hi0 + 0.5) if lo0 == hi0 else (lo0, hi0)
    lo, hi = F.lit(float(lo_v)), F.lit(float(hi_v))
    scale = F.lit(float(bins)) / (hi - lo)
    b = F.least(F.floor((F.col("x") - lo) * scale), F.lit(bins - 1)).cast("int")
    counts = vals.groupBy(b.alias("bin")).agg(F.sum("n").alias("count"))
    width = (hi - lo) / F.lit(float(bins))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lower"), (lo + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))
