"""Operator 8: contiguous shards of equal bytes (native).

Rows are put into one global order (by id), every range partition sums its
sizes, and the prefix sums of those few totals turn running sums inside a
partition into global ones. A row goes to the shard its middle byte falls in
when the total is cut at equal targets, so shards are contiguous in the order
and their sizes differ by less than the two rows at their ends. No partition
sees more than its own rows; only one row for each partition meets in one place.

Cases: a null text has size 1; null ids come first; repeated rows are all kept
(equal rows are interchangeable); an empty table gives an empty result; other
columns of the input are left out, so nothing can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # sampled range bounds may differ between runs of a plan: written once, read twice
    rows = written(rows.repartitionByRange(id_col, "text_crc32").withColumn("_rw_part", F.spark_partition_id()),
                   "shards")
    totals = rows.groupBy("_rw_part").agg(F.sum("size").alias("_rw_bytes"), F.count(F.lit(1)).alias("_rw_rows"))
    before = Window.orderBy("_rw_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    whole = Window.partitionBy()
    offsets = totals.select("_rw_part", F.coalesce(F.sum("_rw_bytes").over(before), F.lit(0)).alias("_rw_byte0"),
                            F.coalesce(F.sum("_rw_rows").over(before), F.lit(0)).alias("_rw_row0"),
                            F.sum("_rw_bytes").over(whole).alias("_rw_all"))
    inside = Window.partitionBy("_rw_part").orderBy(id_col, "text_crc32", "size")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumns({"_rw_sum": F.sum("size").over(run), "_rw_no": F.row_number().over(inside)})
              .join(F.broadcast(offsets), "_rw_part"))  # as many rows as partitions
    middle2 = 2 * (F.col("_rw_byte0") + F.col("_rw_sum")) - F.col("size")  # twice the middle byte
    placed = placed.withColumns({"_rw_cut": middle2 * shards, "_rw_whole": 2 * F.col("_rw_all")}).select(
        id_col, "size", "text_crc32", F.expr("cast(_rw_cut div _rw_whole as int)").alias("shard"),
        (F.col("_rw_row0") + F.col("_rw_no") - 1).alias("_rw_row"))
    placed = written(placed, "shards")
    first = placed.groupBy("shard").agg(F.min("_rw_row").alias("_rw_first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rw_row") - F.col("_rw_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
