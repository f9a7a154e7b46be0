"""Join helpers for low-cardinality keys.

A key with few distinct values (a label, a batch, a query popular with many
documents) puts a large share of rows in one shuffle partition. ``salted_join``
spreads the large side over ``salt`` sub-keys by a deterministic hash of a
unique column and copies the small side once per sub-key, so each task gets
about 1/salt of a hot key. The salt is a hash, not ``rand()``, so a retried
task recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, small: DataFrame, on: list[str] | str, *, unique_col: str,
                salt: int = 64, how: str = "inner", spread: bool = False) -> DataFrame:
    """Equi-join ``big`` to ``small`` on ``on`` with the big side split ``salt`` ways. With
    ``spread`` its tasks are not put together by the size of what they read: for joins
    that make many more rows than they read."""
    keys = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    if salt <= 1:
        return big.join(small, keys, how)
    b = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(unique_col)), F.lit(salt)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    if spread:  # both sides: either may be broadcast, and the other one's tasks count then
        spark = big.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
        b, s = (t.repartition(tasks, *keys, "_salt") for t in (b, s))
    return b.join(s, keys + ["_salt"], how).drop("_salt")
