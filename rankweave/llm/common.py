"""Small helpers shared by the operators of this subpackage.

Text cases are the same everywhere: a null text is the empty text, rows are
never dropped, and helper columns carry the prefix ``_rw_`` so they cannot
clash with columns of the caller.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character kept (``lower`` is exact, and much
    faster than ``translate``, where the text is ASCII only)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame written as Parquet below the shared checkpoint folder and read
    again: lineage is cut and lost executors cost nothing already written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this process has freed goes back to the system: the C library and Arrow keep
    it for themselves otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow by a worker that begins and leaves every task with no more
    memory than it uses: between tasks, and in later stages, it lives on beside the JVM."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return tidy


def discard(df: DataFrame) -> None:
    """Deletes a written table, once all that was made of it is itself written."""
    if files := df.inputFiles():
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
