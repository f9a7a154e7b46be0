"""The passage split on a streaming DataFrame.

Passage splitting (and title prefixing, the empty-body filter and the
encoder host) are stateless row transforms, so the batch operators apply
unchanged to ``readStream`` input: no watermark, window or state is needed,
and each micro-batch is a narrow stage. ``run_available_now`` drains the
source once (``availableNow`` trigger) into a Parquet sink whose checkpoint
lives under the session's reliable checkpoint folder.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.operators import passages
from rankweave.session import ensure_checkpoint_dir


def stream_passages(spark: SparkSession, path: str, schema, *, passage_size: int = 512, prepend_title: bool = True,
                    view: Callable[[DataFrame], DataFrame] | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (doc_id, passage_idx, passage_id, passage_body) over Parquet
    documents arriving in the folder ``path`` (or one ``*.parquet`` table, a file or a folder of files);
    ``view`` maps the raw rows to (doc_id, title, body)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if path.rstrip("/").endswith(".parquet"):
        # one table, a file or a folder of part files: a source whose path is a pattern (here one
        # that this name alone fits) takes either, where a plain path has to be a folder
        path = f"{path.rstrip('/')[:-1]}[t]"
    src = reader.parquet(path)
    docs = view(src) if view is not None else src
    return passages.split_passages(passages.drop_empty(docs), passage_size, prepend_title, keep=[])


def run_available_now(stream: DataFrame, out_path: str | None = None) -> str:
    """Process everything available, write Parquet, return the output folder."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run_id = uuid.uuid4().hex
    out = out_path or f"{base}/stream-out-{run_id}"
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", f"{base}/stream-ckpt-{run_id}")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out
