"""Micro-batches written once each, whatever is replayed.

A passage's vector, its normalisation and the flat form of a document are made
from the rows of that document alone, so the batch operators apply unchanged to
each micro-batch. ``foreachBatch`` may see a batch again after a failure; the
writer keys its output by the batch id and replaces that folder, so a replayed
batch leaves the same rows, and not twice.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame

from rankweave.operators import embed, passages, pooling
from rankweave.session import ensure_checkpoint_dir


def write_batch(df: DataFrame, batch_id: int, out: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """The batch as partition ``batch_id`` of the table at ``out``; written again, it is replaced."""
    transform(df).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def drain(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str | None = None,
          checkpoint: str | None = None) -> str:
    """Run what is available through ``transform``, batch by batch; the folder of the table.
    A later call with the same ``out`` and ``checkpoint`` goes on with what has arrived since."""
    base = ensure_checkpoint_dir(stream.sparkSession).rstrip("/")
    name = uuid.uuid4().hex
    out = out or f"{base}/batches-{name}"
    q = (stream.writeStream.foreachBatch(lambda df, batch_id: write_batch(df, batch_id, out, transform))
         .option("checkpointLocation", checkpoint or f"{base}/batches-ckpt-{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out


def passage_vectors(encoder_factory, *, batch_size: int = 16, dim: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Transform of passages (doc_id, passage_idx, passage_id, passage_body): encoded,
    normalised, nested by document and flattened again in passage order."""
    def transform(df: DataFrame) -> DataFrame:
        vecs = embed.embed(df, "passage_body", encoder_factory, out_col="passage_embedding", batch_size=batch_size, dim=dim)
        unit = pooling.l2_normalize(vecs, "passage_embedding", "norm_embedding").drop("passage_embedding")
        return passages.flatten(passages.nest(unit, fields=["passage_idx", "passage_id", "norm_embedding"]))
    return transform
