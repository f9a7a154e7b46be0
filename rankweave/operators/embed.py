"""Hosting a user encoder as a batch Arrow job.

``embed`` runs ``encoder_factory()`` once per task (so a model is loaded once
per Python worker, not per row) and feeds it lists of ``batch_size`` texts;
the vectors come back as an ``ARRAY<FLOAT>`` column on the same rows (the row
carries its key, so nothing is zipped back by position). ``embed_documents``
does the same for a function of a document's passage-vector matrix.

No model ships with the package; ``hashed_encoder`` is a deterministic
bag-of-words stand-in used by the tests and the query catalogue.
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.defaults import QUERY_ENCODE_BATCH
from rankweave.functions.vectors import list_column_to_matrix, matrix_to_list_array
from rankweave.operators.passages import nest

Encoder = Callable[[list], np.ndarray]

PIECE_BYTES = 2 << 20  # of a batch's columns that a hosted function works on at once

# token -> bucket caches of the hashed encoder, per dimension (one per task:
# the package is serialised by value with the task function)
_BUCKETS: dict[int, dict[str, int]] = {}


def hashed_encoder(dim: int = 64, cache_size: int = 1 << 20) -> Encoder:
    """Factory of a bag-of-words encoder: each token (split on single spaces,
    empty tokens kept) adds 1 to bucket ``int(md5(token)[:8], 16) mod dim``;
    the counts are L2-normalised. Null text -> zero vector. Token buckets are
    cached, so md5 runs about once per distinct token and task."""
    cache = _BUCKETS.setdefault(dim, {})

    def bucket(tok: str) -> int:
        if len(cache) >= cache_size:
            cache.clear()
        b = cache[tok] = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
        return b

    def encode(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        get = cache.get
        for i, t in enumerate(texts):
            if t is None:
                continue
            ids = [b if (b := get(tok)) is not None else bucket(tok) for tok in t.split(" ")]
            out[i] = np.bincount(ids, minlength=dim)
        norms = np.sqrt((out * out).sum(axis=1))
        norms[norms == 0] = 1.0
        return (out / norms[:, None]).astype(np.float32)

    return encode


def embed(df: DataFrame, text_col: str, encoder_factory: Callable[[], Encoder], *, out_col: str = "embedding",
          batch_size: int = QUERY_ENCODE_BATCH, dim: int | None = None, drop_text: bool = True,
          partitions: int | None = None, by_length: bool = False, profile=None) -> DataFrame:
    """Add ``out_col`` (ARRAY<FLOAT>) = encoder(text) to every row.

    ``by_length`` makes the encoder's batches of texts of about one length (each of
    Spark's batches is sorted by length, encoded, and put back in its order), so an
    encoder that pads to the longest text of a call pads little. ``profile`` is a
    ``ResourceProfile`` for the stage that encodes, such as a GPU for each task.

    ``partitions`` spreads the rows round-robin over that many tasks before
    encoding (one shuffle of the text), for inputs whose splits are fewer or
    more uneven than the encoder workers; Spark sorts before a round-robin
    repartition, so a retried task gets the same rows."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    if partitions is not None:
        df = df.repartition(partitions)
    keep = [f for f in df.schema.fields if not (drop_text and f.name == text_col)]
    out_schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.FloatType()), True)])
    names = [f.name for f in keep]
    src = df.select(*names, *([] if text_col in names else [text_col]))

    def run(batches):
        encode = encoder_factory()
        for b in batches:
            texts = b.column(text_col).to_pylist()
            order = None
            if by_length:
                order = np.argsort([len(t) if t is not None else 0 for t in texts], kind="stable")
                texts = [texts[i] for i in order]
            parts = [np.asarray(encode(texts[i:i + batch_size]), dtype=np.float32)
                     for i in range(0, len(texts), batch_size)]
            m = np.concatenate(parts) if parts else np.zeros((0, dim or 0), np.float32)
            if m.shape[0] != len(texts):
                raise ValueError(f"encoder returned {m.shape[0]} vectors for {len(texts)} texts")
            if dim is not None and len(texts) and m.shape[1] != dim:
                raise ValueError(f"encoder returned dimension {m.shape[1]}, expected {dim}")
            if order is not None:
                back = np.empty_like(m)
                back[order] = m
                m = back
            cols = [b.column(n) for n in names] + [matrix_to_list_array(m, pa.float32())]
            yield pa.RecordBatch.from_arrays(cols, names=names + [out_col])

    return src.mapInArrow(run, out_schema, profile=profile)


def pieces(b: pa.RecordBatch, most: int = PIECE_BYTES):
    """The batch in parts of consecutive rows, each of at most ``most`` bytes or one row."""
    if b.num_rows <= 1 or b.nbytes <= most:
        yield b
    else:
        half = b.num_rows // 2
        yield from pieces(b.slice(0, half), most)
        yield from pieces(b.slice(half), most)


def map_columns(df: DataFrame, in_cols: list[str], fn_factory: Callable[..., Callable], out_col: str, out_type: str, *,
                batch_size: int = 256, drop_inputs: bool = False, fn_kwargs: dict | None = None,
                arrow: bool = False) -> DataFrame:
    """Host a user batch function of one or more columns as a ``mapInArrow`` column.

    ``fn_factory()`` runs once per task and returns the function; it is called with one
    list of at most ``batch_size`` values for each of ``in_cols`` and with ``fn_kwargs`` by
    name, and returns as many values. With ``arrow`` it gets and returns Arrow arrays
    (of about ``PIECE_BYTES`` at most), so no value becomes a Python object on the way.
    Spark's batches are worked off in pieces of that size: what a function needs beside its
    values, several times their size in a tokenizer, does not grow with the batch."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    keep = [f for f in df.schema.fields if not (drop_inputs and f.name in in_cols)]
    out_field = T.StructField(out_col, T.DataType.fromDDL(out_type), True)
    out_schema = T.StructType([f for f in keep if f.name != out_col] + [out_field])
    names = [f.name for f in out_schema.fields[:-1]]
    src = df.select(*names, *[c for c in dict.fromkeys(in_cols) if c not in names])
    kwargs = dict(fn_kwargs or {})

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        fn = fn_factory()
        a_type = to_arrow_type(out_field.dataType)
        for b in (piece for whole in batches for piece in pieces(whole)):
            values = [b.column(c) if arrow else b.column(c).to_pylist() for c in in_cols]
            if arrow:
                out = fn(*values, **kwargs)
                out = out if out.type == a_type else out.cast(a_type)
            else:
                out = []
                for i in range(0, b.num_rows, batch_size):
                    out.extend(fn(*(v[i:i + batch_size] for v in values), **kwargs))
                    if len(out) != min(b.num_rows, i + batch_size):
                        raise ValueError("the function must return one value per input")
                out = pa.array(out, a_type)
            if len(out) != b.num_rows:
                raise ValueError("the function must return one value per input")
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [out], names=names + [out_col])

    return src.mapInArrow(run, out_schema)


def map_column(df: DataFrame, in_col: str, fn_factory: Callable[[], Callable], out_col: str, out_type: str, *,
               batch_size: int = 256, drop_input: bool = False, arrow: bool = False) -> DataFrame:
    """``map_columns`` of a single column. Used for tokenizers (text -> ids) and
    detokenizers (ids -> text)."""
    return map_columns(df, [in_col], fn_factory, out_col, out_type, batch_size=batch_size, drop_inputs=drop_input,
                       arrow=arrow)


def tokenize(df: DataFrame, text_col: str, tokenizer_factory, out_col: str, *, id_type: str = "int",
             batch_size: int = 256, arrow: bool = False) -> DataFrame:
    """Token ids of a text column from a user tokenizer (list of str -> list of id lists)."""
    return map_column(df, text_col, tokenizer_factory, out_col, f"array<{id_type}>", batch_size=batch_size, arrow=arrow)


def detokenize(df: DataFrame, ids_col: str, decoder_factory, out_col: str, *, batch_size: int = 256,
               arrow: bool = False) -> DataFrame:
    """Text from token ids with a user decoder (list of id lists -> list of str)."""
    return map_column(df, ids_col, decoder_factory, out_col, "string", batch_size=batch_size, arrow=arrow)


def masked_mean(m: np.ndarray) -> np.ndarray:
    """Mean over the rows that are not all zero (padding); NaN when all are."""
    keep = ~np.all(m == 0, axis=1)
    if not keep.any():
        return np.full(m.shape[1], np.nan)
    return m[keep].mean(axis=0)


def embed_documents(passages: DataFrame, fn: Callable[[np.ndarray], np.ndarray] = masked_mean, *,
                    vec: str = "passage_embedding", out_col: str = "doc_embedding",
                    max_passages: int | None = None) -> DataFrame:
    """(doc_id, out_col ARRAY<DOUBLE>): ``fn`` applied to each document's
    (passages x dim) matrix in passage order (all rows, or the first ``max_passages``).
    Documents for which ``fn`` gives NaN have no row."""
    nested = nest(passages.select("doc_id", "passage_idx", vec), fields=["passage_idx", vec], out_col="_ps",
                  max_passages=max_passages)
    src = nested.select("doc_id", F.transform("_ps", lambda p: p[vec]).alias("_m"))

    def run(batches):
        for b in batches:
            ids, vecs = [], []
            mats = b.column(1)
            for i in range(b.num_rows):
                one = mats[i].values
                m = list_column_to_matrix(one)
                v = np.asarray(fn(m), dtype=np.float64)
                if np.isnan(v).any():
                    continue
                ids.append(b.column(0)[i].as_py())
                vecs.append(v)
            if not ids:
                continue
            arr = matrix_to_list_array(np.vstack(vecs), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), arr], names=["doc_id", out_col])

    return src.mapInArrow(run, f"doc_id string, {out_col} array<double>")
