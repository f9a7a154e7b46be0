"""Rows of (id, vector) packed into binary Arrow streams, and columns of numbers into bytes.

A pack is one row that holds up to some thousand vectors, so that joins and
products of blocks move whole matrices and a task scores a block of queries
against a block of the corpus with one matrix product. Spark reads, places and
joins packs like any other row. Numbers in order are packed as the steps between
them: pairs of numbers that would be some tens of bytes each as rows take one or two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.functions.vectors import list_column_to_matrix

PACK_BYTES = 8 << 20
_LEVEL = 3  # of zstd, with a window of 2 MB: finds what lists of numbers share


def rows_of_pack(dim: int, most: int) -> int:
    """Vectors of ``dim`` doubles in a pack of about ``PACK_BYTES``, at most ``most``."""
    return max(1, min(most, PACK_BYTES // (8 * max(1, dim))))


def _stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data) -> pa.Table:
    """The rows of a pack."""
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def unpack_matrix(data) -> tuple[pa.Table, np.ndarray]:
    """The rows of a pack and their vectors (second column)."""
    t = unpack(data)
    return t, list_column_to_matrix(t.column(1))


def pack(df: DataFrame, rows: int, by: str | None = None) -> DataFrame:
    """([by,] first STRING, n INT, data BINARY): rows of df (id STRING, vector, ...), at
    most ``rows`` in a pack; ``first`` is the first id. With ``by`` (the last column of df,
    an INT by which each partition is sorted) a pack holds rows of one value of it."""
    schema = (f"{by} int, " if by else "") + "first string, n int, data binary"

    def out(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        for at in range(0, t.num_rows, rows):
            part = t.slice(at, rows)
            cols = [pa.array([part.column(by)[0].as_py()], pa.int32())] if by else []
            own = part.drop_columns([by]) if by else part
            cols += [pa.array([own.column(0)[0].as_py()], pa.string()), pa.array([own.num_rows], pa.int32()),
                     pa.array([_stream(own)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=([by] if by else []) + ["first", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            cuts = [0, t.num_rows]
            if by:
                v = t.column(by).to_numpy()
                cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), t.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                part = t.slice(x, y - x)
                if by and held and held[0].column(by)[0].as_py() != part.column(by)[0].as_py():
                    yield from out(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
                if n >= rows:  # whole packs go, the rest waits for more
                    t_all = pa.concat_tables(held)
                    whole = n - n % rows
                    yield from out([t_all.slice(0, whole)])
                    held, n = ([t_all.slice(whole)], n - whole) if n > whole else ([], 0)
        if held:
            yield from out(held)

    return df.mapInArrow(run, schema)


def pack_numbers(columns: list[np.ndarray]) -> bytes:
    """Integer columns, of any lengths, as bytes: the steps from a number to the next, all
    lowest bytes first, compressed. Best for numbers in order."""
    head, body = [len(columns)], []
    for c in columns:
        c = np.ascontiguousarray(c, np.int64)
        step = np.diff(c, prepend=c[:1])
        down = step >> 63
        step <<= 1
        step ^= down  # small numbers for small steps down, too
        step = step.view(np.uint64)
        width = (int(step.max(initial=0)).bit_length() + 7) // 8
        head += [len(c), int(c[0]) if len(c) else 0, width]
        body += [(step >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(width)]
    return np.array(head, "<i8").tobytes() + pa.Codec(
        "zstd", compression_level=_LEVEL).compress(b"".join(body), asbytes=True)


def unpack_numbers(data: bytes) -> list[np.ndarray]:
    """The columns of ``pack_numbers``."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    size = sum(rows * width for rows, _, width in head)
    body = pa.decompress(memoryview(data)[8 + 24 * n:], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for rows, first, width in head:
        step = np.zeros(rows, np.uint64)
        for i in range(width):
            plane = np.frombuffer(body, np.uint8, rows, at).astype(np.uint64)
            plane <<= np.uint64(8 * i)
            step |= plane
            at += rows
        down = (step & np.uint64(1)).view(np.int64)
        step >>= np.uint64(1)
        step = step.view(np.int64)
        step ^= np.negative(down, out=down)
        np.cumsum(step, out=step)
        step += first
        out.append(step)
    return out
