"""Operator 11: vector code compression with an integer Walsh-Hadamard transform.

Components become integers floor(4096 x), a vector is cut into parts, and each
part is coded by the nearest entry of its codebook. The nearest entry is found
in the transform domain: parts and entries are padded with zeros to a power of
two P and Walsh-Hadamard transformed, which multiplies squared distances by P;
squared differences of coefficients are summed in sequency order (few sign
changes first, where the energy of smooth parts lies), an entry leaves as soon as its partial sum
passes the whole sum of the entry that led after the first coefficients, and
what stays is decided exactly, ties by the lower index. No floating point is
used after the floor.

A codebook (parts x entries x length integers) is small whatever the table's
size: each round is one job in which every task adds up its parts by entry, and
only these sums are shuffled.

Cases: vectors that are null, hold null or non-finite components, or components of
2^38 or more take no part; shorter vectors are padded with zeros to the longest
one, and to a multiple of the number of parts; with fewer rows than entries the
codebooks are shorter; rows of one vec_id count each (first entries: ordered by
vec_id, nulls last, then by components); squared distances beyond 64 bits give a
null error; null labels are one label; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 4096
ROWS = 2048           # vectors coded at once
LIMB = 31             # sums travel as high and low parts of so many bits
MAX_LABELS = 100_000  # label totals that are broadcast; more are joined by shuffle


@lru_cache
def sequency(size: int) -> np.ndarray:
    """The rows of the natural order, by their number of sign changes."""
    i = np.arange(size)
    rows = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i]).reshape(size, size)
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def walsh(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Transform of each row (of a power of two), coefficients in the given order."""
    n, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        half *= 2
    return x[:, order]


def padded(x: np.ndarray, size: int, kind) -> np.ndarray:
    out = np.zeros((len(x), size), kind)
    out[:, :x.shape[1]] = x
    return out


def _largest(*arrays: np.ndarray) -> int:
    return max(int(np.abs(x).max(initial=0)) for x in arrays)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the lowest of equals), and its squared distance."""
    n, length = x.shape
    size = 1 << max(0, length - 1).bit_length()
    # Python's integers where 64 bits might not hold a sum
    kind = np.int64 if (2 * _largest(x, entries) * size) ** 2 < 1 << 62 else object
    order = sequency(size)
    a, e = walsh(padded(x, size, kind), order), walsh(padded(entries, size, kind), order)
    first = max(1, size // 4)
    total = np.zeros((n, len(e)), kind)
    for c in range(first):
        total += (a[:, c, None] - e[None, :, c]) ** 2
    lead = total.argmin(axis=1)
    most = total[np.arange(n), lead] + ((a[:, first:] - e[lead, first:]) ** 2).sum(axis=1)
    row, entry = np.nonzero(total <= most[:, None])
    total = total[row, entry]
    for c in range(first, size):
        total = total + (a[row, c] - e[entry, c]) ** 2
        stay = (total <= most[row]).astype(bool)
        row, entry, total = row[stay], entry[stay], total[stay]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if n else np.empty(0, int)
    least = np.minimum.reduceat(total, starts) if n else total
    hit = np.flatnonzero(total == least[row])
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], least // size


def integers(batch: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE x), rows padded with zeros to ``width``."""
    ends = np.asarray(batch.offsets)
    flat = np.floor(SCALE * np.asarray(batch.values)[ends[0]:ends[-1]]).astype(np.int64)
    length = np.diff(ends)
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat
    return out


def _sums(x: np.ndarray, entry: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of the rows of each entry."""
    total, count = np.zeros((entries, x.shape[1]), object), np.bincount(entry, minlength=entries)
    if len(x):
        order = np.argsort(entry, kind="stable")
        kind = np.int64 if _largest(x) * len(x) < 1 << 62 else object
        own, at = np.unique(entry[order], return_index=True)
        total[own] = np.add.reduceat(x[order].astype(kind), at, axis=0)
    return total, count


class Codebooks:
    """entries[part]: integers, entries x length of a part."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.parts, self.length = len(entries), entries[0].shape[1]

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, p * self.length:(p + 1) * self.length] for p in range(self.parts)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for e in self.entries for c in e.ravel()).encode()).hexdigest()


def kept(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """The rows that take part, with v (array<double>)."""
    v = vectors.withColumn("v", F.col(vec_col).cast("array<double>")).where("v is not null")
    return v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float(1 << 38))))


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of rows (vec_id, v); None without rows."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    length = -(-longest // parts)
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toArrow()
    x = integers(start["v"].combine_chunks(), length * parts)
    books = Codebooks([x[:, p * length:(p + 1) * length] for p in range(parts)])
    spark = rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            total = [np.zeros(e.shape, object) for e in books.entries]
            count = [np.zeros(len(e), np.int64) for e in books.entries]
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = integers(batch.column(0).slice(at, ROWS), books.parts * books.length)
                    for p, own in enumerate(books.split(x)):
                        more, n = _sums(own, nearest(own, books.entries[p])[0], len(books.entries[p]))
                        total[p] += more
                        count[p] += n
            rows = [(p, e, pos, int(c) >> LIMB, int(c) & (1 << LIMB) - 1, int(count[p][e]))
                    for p in range(books.parts) for e in np.flatnonzero(count[p]).tolist()
                    for pos, c in enumerate(total[p][e])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                             [pa.array([], pa.int64())] * 6,
                                             names=["part", "entry", "pos", "high", "low", "n"])

        sums = rows.select("v").mapInArrow(
            run, "part bigint, entry bigint, pos bigint, high bigint, low bigint, n bigint").groupBy(
            "part", "entry", "pos").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
        new = [e.copy() for e in books.entries]
        for r in sums.collect():  # one row for each component of the codebooks
            new[r["part"]][r["entry"], r["pos"]] = ((r["high"] << LIMB) + r["low"]) // r["n"]
        books = Codebooks(new)
        shared.destroy()
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error for rows (vec_id, label, v)."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                codes, error = [], np.zeros(batch.num_rows, object)
                for p, own in enumerate(books.split(integers(batch.column(2), books.parts * books.length))):
                    entry, far = nearest(own, books.entries[p])
                    codes.append(entry)
                    error += far
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(["".join(f"{c:02x}" for c in r) for r in zip(*codes)]),
                     pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for the vectors (vec_id, embedding, label) that take part."""
    rows = kept(vectors.select("vec_id", "embedding", "label")).select("vec_id", "label", "v")
    books = fit(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(encode(rows, books), "coded")
    totals = written(coded.groupBy(F.col("label").alias("_rw_label")).agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(
        "_rw_label", F.expr("try_cast(total as bigint)").alias("label_error")), "label_errors")
    few = totals.count() <= MAX_LABELS
    out = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_rw_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
