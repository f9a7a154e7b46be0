"""Global row positions, contiguous shards and fixed-size batches.

Spark tables have no row order, so "row r", "the first n" or "shard i of n"
need an explicit order. ``dense_index`` numbers rows 0..N-1 in that order
without a single-partition window: the ordered frame gets
``monotonically_increasing_id`` (partition id in the high bits), is
checkpointed to the session's reliable checkpoint folder so that a retried
task sees the same rows, and each partition's offset comes from the
per-partition counts (one number per partition, collected like
``zipWithIndex`` does).

Rows of nothing but numbers, such as pairs, can be far more than what they are made
of. ``assign_batches`` with ``lists`` orders them in packs of a byte or two a row and
gives a row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.packs import pack_numbers, unpack_numbers
from rankweave.session import ensure_checkpoint_dir, written

_LOW_BITS = (1 << 33) - 1
BOUND_ROWS = 10_000       # rows of a sample that tells where the parts of an order begin
PART_ROWS = 1 << 21       # rows of numbers that are put in order at once, about
LEAST_PART_ROWS = 1 << 16  # but more parts than cores need have more than so many
HELD_ROWS = 1 << 20       # rows of numbers that are cut into parts at once
PACK_ROWS = 1 << 21       # rows of numbers in a written pack, at most
BATCH_ROWS = 1 << 16      # rows of the lists that leave a task at once, about


def indexed_with_count(df: DataFrame, order_by: list[str] | str, *, out_col: str = "row_idx",
                       checkpoint: bool = True) -> tuple[DataFrame, int]:
    """``dense_index`` plus the row count N.

    The ordered frame gets ``monotonically_increasing_id`` (partition id in the
    high bits) and is checkpointed, so a retried task sees the same rows; the
    per-partition row counts (one number per partition, the same bounded list
    ``zipWithIndex`` gathers) give each partition's offset, which is joined back
    as a small broadcast table. The checkpoint is Parquet, a few bytes a row for
    numbers in order.
    """
    ordered, parts = ordered_parts(df, order_by, checkpoint=checkpoint, in_place=False)
    spark = df.sparkSession
    off = spark.createDataFrame([(pid, start) for pid, start, _ in parts] or [(0, 0)], "_pid long, _off long")
    out = (ordered.join(F.broadcast(off), "_pid")
           .withColumn(out_col, F.col("_off") + F.col("_pos")).drop("_pid", "_off", "_pos"))
    return out, sum(n for _, _, n in parts)


def ordered_parts(df: DataFrame, order_by: list[str] | str, *, checkpoint: bool = True, in_place: bool = True
                  ) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The frame in ``order_by`` order with its partition ``_pid`` and the place
    ``_pos`` in it, and (partition, global place of its first row, rows) of each
    partition with rows. Partitions follow one another in the order, and a
    partition's rows are in order inside it; without ``in_place`` only the columns
    tell so, not where the rows lie."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    ordered = df.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint and not in_place:
        ordered = written(ordered, "ordered")
    elif checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumns({"_pid": F.shiftrightunsigned(F.col("_mid"), 33),
                                   "_pos": F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))}).drop("_mid")
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("_pid").agg(F.count(F.lit(1))).collect())
    parts, total = [], 0
    for pid, n in counts:
        parts.append((pid, total, n))
        total += n
    return ordered, parts


def dense_index(df: DataFrame, order_by: list[str] | str, *, out_col: str = "row_idx",
                checkpoint: bool = True) -> DataFrame:
    """Add ``out_col`` = 0-based position of the row in ``order_by`` order (BIGINT).

    ``order_by`` should be a total order (unique keys); ties are ordered
    arbitrarily but consistently once checkpointed.
    """
    return indexed_with_count(df, order_by, out_col=out_col, checkpoint=checkpoint)[0]


def contiguous_shard(df: DataFrame, n_shards: int, order_by: list[str] | str, *, rule: str = "balanced",
                     out_col: str = "shard") -> DataFrame:
    """Add the contiguous shard number of each row (0..n_shards-1) in ``order_by`` order.

    rule="balanced": sizes differ by at most one, the first ``N mod n`` shards
    are one larger (shard k starts at ``k*(N div n) + min(k, N mod n)``).
    rule="proportional": shard k is ``[int(k/n*N), int((k+1)/n*N))`` computed in
    double precision, as a float slice of a corpus of N rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be >= 1")
    idx, n_rows = indexed_with_count(df, order_by, out_col="_r")
    total = F.lit(n_rows).cast("long")
    r = F.col("_r")
    n = F.lit(n_shards).cast("long")
    if rule == "balanced":
        div = F.floor(total / n)  # 0 when N < n: then every row is before the boundary
        mod = F.pmod(total, n)
        boundary = mod * (div + 1)
        shard = F.when(r < boundary, F.floor(r / (div + 1))).otherwise(mod + F.floor((r - boundary) / div))
    elif rule == "proportional":
        def start(k):
            return F.floor(k.cast("double") / F.lit(float(n_shards)) * total.cast("double"))
        # the last shard whose start is <= r; exact up to one float step, then corrected
        k0 = F.ceil((r + 1) * n / F.greatest(total, F.lit(1))) - 1
        shard = (k0 + F.when((k0 + 1 < n) & (r >= start(k0 + 1)), 1).otherwise(0)
                 - F.when(r < start(k0), 1).otherwise(0))
    else:
        raise ValueError("rule must be 'balanced' or 'proportional'")
    return idx.withColumn(out_col, shard.cast("int")).drop("_r")


def take_shard(df: DataFrame, n_shards: int, index: int, order_by, *, rule: str = "balanced") -> DataFrame:
    """Rows of shard ``index`` of ``n_shards`` (same rules as ``contiguous_shard``)."""
    if not 0 <= index < n_shards:
        raise ValueError("shard index out of range")
    return contiguous_shard(df, n_shards, order_by, rule=rule, out_col="_shard").where(
        F.col("_shard") == index).drop("_shard")


def assign_batches(df: DataFrame, batch_size: int, order_by, *, out_col: str = "batch",
                   lists: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in ``order_by`` order (last one shorter).

    With ``lists``, for rows of whole numbers, a batch is one row (``out_col``, an ARRAY<BIGINT>
    of its rows' numbers for each column of ``lists``); rows go through the exchange and the
    scratch folder as packs."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    if lists is not None:
        return _batch_lists(df, batch_size, [order_by] if isinstance(order_by, str) else list(order_by), out_col,
                            lists, part_rows)
    idx = dense_index(df, order_by, out_col="_r")
    return idx.withColumn(out_col, F.floor(F.col("_r") / batch_size).cast("long")).drop("_r")


def _numbers(b: pa.RecordBatch) -> list[np.ndarray]:
    if any(c.null_count for c in b.columns):
        raise ValueError("null among the numbers of a batch")
    return [c.to_numpy() for c in b.columns]


def _places_in_order(columns: list[np.ndarray]) -> np.ndarray:
    """The places of the rows in the order of the columns."""
    keys: list[np.ndarray] = []
    spans: list[int] = []
    for i, c in enumerate(columns):
        if any(np.array_equal(c, own) for own in columns[:i]):
            continue  # decides nothing
        low = c.min(initial=0)
        span = int(c.max(initial=0)) - int(low) + 1
        if spans and spans[-1] * span < 1 << 62:  # two columns make one number
            keys[-1], spans[-1] = keys[-1] * span + (c - low), spans[-1] * span
        else:
            keys, spans = [*keys, c - low if span < 1 << 62 else c], [*spans, span]
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _bounds(rows: DataFrame, part_rows: int) -> list[tuple[int, ...]]:
    """Rows at which the parts of the order begin, but the first, from an even sample."""
    names = rows.columns

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, most, held, n = np.random.default_rng(TaskContext.get().partitionId()), 1.0, [], 0

        def lowest():
            u, *columns = map(np.concatenate, zip(*held))
            own = np.argsort(u)[:BOUND_ROWS]
            return [u[own], *(c[own] for c in columns)]

        for b in batches:
            u = rng.random(b.num_rows)
            own = np.flatnonzero(u < most)
            if len(own):
                held.append([u[own], *(c[own] for c in _numbers(b))])
                n += len(own)
            if n > 8 * BOUND_ROWS:
                held = [lowest()]
                most, n = held[0][0][-1], BOUND_ROWS
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in lowest()], names=["_u", *names])

    found = rows.mapInArrow(sample, "_u double, " + ", ".join(f"`{c}` long" for c in names))
    found = [tuple(r) for r in found.orderBy("_u").limit(BOUND_ROWS).collect()]
    # the lowest of n even draws: the last of k is at about k / n
    n = int(len(found) / max(r[0] for r in found)) if len(found) == BOUND_ROWS else len(found)
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // part_rows), min(tasks, n // LEAST_PART_ROWS), 1)
    own = sorted(r[1:] for r in found)
    return sorted({own[i * len(own) // parts] for i in range(1, parts)}) if own else []


def _batch_lists(df: DataFrame, batch_size: int, order_by: list[str], out_col: str, lists: list[str],
                 part_rows: int) -> DataFrame:
    columns = list(dict.fromkeys([*order_by, *lists]))
    rows = df.select(*[F.col(c).cast("long").alias(c) for c in columns])
    kept, n_order = [columns.index(c) for c in lists], len(order_by)
    bounds = _bounds(rows.select(*order_by), part_rows)

    def cuts(ordered: list[np.ndarray]) -> list[int]:
        """The first place of each part, and the end."""
        out = [0]
        for bound in bounds:
            low, high = out[-1], len(ordered[0])
            for c, v in zip(ordered, bound):
                low, high = (low + int(np.searchsorted(c[low:high], v, side)) for side in ("left", "right"))
                if low == high:
                    break
            out.append(low)
        return [*out, len(ordered[0])]

    def in_order(held: list[list[np.ndarray]], own: list[int]) -> list[np.ndarray]:
        """The columns ``own`` of the rows, in order; the rows are held no longer."""
        whole = []
        for i in range(len(columns)):
            whole.append(np.concatenate([h[i] for h in held]))
            for h in held:
                h[i] = None
        held.clear()
        place = _places_in_order(whole[:n_order])
        return [whole[i][place] for i in own]

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            ordered = in_order(held, range(len(columns)))
            at = cuts(ordered)
            own = [i for i, (x, y) in enumerate(zip(at, at[1:])) if x < y]
            packs = [pack_numbers([c[at[i]:at[i + 1]] for c in ordered]) for i in own]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packs, pa.binary())],
                                              names=["_part", "_data"])

        for b in batches:
            if b.num_rows:
                held.append(_numbers(b))
                n += b.num_rows
            if n >= HELD_ROWS:
                yield out()
                n = 0
        if held:
            yield out()

    def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out():
            ordered = in_order(held, kept)
            for at in range(0, len(ordered[0]), PACK_ROWS):
                own = [c[at:at + PACK_ROWS] for c in ordered]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(own[0])], pa.int64()),
                     pa.array([pack_numbers(own)], pa.binary())], names=["_part", "_pos", "_n", "_data"])

        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1)):
                if p != part and held:
                    yield from out()
                part = p
                held.append(unpack_numbers(data.as_buffer()))
        if held:
            yield from out()

    packs = rows.mapInArrow(in_parts, "_part int, _data binary").repartition(len(bounds) + 1, "_part")
    packs = written(packs.sortWithinPartitions("_part").mapInArrow(
        whole_parts, "_part int, _pos long, _n long, _data binary"), "batches")
    first, total = {}, 0
    for part, n in sorted(map(tuple, packs.groupBy("_part").agg(F.sum("_n")).collect())):
        first[part], total = total, total + n

    def cut(whole: bool):
        """Batches that lie in one pack, or the pieces of the others."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, pos, n, data in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                    start = first[part] + pos
                    at = np.arange(-(-start // batch_size) * batch_size, start + n, batch_size)
                    at = np.unique([start, *at, start + n])
                    no = at[:-1] // batch_size
                    own = (np.diff(at) == np.minimum(batch_size, total - no * batch_size)) == whole
                    if not own.any():
                        continue
                    values = unpack_numbers(data.as_buffer())
                    # whole batches follow one another; of pieces there are two at most
                    own = np.flatnonzero(own)
                    some = max(1, BATCH_ROWS // batch_size) if whole else 1
                    for x, y in [(i, min(i + some, own[-1] + 1)) for i in (
                            range(own[0], own[-1] + 1, some) if whole else own)]:
                        ends = at[x:y + 1] - start
                        offsets = pa.array(ends - ends[0], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(no[x:y]), pa.array(at[x:y]),
                             *(pa.ListArray.from_arrays(offsets, pa.array(v[ends[0]:ends[-1]])) for v in values)],
                            names=[out_col, "_at", *lists])

        return packs.mapInArrow(run, f"`{out_col}` long, _at long, " + ", ".join(f"`{c}` array<long>" for c in lists))

    pieces = cut(False).groupBy(out_col).agg(F.sort_array(F.collect_list(F.struct("_at", *lists))).alias("_p"))
    return cut(True).drop("_at").unionByName(
        pieces.select(out_col, *[F.flatten(F.col("_p")[c]).alias(c) for c in lists]))
