"""Operator 12: near-duplicate groups by SetSketch registers.

A document is the set of its word shingles (64-bit digests); equal sets are one
class. A register of a class is the least of independent exponentially
distributed hashes of its shingles, truncated to steps of ``BASE``: it grows with
the logarithm of the set's size, the larger of two registers is that of the
union (sketches merge), and equal registers are as likely as the sets are alike.

* ``BANDS`` bands of ``ROWS`` registers are the buckets: of sets at the threshold
  of 0.8 fewer than one pair in a million shares none.
* Every class of a bucket is compared with the bucket's first one, so groups of
  copies join in linear work. Of buckets that still hold more than one component the
  whole sets meet, block by block, and pairs of different components are compared
  there; only links that join components come out, never the pairs.
* A pair is judged by its registers jointly: how many are larger, smaller and
  equal has a likelihood for each Jaccard similarity, given both sizes. Pairs whose
  likelihood at the threshold lies more than ``SIGMAS`` standard deviations under
  its maximum go, all others are verified with the whole sets.

Cases: A-Z are lower-cased, words end at ASCII white space; fewer words than a
shingle has are one; null, empty and wordless texts have an empty set, no links
and their own doc_id as component; rows with one doc_id are joined each by its
text and are kept or not alike; a row without doc_id can link others, but names no
component (null if nothing else does); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .jaccard_join import WordHashes, digest, least_size, shingle_set

U = np.uint64
BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
BASE = 1.1
OFFSET = 40        # registers of small sets stay above 0
MOST = 255         # one byte each
SIGMAS = 6
BLOCK = 2048       # classes of a bucket that meet in one task
SHINGLES = 1 << 20  # and all their shingles, about
MAX_WANTED = 250_000  # doc_ids (8 to 16 bytes each) that are broadcast to pick texts
STEP = 128         # shingles hashed at once

FACTORS = np.random.default_rng(20_240_521).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * U(2) + U(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set."""
    least = np.full(REGISTERS, (1 << 64) - 1, U)
    hashes = np.empty((min(STEP, len(shingles)), REGISTERS), U)
    for at in range(0, len(shingles), STEP):
        part = shingles[at:at + STEP, None]
        own = np.multiply(part, FACTORS, out=hashes[:len(part)])
        np.minimum(least, own.min(axis=0), out=least)
    # the least of uniform values, as the least of exponential ones
    h = -np.log1p(-((least >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
    return np.clip(np.floor(1 + OFFSET - np.log(h) / math.log(BASE)), 0, MOST).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def log_likelihood(larger, smaller, equal, u, v, j):
    """Of the similarity j, when so many registers of the first set are larger than,
    smaller than and equal to those of the second; u, v: the sizes' shares of their sum."""
    def p(x):
        return -np.log(1 - np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    return (larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny))
            + equal * np.log(np.maximum(1 - up - down, tiny)))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 64
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likeliest similarity of each pair of sketches, its log likelihood, and the counts."""
    counts = np.stack([(a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1)])
    u = na / (na + nb)
    most = np.minimum(na, nb) / np.maximum(na, nb)  # sets so different in size are no more alike
    grid = most[:, None] * np.linspace(0, 1, steps)
    ll = log_likelihood(*(c[:, None] for c in counts), u[:, None], 1 - u[:, None], grid)
    best = ll.argmax(axis=1)
    rows = np.arange(len(best))
    return grid[rows, best], ll[rows, best], counts


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the similarity."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    keep = np.flatnonzero(100 * small >= percent * large)
    a, b, na, nb = a[keep], b[keep], na[keep].astype(float), nb[keep].astype(float)
    if len(keep):
        j, ll, counts = estimate(a, b, na, nb)
        u = na / (na + nb)
        at = log_likelihood(*counts, u, 1 - u, percent / 100)
        keep = keep[(j >= percent / 100) | (ll - at <= SIGMAS ** 2 / 2)]
    out = np.zeros(len(small), bool)
    out[keep] = True
    return out


def _documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), sketch (null for sets that link only with equals)."""
    kind, least = docs.schema["doc_id"].dataType.simpleString(), least_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, node, registers = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text or "", hashes, words)
                    n.append(len(s))
                    node.append(digest(s) if len(s) else None)
                    registers.append(sketch(s).tobytes() if len(s) >= least else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "node", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, node bigint, sketch binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    one = classes.selectExpr("node as a", "n_shingles as na", "sketch as ra")
    two = classes.selectExpr("node as b", "n_shingles as nb", "sketch as rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                keep = likely(_registers(batch.column(4)), _registers(batch.column(5)), na, nb, percent)
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(
        run, "a bigint, b bigint, na bigint, nb bigint")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the wanted classes (node, least): the text of the least
    doc_id is read again, picked by a broadcast of the ids if they are few and by
    a shuffle join if not."""
    ids = wanted.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    few = wanted.count() <= MAX_WANTED
    own = docs.where("doc_id is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
    if not wanted.where("least is null").isEmpty():
        own = own.unionByName(docs.where("doc_id is null").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                found = {}
                for text in whole.column(0).slice(at, 500).to_pylist():
                    s = shingle_set(text or "", hashes, words)
                    if len(s):
                        found[digest(s)] = s.view(np.int64)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in found.values()]))).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *found.values()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["node", "shingles"])

    return own.mapInArrow(run, "node bigint, shingles array<bigint>").groupBy("node").agg(
        F.first("shingles").alias("shingles"))


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link, by their whole sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(ends.join(classes.select("node", "least"), "node"), "wanted")
    sets = _sets(docs, wanted, words)
    both = (pairs.join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
            .join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a"))
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return written(both.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common")))
                   .select("a", "b"), "links")


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between different components in the buckets of left (key, node,
    root, blocks); sets: node, n_shingles, sketch, shingles. A pair is compared in the
    first band it shares, and a block returns no more links than join its components."""
    last = F.col("blocks") - 1
    m = left.select("key", "node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("home"),
                    F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("x"))
    m = m.select("key", "node", "root", "home", F.least("home", "x").alias("i"), F.greatest("home", "x").alias("j"))
    m = m.join(sets, "node").select("key", "i", "j", "home", "node", "root", "n_shingles", "sketch", "shingles").repartition(
        "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(others)
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))

    def links_in(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, root, home, n = (t[c].to_numpy().copy() for c in ("node", "root", "home", "n_shingles"))
        lists = t["shingles"].combine_chunks()
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(U)
        held = [flat[x:y] for x, y in zip(ends, ends[1:])]
        registers = _registers(t["sketch"])
        bands = np.ascontiguousarray(registers).reshape(len(node), BANDS, ROWS)
        band = t["key"][0].as_py() & 63
        apart = t["i"][0].as_py() != t["j"][0].as_py()
        a, b = [], []
        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node))
            y = y[root[y] != root[x]]
            if apart:  # classes of one block meet where it meets itself
                y = y[home[y] != home[x]]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if band and len(y):
                y = y[~(bands[y, :band] == bands[x, :band]).all(axis=2).any(axis=1)]
            if len(y):
                y = y[likely(np.broadcast_to(registers[x], (len(y), REGISTERS)), registers[y],
                             np.full(len(y), n[x]), n[y], percent)]
            if len(y):
                shared = common(held[x], [held[k] for k in y])
                for k in y[100 * shared >= percent * (n[x] + n[y] - shared)]:
                    if root[k] != root[x]:
                        a.append(node[x])
                        b.append(node[k])
                        root[root == root[k]] = root[x]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            names = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
            edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()]
            for x, y in zip(edges, edges[1:]):
                yield from links_in(t.slice(x, y - x))
            held = t.slice(edges[-1])  # the last bucket may go on
        if held is not None and held.num_rows:
            yield from links_in(held)

    return m.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; documents link
    when 100 * shared shingles >= percent * all shingles of both."""
    if not 75 <= percent <= 100:
        raise ValueError("the bands are made for similarities of 75 per cent or more")
    rows = written(_documents(docs, words, percent), "sketched")
    classes = written(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")),
        "classes")
    bands = classes.where("sketch is not null").select("node", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.expr("sketch").substr(i * ROWS + 1, F.lit(ROWS))).bitwiseAND(F.lit(-64))
        .bitwiseOR(i.cast("bigint")))).alias("key"))
    several = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1"),
                      "buckets")
    members = written(bands.join(several, "key"), "members")
    star = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    star = written(_likely_pairs(star, classes, percent), "pairs")
    links = _links(star, docs, classes, words, percent)
    roots = components(links)
    # buckets of two have met; others go on where more than one component is left
    left = members.where("n > 2").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"))
    left = written(left.join(classes.select("node", "n_shingles"), "node"), "left")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / SHINGLES)).alias("blocks")
    several = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks)
    left = written(left.join(several.where("low < high").select("key", "blocks"), "key"), "left")
    wanted = written(left.select("node").distinct().join(classes.select("node", "least"), "node"), "wanted")
    sets = classes.select("node", "n_shingles", "sketch").join(_sets(docs, wanted, words), "node")
    more = written(_across(left, sets, percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = classes.select("node", "least").join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles",
                     F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
