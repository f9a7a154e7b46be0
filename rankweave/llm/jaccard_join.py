"""Operator 6: n-gram Jaccard join by a count-vector R-tree.

A document is the set of its word shingles (as 64-bit digests). Documents with
equal sets are one class, and classes are joined:

* Shingles are hashed to groups; the counts of a set's groups are a point, and
  the overlap of two sets is at most the sum of the minima of their coordinates.
* The tree's top needs no sampling and every part of it is a shuffle key: in any
  one order of all shingles, two sets that link share one of the first
  n - ceil(p n / 100) + 1 shingles of each (n its size, p the similarity in per
  cent), so every set goes to the bucket of each of these. The order puts rare
  shingles first: it is by the counts of a fixed-size sketch over all documents
  (``SKETCH`` slots), then by digest, so what many documents repeat opens no
  bucket for them.
* The place of a bucket's shingle in a set's prefix bounds the sizes of the sets it
  links with there (what precedes the first shared shingle is not shared); sets
  without a partner by these bounds leave the bucket.
* In a bucket the first set of about each size is compared with the others of
  it, which joins the groups of copies in linear work. Only buckets that then still hold more than one
  component go on: their points are packed into an R-tree (boxes hold the
  coordinates' maxima and the least size), every point is searched in it, and
  only sets with a partner of another component whose bound reaches the needed overlap
  come out. Large buckets are cut into blocks, and the blocks meet in pairs.
* Of the sets that come out the whole sets meet in the bucket, block by block, and
  are verified there; only links that join components come out, never the pairs.

Cases: A-Z are lower-cased, words end at ASCII white space; fewer words than a
shingle has are one; null, empty and wordless texts have an empty set, no
links and their own doc_id as component; rows with one doc_id are joined each by
its text; a row without doc_id can link others, but names no component (null if
nothing else does); an empty table gives an empty result; other columns are not
read (``first_of_each`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, tidied, written
from .components import components
from .url_cascade import encode_bits, passes

U = np.uint64
CACHE_WORDS = 250_000
SKETCH = 1 << 20      # slots of the sketch of shingle counts
CHUNK = 2_000_000     # shingles counted together
OFTEN = 3             # documents of a chunk that make a shingle count
LEAF = 16             # points of a leaf, and leaves of a box above
TREE_POINTS = 2048    # points of a bucket that meet in one task
BLOCK = 1024          # near sets of a bucket that meet in one task
SHINGLES = 1 << 20    # and all their shingles, about
CELLS = 1 << 21       # of an incidence matrix
MAX_FILTER_BITS = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str, hashes: WordHashes, n: int = 3) -> np.ndarray:
    """Sorted digests of the distinct shingles of n words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, U)
    for i in range(size):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def digest(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def least_size(percent: int) -> int:
    """Smaller sets link only with their equals."""
    return max(1, -(-100 // (100 - percent)) - 1) if percent < 100 else 1 << 62


def prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, of which sets that link share one."""
    n = len(shingles)
    if n < least_size(percent):
        return np.empty(0, U)
    order = np.lexsort((shingles, counts[(shingles & U(SKETCH - 1)).astype(np.int64)]))
    return shingles[order[:n - -(-percent * n // 100) + 1]]


def partner_size(n, place, percent: int):
    """The largest size of a set that links with one of n shingles, if the first of the
    shared ones (in the order of the prefixes) has this place among the n; for arrays and columns."""
    most = (n - place) * (100 + percent) / percent
    return (F.floor(most) if isinstance(most, Column) else np.floor(most).astype(np.int64)) - n


def groups_of(n: int) -> int:
    """A power of two, about a quarter of a set's size."""
    groups = 16
    while groups * 4 < n and groups < 4096:
        groups *= 2
    return groups


def point(shingles: np.ndarray) -> np.ndarray:
    """Group counts."""
    groups = groups_of(len(shingles))
    # other bits than the sketch's slots take
    return np.bincount(((shingles >> U(40)) % U(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def packed(p: np.ndarray) -> bytes:
    """A point in as few bytes a count as its largest count allows."""
    most = p.max(initial=0)
    return p.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // groups_of(n)}").astype(np.int32)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    """The point over fewer groups (groups are remainders)."""
    return p.reshape(-1, groups).sum(axis=0) if len(p) > groups else p


class CountTree:
    """R-tree of count points; a box holds its points' maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, 1], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][0]) > LEAF:
            p, s = self.levels[-1]
            cut = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, cut), np.minimum.reduceat(s, cut)))

    def search(self, q: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions of the points whose bound reaches the overlap a link needs."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[depth]
            at = at[at < len(p)]
            bound = np.minimum(p[at], q).sum(axis=1)
            at = at[(100 + percent) * bound >= percent * (s[at] + size)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[at]


def _counts(docs: DataFrame, words: int) -> np.ndarray:
    """The sketch of how often shingles are: every task counts its documents'
    shingles chunk by chunk, and those that ``OFTEN`` documents of a chunk share
    add their count to their slot. What stays under that everywhere counts 0;
    any counts give a valid order, these only keep frequent shingles from the
    prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(SKETCH, np.int64)
        held, n = [], 0

        def add() -> None:
            shingles, counts = np.unique(np.concatenate([np.empty(0, U), *held]), return_counts=True)
            often = counts >= OFTEN
            np.add.at(total, (shingles[often] & U(SKETCH - 1)).astype(np.int64), counts[often])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    held.append(shingle_set(text or "", hashes, words))
                    n += len(held[-1])
                    if n >= CHUNK:
                        add()
                        held, n = [], 0
        add()
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 10_000):
            part = slots[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    found = docs.select("text").mapInArrow(tidied(run), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # at most a row for each slot
    counts = np.zeros(SKETCH, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    return counts


def _documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), keys (its prefix), point."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_counts(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, node, keys, points = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text or "", hashes, words)
                    n.append(len(s))
                    node.append(digest(s) if len(s) else None)
                    keys.append(prefix(s, shared.value, percent).view(np.int64))
                    points.append(packed(point(s)) if len(keys[-1]) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     _lists(keys, np.int64), pa.array(points, pa.binary())],
                    names=["doc_id", "n_shingles", "node", "keys", "point"])

    return docs.select("doc_id", "text").mapInArrow(
        tidied(run), f"doc_id {kind}, n_shingles bigint, node bigint, keys array<bigint>, point binary")


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate([np.empty(0, kind), *arrays]).astype(kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the wanted nodes (and of a few more); wanted: node,
    least. The texts are read again; a bitmap of the classes' first doc_ids, of
    at most ``MAX_FILTER_BITS``, spares most others (it only spares fewer when
    more are wanted)."""
    ids = wanted.where("least is not null").select(F.col("least").alias("key")).distinct()
    bits = min(MAX_FILTER_BITS, 64 * (ids.count() // 4 + 1))
    known = encode_bits(ids, 0, bits, 2)
    own = docs.where(F.col("doc_id").isNull() | passes(F.col("doc_id"), 0, known)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                found = {}
                for text in whole.column(0).slice(at, 500).to_pylist():
                    s = shingle_set(text or "", hashes, words)
                    if len(s):
                        found[digest(s)] = s.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), _lists(list(found.values()), np.int64)],
                    names=["node", "shingles"])

    return own.mapInArrow(tidied(run), "node bigint, shingles array<bigint>").groupBy("node").agg(
        F.first("shingles").alias("shingles"))


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose summed minima reach the overlap a link needs."""
    one = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("point").alias("pa"))
    two = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("point").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("na", "nb", "pa", "pb")}
            keep = []
            for i in range(batch.num_rows):
                na, nb = c["na"][i], c["nb"][i]
                p, q = unpacked(c["pa"][i], na), unpacked(c["pb"][i], nb)
                groups = min(len(p), len(q))
                bound = int(np.minimum(fold(p, groups), fold(q, groups)).sum())
                keep.append((100 + percent) * bound >= percent * (na + nb))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(
        tidied(run), "a bigint, b bigint, na bigint, nb bigint")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, by bound and then by their whole sets."""
    pairs = written(_bounded(pairs, classes, percent), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        classes.select("node", "least"), "node")
    sets = _sets(docs, written(wanted, "wanted"), words)
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("common", common).where(
        F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common")))
    return written(both.select("a", "b"), "links")


def _blocks(members: DataFrame, blocks) -> DataFrame:
    """Every row of a bucket (key, node, more columns) in the blocks (i, j) in which it
    meets the others: its own one (home) with each of the bucket's ``blocks``."""
    m = members.withColumn("home", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "x", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return m.withColumns({"i": F.least("home", "x"), "j": F.greatest("home", "x")}).drop("x")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by key, i, j as tables of whole blocks, and where these begin and end."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        names = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
        edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist()]
        held = t.slice(edges[-1])  # the last block may go on
        if len(edges) > 1:
            yield t.slice(0, edges[-1]), edges
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _near(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, node, root, n_shingles: the sets which the R-tree of a bucket finds near to a set of
    another component; of the buckets a pair shares only that of its first key finds it.
    left: key, node, root, place of the key in the prefix, n sets of the bucket."""
    own = left.groupBy("node").agg(F.expr("transform(sort_array(collect_list(struct(place, key))), x -> x.key)").alias("keys"))
    m = _blocks(left, F.ceil(F.col("n") / TREE_POINTS)).drop("n")
    m = m.join(own.join(classes.select("node", "n_shingles", "point"), "node"), "node")
    # a pair is found by the first key it shares: only the keys before need to be known
    m = m.withColumn("keys", F.slice("keys", 1, (F.array_position("keys", F.col("key")) - 1).cast("int")))
    m = m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def near_pairs(points: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair at least one way round, at the number of groups of its smaller point."""
        kinds = np.array([len(p) for p in points])
        one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for groups in np.unique(kinds).tolist():
            ask = np.flatnonzero(kinds == groups)
            at = np.flatnonzero((kinds >= groups) & (percent * sizes <= 100 * sizes[ask].max()))
            if len(at) < 2:
                continue
            matrix = np.array([fold(points[k], groups) for k in at])
            own, n = matrix[np.searchsorted(at, ask)], sizes[at]
            if len(at) <= LEAF:  # a tree of one leaf
                bound = np.minimum(own[:, None], matrix[None]).sum(axis=2)
                x, y = np.nonzero((100 + percent) * bound >= percent * (sizes[ask][:, None] + n[None]))
            else:
                tree = CountTree(matrix, n)
                found = [tree.search(q, int(size), percent) for q, size in zip(own, sizes[ask])]
                x, y = np.repeat(np.arange(len(found)), list(map(len, found))), np.concatenate(found)
            one.append(ask[x])
            two.append(at[y])
        return np.concatenate(one), np.concatenate(two)

    def near_in(t: pa.Table, edges: list[int]) -> np.ndarray:
        c = {n: t[n].to_numpy() for n in ("i", "j", "home", "root", "n_shingles", "place")}
        sizes, roots, homes = c["n_shingles"], c["root"], c["home"]
        most = partner_size(sizes, c["place"], percent)
        points, keys = t["point"].to_pylist(), t["keys"].to_pylist()
        near = np.zeros(len(sizes), bool)
        for x, y in zip(edges, edges[1:]):
            if y - x < 2:
                continue
            n = sizes[x:y]
            one, two = near_pairs([unpacked(p, k) for p, k in zip(points[x:y], n.tolist())], n)
            one, two = one + x, two + x
            keep = roots[one] != roots[two]
            keep &= (sizes[one] <= most[two]) & (sizes[two] <= most[one])
            if c["i"][x] != c["j"][x]:  # sets of one block meet where it meets itself
                keep &= homes[one] != homes[two]
            for k, m in zip(one[keep].tolist(), two[keep].tolist()):
                if not (near[k] and near[m]) and set(keys[k]).isdisjoint(keys[m]):
                    near[k] = near[m] = True
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _whole_blocks(batches):
            t = t.combine_chunks()
            yield from t.select(["key", "node", "root", "n_shingles"]).filter(pa.array(near_in(t, edges))).to_batches()

    return m.select("key", "i", "j", "home", "node", "root", "n_shingles", "place", "keys", "point").mapInArrow(
        tidied(run), "key bigint, node bigint, root bigint, n_shingles bigint").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two sets share: the incidence matrix times its transpose,
    some columns at a time (exact in float32, below 2^24 shingles a set)."""
    m = len(sets)
    owner = np.repeat(np.arange(m), list(map(len, sets)))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(max(64, CELLS // m), columns)
    for at in range(0, columns, width or 1):
        x, y = np.searchsorted(column, (at, at + width))
        part = np.zeros((m, width), out.dtype)
        part[owner[x:y], column[x:y] - at] = 1
        out += part @ part.T
    return out


def _across(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between different components among the near sets (key, node, root,
    n_shingles) of a bucket, by the whole sets; a block returns no more links than join
    its components."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / SHINGLES))
    near = near.drop("n_shingles").join(near.groupBy("key").agg(blocks.alias("blocks")), "key")
    m = _blocks(near, F.col("blocks")).join(sets, "node").select("key", "i", "j", "home", "node", "root", "shingles")

    def links_in(t: pa.Table) -> Iterator[tuple[int, int]]:
        node, root, home = (t[c].to_numpy().copy() for c in ("node", "root", "home"))
        lists = t["shingles"].combine_chunks()
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(U)
        sets = [flat[x:y] for x, y in zip(ends, ends[1:])]
        n = np.diff(ends)
        common = overlaps(sets)
        apart = t["i"][0].as_py() != t["j"][0].as_py()
        for x in range(len(node) - 1):
            linked = (100 + percent) * common[x, x + 1:].astype(np.int64) >= percent * (n[x] + n[x + 1:].astype(np.int64))
            if apart:
                linked &= home[x + 1:] != home[x]
            for k in (np.flatnonzero(linked) + x + 1).tolist():
                if root[k] != root[x]:
                    yield int(node[x]), int(node[k])
                    root[root == root[k]] = root[x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _whole_blocks(batches):
            links = [link for x, y in zip(edges, edges[1:]) if y - x > 1 for link in links_in(t.slice(x, y - x))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()),
                                              pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidied(run), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; documents link
    when 100 * shared shingles >= percent * all shingles of both."""
    rows = written(_documents(docs, words, percent), "shingled")
    classes = written(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"),
        F.first("point").alias("point")), "classes")
    shingled, rows = rows, written(rows.select("doc_id", "n_shingles", "node"), "rows")
    discard(shingled)
    points = classes.select("node", "least", "n_shingles", "point")
    # of a bucket's sets of about one size the first is compared with all others
    by_key, by_size = Window.partitionBy("key"), Window.partitionBy("key", "size")
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent))
    most = partner_size(F.col("n_shingles"), F.col("place"), percent)
    buckets = classes.select("node", F.col("n_shingles").cast("int"), F.posexplode("keys").alias("place", "key"))
    buckets = buckets.repartition("key").withColumns({"size": size, "most": most.cast("int")}).withColumns({
        "n": F.count(F.lit(1)).over(by_key), "m": F.count(F.lit(1)).over(by_size),
        "first": F.min(F.struct(F.expr("most < n_shingles").alias("late"), "node", "n_shingles", "most")).over(by_size)})
    # a set has no link in this bucket if all smaller ones admit only smaller partners
    # and the next larger one is larger than it admits
    order = Window.partitionBy("key").orderBy("n_shingles", "node")
    smaller = F.max("most").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("n_shingles")
    larger = F.lead("n_shingles").over(order) <= F.col("most")
    buckets = buckets.withColumn("near", F.coalesce(smaller, F.lit(False)) | F.coalesce(larger, F.lit(False)))
    fits = (F.col("first.n_shingles") <= F.col("most")) & (F.col("n_shingles") <= F.col("first.most"))
    buckets = written(buckets.where("near").select(
        "key", "node", "place", "n", "m", F.when(fits & (F.col("node") != F.col("first.node")), F.col("first.node")).alias("first")),
        "buckets")
    star = buckets.where("first is not null").select(
        F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()
    links = _links(star, docs, points, words, percent)
    roots = components(links)
    # buckets go on if not all their sets have met by now; of two of one size they have
    left = buckets.where("n > 2 or m < 2").join(roots, "node", "left").select(
        "key", "node", "place", "n", F.coalesce("root", "node").alias("root"))
    several = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = written(left.join(several.select("key"), "key"), "left")
    discard(buckets)
    near = written(_near(left, points, percent), "near")
    wanted = written(near.select("node").distinct().join(points.select("node", "least"), "node"), "wanted")
    more = written(_across(near, _sets(docs, wanted, words), percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = classes.select("node", "least").join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                      .alias("component_id"))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component: that of the smallest doc_id, then of the
    smallest digest of the text, rows without doc_id last; of rows that repeat both
    any one. Rows with an empty set all stay."""
    text = text_or_empty()
    key1, key2 = F.xxhash64("doc_id", text), F.xxhash64(text, F.lit(1))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), key2.alias("key2"),
                     key1.alias("key1"))
    found = jaccard_components(docs.select(order.alias("doc_id"), "text"), words, percent)
    own, name = F.col("doc_id"), F.col("component_id")
    first = (own["key1"] == name["key1"]) & (own["key2"] == name["key2"])
    marks = found.where("n_shingles > 0").groupBy(own["key1"].alias("_rw_key1"), own["key2"].alias("_rw_key2")).agg(
        F.bool_or(first).alias("_rw_first"), F.count(F.lit(1)).alias("_rw_rows"))
    marks = written(marks.where("not _rw_first or _rw_rows > 1").drop("_rw_rows"), "marks")
    keys = ["_rw_key1", "_rw_key2"]
    keyed = docs.withColumns({"_rw_key1": key1, "_rw_key2": key2})
    single = keyed.join(marks, keys, "left_anti")
    repeated = keyed.join(marks.where("_rw_first"), keys, "left_semi").dropDuplicates(keys)
    return single.unionByName(repeated).drop(*keys)
