"""Operator 13: ranked lexical search by dense blocked products.

The items' terms are the only vocabulary. A first pass over the documents gives
the collection's counts and the document counts of these terms; a second one
scores: the items go in tiles of few items, each with its own compact
vocabulary, whose weights are a dense matrix; the documents of a tile are a
dense matrix of impacts over the terms that occur in them; one float64 product
of the two gives all scores. All factors are integers, and a tile is never so
wide that a partial sum could reach 2^53, so the product is exact in any order
of summation; sums over tiles are 64-bit integers. A tile hands on the
documents that reach its k-th best score, ties included, a task keeps k for each
item, and only those are shuffled. Items beyond ``PAIRS`` (item, term) pairs go in
several blocks, dealt by item.

Cases: rows of one item_id are one item with the terms of all; null texts have no
terms; an item without terms, and an empty table, give no rows; documents without
a doc_id come last among equal scores; repeated documents rank each; with fewer
than k documents above 0 all are returned; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PAIRS = 100_000        # (item, term) pairs of a block
ITEMS = 64             # items of a tile
CELLS = 1 << 21        # cells of a tile's weights
TERMS = 4096           # terms multiplied at once
DOCS = 256             # documents of a tile
MOST_IMPACT = 10 ** 6  # no impact reaches it
EXACT = 1 << 53

KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
FOLDED = bytes(c if c in KEPT or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLDED).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: each once."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([t for f in found for t in f], pa.binary())],
                names=["item_id", "term"])

    return items.select(F.col(item_id).alias("item_id"), text).mapInArrow(
        run, f"item_id {kind}, term binary").distinct()


class Tile:
    """Some items, and the weights of their terms."""

    def __init__(self, items: list[int], of: list[np.ndarray], weights: np.ndarray):
        self.items = np.array(items)
        self.vocabulary = np.unique(np.concatenate(of))
        self.weights = np.zeros((len(items), len(self.vocabulary)))
        for row, own in enumerate(of):
            self.weights[row, np.searchsorted(self.vocabulary, own)] = weights[own]
        most = int(weights[self.vocabulary].max(initial=0))
        self.width = max(1, min(TERMS, (EXACT - 1) // (MOST_IMPACT * max(1, most))))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Exact scores of the items for the documents of a tile."""
        out = np.zeros((len(self.items), docs), np.int64)
        at = np.searchsorted(self.vocabulary, term)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == term
        present, at = np.unique(at[known], return_inverse=True)
        doc, impact = doc[known], impact[known]
        for low in range(0, len(present), self.width):
            here = (at >= low) & (at < low + self.width)
            dense = np.zeros((min(self.width, len(present) - low), docs))
            dense[at[here] - low, doc[here]] = impact[here]
            out += (self.weights[:, present[low:low + self.width]] @ dense).astype(np.int64)
        return out


def tiles(of: list[np.ndarray], weights: np.ndarray) -> list[Tile]:
    """The items with terms, cut so that a tile's weights stay within ``CELLS``
    (an item that has more terms is a tile alone)."""
    out, items, known = [], [], set()
    for i in (i for i, own in enumerate(of) if len(own)):
        more = known | set(of[i].tolist())
        if items and (len(items) == ITEMS or len(more) * (len(items) + 1) > CELLS):
            out.append(Tile(items, [of[j] for j in items], weights))
            items, more = [], set(of[i].tolist())
        items, known = [*items, i], more
    return [*out, Tile(items, [of[j] for j in items], weights)] if items else out


class Best:
    """The k best documents of each item: highest score, then smallest doc_id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held, self.size = [], 0

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        least = self.least[items]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        rows, docs = np.nonzero(scores >= least[:, None])  # all that tie with the last stay
        self.held.append((items[rows], scores[rows, docs], ids[docs], null[docs]))
        self.size += len(rows)
        if self.size > 1 << 17:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        item, score, ids, null = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, null, -score, item))
        own = item[order]
        order = order[np.arange(len(own)) - np.searchsorted(own, own) < self.k]
        item, score = item[order], score[order]
        last = np.flatnonzero(np.append(item[1:] != item[:-1], True))
        full = np.diff(np.append(-1, last)) == self.k
        self.least[item[last[full]]] = score[last[full]]
        self.held, self.size = [(item, score, ids[order], null[order])], len(item)
        return self.held[0]


def _counts(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and documents with each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(shared.value)}
        with_terms, all_terms, holding = 0, 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                for text in batch.column(0).slice(at, DOCS).to_pylist():
                    own = terms(text)
                    with_terms, all_terms = with_terms + bool(own), all_terms + len(own)
                    holding[[known[t] for t in set(own).intersection(known)]] += 1
        found = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((found, [-1, -2]))),
             pa.array(np.concatenate((holding[found], [with_terms, all_terms])))], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()  # at most a row for each term of the block
    n = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))
    return n.get(-1, 0), n.get(-2, 0), np.array([n.get(i, 0) for i in range(len(shared.value))], np.int64)


def _block(docs: DataFrame, pairs: pa.Table, k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    names = sorted(set(pairs["item_id"].to_pylist()), key=lambda x: (x is None, x))
    vocabulary = sorted(set(pairs["term"].to_pylist()))
    at, number = {t: i for i, t in enumerate(vocabulary)}, {x: i for i, x in enumerate(names)}
    of: list[list[int]] = [[] for _ in names]
    for x, t in zip(pairs["item_id"].to_pylist(), pairs["term"].to_pylist()):
        of[number[x]].append(at[t])
    words = spark.sparkContext.broadcast(vocabulary)
    n_docs, n_terms, holding = _counts(docs, words)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    shared = spark.sparkContext.broadcast(([np.sort(np.array(own)) for own in of], weights, pa.array(
        names, pairs["item_id"].type)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(words.value)}
        of, weights, names = shared.value
        blocks, best = tiles(of, weights), Best(len(of), k)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS):
                batch = whole.slice(start, DOCS)
                term, doc, tf, m = [], [], [], np.zeros(batch.num_rows, np.int64)
                for i, text in enumerate(batch.column(1).to_pylist()):
                    own = terms(text)
                    hits = [known[t] for t in own if t in known]
                    if hits:
                        found, count = np.unique(hits, return_counts=True)
                        m[i] = 10 + 90 * len(own) * n_docs // n_terms
                        term.append(found)
                        tf.append(count)
                        doc.append(np.full(len(found), i))
                if not term:
                    continue
                term, doc, tf = np.concatenate(term), np.concatenate(doc), np.concatenate(tf)
                impact = 10 ** 9 * tf // (1000 * tf + 8 * m[doc])
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy()
                for tile in blocks:
                    best.add(tile.items, tile.scores(term, doc, impact, batch.num_rows), ids, null)
        item, score, ids, null = best.cut()
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(item)), pa.array(ids, pa.int64(), mask=null), pa.array(score)],
            names=["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"item_id {kind}, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs (doc_id, text) for each of items (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = written(item_terms(items), "item_terms")
    blocks = -(-pairs.count() * 6 // (5 * PAIRS))
    own = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    parts = [docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id bigint, score bigint")]
    for b in range(blocks):
        block = pairs.where(own == b).toArrow()  # about PAIRS rows
        if block.num_rows:
            found = _block(docs, block, k, kind)
            parts.append(found if blocks == 1 else written(found, "ranked"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = reduce(DataFrame.unionByName, parts[1:] or parts)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
