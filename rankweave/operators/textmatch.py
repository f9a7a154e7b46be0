"""Exact substring containment join: (document, pattern) pairs where the
pattern text occurs in the document text.

A non-equi ``contains`` join would be a nested loop over documents x patterns, and
an equi-join on shared grams would carry the grams of every text through a
shuffle and the whole texts to the pairs found. Instead the patterns go to the
texts: every pattern is anchored at a gram that a text holding the pattern must
hold too, the anchors are broadcast as a dictionary (its size is measured in
Spark first), and one pass over the documents looks up each gram of a text and
verifies what it finds in the row. Only (document, pattern) keys leave the task:
no text is shuffled, broadcast or joined back.

* a pattern with inner words (words bounded by single spaces on both sides
  inside the pattern) is anchored at its longest run of up to ``WORDS`` of them;
* a shorter pattern is anchored at its first ``CHARS`` characters;
* an empty pattern is contained in every non-null text.

Only the kinds of grams that some pattern needs are looked up. Patterns beyond
``MAX_PATTERNS`` or ``MAX_PATTERN_BYTES`` go in blocks, one pass each, whose
pairs are written to the shared checkpoint folder.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import written

WORDS = 3
CHARS = 8
MAX_PATTERNS = 100_000
MAX_PATTERN_BYTES = 32 << 20


class Anchors:
    """Patterns by the gram that a text holding them must hold."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.empty: list[int] = []
        self.words: dict[str, dict[int, dict[str, list[int]]]] = {}  # first word, words of the gram, gram
        self.chars: dict[int, dict[str, list[int]]] = defaultdict(dict)
        for i, p in enumerate(patterns):
            inner = p.split(" ")[1:-1]
            if inner:
                n = min(len(inner), WORDS)
                grams = [inner[j:j + n] for j in range(len(inner) - n + 1)]
                best = max(grams, key=lambda g: (len(" ".join(g)), g))
                self.words.setdefault(best[0], {}).setdefault(n, {}).setdefault(" ".join(best), []).append(i)
            elif p:
                self.chars[min(len(p), CHARS)].setdefault(p[:CHARS], []).append(i)
            else:
                self.empty.append(i)

    def found(self, text: str) -> list[int]:
        """The patterns that the text contains."""
        near: set[int] = set()
        if self.words:
            tokens = text.split(" ")
            for i, t in enumerate(tokens):
                for n, grams in self.words.get(t, {}).items():
                    near.update(grams.get(t if n == 1 else " ".join(tokens[i:i + n]), ()))
        for n, grams in self.chars.items():
            for g in grams.keys() & {text[i:i + n] for i in range(len(text) - n + 1)}:
                near.update(grams[g])
        return self.empty + [i for i in near if self.patterns[i] in text]


def contains_join(docs: DataFrame, patterns: DataFrame, *, doc_key: str, doc_text: str, pat_key: str,
                  pat_text: str, max_patterns: int = MAX_PATTERNS, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Rows ``(doc_key, pat_key)`` for every document containing the pattern
    text, as SQL ``contains``: an empty pattern is contained in every non-null
    document, a null pattern or document matches nothing.
    """
    d = docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_t")).where(F.col("_t").isNotNull())
    p = patterns.select(F.col(pat_key).alias("_p"), F.col(pat_text).alias("_s")).where(F.col("_s").isNotNull()).distinct()
    size = p.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_s")), F.lit(0)).alias("bytes")).first()
    # blocks are dealt by hash: a fifth more of them keeps each within the bounds
    over = max(size["n"] / max_patterns, size["bytes"] / max_bytes)
    blocks = 1 if over <= 1 else math.ceil(1.2 * over)
    parts = []
    for b in range(blocks):
        own = p if blocks == 1 else p.where(F.pmod(F.xxhash64("_p", "_s"), F.lit(blocks)) == b)
        found = _found(d, own.toArrow(), p.schema["_p"].dataType.simpleString())
        parts.append(found if blocks == 1 else written(found, "contained"))
    return reduce(DataFrame.unionByName, parts).select(F.col("_d").alias(doc_key), F.col("_p").alias(pat_key))


def _found(d: DataFrame, patterns: pa.Table, key_type: str) -> DataFrame:
    bc = d.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        anchors = Anchors(bc.value.column("_s").to_pylist())
        keys = pa.concat_arrays(bc.value.column("_p").chunks) if len(anchors.patterns) else None
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = anchors.found(text)
                rows += [i] * len(got)
                hits += got
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.array(rows))), keys.take(pa.array(np.array(hits)))], names=["_d", "_p"])

    return d.mapInArrow(run, f"_d {d.schema['_d'].dataType.simpleString()}, _p {key_type}")
