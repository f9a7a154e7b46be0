"""Operator 1: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern; each match (pre-token) is encoded by
itself. All pre-tokens a batch has not seen before are laid end to end and
merged by one queue: a bucket for each merge rank holds the positions (of a
doubly linked list of parts) where that pair stands, a bitmap in three levels
says which buckets hold something, find-first-set gives the next rank, and
entries whose pair has changed meanwhile are stale and skipped. The positions of
a bucket are merged together by NumPy, so the Python cost goes with the number
of distinct ranks, not of merges; a pre-token of any length takes the same way.

Taking a whole bucket at once is exact for ranks whose token can never be the
part of a pair with a lower rank (computed from the vocabulary); for the others,
and where equal pairs overlap, only the leftmost of each pre-token is taken.

The cache of encoded units is bounded by ``CACHE_UNITS`` and ``CACHE_IDS`` and
emptied when full; a worker keeps it from task to task, beside the broadcast
vocabulary. Cases: null text is empty: no ids, digests of nothing; any length of text;
repeated rows are all kept; empty table, empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, tidied

CACHE_UNITS = 250_000     # encoded units kept by a worker
CACHE_IDS = 4_000_000     # and their ids
BATCH_CHARS = 8_000_000   # characters whose new units are merged together
LOOKUP = 1 << 16          # pairs looked up together


class RankBits:
    """Three-level bitmap over ranks: find-first-set by bit tricks on integers."""

    def __init__(self, n: int):
        self.low = [0] * (n // 64 + 1)
        self.mid = [0] * (n // 4096 + 1)
        self.top = 0

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << ((r >> 6) & 63)
        self.top |= 1 << (r >> 12)

    def first(self) -> int:
        """The least rank present, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = (a << 6) + (m & -m).bit_length() - 1
        w = self.low[b]
        return (b << 6) + (w & -w).bit_length() - 1

    def remove(self, r: int) -> None:
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.mid[r >> 12] &= ~(1 << ((r >> 6) & 63))
            if not self.mid[r >> 12]:
                self.top &= ~(1 << (r >> 12))


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of ranks that has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, got, early = [], [], set()
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    got.append(r)
                    early.update(x for x in (a, b) if x > r)
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks = np.array(keys, np.int64)[at], np.array(got, np.int32)[at]
        self.early = early  # tokens that are part of a pair with a lower rank

    @classmethod
    def read(cls, data: bytes) -> "Vocabulary":
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})

    @classmethod
    def of(cls, state: dict) -> "Vocabulary":
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair, -1 if it has none."""
        out = np.empty(len(a), np.int32)
        for i in range(0, len(a), LOOKUP):
            key = a[i:i + LOOKUP].astype(np.int64) << 32 | b[i:i + LOOKUP]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[i:i + LOOKUP] = np.where(self.keys[at] == key, self.ranks[at], -1)
        return out


def _leftmost(pos: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of sorted positions of one pair, those merged when going from left to
    right: in a chain in which each part is the right half of the one before,
    every second."""
    if len(pos) < 2:
        return np.ones(len(pos), bool)
    linked = np.concatenate(([False], after[pos[:-1]] == pos[1:]))
    at = np.arange(len(pos))
    start = np.maximum.accumulate(np.where(linked, 0, at))
    return (at - start) % 2 == 0


def merge(v: Vocabulary, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces of ``data`` one after another, and how many each has."""
    n = len(data)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    part = np.empty(n + 1, np.int32)
    part[:n], part[n] = v.bytes[np.frombuffer(data, np.uint8)], -1
    # the list links of parts; n stands for "none", and a piece ends its list
    after, prior = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    if n:
        last = np.cumsum(lengths)[lengths > 0] - 1
        first = np.concatenate(([0], last[:-1] + 1))
        after[last], prior[first] = n, n
    after[n] = prior[n] = n
    rank = np.full(n + 1, -1, np.int32)
    alive = np.ones(n + 1, bool)
    alive[n] = False
    buckets: dict[int, list[np.ndarray]] = {}
    bits = RankBits(len(v.tokens))

    def push(pos: np.ndarray) -> None:
        """Look up the pairs at these positions and enter those with a rank."""
        if not len(pos):
            return
        right = after[pos]
        r = v.pair(part[pos], part[right])
        r[right >= n] = -1
        rank[pos] = r
        keep = r >= 0
        pos, r = pos[keep], r[keep]
        if not len(pos):
            return
        by = np.argsort(r, kind="stable")
        pos, r = pos[by], r[by]
        cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))).tolist()
        for i, j in zip(cuts, cuts[1:] + [len(r)]):
            k = int(r[i])
            if k not in buckets:
                buckets[k] = []
                bits.add(k)
            buckets[k].append(pos[i:j])

    push(np.arange(n, dtype=np.int32))
    while (k := bits.first()) >= 0:
        bits.remove(k)
        found = buckets.pop(k)
        pos = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        pos = pos[alive[pos] & (rank[pos] == k)]  # the others are stale
        if not len(pos):
            continue
        if k in v.early:
            own = owner[pos]
            take = np.concatenate(([True], own[1:] != own[:-1]))
        else:
            take = _leftmost(pos, after)
        if not take.all():
            buckets[k] = [pos[~take]]
            bits.add(k)
            pos = pos[take]
        right = after[pos]
        beyond = after[right]
        part[pos] = k
        alive[right] = False
        after[pos] = beyond
        prior[beyond] = pos
        after[n] = prior[n] = n
        left = prior[pos]
        push(np.unique(np.concatenate((left[left < n], pos))))
    live = alive[:n]
    return part[:n][live], np.bincount(owner[live], minlength=len(lengths)).astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] items, then those of the next."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Encoder:
    """Texts to ids with a bounded cache of encoded units.

    A unit is what stands between two single spaces, with the space before it:
    the pattern never matches across a space that has a non-space on both sides,
    so a unit's pre-tokens are the text's own. Texts where white space meets
    white space at a unit's edge are cut by the pattern as a whole instead, and
    their pre-tokens are the units.
    """

    class _Numbers(dict):
        """Numbers of units, in order of first sight; -1 where the edge is white space."""

        def __init__(self, new: list[str], prefix: str):
            self.new, self.prefix = new, prefix

        def __missing__(self, key):
            if self.prefix and (not key or key[0].isspace() or key[-1].isspace()):
                self[key] = -1
                return -1
            self[key] = n = len(self.new)
            self.new.append(self.prefix + key)
            return n

    def __init__(self, vocabulary: Vocabulary, pattern: str, batch_chars: int = BATCH_CHARS,
                 cache_units: int = CACHE_UNITS):
        import regex

        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self.batch_chars, self.cache_units = batch_chars, cache_units
        self._clear()

    def _clear(self) -> None:
        self.units, self.done = [], 0
        self.plain, self.spaced = self._Numbers(self.units, ""), self._Numbers(self.units, " ")
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _cut(self, text: str) -> np.ndarray:
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            seq = np.empty(len(rest) + 1, np.int32)
            seq[0] = self.plain[head]
            seq[1:] = np.fromiter(map(self.spaced.__getitem__, rest), np.int32, len(rest))
            if seq.min() >= 0:
                return seq
        words = self.find(text)
        return np.fromiter(map(self.plain.__getitem__, words), np.int32, len(words))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        at = 0
        while at < len(texts):
            if len(self.units) > self.cache_units or len(self.ids) > CACHE_IDS:
                self._clear()
            seqs, chars = [], 0
            while at < len(texts) and (not seqs or chars + len(texts[at]) <= self.batch_chars):
                seqs.append(self._cut(texts[at]))
                chars += len(texts[at])
                at += 1
            self._learn()
            for s in seqs:
                yield self.ids[ragged(self.starts[s], self.counts[s])]

    def _learn(self) -> None:
        if self.done == len(self.units):
            return
        cut = [self.find(u) for u in self.units[self.done:]]
        new = [w.encode("utf-8", "surrogatepass") for c in cut for w in c]
        ids, counts = merge(self.v, b"".join(new), np.fromiter(map(len, new), np.int64, len(new)))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        total = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))]
        self.starts = np.concatenate((self.starts, len(self.ids) + total[:-1]))
        self.counts = np.concatenate((self.counts, np.diff(total)))
        self.ids = np.concatenate((self.ids, ids))
        for i in range(self.done, len(self.units)):
            self.units[i] = None  # only the dictionaries need the strings
        self.done = len(self.units)


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    return b"".join(map(v.tokens.__getitem__, ids.tolist()))


def vocabulary_file(name_or_path: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
                     pattern: str | None = None, with_ids: bool = False, batch_chars: int = BATCH_CHARS,
                     cache_units: int = CACHE_UNITS) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids
    themselves (``ids array<int>``). ``ranks``: path of a rank file, read on the
    driver and sent with the tasks (its size is that of the vocabulary).
    ``batch_chars`` and ``cache_units`` bound a worker's memory, not the result."""
    with open(vocabulary_file(ranks or "byte_bpe_50k.tiktoken"), "rb") as f:
        state = {"vocabulary": vars(Vocabulary.read(f.read())), "pattern": pattern or public_pattern()}
    shared = docs.sparkSession.sparkContext.broadcast(state)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # kept by the worker from task to task, and the cache with it
        if "encoder" not in state:
            state["encoder"] = Encoder(Vocabulary.of(state["vocabulary"]), state["pattern"], batch_chars, cache_units)
        encoder = state["encoder"]
        for batch in (whole.slice(at, 2500) for whole in batches for at in range(0, whole.num_rows, 2500)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, a, b, kept = [], [], [], []
            for ids in encoder.encode(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(decode(encoder.v, ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.empty(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(out, names=names)
            del texts, kept, out
            give_back()

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
