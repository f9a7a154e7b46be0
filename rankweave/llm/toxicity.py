"""Operator 2: toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

Kernel: gap-weighted subsequences of ``ORDER`` characters inside words (a gap
costs a factor ``DECAY`` for each character it spans), squared, which keeps what
unrelated words share by chance small, and summed over the words of a sentence;
characters that are neither letters nor digits are taken out of a
word first, and runs of single letters are read as one word. So an insult with
inserted or spaced characters still shares its subsequences.

Landmarks are substrings of words: of those typical of toxic training documents
the ones that cover most of them, and frequent ordinary words. A sentence's
features are its kernels with the landmarks times the inverse root of the
landmarks' own kernel matrix, and a squared-hinge SVM is trained on sentences:
all sentences of clean documents, and of each toxic document the sentence that
looks most toxic, chosen anew in each of a few rounds. As the squares cost an
insult with an inserted letter three quarters of its kernel, every toxic document
is trained on once more with a letter inserted into each toxic landmark in it, and
clean sentences weigh ``CLEAN`` times, as the line then runs close to them. As features are sums over
words, the decision of a sentence is a sum of one number for each word, which is
computed once for each distinct word. A document scores as its most toxic
sentence, put through a logistic curve fitted on the training documents.

Training sees at most ``max_toxic`` and ``max_clean`` documents (those first by
the hash of doc_id, of at most ``max_chars`` characters), so what reaches the
driver is bounded; scoring reads every whole text.

Cases: null and empty texts score as a sentence without words; words over
``PIECE`` characters are read as overlapping pieces; repeated labels count once
(toxic if any says so), null ones not at all; without labels of both classes
the score is the share of toxic ones (0 without any); rows are all kept and only
``doc_id`` and ``text`` are read (``clean_documents`` keeps all columns).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied

ORDER, DECAY = 4, 0.5
PIECE, OVERLAP = 40, 12       # characters of a piece of a very long word
SENTENCE = 40                 # words, where no sentence ends before
SHORT, LONG = 4, 9            # characters of a landmark
CLEAN = 16                    # weight of all clean sentences against all toxic ones
COVER = 3                     # landmarks wanted in each toxic training document
CACHE_WORDS = 250_000
ENDS = (".", "!", "?", "…", "。")
JUNK = re.compile(r"[\W_]+")


# ------------------------------------------------------------------- kernel

def codes(words: list[str]) -> np.ndarray:
    """Code points of words, a row each, 0 after the end."""
    width = max(map(len, words), default=1) or 1
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def pair_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of the rows of s with the rows of t, pair by pair."""
    n = t.shape[1]
    step = np.arange(n)
    reach = np.where(step[None, :] >= step[:, None], DECAY ** (step[None, :] - step[:, None]).clip(0), 0.0)
    reach = reach.astype(np.float32)
    inner = [np.zeros((len(s), n + 1), np.float32) for _ in range(ORDER - 1)]
    ones = np.ones((len(s), n + 1), np.float32)
    out = np.zeros(len(s), np.float32)
    for x in s.T:
        live = x != 0
        if not live.any():
            break
        hit = ((t == x[:, None]) & live[:, None]) * np.float32(DECAY * DECAY)
        out += (hit * inner[-1][:, :-1]).sum(axis=1)
        decay = np.where(live, np.float32(DECAY), np.float32(1))[:, None]
        for i in range(ORDER - 2, -1, -1):
            below = inner[i - 1] if i else ones
            inner[i] *= decay
            inner[i][:, 1:] += (hit * below[:, :-1]) @ reach
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Squared kernels of all words with all landmarks (a landmark without gaps
    has about 1 for each of its subsequences); pairs that cannot share a
    subsequence (too few characters in common) are not computed: they are 0."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    t = codes(landmarks)
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(words), 20_000):
        rows = order[at:at + 20_000]
        s = codes([words[i] for i in rows])
        for j in range(len(landmarks)):
            own = t[j][t[j] != 0]
            common = np.zeros(len(rows), np.int32)
            for c in np.unique(own):
                common += np.minimum((s == c).sum(axis=1), (own == c).sum())
            near = np.flatnonzero(common >= ORDER)
            if len(near):
                out[rows[near], j] = pair_kernel(s[near], np.broadcast_to(own, (len(near), len(own))))
    return (out * np.float32(DECAY ** (-2 * ORDER))) ** 2


# ----------------------------------------------------------------- documents

def pieces(token: str) -> list[str]:
    word = JUNK.sub("", token)
    if len(word) <= PIECE:
        return [word]
    return [word[i:i + PIECE] for i in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


class Reader(dict):
    """Numbers of tokens, and of each token: value by ``measure`` (a row for each
    word), whether it ends a sentence, whether it is a single letter."""

    def __init__(self, measure):
        self.measure = measure
        self.tokens: list[str] = []
        self.values = self.ends = self.single = None

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.tokens)
        self.tokens.append(token)
        return n

    def reset(self) -> None:
        self.clear()
        self.tokens = []
        self.values = self.ends = self.single = None

    def learn(self) -> None:
        done = 0 if self.values is None else len(self.values)
        new = self.tokens[done:]
        if not new:
            return
        cut = [pieces(x) for x in new]
        flat = sorted({p for c in cut for p in c})
        at = {p: i for i, p in enumerate(flat)}
        of = self.measure(flat)
        first = np.fromiter((at[c[0]] for c in cut), np.int64, len(cut))
        values = of[first].copy()
        for i, c in enumerate(cut):
            for p in c[1:]:
                values[i] += of[at[p]]
        ends = np.fromiter((x.endswith(ENDS) for x in new), bool, len(new))
        single = np.fromiter((len(c[0]) == 1 for c in cut), bool, len(new))
        if done:
            values, ends, single = (np.concatenate(x) for x in (
                (self.values, values), (self.ends, ends), (self.single, single)))
        self.values, self.ends, self.single = values, ends, single

    def sentences(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the values of its sentences (none for a text without words)."""
        if len(self.tokens) > CACHE_WORDS:
            self.reset()
        seqs = []
        for text in texts:
            tokens = text.lower().split()
            seqs.append(np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens)))
        self.learn()
        spaced = []
        for k, s in enumerate(seqs):
            if not len(s):
                continue
            one = self.single[s]
            if one.sum() < 3:
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], one.astype(np.int8), [0]))))
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a >= 3:
                    word = "".join(JUNK.sub("", self.tokens[i]) for i in s[a:b])
                    spaced.append((k, a, self[word]))
        if spaced:
            self.learn()
        extra = defaultdict(list)
        for k, a, number in spaced:
            extra[k].append((a, number))
        for k, s in enumerate(seqs):
            if not len(s):
                yield np.zeros((0, *self.values.shape[1:]) if self.values is not None else 0)
                continue
            v = self.values[s]
            for a, number in extra.get(k, ()):
                v[a] += self.values[number]
            v[1:][s[1:] == s[:-1]] = 0  # a word right after itself counts once
            after = np.concatenate(([True], self.ends[s][:-1]))
            at = np.arange(len(s))
            since = at - np.maximum.accumulate(np.where(after, at, 0))
            start = np.flatnonzero(since % SENTENCE == 0)
            yield np.add.reduceat(v, start, axis=0)


# ------------------------------------------------------------------ training

@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: np.ndarray     # of the kernels with the landmarks
    bias: float
    slope: float            # of the logistic curve
    shift: float

    def measure(self, words: list[str]) -> np.ndarray:
        return (kernel(words, list(self.landmarks)) @ self.weights).astype(np.float64)

    def score(self, sentences: np.ndarray) -> float:
        top = self.bias + (sentences.max() if len(sentences) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -500, 500))))


def substrings(word: str) -> set[str]:
    return {word[i:i + n] for n in range(SHORT, LONG + 1) for i in range(len(word) - n + 1)}


def choose_landmarks(texts: list[str], toxic: np.ndarray, landmarks: int, ordinary: int) -> list[str]:
    """Substrings that cover the toxic documents, then frequent words of clean ones."""
    in_toxic, in_clean = defaultdict(set), defaultdict(int)
    for k, text in enumerate(texts):
        for w in {p for t in set(text.lower().split()) for p in pieces(t) if len(p) >= SHORT}:
            if toxic[k]:
                in_toxic[w].add(k)
            else:
                in_clean[w] += 1
    least = max(3, int(0.003 * toxic.sum()))
    share = toxic.sum() / max(1, (~toxic).sum())
    # documents of a substring are held only where bounds of their number let it through:
    # sums over words in a table of fixed size first, then of the substrings left
    slots = np.zeros(1 << 22, np.int32)
    for w, ks in in_toxic.items():
        slots[[hash(g) & len(slots) - 1 for g in substrings(w)]] += len(ks)
    most, of_clean = defaultdict(int), defaultdict(int)
    for w, ks in in_toxic.items():
        for g in substrings(w):
            if slots[hash(g) & len(slots) - 1] >= least:
                most[g] += len(ks)
    del slots
    for w, c in in_clean.items():
        for g in substrings(w):
            if g in most:
                of_clean[g] += c
    fit = {g: set() for g, n in most.items() if n >= max(least, 5 * share * (of_clean[g] + 0.5))}
    del most
    for w, ks in in_toxic.items():
        for g in substrings(w):
            if g in fit:
                fit[g] |= ks
    fit = {g: ks for g, ks in fit.items() if len(ks) >= max(least, 5 * share * (of_clean[g] + 0.5))}
    chosen, left = [], set(np.flatnonzero(toxic).tolist())
    times = dict.fromkeys(left, 0)
    while fit and len(chosen) < landmarks:
        # the most documents not covered COVER times; of equals the longest, then by spelling
        g = max(fit, key=lambda g: (len(fit[g] & left) - 5 * share * of_clean[g], len(g), g))
        if len(fit[g] & left) < least:
            break
        chosen.append(g)
        for k in fit.pop(g):
            times[k] += 1
        left = {k for k in left if times[k] < COVER}
        own = {g[i:i + SHORT] for i in range(len(g) - SHORT + 1)}
        fit = {x: ks for x, ks in fit.items() if not any(q in x for q in own)}
    common = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    chosen += [w[:LONG] for w in common[:ordinary]]
    return list(dict.fromkeys(chosen))


def with_inserted(text: str, marks: list[str]) -> str:
    """The text with a letter inserted into the first of each mark in each word;
    place and letter are by a digest."""
    out = []
    for n, word in enumerate(text.lower().split()):
        for mark in marks:
            at = word.find(mark)
            if at >= 0:
                by = crc32(f"{n} {word} {mark}".encode("utf-8", "surrogatepass"))
                at += 1 + by % (len(mark) - 1)
                word = word[:at] + chr(ord("a") + (by >> 8) % 26) + word[at:]
        out.append(word)
    return " ".join(out)


def train_svm(a: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared-hinge linear SVM in the primal, by Newton steps on the active rows;
    the last column of a is 1, rows of no cost take no part. Rows are read in
    blocks, so that they are held once."""
    keep = ridge * np.eye(a.shape[1])
    keep[-1, -1] = 1e-9
    w = np.zeros(a.shape[1])
    for _ in range(30):
        on = np.flatnonzero((y * (a @ w) < 1) & (cost > 0))
        left, right = keep.copy(), np.zeros(a.shape[1])
        for at in range(0, len(on), 10_000):
            own = on[at:at + 10_000]
            b = a[own] * cost[own, None]
            left += b.T @ a[own]
            right += b.T @ y[own]
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-6 * (1 + np.abs(w).max())
        w = new
        if done:
            break
    return w


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 28, ordinary: int = 8, rounds: int = 4) -> Model:
    toxic = np.asarray(toxic, bool)
    n = len(toxic)
    if not n or toxic.all() or not toxic.any():
        odds = np.clip(toxic.mean() if n else 0.0, 1e-9, 1 - 1e-9)
        return Model((), np.zeros(0, np.float32), 0.0, 0.0, float(np.log(odds / (1 - odds))))
    marks = choose_landmarks(texts, toxic, landmarks, ordinary)
    bad = marks[:max(1, len(marks) - ordinary)]
    more = [v for t, y in zip(texts, toxic) if y and (v := with_inserted(t, bad)) != " ".join(t.lower().split())]
    texts, toxic = [*texts, *more], np.concatenate((toxic, np.ones(len(more), bool)))
    n = len(toxic)
    own = kernel(marks, marks).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])  # to Nystroem features
    # first guess: the kernels with the toxic landmarks, each by its own size
    reader, size = Reader(lambda words: kernel(words, marks).astype(np.float64)), np.diag(own)
    parts, guess, counts = [], [], []
    for at in range(0, n, 250):
        held = [s if len(s) else np.zeros((1, len(marks))) for s in reader.sentences(texts[at:at + 250])]
        counts += map(len, held)
        whole = np.concatenate(held)
        parts.append(np.hstack((whole @ root, np.ones((len(whole), 1)))))
        guess.append((whole / size)[:, :len(bad)].sum(axis=1))
    reader.reset()
    first = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(n), counts)
    rows, guess, at = np.empty((first[-1], root.shape[1] + 1)), np.concatenate(guess), 0
    while parts:  # a part goes as soon as its rows are taken over
        part = parts.pop(0)
        rows[at:at + len(part)] = part
        at += len(part)
    scale = np.abs(rows[:, :-1]).max() or 1.0
    rows[:, :-1] /= scale
    y = np.where(toxic[owner], 1.0, -1.0)
    clean = int((y < 0).sum())
    for _ in range(rounds):
        top = np.array([first[k] + np.argmax(guess[first[k]:first[k + 1]]) for k in np.flatnonzero(toxic)])
        cost = np.where(y < 0, CLEAN / clean, 0.0)
        cost[top] = 1 / len(top)
        w = train_svm(rows, y, cost * (len(top) + clean), ridge=1e-3)
        guess = rows @ w
    w, b = w[:-1], float(w[-1])
    best = np.maximum.reduceat(guess, first[:-1])
    slope, shift = fit_curve(best, toxic)
    return Model(tuple(marks), (root @ w / scale).astype(np.float32), b, slope, shift)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve with softened targets, by Newton steps."""
    p, n = y.sum(), (~y).sum()
    target = np.where(y, (p + 1) / (p + 2), 1 / (n + 2))
    a = np.stack((x, np.ones(len(x))), axis=1)
    w = np.zeros(2)

    def loss(v):
        z = a @ v
        return np.sum(np.logaddexp(0, z) - target * z) + 1e-6 * v @ v

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (q - target) + 2e-6 * w
        move = np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 2e-6 * np.eye(2), g)
        size = 1.0
        while loss(w - size * move) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


# --------------------------------------------------------------------- Spark

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000,
        max_chars: int = 20_000, **options) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_rw_id")).agg(F.max("toxic").alias("_rw_toxic"))
    order = (F.xxhash64("_rw_id"), F.col("_rw_id"))
    sample = (known.where("_rw_toxic = 1").orderBy(*order).limit(max_toxic)
              .unionByName(known.where("_rw_toxic = 0").orderBy(*order).limit(max_clean)))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    got = texts.where(F.char_length("text") <= max_chars).join(
        F.broadcast(sample), F.col("doc_id") == F.col("_rw_id")).select("doc_id", "text", "_rw_toxic").distinct()
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_toxic + max_clean).collect()
    return train([r["text"] for r in got], np.array([r["_rw_toxic"] == 1 for r in got], bool), **options)


def _scored(docs: DataFrame, model: Model, text_at: int, schema: str, emit) -> DataFrame:
    state = {"model": (model.landmarks, model.weights, model.bias, model.slope, model.shift)}
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value  # kept by the worker from task to task, and the cache with it
        if "reader" not in state:
            own = Model(*state["model"])
            state["reader"] = own, Reader(own.measure)
        own, reader = state["reader"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                part = batch.slice(at, 2500)
                texts = [x or "" for x in part.column(text_at).to_pylist()]
                yield emit(part, np.array([own.score(s) for s in reader.sentences(texts)], np.float64))

    return docs.mapInArrow(tidied(run), schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(part, s):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = _scored(docs.select("doc_id", "text"), model, 1, f"doc_id {kind}, score double", emit)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score under one half."""
    return _scored(docs, model, docs.columns.index("text"), docs.schema,
                   lambda part, s: part.filter(pa.array(s < 0.5)))
