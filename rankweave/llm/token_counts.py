"""Operator 5: token counts of a unigram tokenizer by a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all matches by their
end; dynamic programming carries, for each position, the best score and the
number of tokens on its path, and no path. Ties follow the ``tokenizers``
library exactly: doubles are summed from the left, the first candidate (the
longest piece) stays unless a later one is strictly better, a character without
a piece of its own costs the least score minus 10, and such characters become
their UTF-8 bytes.

The dealt vocabulary file is a BPE model: its scores are merge ranks, no log
probabilities, and no unigram file is given. So ``unigram`` makes one: the
file's pieces (without control, unknown and byte pieces, which stand for no text),
with the log share of each among all pieces of the file's own segmentation of
the corpus (one more than counted, so that pieces not seen stay possible).

A space becomes the mark U+2581, a mark is put before the text, and the text is
cut before each mark, as that library's ``Metaspace`` does; counts of what
stands between marks are cached (``CACHE_WORDS`` at most, kept by a worker from
task to task).

Cases: null and empty texts have 0 tokens; any length of text; repeated rows are
all kept; empty table, empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MARK = "▁"
CACHE_WORDS = 250_000
UNKNOWN_PENALTY = 10.0


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[str]:
    """What stands after each mark (without the mark), the one put before the text included."""
    if not text:
        return []
    parts = text.replace(" ", MARK).split(MARK)
    if not parts[0]:
        del parts[0]
    return parts


def vocabulary(model_path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order of id. Those of a
    BPE model are merge ranks; ``unigram`` has log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path or model_file())
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter(dict):
    """Counts of the tokens of a mark and what follows it up to the next one."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        self[word] = n = self.count(MARK + word)
        return n

    def count(self, text: str) -> int:
        n = len(text)
        best, tokens = [0.0] * (n + 1), [0] * (n + 1)
        at, single = 0, True  # the end looked at; whether its last character is a piece
        for end, (length, score) in self.automaton.iter(text):  # by end, the longest first
            end += 1
            if end != at:
                if not single:
                    self._unknown(text, best, tokens, at, True)
                for i in range(at + 1, end):  # ends without a match
                    self._unknown(text, best, tokens, i, False)
                at, single = end, length == 1
                best[end], tokens[end] = best[end - length] + score, tokens[end - length] + 1
                continue
            single = single or length == 1
            candidate = best[end - length] + score
            if candidate > best[end]:
                best[end], tokens[end] = candidate, tokens[end - length] + 1
        if not single:
            self._unknown(text, best, tokens, at, True)
        for i in range(at + 1, n + 1):
            self._unknown(text, best, tokens, i, False)
        return tokens[n]

    def _unknown(self, text: str, best: list, tokens: list, end: int, matched: bool) -> None:
        """The last character before ``end`` as bytes: the last candidate for that end."""
        candidate = best[end - 1] + self.unknown
        if not matched or candidate > best[end]:
            best[end] = candidate
            tokens[end] = tokens[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

    def tokens(self, text: str) -> int:
        return sum(map(self.__getitem__, words_of(text)))


def unigram(docs: DataFrame, text_col: str = "text", model_path: str | None = None) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model file with the log of their share in the
    model's segmentation of all texts. The driver gets a count for each piece."""
    import sentencepiece

    with open(model_path or model_file(), "rb") as f:
        proto = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        counts, words = np.zeros(own.get_piece_size(), np.int64), Tally()

        def add() -> None:
            said = list(words)
            for i in range(0, len(said), 10_000):
                some = said[i:i + 10_000]
                ids = [own.encode(w) if w else [own.piece_to_id(MARK)] for w in some]
                times = np.repeat([words[w] for w in some], list(map(len, ids)))
                np.add.at(counts, np.concatenate(ids).astype(np.int64), times)
            words.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(words_of(text or ""))
                if len(words) > CACHE_WORDS:
                    add()
        add()
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    found = docs.select(text_col).mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    table = written(found, "pieces").toArrow()  # at most a row for each piece
    fit = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    counts = np.zeros(model.get_piece_size(), np.int64)
    counts[table["id"].to_numpy()] = table["n"].to_numpy()
    scores = np.log(counts[fit] + 1.0) - np.log(counts[fit].sum() + len(fit))
    return list(zip(map(model.id_to_piece, fit), scores.tolist()))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model_path: str | None = None, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """id and n_tokens of every row, by the given pieces and scores or else by those
    of the vocabulary file, which is read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": pieces or vocabulary(model_path)})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "counter" not in state:
            state["counter"] = Counter(state["pieces"])
        counter = state["counter"]
        for batch in batches:
            n = []
            for text in batch.column(1).to_pylist():
                n.append(counter.tokens(text or ""))
                if len(counter) > CACHE_WORDS:
                    counter.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
