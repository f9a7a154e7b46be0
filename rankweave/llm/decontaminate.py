r"""Operator 9: benchmark decontamination by a prefix-filtered set join (native).

Items are cut into windows of 13 words (a shorter item is one window). To occur
in a document a window needs all its words there, so its containment prefix is
one word: the window's rarest over the whole corpus. Words of the items are
counted over all documents, every window is anchored at its rarest word (windows
with a word the corpus lacks cannot occur), document positions that hold an
anchor are joined to the anchored windows, the position of the anchor and the
words left on both sides bound what can fit, and the words around the position
are compared with the window exactly. A bitmap of the anchors (``filter_bits``
at most; it only filters less when there are more anchors) keeps other words
from leaving the row of their document, and unverified pairs are never shuffled
when the windows are small enough to broadcast (their measured bytes decide).

Cases: null and wordless texts have no words, no hits and are clean; null or
wordless items have no window; repeated documents are judged each; items are
listed once by id, and one without an id hits words but is not listed; empty
tables work; other columns are not read (``clean_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty, written
from .url_cascade import Level, encode_bits, passes

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """words, item_ids (sorted as strings): every distinct window."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty()).alias("w"))
    w = w.where(F.size("w") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    w = w.select("item_id", "w", first.alias("i")).select("item_id", F.slice("w", F.col("i"), window).alias("words"))
    return w.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))


def _bitmap(words: DataFrame, filter_bits: int) -> Level:
    bits = min(filter_bits, 64 * (words.count() * 16 // 64 + 1))
    return encode_bits(words.select(F.col("word").alias("key")), 0, bits, 1)


def anchored_windows(docs: DataFrame, windows: DataFrame, filter_bits: int) -> DataFrame:
    """The windows that can occur, each with its rarest word and where it stands."""
    each = windows.select("words", "item_ids", F.explode(F.array_distinct("words")).alias("word"))
    vocabulary = written(each.select("word").distinct(), "vocabulary")
    known = _bitmap(vocabulary, filter_bits)
    found = docs.select(F.explode(F.filter(words_of(text_or_empty()), lambda w: passes(w, 0, known))).alias("word"))
    counts = found.groupBy("word").count().join(vocabulary, "word", "left_semi")
    rated = each.join(counts, "word", "left").groupBy("words").agg(
        F.first("item_ids").alias("item_ids"), F.min(F.coalesce("count", F.lit(0))).alias("least"),
        F.min(F.struct(F.coalesce("count", F.lit(0)), "word"))["word"].alias("anchor"))
    return rated.where("least > 0").select(
        "words", "item_ids", "anchor", (F.array_position("words", F.col("anchor")) - 1).cast("int").alias("offset"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, filter_bits: int = 1 << 20) -> DataFrame:
    """A row for every different (doc_id, text): doc_id, copies, key1, key2 (64-bit
    digests of the row), n_words, spans (array<start, end> of occurrences), item_ids."""
    windows = written(anchored_windows(docs, item_windows(items, window), filter_bits), "windows")
    anchors = _bitmap(windows.select(F.col("anchor").alias("word")).distinct(), filter_bits)
    size = windows.select(F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words") + 64
                                + 32 * F.size("item_ids"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        windows = F.broadcast(windows)
    text = text_or_empty()
    d = docs.select("doc_id", F.xxhash64(F.col("doc_id"), text).alias("key1"),
                    F.xxhash64(text, F.lit(1)).alias("key2"), words_of(text).alias("w"))
    places = F.when(F.size("w") == 0, F.array().cast("array<int>")).otherwise(F.filter(
        F.sequence(F.lit(0), F.size("w") - 1), lambda i: passes(F.get("w", i), 0, anchors)))
    near = F.transform(places, lambda i: F.struct(
        i.alias("at"), F.get("w", i).alias("word"), F.least(i, F.lit(window - 1)).alias("left"),
        F.slice("w", F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1)) + window).alias("around")))
    # one more entry for each document: it counts the copies of a row and keeps
    # those without hits; its word is no word, and another for each document
    mark = F.struct(F.lit(-1).alias("at"), F.concat(F.lit("\0"), F.col("key1").cast("string")).alias("word"),
                    F.lit(0).alias("left"), F.array().cast("array<string>").alias("around"))
    d = d.select("doc_id", "key1", "key2", F.size("w").cast("long").alias("n_words"),
                 F.explode(F.concat(F.array(mark), near)).alias("x"))
    x, length = F.col("x"), F.size("words")
    fits = ((x["word"] == F.col("anchor")) & (x["left"] >= F.col("offset"))
            & (F.size(x["around"]) - x["left"] >= length - F.col("offset"))
            & (F.slice(x["around"], x["left"] - F.col("offset") + 1, length) == F.col("words")))
    j = d.join(windows, fits, "left").where((x["at"] < 0) | F.col("anchor").isNotNull())
    start = x["at"] - F.col("offset")
    j = j.select("doc_id", "key1", "key2", "n_words", (x["at"] < 0).cast("long").alias("mark"),
                 F.when(x["at"] >= 0, F.struct(start.alias("start"), (start + length).alias("end"))).alias("span"),
                 "item_ids")
    return j.groupBy("doc_id", "key1", "key2", "n_words").agg(
        F.sum("mark").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))


def _n_hit() -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate("spans", start, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"),
        F.greatest(s["end"], a["to"]).alias("to")), lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    h = hits(docs, items, **options).withColumn("n_hit", _n_hit())
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    h = h.select("doc_id", "key1", "key2", "copies", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                 F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), dirty.alias("contaminated"))
    return h.withColumn("_rw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_rw_copy",
                                                                                                    "copies")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    dirty = contamination(docs, items, **options).where("contaminated").select(
        F.col("key1").alias("_rw_key1"), F.col("key2").alias("_rw_key2")).distinct()
    text = text_or_empty()
    keyed = docs.withColumns({"_rw_key1": F.xxhash64(F.col("doc_id"), text), "_rw_key2": F.xxhash64(text, F.lit(1))})
    return keyed.join(dirty, ["_rw_key1", "_rw_key2"], "left_anti").drop("_rw_key1", "_rw_key2")
