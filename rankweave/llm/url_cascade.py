"""Operator 10: URL rules through a Bloom filter cascade (native).

Rules are (host, path, verdict); a rule fits its host and all subdomains when
the path of the url starts with the path of the rule, and the longest fitting
rule wins (host and path together; on a tie the longer host). Every url yields
a few candidate keys ``suffix-of-host + prefix-of-path``; only suffixes with at
most as many labels as some rule has, and prefixes as long as some rule's path,
can name a rule, so nothing else is made.

The rule keys are encoded as a cascade over the complete universe of candidate
keys of the corpus: level 0 is a Bloom filter of the listed keys, level 1 one of
the universe keys that pass level 0 without being listed, level 2 one of the
listed keys that pass level 1, and so on until nothing passes wrongly. The first
level a key fails tells exactly whether it is listed, so the corpus is judged by
column expressions, without a join. Level 0 is sized from the number of universe
keys, so that about as many keys pass it wrongly as are listed: all levels
together take O(listed * log(universe / listed)) bits and are bounded by the
rule list. Lists over ``max_bits`` raise, so nothing unbounded becomes a literal.

Cases: null url, or one without ``://``: empty host and path, no rule, verdict
``default``. Empty tables give empty results; repeated rows are all judged;
other columns of the input are not touched (``judge`` only adds columns).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def candidate_keys(host: Column, path: Column, rules) -> Column:
    """Keys a rule for this url could have, the longest first."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    parts = []
    for k in sorted({h.count(".") + 1 for h, _, _ in rules}):
        suffix = F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
        for m in sorted({len(p) for _, p, _ in rules}):
            fits = (n >= k) & (F.char_length(path) >= m)
            key = F.concat(suffix, F.substring(path, 1, m))
            parts.append(F.when(fits, F.struct(F.char_length(key).alias("n"), F.char_length(suffix).alias("h"),
                                               key.alias("key"))))
    found = F.sort_array(F.array_compact(F.array(*parts)), asc=False)
    return F.transform(found, lambda x: x["key"])


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits).cast("long")) for j in range(hashes)]


def encode_bits(keys: DataFrame, level: int, bits: int, hashes: int) -> Level:
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    got = pos.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    words = [0] * (bits // 64)
    for r in got.collect():  # at most bits / 64 rows
        words[r["w"]] = r["v"]
    return Level(bits, hashes, tuple(words))


def passes(key: Column, level: int, made: Level) -> Column:
    # a foldable expression: Catalyst turns it into one array literal
    words = F.split(F.lit(",".join(map(str, made.words))), ",").cast("array<bigint>")
    tests = [F.call_function("bit_get", F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1
             for p in _positions(key, level, made.bits, made.hashes)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(passes(key, i, self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = 1 << 27) -> Cascade:
    """``universe`` and ``listed`` have a column ``key`` without repeats or nulls."""
    n_listed, n_universe = listed.count(), universe.count()
    sides = [listed, universe.join(listed, "key", "left_anti")]
    levels: list[Level] = []
    n = n_listed
    while n:
        i = len(levels)
        if i == 0:
            hashes = max(1, math.ceil(math.log2(max(2.0, n_universe / n))))
        else:
            hashes = 1
        bits = 64 * math.ceil(1.45 * hashes * n / 64)
        if bits > max_bits:
            raise ValueError(f"{n} keys need {bits} bits, over max_bits={max_bits}")
        levels.append(encode_bits(sides[i % 2], i, bits, hashes))
        # what passes this level wrongly is all the next level has to hold
        sides[1 - i % 2] = written(sides[1 - i % 2].where(passes(F.col("key"), i, levels[-1])), "cascade")
        n = sides[1 - i % 2].count()
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules=RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict`` added."""
    if any(not p.startswith("/") for _, p, _ in rules):
        raise ValueError("the path of a rule starts with /")
    spark = pages.sparkSession
    kind = {h + p: v for h, p, v in rules}
    if not kind:
        return pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)),
                                  "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    parsed = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    universe = written(parsed.select(F.explode(candidate_keys(F.col("host"), F.col("path"), rules)).alias("key"))
                       .distinct(), "universe")

    def cascade(keys: list[str]) -> Cascade:
        return build_cascade(universe, spark.createDataFrame([(k,) for k in keys], "key string"))

    listed, blocked = cascade(sorted(kind)), cascade(sorted(k for k, v in kind.items() if v == "block"))
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", F.get(F.filter(keys, listed.contains), F.lit(0)))
    verdict = (F.when(F.col("rule").isNull(), F.lit(default))
               .when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("verdict", verdict)
