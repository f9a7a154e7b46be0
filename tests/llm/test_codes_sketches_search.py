"""Vector codes, SetSketch groups and ranked lexical search against plain versions."""
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from rankweave.llm import lexical, setsketch, walsh_codes
from rankweave.llm.jaccard_join import WordHashes, shingle_set

rng = random.Random(31)


# --------------------------------------------------------------------------- vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error) of rows (vec_id, vector, label), and the codebooks' digest."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(v) for _, v, _ in rows), default=0)
    length = -(-longest // parts)

    def ints(v):
        own = [math.floor(4096 * Fraction(x)) for x in v] + [0] * (length * parts - len(v))
        return [own[p * length:(p + 1) * length] for p in range(parts)]
    vecs = [ints(v) for _, v, _ in rows]
    start = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))[:entries]
    books = [[vecs[i][p] for i in start] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v[p], books[p])[1] for v in vecs]
            new = list(books[p])
            for e in set(own):
                members = [v[p] for v, k in zip(vecs, own) if k == e]
                new[e] = [sum(c) // len(members) for c in zip(*members)]
            books[p] = new
    out = []
    for r, v in zip(rows, vecs):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
    totals = {}
    for _, _, e, label in out:
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=repr)


def codes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id bigint, embedding array<double>, label int, code string, v int")
    return sorted((tuple(r) for r in walsh_codes.compress(df).collect()), key=repr)


def test_codes_by_definition(spark):
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], rng.choice([0, 1, 2, None])) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(120)]                    # a third are copies
    rows += [(5, [0.5] * 24, 2), (None, [0.25] * 24, None), (900, None, 1), (901, [None] * 24, 1),
             (902, [float("nan")] * 24, 1), (903, [float("inf")] + [0.0] * 23, 1), (904, [], 1), (905, [-0.0] * 24, 1)]
    rng.shuffle(rows)
    assert codes(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize("dim, n", [(64, 40), (5, 60), (8, 3), (21, 50)])
def test_codes_of_other_shapes(spark, dim, n):
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(dim if i % 5 else dim - 2)], i % 3)
            for i in range(n)]
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_beyond_64_bits_are_exact(spark):
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0 ** (10 + i % 10) for _ in range(16)], 0) for i in range(40)]
    assert codes(spark, rows) == plain_codes(rows)
    big = [(i, [2.0 ** 37 * (i % 2), *[0.0] * 15], 0) for i in range(40)]
    assert {r[2] for r in codes(spark, big)} == {0}
    far = [(i, [float(i) * 2.0 ** 32] + [0.0] * 7, 0) for i in range(20)]
    assert any(r[2] is None for r in codes(spark, far)) and len(codes(spark, far)) == 20
    assert codes(spark, [(1, [2.0 ** 39] * 8, 0)]) == []


def test_codes_of_an_empty_table(spark):
    assert codes(spark, []) == [] and codes(spark, [(1, None, 2)]) == []


def test_transform_is_in_sequency_order_and_keeps_distances():
    for size in (1, 2, 8, 32):
        order = walsh_codes.sequency(size)
        full = walsh_codes.walsh(np.eye(size, dtype=np.int64), order).T
        assert [int((r[1:] != r[:-1]).sum()) for r in full] == list(range(size))
        assert (full @ full.T == size * np.eye(size)).all()


def test_nearest_takes_the_lower_index_of_equals():
    x = np.array([[0, 0, 0], [5, 5, 5], [1, 0, 0]])
    e = np.array([[2, 0, 0], [0, 0, 0], [0, 0, 0], [5, 5, 6], [5, 5, 4]])
    entry, far = walsh_codes.nearest(x, e)
    assert entry.tolist() == [1, 3, 0] and far.tolist() == [0, 1, 1]
    wide = np.array([[rng.randrange(-9, 9) for _ in range(20)] for _ in range(200)])
    books = np.array([[rng.randrange(-9, 9) for _ in range(20)] for _ in range(16)])
    entry, far = walsh_codes.nearest(wide, books)
    whole = ((wide[:, None] - books[None]) ** 2).sum(axis=2)
    assert (entry == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()


# --------------------------------------------------------------------------- SetSketch groups

def plain_groups(rows, words=2, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                group[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), ids.get(root(i)), d == ids.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))),
                  key=repr)


def groups(spark, rows, words=2, percent=80):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, node string, n int")
    return sorted((tuple(r) for r in setsketch.near_duplicates(df, words, percent).collect()), key=repr)


def prose(n):
    return [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]


def changed(words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "new" + str(rng.randrange(10_000))
    return out


def test_groups_by_definition(spark):
    rows = []
    for g in range(12):  # groups of near copies on both sides of the threshold
        base = prose(rng.choice([6, 40, 150]))
        rows += [(0, " ".join(changed(base, rng.randrange(0, max(1, len(base) // 8) + 1)))) for _ in range(14)]
    chain = prose(100)
    for _ in range(30):  # each links with the next one, the ends do not
        rows.append((0, " ".join(chain)))
        chain = changed(chain, 4)
    rows += [(0, rows[3][1])] * 40
    rows += [(0, t) for t in (None, "", " \t\n", "one", "ONE", "one two", "a b c d e", "a b c d e f", "É é", "é é",
                              "word " * 30_000, "x" * 100_000, " nbsp joined here")]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(5, rows[9][1]), (None, rows[4][1]), (None, "only here without an id"), (None, "only here without an id")]
    assert groups(spark, rows) == plain_groups(rows)
    assert groups(spark, rows, 3, 90) == plain_groups(rows, 3, 90)


def test_groups_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    base = prose(60)
    rows = [(i, " ".join(changed(base, rng.randrange(3, 14)))) for i in range(160)]
    assert groups(spark, rows) == plain_groups(rows)
    monkeypatch.setattr(setsketch, "MAX_WANTED", 0)
    assert groups(spark, rows) == plain_groups(rows)


def test_groups_of_an_empty_table(spark):
    assert groups(spark, []) == []


def test_registers_merge_and_estimate():
    hashes = WordHashes()
    a = shingle_set(" ".join(f"w{i}" for i in range(1000)), hashes, 1)
    b = shingle_set(" ".join(f"w{i}" for i in range(200, 1100)), hashes, 1)
    one, two = setsketch.sketch(a), setsketch.sketch(b)
    assert (setsketch.merge(one, two) == setsketch.sketch(np.union1d(a, b))).all()
    j, _, _ = setsketch.estimate(one[None], two[None], np.array([1000.0]), np.array([900.0]))
    assert abs(j[0] - 800 / 1100) < 0.1
    assert setsketch.likely(one[None], one[None], np.array([1000]), np.array([1000]), 80).all()
    assert not setsketch.likely(one[None], setsketch.sketch(b[600:])[None], np.array([1000]), np.array([300]), 80).any()


def test_register_equality_grows_with_similarity():
    gen = np.random.default_rng(4)
    for n in (5, 50, 3000):
        pool = gen.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        equal = []
        for share in (0.2, 0.5, 0.8, 1.0):
            k = round(2 * n * share / (1 + share))  # shared elements
            a, b = pool[:n], np.concatenate((pool[:k], pool[n:2 * n - k]))
            equal.append(float((setsketch.sketch(a) == setsketch.sketch(b)).mean()))
        assert equal == sorted(equal) and equal[-1] == 1.0 and equal[0] < 0.6


# --------------------------------------------------------------------------- lexical search

def plain_search(docs, items, k=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [words(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, own)), sum(map(len, own))
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(words(t))
    df = {t: sum(t in w for w in own) for ts in of.values() for t in ts}
    out = []
    for i, ts in of.items():
        found = []
        for (doc_id, _), w in zip(docs, own):
            if w:
                m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                            * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in ts)
                if score > 0:
                    found.append((-score, doc_id is None, doc_id or 0))
        for r, (s, null, d) in enumerate(sorted(found)[:k], 1):
            out.append((i, r, None if null else d, -s))
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, score int, item_id string")
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id bigint, text string, doc_id int").repartition(2)
    return sorted((tuple(r) for r in lexical.search(d.repartition(3), i, k).collect()), key=repr)


def collection():
    docs = [(i, " ".join(rng.choice("The of a-b Éa éa x1 _y_ tail;head q w e r t".split()) for _ in range(rng.randrange(0, 40))))
            for i in range(400)]
    docs += [(1000 + i, docs[3][1] + " rare") for i in range(150)]     # ties
    docs += [(None, docs[3][1] + " rare"), (None, None), (5000, None), (5001, ""), (5002, "?!"), (7, "rare w"),
             (5003, "the rare " * 20_000), (5004, "z" * 100_000)]
    items = [(1, "the rare tail"), (2, "RARE! éa"), (3, None), (4, ""), (5, "nothing like it"), (1, "of"), (6, "the the of"),
             (None, "x1 y"), (8, " ".join("w%d" % i for i in range(3000)) + " q e r")]
    items += [(100 + i, " ".join(rng.choice("the of a b éa x1 y tail head q w e".split()) for _ in range(4))) for i in range(90)]
    return docs, items


def test_search_by_definition(spark):
    docs, items = collection()
    assert ranked(spark, docs, items) == plain_search(docs, items)
    assert ranked(spark, docs, items, 3) == plain_search(docs, items, 3)


def test_search_in_blocks_and_narrow_tiles(spark, monkeypatch):
    docs, items = collection()
    want = plain_search(docs, items)
    monkeypatch.setattr(lexical, "PAIRS", 900)
    assert ranked(spark, docs, items) == want


def test_search_of_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, [(1, "a")], []) == ranked(spark, [(1, None)], [(1, "a")])


def test_tiles_stay_within_their_cells_and_exact():
    of = [np.arange(i, i + 50) for i in range(300)] + [np.empty(0, int), np.arange(9000)]
    weights = np.full(9000, 500_000_000)
    got = lexical.tiles(of, weights)
    assert sorted(i for t in got for i in t.items) == [*range(300), 301]
    assert all(t.weights.size <= max(lexical.CELLS, len(t.vocabulary)) for t in got)
    assert all(t.width * 500_000_000 * lexical.MOST_IMPACT < lexical.EXACT for t in got)
    term, doc = np.repeat(np.arange(0, 9000, 3), 2), np.tile([0, 1], 3000)
    impact = np.tile([999_999, 3], 3000)
    for t in got:
        s = t.scores(term, doc, impact, 2)
        for row, i in enumerate(t.items):
            n = int((of[i] % 3 == 0).sum())
            assert s[row].tolist() == [n * 500_000_000 * 999_999, n * 500_000_000 * 3]
