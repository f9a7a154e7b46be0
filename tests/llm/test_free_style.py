"""The other operators against brute force, libraries and held-out labels."""
import random
import re
import string

import numpy as np
import pytest

from rankweave.llm import components, jaccard_join, page_text, permutation_index, toxicity

rng = random.Random(12)


# --------------------------------------------------------------------------- toxicity

def plain_kernel(s, t):
    """The gap-weighted subsequence kernel by its definition."""
    from itertools import combinations

    def features(w):
        out = {}
        for at in combinations(range(len(w)), toxicity.ORDER):
            key = "".join(w[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out
    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_by_definition():
    words = ["idiot", "idxiot", "abababab", "", "éèéèéè", "x", "thirteen"] + [
        "".join(rng.choice("abci") for _ in range(rng.randrange(1, 10))) for _ in range(40)]
    marks = ["idiot", "abab", "éèéè", "iiii"]
    got = toxicity.kernel(words, marks)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx((plain_kernel(w, m) * toxicity.DECAY ** (-2 * toxicity.ORDER)) ** 2, rel=1e-4)


def corpus(n):
    syllables = "the on er an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    bad = ["idiot", "moron", "worthless", "pathetic", "stupid"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        for k in range(7, len(words), 9):
            words[k] += "."
        rows.append((i, " ".join(words), int(toxic), "en"))
    return rows


def test_toxicity_held_out(spark):
    rows = corpus(1000)
    rows += [(5000, None, None, "x"), (None, "", 1, "x"), (5001, "", 0, "x"), (5002, "idiot " * 20_000, None, "x"),
             (5003, "x" * 100_000, None, "x"), (7, rows[7][1], rows[7][2], "x")]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.repartition(4), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y, _ in rows[:1000]}
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([(s >= 0.5) == (y == 1) for y, s in held]) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[5002] >= 0.5 > by[5003] and by[5001] == by[5000] < 0.5
    said = ["you i.d.i.o.t here", "an i d i o t today", "some mor-on there", "worthlesss or not", "an on the nd of it"]
    reader = toxicity.Reader(model.measure)
    scores = [model.score(s) for s in reader.sentences(said)]
    assert all(s >= 0.5 for s in scores[:4]) and scores[4] < 0.5
    # an inserted character leaves a part of the kernel
    assert toxicity.kernel(["worthlxess", "thereofion"], ["worthless"])[0] > 3 * toxicity.kernel(["thereofion"], ["worthless"])[0]
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if not r.predicted)


def test_toxic_documents_of_inserted_letters():
    rows = corpus(1200)
    model = toxicity.train([t for _, t, _, _ in rows[:1000]], np.array([y for _, _, y, _ in rows[:1000]]) == 1)
    def inserted(word):
        k = rng.randrange(1, len(word))
        return word[:k] + rng.choice(string.ascii_lowercase) + word[k:]
    bad = ["idiot", "moron", "worthless", "pathetic", "stupid"]
    clean = [t for _, t, y, _ in rows[1000:] if not y]
    said = []
    for t in clean:
        words = t.split()
        at = rng.randrange(len(words))
        words.insert(at, inserted(rng.choice(bad)))
        said.append(" ".join(words))
    reader = toxicity.Reader(model.measure)
    scores = [np.array([model.score(s) for s in reader.sentences(texts)]) for texts in (said, clean)]
    print("inserted", (scores[0] >= 0.5).mean(), "clean", (scores[1] >= 0.5).mean())
    assert (scores[0] >= 0.5).mean() >= 0.65 and (scores[1] >= 0.5).mean() <= 0.03
    assert toxicity.with_inserted("An idiot", ["idiot"]) != "an idiot" and toxicity.with_inserted("", ["idiot"]) == ""


def test_toxicity_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    ones = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, ones)).collect()] == [1, 1]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).collect() == []


# ------------------------------------------------------------------------ Jaccard join

def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def near_copies():
    rows = []
    def doc(n):
        return [f"t{rng.randrange(60)}" for _ in range(n)]
    passage = doc(30)
    for family in range(30):
        base = doc(rng.choice([1, 2, 9, 12, 40, 120]))
        if family % 5 == 0:
            base = base + passage
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(copy) + 1)
                copy[k:k + rng.choice([0, 1])] = [f"u{rng.randrange(500)}"] * rng.choice([0, 1])
            rows.append(" ".join(x.upper() if rng.random() < 0.05 else x for x in copy))
    chain = doc(80)  # each is near the next only
    for k in range(20):
        chain = chain[1:] + [f"c{k}"]
        rows.append("\t".join(chain))
    rows += ["", None, " \n", "É É É É", "é é é é", "same text here", "same text here", "Same Text\nHere"]
    ids = rng.sample(range(1000), len(rows))
    return [(i, t, "k") for i, t in zip(ids, rows)]


def components_of(rows, words, percent):
    sets = [shingles(t, words) for _, t, _ in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        i = rows[a][0]
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(rows[a][0], len(sets[a]), least.get(find(a))) for a in range(len(rows))]


@pytest.mark.parametrize("words, percent, points, sketch", [(3, 90, 2048, 1 << 17), (5, 80, 4, 64), (2, 60, 4, 1)])
def test_jaccard_components(spark, monkeypatch, words, percent, points, sketch):
    monkeypatch.setattr(jaccard_join, "TREE_POINTS", points)
    monkeypatch.setattr(jaccard_join, "SKETCH", sketch)
    monkeypatch.setattr(jaccard_join, "BLOCK", points)
    monkeypatch.setattr(jaccard_join, "CELLS", 64)
    rows = near_copies()
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string, node string").repartition(5)
        got = [tuple(r) for r in jaccard_join.jaccard_components(df, words, percent).collect()]
        assert sorted(got) == sorted(components_of(rows, words, percent))
        if words == 5:
            kept = jaccard_join.first_of_each(df, words, percent)
            assert kept.columns == df.columns
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in got if i == c)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_jaccard_nulls_and_empty(spark):
    schema = "doc_id bigint, text string"
    rows = [(None, "a b c d"), (4, "a b c d"), (None, "q r s"), (7, None), (4, "z y x"), (9, "z y x")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [
        (None, 2, 4), (4, 2, 4), (None, 1, None), (7, 0, 7), (4, 1, 4), (9, 1, 4)]))
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).collect() == []


def test_first_of_each_keeps_one_row_of_each_text(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 5), (None, c, 6), (None, "v w x y z", 7),
            (None, "v w x y z", 8), (9, None, 9), (9, None, 10), (None, "", 11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3)
    kept = jaccard_join.first_of_each(df)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(map(repr, [r[:2] for r in got])) == sorted(map(repr, [
        (3, a), (5, b), (7, c), (None, "v w x y z"), (9, None), (9, None), (None, "")]))
    assert set(got) <= set(rows)


def test_tree_search_loses_nothing():
    r = np.random.default_rng(1)
    points = r.poisson(1.0, (500, 16)).astype(np.int32)
    points[250:] = points[:250] + (r.random((250, 16)) < 0.05)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = jaccard_join.CountTree(points, sizes)
    for k in range(0, 500, 7):
        bound = np.minimum(points, points[k]).sum(axis=1)
        assert sorted(tree.search(points[k], int(sizes[k]), 90)) == np.flatnonzero(
            190 * bound >= 90 * (sizes + sizes[k])).tolist()


def test_overlaps_and_partner_sizes():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 200))).astype(np.uint64) for _ in range(40)]
    got = jaccard_join.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40))
    assert jaccard_join.overlaps([np.arange(3, dtype=np.uint64), np.arange(5, 9, dtype=np.uint64)])[0, 1] == 0
    for percent in (60, 80, 90):
        for n in range(1, 60):
            most = jaccard_join.partner_size(np.full(n, n), np.arange(n), percent)
            for place in range(n):  # the sizes m that a link leaves possible, when n - place shingles may be shared
                sizes = [m for m in range(1, 200) if 100 * (n - place) >= percent * (n + m - (n - place))]
                assert most[place] == max(sizes, default=most[place]) and (sizes or most[place] < 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 300), (300, 7), (8, 8)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)} | {300: 5}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ----------------------------------------------------------------------------- pages

def test_lines_of_markup():
    page = ('<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>m<li>n</ul></nav>'
            '<div id="side-bar">x</div><!-- c > --><article><header><h1>Head</h1></header><p class="notice">no<p>one &amp; t<b>w</b>o'
            '<br>x <p><b>three</article><div class="ad">y</div><form><p>f</form><script>var a="</p>";if(a<b){}</script>'
            '<p>plain < 3 &nbsp;z<div class="reader-comments"><p>c</div><p title="a>b">q</p><footer>&copy; F</footer><p>cut <a hr')
    assert page_text.lines_of(page) == [(2, "Head"), (2, "one & two"), (2, "x"), (2, "three"), (0, "plain < 3 z"), (0, "q"), (0, "cut")]
    assert page_text.lines_of("") == [] and page_text.lines_of("a<script>x") == [(0, "a")]


def test_classes_that_only_mention_junk():
    page = "<body><div class='layout has-sidebar'><p>one</p><main class='no-sidebar'><article class='post share-enabled ad'><p>two"
    assert page_text.lines_of(page) == [(0, "one"), (2, "two")]
    assert page_text.lines_of("<div class='site-menu'>m</div><div class='with_ads'>x</div>") == [(0, "x")]


def test_shared_lines_are_a_longest_common_subsequence():
    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        same = page_text.shared(a, b)
        rest = iter(b)
        assert all(x in rest for x, s in zip(a, same) if s) and sum(same) == length(a, b)


def test_pages_differ_from_their_neighbours(spark):
    page = "<body><div>Site menu</div><p>{0} first</p><p>{0} second</p><div>All rights</div>"
    rows = [(i, f"http://h.com/a/{i}", page.format(f"text{i}"), "t") for i in range(8)]
    rows += [(10, "http://one.org/x", page.format("alone"), "t"), (11, None, None, "t"), (12, "", "", "t"),
             (13, "http://main.net/1", "<p>M</p><article>same</article>", "t"),
             (14, "http://main.net/2", "<p>M</p><article>same</article>", "t"),
             (15, "http://twin.net/1", page.format("twin"), "t"), (15, "http://twin.net/1", page.format("twin"), "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").coalesce(1)
    got = sorted((r.page_id, r.text, r.n_chars) for r in page_text.extract(df).collect())
    expect = [(i, f"text{i} first text{i} second") for i in range(8)]
    whole = "Site menu {0} first {0} second All rights"
    expect += [(10, whole.format("alone")), (11, ""), (12, ""), (13, "same"), (14, "same"),
               (15, whole.format("twin")), (15, whole.format("twin"))]
    # a page that a partition holds alone has no neighbour there; these few rows are one partition
    assert got == sorted((i, t, len(t)) for i, t in expect)
    assert page_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_marked_pages_are_differenced(spark):
    """An article element that is only a teaser does not replace the page's own text, which
    differencing finds; one that holds the text does, with the lines it shares."""
    teaser = "<body><p>Site line</p><main><article><p>Read this too</p></article><p>{0} long own text of the page</p></main>"
    rows = [(i, f"http://h.com/{i}", teaser.format(f"word{i}")) for i in range(5)]
    kept = "<body><p>Site {0}</p><article><p>Shared opening line of all of them</p><p>{0} own</p></article>"
    rows += [(10 + i, f"http://k.com/{i}", kept.format(f"word{i}")) for i in range(5)]
    rows += [(20, "http://alone.org/", teaser.format("alone"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in page_text.extract(df).collect()}
    assert got == ({i: f"Read this too word{i} long own text of the page" for i in range(5)}
                   | {10 + i: f"Shared opening line of all of them word{i} own" for i in range(5)} | {20: "Read this too"})


# ---------------------------------------------------------------------- nearest neighbours

def test_permutation_index_recall_and_order(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 24))
    x[100] = x[200]
    rows = [(i, x[i].tolist(), 1) for i in range(len(x))]
    rows += [(5000, None, 1), (5100, [0.0] * 24, 1), (5200, [float("nan")] * 24, 1), (5300, [1.0, None] * 12, 1),
             (5400, [float("inf")] * 24, 1), (6000, [1.0, 2.0], 1), (6100, [2.0, 2.0], 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int").repartition(3)
    vectors = permutation_index.valid_vectors(df)
    queries = vectors.where("vec_id % 100 = 0")
    got = permutation_index.search(vectors, queries, 10, block=16).collect()
    by = {}
    for q in got:
        by.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert set(by) == {*range(0, 4000, 100), 6000, } | ({6100})
    ids = np.array([i for i in range(4000)] + [7])
    every = np.vstack((x, x[7:8]))
    hit = 0
    for q in range(0, 4000, 100):
        found = sorted(by[q])
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        d = np.sqrt(((every - x[q]) ** 2).sum(axis=1))
        assert all(f[2] == pytest.approx(np.sqrt(((x[f[1]] - x[q]) ** 2).sum()), rel=1e-12) for f in found)
        d[ids == q] = np.inf
        hit += len({f[1] for f in found} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit / 400 >= 0.9
    assert by[6000] == [(1, 6100, 1.0)] and by[6100] == [(1, 6000, 1.0)]
    assert permutation_index.search(vectors.limit(0), queries.limit(0)).collect() == []


def test_ties_at_the_candidate_cut_go_to_the_smaller_ids(spark):
    r = np.random.default_rng(8)
    n, d = 3000, 16
    x = r.normal(size=(n, d))
    copies = r.permutation(n)[:n // 3]  # a third of the rows is one vector
    x[copies] = r.normal(size=d)
    ids = r.permutation(100_000)[:n]
    beside = sorted(copies[:10].tolist()) + sorted(set(range(60)) - set(copies.tolist()))
    near = [(200_000 + j, (x[copies[0]] + r.normal(size=d) * 0.02).tolist()) for j in range(5)]  # beside the copies
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows + near, "vec_id bigint, v array<double>").coalesce(1)
    asked = spark.createDataFrame([rows[k] for k in beside] + near, "vec_id bigint, v array<double>")
    by = {}
    for q in permutation_index.search(df, asked, 10).collect():
        by.setdefault(q.query_id, []).append((q.rank, q.vec_id))
    every, names = np.vstack((x, [v for _, v in near])), np.concatenate((ids, [i for i, _ in near]))
    hit = 0
    for i, v in [rows[k] for k in beside] + near:
        far = np.sqrt(((every - v) ** 2).sum(axis=1))
        far[names == i] = np.inf
        true = names[np.lexsort((names, far))[:10]].tolist()
        found = [x for _, x in sorted(by[i])]
        hit += len(set(true) & set(found))
        if i in set(ids[copies].tolist()) or i >= 200_000:
            assert found == true
    assert hit / (10 * len(by)) >= 0.9


def test_every_length_of_vectors_is_searched(spark):
    rows = [(2 * n + j, [1.0] * n if j else [2.0] + [1.0] * (n - 1)) for n in range(1, 81) for j in range(2)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>").coalesce(2)
    got = permutation_index.search(df, df, 3).collect()
    assert sorted((q.query_id, q.vec_id, q.score) for q in got) == sorted((i, i ^ 1, 1.0) for i, _ in rows)
    blocks = list(permutation_index.blocks_of([(n, 1) for n in range(20)] + [(30, 9)], 4))
    assert blocks == [(k, k + 3, 1, 0) for k in range(0, 20, 4)] + [(30, 30, 3, part) for part in range(3)]


def test_footrule_by_definition():
    order = np.array([rng.sample(range(12), 5) for _ in range(50)])
    files = permutation_index.Postings(order, 12)
    for q in order[:10]:
        far = [sum(abs((list(a).index(p) if p in a else 5) - (list(q).index(p) if p in q else 5)) for p in {*a, *q})
               for a in order]
        assert files.footrule(q).tolist() == far
