"""The native operators against brute force on small hand-made tables."""
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rankweave.llm import chat_windows, decontaminate, queries, shards, url_cascade

rng = random.Random(11)


def python_nodes(df):
    plan = df._jdf.queryExecution().toString()
    return re.findall(r"MapInArrow|MapInPandas|PythonUDF|ArrowEvalPython|BatchEvalPython", plan)


# ------------------------------------------------------------------- chat windows

def conversations():
    words = ["alpha", "beta<s>", "[INST]", "</s>", "\\l", "\\", "<|im_end|>", "é😀", "\n", "<<SYS>>", "[/INST] ", "<"]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 400])))
            rows.append((c, t, role, text, "x"))
    rows += [(100, 0, None, None, "x"), (100, 1, "assistant", None, None), (None, 0, "user", "no id", None),
             (101, 0, "assistant", "twice", None), (101, 0, "assistant", "twice", None), (101, None, "a\nb", "x\n", None),
             (102, 0, "system", "only", None), (103, 0, "user", "long " * 5000, None), (103, 1, "assistant", "z" * 9000, None)]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_chat_windows_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    windows = chat_windows.format_windows(df, 200, 40)
    assert not python_nodes(windows)
    expect = {}
    for c, t, role, text, _ in rows:
        expect.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    got = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    assert set(got) == set(expect)
    total = {}
    for w in windows.collect():
        total[w.conv_id] = total.get(w.conv_id, 0) + len(w.formatted)
        for s in w.loss:
            assert "<|im_" not in w.formatted[s.start:s.start + s.length]
    for c, turns in expect.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == total[c]


def test_chat_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], "w" * 4 * (10 + t % 7), None) for t in range(60)]
    windows = chat_windows.format_windows(spark.createDataFrame(rows, SCHEMA), 200, 40).orderBy("window").collect()
    assert len(windows) > 3
    for w in windows:
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>", w.formatted)
        assert turns[0][0] == "system"
        assert sum(len(x) // 4 + 5 for _, x in turns) <= 200
        assert (w.window == 0 and w.repeated == 0) or w.repeated >= 1


def test_chat_windows_empty(spark):
    none = chat_windows.format_windows(spark.createDataFrame([], SCHEMA))
    assert chat_windows.read_back(none).collect() == []


# ------------------------------------------------------------------------- shards

def test_shards(spark):
    texts = ["", None, "é😀", "a" * 50_000] + ["x" * rng.randrange(300) for _ in range(400)]
    rows = [(rng.randrange(300) if i % 9 else None, t, "s") for i, t in enumerate(texts)] + [(5, "same", "")] * 3
    df = shards.byte_shards(spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(7), 8)
    assert not python_nodes(df)
    got = df.collect()
    key = lambda i, s, c: (i is not None, i or 0, s, c)
    expect = sorted(key(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(key(r.doc_id, r.size, r.text_crc32) for r in got) == expect
    whole, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
        assert abs(sum(r.size for r in got if r.shard == s) - whole / 8) <= largest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert shards.byte_shards(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# ------------------------------------------------------------------ decontamination

def contamination_tables():
    vocab = [f"w{i}" for i in range(40)] + ["É", "ñandú", "the", "the", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(30)]
    items += [(30, None), (31, " .,"), (7, items[7][1]), (40, items[3][1]), (None, items[5][1])]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab + [f"v{i}" for i in range(300)] * 2) for _ in range(rng.choice([0, 1, 20, 200]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            it = rng.choice(items)[1] or ""
            at = rng.randrange(len(words) + 1)
            cut = it.split()[rng.choice([0, 0, 1]):]
            words[at:at] = [x.upper() if x.isascii() and rng.random() < 0.3 else x for x in cut]
        docs.append((d, ", ".join(words), "c"))
    docs += [(200, None, "c"), (None, docs[3][1], "c"), (5, docs[5][1], "c"), (5, docs[6][1], "c"), (201, "", "c"),
             (202, (items[8][1] + " ") * 300, "c")]
    return docs, items


def words_of(text):
    low = (text or "").translate(str.maketrans(url_cascade.UPPER, url_cascade.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def judged(text, windows):
    w, hit, ids = words_of(text), set(), set()
    for win, item in windows:
        for k in range(len(w) - len(win) + 1):
            if w[k:k + len(win)] == win:
                hit.update(range(k, k + len(win)))
                if item is not None:
                    ids.add(str(item))
    sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bits, broadcast", [(1 << 20, 32 << 20), (64, 0)])
def test_contamination(spark, monkeypatch, bits, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    docs, items = contamination_tables()
    windows = []
    for i, t in items:
        w = words_of(t)
        windows += [(w[k:k + 13], i) for k in range(max(1, len(w) - 12))] if w else []
    d = spark.createDataFrame(docs, "doc_id bigint, text string, words string").repartition(4)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    df = decontaminate.contamination(d, b, filter_bits=bits)
    assert not python_nodes(df)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    expect = [(i, *judged(t, windows)) for i, t, _ in docs]
    assert got == sorted(map(repr, expect))
    kept = decontaminate.clean_documents(d, b, filter_bits=bits)
    assert kept.columns == d.columns
    clean = [repr(r) for r, e in zip(docs, expect) if not e[5]]
    assert sorted(repr(tuple(r)) for r in kept.collect()) == sorted(clean)


def test_contamination_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(d, none).collect()] == [(2, 0, False)]
    assert decontaminate.contamination(d.limit(0), none).collect() == []


# --------------------------------------------------------------------- URL cascade

URLS = ["http://Example.COM/en/1", "https://www.example.com/en/2?x=1", "http://a.www.example.com/en/", "x://com/", "http://com",
        "http://b.net/es/3#f", "http://net/fr/", "http://evilnet/fr/", "http://b.net/de/", "", None, "no scheme", "a://b://c.com/d",
        "http://example.com/EN/1", "http://example.com:80/en/1", "http://ÉX.net/es/", "http://x.org/en/?a", "http://..net/es/", "http:///es/",
        "http://y.com?q#r", "http://y.com\n/en/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(str.maketrans(url_cascade.UPPER, url_cascade.LOWER))
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_cascade.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark):
    rows = [(i, u, "z") for i, u in enumerate(URLS * 2)]
    df = url_cascade.judge(spark.createDataFrame(rows, "page_id bigint, url string, key string").repartition(3))
    assert not python_nodes(df) and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}
    assert got == {i: brute(u) for i, u, _ in rows}
    assert url_cascade.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(5000)]
    listed = keys[::7]
    cascade = url_cascade.build_cascade(spark.createDataFrame([(k,) for k in keys], "key string"),
                                        spark.createDataFrame([(k,) for k in listed], "key string"))
    assert len(cascade.levels) > 2  # false positives of the first levels had to be encoded
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", cascade.contains(F.col("key")).alias("c"))
    assert {r.key for r in got.collect() if r.c} == set(listed)
    with pytest.raises(ValueError):
        url_cascade.build_cascade(spark.createDataFrame([("a",)], "key string"),
                                  spark.createDataFrame([("a",)], "key string"), max_bits=8)


# -------------------------------------------------------------------------- oracle

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    exp = sorted((tuple(x for _, x in sorted(zip(rel.columns, r))) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == exp
