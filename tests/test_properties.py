"""Property checks against plain-Python statements of the semantics."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.operators import passages

WORDS = st.sampled_from(["a", "bb", "ccc", "é", "x.y", ""])
BODIES = st.one_of(st.none(), st.lists(WORDS, min_size=0, max_size=30).map(" ".join),
                   st.text(alphabet="ab é", max_size=40))
TITLES = st.one_of(st.none(), st.just(""), st.sampled_from(["T", "Title words"]))


def split_reference(title, body, size, prepend):
    if body is None:
        return []
    toks = body.split(" ")
    prefix = title + " " if (prepend and title) else ""
    return [prefix + " ".join(toks[i:i + size]) for i in range(0, len(toks), size)]


@settings(max_examples=4, deadline=None)
@given(docs=st.lists(st.tuples(TITLES, BODIES), min_size=1, max_size=60), size=st.integers(1, 6),
       prepend=st.booleans())
def test_split_matches_reference(spark, docs, size, prepend):
    rows = [(f"D{i}", t, b) for i, (t, b) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id string, title string, body string")
    got = {}
    for r in passages.split_passages(df, size, prepend, keep=[]).collect():
        got.setdefault(r.doc_id, []).append((r.passage_idx, r.passage_id, r.passage_body))
    for doc_id, title, body in rows:
        exp = split_reference(title, body, size, prepend)
        have = sorted(got.get(doc_id, []))
        assert [p for _, _, p in have] == exp
        assert [pid for _, pid, _ in have] == [f"{doc_id}_{i}" for i in range(len(exp))]
