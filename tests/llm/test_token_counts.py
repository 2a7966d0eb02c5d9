from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formfield.llm import token_counts as tc

pytestmark = pytest.mark.skipif(not Path(tc.VOCABULARY).exists(), reason="no tokenizer files here")
ALPHABET = "ab 'slltve\n\t12.!é  日"


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(Path(tc.VOCABULARY).read_bytes())


_shared = {}


def _counter():
    if "c" not in _shared:
        _shared["c"] = tc.Counter(Path(tc.VOCABULARY).read_bytes())
    return _shared["c"]


@settings(max_examples=400, deadline=None)
@given(
    st.text(ALPHABET, max_size=400),
    st.lists(st.tuples(st.integers(0, 420), st.integers(0, 40), st.text(ALPHABET, max_size=30)), max_size=5),
)
def test_edits_agree_with_encoding_everything_again(text, edits):
    c = _counter()
    small, tc.LEAF = tc.LEAF, 4
    try:
        tree = tc.build(c, text)
        for start, n, new in edits:
            plain = text[:min(start, len(text))] + new + text[min(start + n, len(text)):]
            text, _ = tc.edit(c, tree, text, start, start + n, new)
            assert text == plain
            assert tree.tokens == len(c.encoding.encode_ordinary(text))
            assert [n for x in tree.leaves for n in x[0]] == [len(p) for p in c.cut.findall(text)]
            assert tree.sums == tc._levels([tc._sum(x) for x in tree.leaves])
    finally:
        tc.LEAF = small


def test_an_edit_encodes_only_its_surroundings(counter):
    text = "some words that go on " * 5000
    tree = tc.build(counter, text)
    after, again = tc.edit(counter, tree, text, 50_000, 50_010, "other")
    assert again < 100
    assert tree.tokens == counter.full(after)


def test_counts_of_a_table(spark):
    rows = [
        (1, "one two three", [(4, 7, "2")]), (2, None, [(0, 0, "new text")]), (3, "", None), (4, "x" * 50_000, [(10, None, " ")]),
        (4, "same id", [(None, 3, "no"), (2, 4, None), (900, 950, "!")]), (None, "no id", []),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    df = df.selectExpr("*", "'clash' AS n_tokens")
    got = {(r.doc_id, r.n_chars): r for r in tc.count_with_edits(df, "edits").collect()}
    c = _counter()
    wanted = {
        (1, 13): ("one two three", "one 2 three"), (2, 0): ("", "new text"), (3, 0): ("", ""),
        (4, 50_000): ("x" * 50_000, "x" * 10 + " " + "x" * 49_990), (4, 7): ("same id", "sa id!"), (None, 5): ("no id", "no id"),
    }
    assert set(got) == set(wanted)
    for key, (before, after) in wanted.items():
        assert (got[key].n_tokens, got[key].n_tokens_edited) == (c.full(before), c.full(after))
        assert got[key].n_chars_edited == len(after)
    assert tc.count_with_edits(df.limit(0), "edits").count() == 0


def test_stored_trees_take_edits(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "left alone"), (3, None)], "doc_id long, text string")
    edits = spark.createDataFrame(
        [(1, 2, 0, 3, "1"), (1, 1, 13, 13, " four"), (9, 1, 0, 0, "nobody")], "doc_id long, seq int, start long, end long, new string"
    )
    got = {r.doc_id: r for r in tc.apply_edits(tc.build_trees(docs), edits).collect()}
    c = _counter()
    assert {k: (r.text, r.n_tokens) for k, r in got.items()} == {
        1: ("1 two three four", c.full("1 two three four")), 2: ("left alone", c.full("left alone")), 3: ("", 0),
    }
