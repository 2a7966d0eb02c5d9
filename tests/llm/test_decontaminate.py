import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formfield.llm import decontaminate as dc


def plain(text, items, size=13):
    """Word count, hit positions and items, by comparing every window with every place."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, owners = cut(text), set(), set()
    for item, content in items:
        known = cut(content)
        n = min(size, len(known))
        for s in range(len(known) - n + 1 if known else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == known[s:s + n]:
                    hit.update(range(at, at + n))
                    if item is not None:
                        owners.add(str(item))
    return len(words), len(hit), sorted(owners)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=18), max_size=4), st.integers(1, 6))
def test_search_finds_every_occurrence(words, items, size):
    named = [(n, " ".join(i)) for n, i in enumerate(items)]
    windows = {(" ".join(i[s:s + size]).encode(), str(n)) for n, i in enumerate(items) if i for s in range(max(1, len(i) - size + 1))}
    found = dc.Searcher(sorted(windows)).find(" ".join(words).encode())
    n_hit = sum(s["end"] - s["start"] + 1 for s in found["spans"])
    assert (found["n_words"], n_hit, found["items"]) == plain(" ".join(words), named, size)


@pytest.mark.parametrize("shard_windows", [200_000, 7])
def test_odd_rows_and_many_passes(spark, shard_windows):
    passage = " ".join(f"Word{n}," for n in range(40))
    items = [(1, passage), (2, "short item here"), (3, None), (4, ""), (None, "nameless item of words"), (2, "short item here"), (10, passage[60:200])]
    texts = [
        None, "", "!!", passage.upper(), "x " * 30_000 + "SHORT-item_here", "word " * 50 + passage[:120], "nameless item of words",
        "short item", "short item here " * 3, "filler " * 59 + "short item here", "filler " * 30 + passage + " é" * 500,
    ]
    rows = [(n % 9, t) for n, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS found", "'y' AS items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs, bench, shard_windows=shard_windows)
    want = sorted((d, *plain(t, items)) for d, t in rows)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in got.collect()) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.collect())
    kept = dc.annotate(docs, bench, "found_", shard_windows=shard_windows)
    assert kept.columns == [*docs.columns, "found_"] and kept.count() == len(rows)
    assert dc.contamination(docs.limit(0), bench).count() == 0
    assert dc.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
