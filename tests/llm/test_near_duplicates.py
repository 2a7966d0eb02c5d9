import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formfield.llm import simhash
from formfield.llm.components import components


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_shingles(text, size=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else {b""}


def plain_groups(texts, likeness=0.8):
    """The smallest id of each one's group, over all pairs."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and min(len(a), len(b)) >= likeness * max(len(a), len(b)) and len(a & b) >= likeness * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@settings(max_examples=60, deadline=None)
@given(st.text("ab C\t\n\x1c é", max_size=60))
def test_fingerprint_follows_its_definition(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_tree_finds_what_a_scan_finds():
    draws = np.random.default_rng(1)
    values = np.unique(draws.integers(0, 2**63, 3000, dtype=np.uint64) & np.uint64(0xFFFFF))
    tree = simhash.BKTree(values)
    found = {(e, int(q)) for e, near in tree.search(values[:500], 3) for q in near}
    wanted = {(e, q) for q in range(500) for e in np.flatnonzero(np.bitwise_count(values ^ values[q]) <= 3).tolist()}
    assert found == wanted


def test_trees_of_a_given_table_are_walked(spark):
    """The shards of a table's fingerprints are trees of many levels, and lookups pass most of their nodes by."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    prints = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).collect()], dtype=np.int64)).view(np.uint64)
    widths, bits = simhash.block_widths(len(prints), 3, simhash.SHARD)
    assert (widths, bits) == ([16] * 4, 3)
    held = visited = 0
    for block in range(4):
        keys = (prints >> np.uint64(16 * block)) & np.uint64((1 << bits) - 1)
        for key in np.unique(keys):
            tree = simhash.BKTree(prints[keys == key])
            list(tree.search(tree.values, 3))
            assert len(tree.values) < 50 or tree.depth() > 2
            held, visited = held + len(tree.values) ** 2, visited + tree.compared
    assert visited < 0.5 * held


def test_blocks_suffice_at_any_size():
    for n in (1, 10**4, 10**9, 10**12, 10**16):
        widths, bits = simhash.block_widths(n, 3, 2048)
        assert sum(widths) == 64 and n / 2**bits <= 2048 or n > 10**13
    assert [len(simhash.block_widths(n, 3, 2048)[0]) for n in (10**8, 10**9, 10**12)] == [4, 5, 6]


@pytest.mark.parametrize("tree,shard", [(16, 4096), (4096, 4096), (64, 1), (4096, 20)])
def test_links_connect_what_all_pairs_connect(spark, tree, shard):
    """Clusters, chains, exact copies and a crowd of close values, with shards of one tree and of many."""
    draws = random.Random(7)
    prints = [0, 0, 2**64 - 1]
    for _ in range(60):
        prints.append(draws.getrandbits(64))
        for _ in range(draws.randrange(4)):
            prints.append(prints[-1] ^ sum(1 << draws.randrange(64) for _ in range(3)))
    crowd = draws.getrandbits(64)
    prints += [crowd ^ draws.getrandbits(9) for _ in range(150)]
    prints += [crowd ^ (0b1111 << 4 * k) for k in range(12)]
    rows = [(n, p - 2**64 if p >= 2**63 else p) for n, p in enumerate(prints)]
    links = simhash.links(spark.createDataFrame(rows, "doc_id long, fp long"), tree=tree, shard=shard)
    root = {r.node: r.root for r in components(links).collect()}
    got = {n: root.get(fp, fp) for n, fp in rows}
    want = plain_components([n for n, _ in rows], dict(enumerate(prints)))
    assert {frozenset(k for k in got if got[k] == got[n]) for n in got} == {frozenset(k for k in want if want[k] == want[n]) for n in want}


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(100, 164)]
    hub = [(500, k) for k in range(501, 560)]
    odd = [(7, 7), (9, 8), (9, 8), (8, 9), (None, 3), (3, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub + odd, "u long, v long")).collect()}
    want = {k: 100 for k in range(100, 165)} | {k: 500 for k in range(500, 560)} | {8: 8, 9: 8}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    words = " ".join(hashlib.md5(str(n).encode()).hexdigest() for n in range(400))
    rows = [
        (5, None), (3, ""), (9, " \t\n"), (8, words), (2, words + " tail"), (8, words), (None, words), (11, "one two"), (10, "ONE two"),
        (12, "a much longer text " * 5000), (None, "only without an id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want_prints = {n: plain_fingerprint(t) for n, (_, t) in enumerate(rows)}
    groups = plain_components(list(want_prints), want_prints)
    want = sorted(
        (rows[n][0] or -1, f"{want_prints[n]:016x}", min((rows[k][0] for k in groups if groups[k] == groups[n] and rows[k][0] is not None), default=None))
        for n in want_prints
    )
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_registered_query_agrees_with_brute_force(spark, sf_dir):
    from formfield.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items() if len(t) < 6000} | {
        i: simhash.fingerprint(t.encode()) for i, t in docs.items() if len(t) >= 6000
    }
    want = plain_components(sorted(docs), prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("tree", [8, 1024])
def test_similar_classes_against_all_pairs(spark, tree):
    """Edited copies around the threshold, a crowd of near copies, exact copies, empty and short texts, ids that miss."""
    draws = random.Random(3)
    word = lambda: f"w{draws.randrange(4000)}"
    texts = {}
    for group in range(25):
        base = [word() for _ in range(draws.randrange(60, 200) + 300 * (group == 0))]
        for _ in range(40 if group == 0 else 3):
            edited = list(base)
            for _ in range(draws.choice((0, 1, 2, 3, 5))):
                edited[draws.randrange(len(edited))] = word()
            texts[len(texts)] = " ".join(edited)
    texts |= {900: "", 901: " \n", 902: None, 903: "one two", 904: "One  two", 905: "one", 906: "a b c d e f", 907: "a b c d e f g"}
    rows = [*texts.items(), (None, texts[0]), (None, "only without an id " * 9), (None, "only without an id " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "'x' AS a", "2 AS shingles").repartition(5)
    found = simhash.similar_classes(docs, "doc_id", tree=tree).collect()
    got = {r.first: r.component for r in found if r.first is not None}
    want = plain_groups(texts)
    pairs = [(i, j) for i in got for j in got if i < j and want[i] == want[j]]
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs) > 400
    assert [r.component for r in found if r.first is None] == [None]
    assert simhash.similar_classes(docs.limit(0), "doc_id").count() == 0


def test_similar_classes_find_edited_copies(spark):
    """Recall over all pairs of likeness 0.8 or more in a given table; nothing else is joined."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_groups(texts)
    found = simhash.similar_classes(docs, "doc_id").collect()
    assert all(want[r.first] == want[r.component] for r in found)
    assert len({r.component for r in found}) == len(set(want.values()))
