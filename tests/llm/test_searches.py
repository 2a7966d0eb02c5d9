"""Vector and lexical searches against plain versions, with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formfield.llm import lexical, negatives, topk
from formfield.llm.grid import Best, in_cells, matrix, scaled

NAN, INF = float("nan"), float("inf")


def vectors(n=400, width=12, seed=3):
    """Random rows with ties, repeats, short and unusable vectors, and ids that repeat or are missing."""
    draws = random.Random(seed)
    same = [draws.gauss(0, 1) for _ in range(width)]
    rows = []
    for k in range(n):
        v = same if k % 3 == 0 else [draws.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(width)] if k % 3 == 1 else [draws.gauss(0, 1) for _ in range(width)]
        rows.append((k, list(v), k % 4))
    rows += [(5, rows[5][1], 1), (0, rows[1][1], 2), (100, rows[100][1], 0), (None, rows[2][1], 2), (None, rows[3][1], 1)]
    rows += [(300 + n, rows[4][1][:5], 3), (301 + n, [], 1), (400 + n, None, 1), (500 + n, [1.0, None], 1), (600 + n, [NAN] * width, 1)]
    rows += [(700 + n, [INF] + [0.0] * (width - 1), 1), (800 + n, rows[7][1], None), (900 + n, [1e30] * width, 2)]
    return rows


def usable(rows, scale, labelled=False):
    kept = []
    for i, v, lab in rows:
        if v is None or any(x is None or not math.isfinite(x) or abs(scale * x) > 1 << 24 for x in v):
            continue
        if not labelled or lab is not None:
            kept.append((i, [math.floor(scale * x) for x in v], lab))
    return kept


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(i):
    return (i is None, i or 0)


def listed(rows):
    return sorted(rows, key=lambda r: tuple(order(x) for x in r))


def plain_top(rows, k, every):
    kept, out = usable(rows, 64), []
    for n, (i, v, _) in enumerate(kept):
        if i is not None and i % every == 0:
            best = sorted((-dot(v, w), order(j), j) for m, (j, w, _) in enumerate(kept) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, _, j) in enumerate(best, 1)]
    return listed(out)


def plain_negatives(rows, every):
    kept, out = usable(rows, 256, True), []
    for n, (i, v, lab) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-dot(v, w), order(j), j, other) for m, (j, w, other) in enumerate(kept) if m != n)
        for p, _, positive, _ in [s for s in scored if s[3] == lab][:5]:
            fits = [(j, -s) for s, _, j, other in scored if other != lab and -30 * p <= -100 * s <= -90 * p][:10]
            out += [(i, positive, r, j, -p, s) for r, (j, s) in enumerate(fits, 1)]
    return listed(out)


@pytest.mark.parametrize("every", [1, 20])
def test_top_k_of_odd_rows(spark, every):
    rows = vectors(120 if every == 1 else 400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long").withColumns({"id": F.lit("x"), "v": F.lit(1)})
    got = [tuple(r) for r in topk.top_k(df.repartition(5), every=every).collect()]
    assert listed(got) == plain_top(rows, 20, every)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("embedding is null")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_of_odd_rows(spark, seed):
    rows = vectors(300, seed=seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit("x"), "windows": F.lit(1)})
    got = [tuple(r) for r in negatives.hard_negatives(df.repartition(3), every=10).collect()]
    assert listed(got) == plain_negatives(rows, 10)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_mined_labels(spark):
    df = spark.createDataFrame([(7, 9), (14, 3), (8, 9), (None, 2), (21, None)], "vec_id long, label int")
    assert [r[0] for r in df.select(negatives.mined_label("vec_id", "label")).collect()] == [0, 4, 9, 2, None]


def test_bounds_leave_work_undone():
    """Queries near a few rows: branch and bound reads a part of the components, the intervals score few rows."""
    draws = np.random.default_rng(5)
    rows = draws.integers(-60, 60, (20_000, 64)) * (np.arange(64) < 32)
    rows[::50] += draws.integers(40, 60, 64)
    table = lambda ix: pa.table({"row": pa.array(ix), "id": pa.array(ix), "label": pa.array(ix % 2), "v": pa.array(list(rows[ix]), pa.list_(pa.int32()))})
    asked, every = np.arange(0, 2000, 50), np.arange(len(rows))
    search = topk.BranchAndBound(table(asked), 10)
    for start in range(0, len(rows), 4096):
        for batch in table(every[start:start + 4096]).combine_chunks().to_batches():
            search.feed(batch)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -(1 << 62)
    assert (search.best.ids == np.array([np.lexsort((every, -s))[:10] for s in scores])).all()
    assert search.scored < 0.8 * scores.size * 64
    codes, align, rest = negatives.encode(rows, 64, 6)
    packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
    full = table(every).append_column("codes", packed(codes)).append_column("align", packed(align)).append_column("rest", packed(rest))
    queries = full.take(asked).append_column("windows", pa.array([[{"ask": 1, "low": 0, "high": 1 << 40}]] * len(asked)))
    near = negatives.IntervalSearch(queries, 5, True, 64, 6)
    for start in range(0, len(rows), 4096):
        near.feed(full.slice(start, 4096).combine_chunks().to_batches()[0])
    scores[:, 1::2] = -(1 << 62)
    assert (near.best.ids == np.array([np.lexsort((every, -s))[:5] for s in scores])).all()
    assert near.scored < 0.05 * near.seen


def test_codes_keep_what_they_say():
    """Codes times alignments plus what is left give the rotated row back; the rotation keeps inner products."""
    values = np.random.default_rng(2).integers(-200, 200, (50, 70))
    size = negatives.dimensions(70)
    turned = negatives.rotate(values, size)
    assert size == 128 and np.allclose(turned @ turned.T, values @ values.T)
    codes, align, rest = negatives.encode(values, size, 4)
    signs = np.unpackbits(codes.view(np.uint8).reshape(50, 4, -1), axis=2, bitorder="little") * 2.0 - 1
    left = turned - np.einsum("rl,rld->rd", align, signs) / np.sqrt(size)
    assert np.allclose(np.linalg.norm(left, axis=1), rest[:, 3])
    assert (np.diff(rest, axis=1) < 0).all()


def test_large_components_stay_exact(spark):
    big = [(20, [250_000.0] * 300), (40, [-250_000.0, 249_999.984375] * 150), (60, [250_000.0] * 299 + [249_999.984375])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    kept = usable([(i, v, 0) for i, v in big], 64)
    want = [(i, r, j, s) for i, v, _ in kept for r, (s, j) in enumerate(sorted(((dot(v, w), j) for j, w, _ in kept if j != i), key=lambda x: (-x[0], x[1])), 1)]
    assert listed([tuple(r) for r in topk.top_k(df).collect()]) == listed(want)


def test_every_query_meets_every_row_once(spark):
    """In any grid of cells."""
    class Count:
        def __init__(self, table):
            self.queries, self.n = table["row"].to_pylist(), 0

        def feed(self, batch):
            self.n += batch.num_rows

        def result(self):
            return pa.RecordBatch.from_arrays([pa.array(self.queries, pa.int64()), pa.array([self.n] * len(self.queries), pa.int64())], ["row", "n"])

    df = spark.createDataFrame([(k, [float(k)]) for k in range(500)], "vec_id long, embedding array<float>")
    known = scaled(df, "vec_id", "embedding", 1)
    asked = known.where("id % 5 = 0")
    for grid in [(1, 1), (7, 3), (3, 40)]:
        met = in_cells(asked, known, grid, Count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
        assert [r.n for r in met] == [500] * 100


def test_matrix_and_best():
    lists = pa.array([[1, 2], [], [3, 4, 5]], pa.list_(pa.int32()))
    assert matrix(lists).tolist() == [[1, 2, 0], [0, 0, 0], [3, 4, 5]]
    assert matrix(lists, 2).tolist() == [[1, 2], [0, 0], [3, 4]]
    best = Best(3, 2)
    best.add(np.array([2, 0, 2, 2]), np.array([5, 1, 5, 4]), np.array([9, 1, 3, 7]))
    best.add(np.array([2]), np.array([5]), np.array([4]))
    assert [x.tolist() for x in best.found()] == [[0, 2, 2], [1, 5, 5], [1, 3, 4]]


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain_search(docs, items, k=10):
    cut = [(i, [w.translate(LOWER) for w in TERM.findall(t or "")]) for i, t in docs]
    cut = [(i, len(w), Counter(w)) for i, w in cut if w]
    n_docs, n_terms, df = len(cut), sum(n for _, n, _ in cut), Counter(t for _, _, c in cut for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked, found = Counter(w.translate(LOWER) for w in TERM.findall(text or "")), []
        for i, n, c in cut:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(times * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                found.append((-s, order(i), i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return listed(out)


def odd_texts():
    draws = random.Random(11)
    words = [f"w{k}" for k in range(40)] + ["Ärger", "日本", "A1b2", "x_y", "naïve-É"]
    texts = [" ".join(draws.choices(words, k=draws.randrange(1, 30))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(1000 + k, texts[0]) for k in range(200)] + [(2000 + k, texts[1].upper()) for k in range(15)]
    docs += [(7, texts[3]), (7, texts[3]), (None, texts[0]), (None, texts[2]), (None, None), (5000, None), (5001, ""), (5002, " -.!\n")]
    docs += [(5003, "w1 w2 " * 60_000), (5004, "q" * 200_000), (5005, "Kelvin K w3")]
    items = [(1, texts[0]), (2, "w1 w1 W2 nothing"), (2, "Ärger 日本"), (3, None), (4, ""), (5, "unknown terms only"), (None, "w3 x y"), (6, "w7 " * 30)]
    return docs, items


@pytest.mark.parametrize("shard_terms", [1_000_000, 25])
def test_lexical_search_of_odd_rows(spark, shard_terms):
    docs, items = odd_texts()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "bag": F.lit(1), "m": F.lit(2)}).repartition(6)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))
    got = [tuple(r) for r in lexical.search(d, b, shard_terms=shard_terms).collect()]
    assert listed(got) == plain_search(docs, items)
    assert lexical.search(d.limit(0), b).count() == 0 and lexical.search(d, b.limit(0)).count() == 0
    assert lexical.search(d, b.where("text = ''")).columns == ["item_id", "rank", "doc_id", "score"]


def test_copies_are_scored_once(spark):
    """Equal bags of equal norm are one class, however many documents it has; others differ byte by byte."""
    docs, _ = odd_texts()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    held = lexical.bags(d, {b"w1": 0, b"w2": 1, b"w3": 2}, "doc_id", "text")
    rows = [(r.doc_id, r.n, bytes(r.bag)) for r in held.collect()]
    n_docs, n_terms = len(rows), sum(n for _, n, _ in rows)
    got = {(r.m, bytes(r.bag)): r.members for r in lexical.classes_of(held, n_docs, n_terms, 3).collect()}
    want = {}
    for i, n, bag in rows:
        if bag:
            want.setdefault((25 + 75 * n * n_docs // n_terms, bag), []).append(i)
    assert got == {c: sorted(m, key=order)[:3] for c, m in want.items()}
    assert len(got) < len(rows) / 3
