import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from formfield.llm import line_spread, mixing


def plain_removal(rows, least, words=50, passage_sites=2):
    sites, texts = defaultdict(set), defaultdict(set)
    key = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(site)
                texts[line.strip(" ")].add(key(text))
    passage = {line for line in sites if len(re.findall("[^\x20\x09-\x0D]+", line)) > words}
    wide = {line for line, s in sites.items() if line not in passage and len(s) >= least}
    repeated = {line: min(texts[line]) for line in passage if len(sites[line]) >= passage_sites and len(texts[line]) > 1}
    out = []
    for doc, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        full = [x for x in lines if x.strip(" ")]
        quoted = {x for x in full if repeated.get(x.strip(" "), key(text)) != key(text)}
        if 2 * sum(len(x) for x in full if x in quoted) >= sum(map(len, full)):
            quoted = set()
        stays = lambda x: x.strip(" ") not in wide and x not in quoted
        n = len(full) - sum(map(stays, full))
        cut = 0 < n < len(full)
        out.append((doc, len(full), n if cut else 0, "\n".join(filter(stays, lines)) if cut else text))
    return sorted(out, key=str)


def test_passages_stay_in_one_text(spark):
    """A passage of two sites or more stays in one text and its copies; copies of half a text keep it."""
    word = lambda k, n: " ".join(f"{k}{j}" for j in range(n))
    own = lambda k, n=200: f"own {word(f'o{k}x', n)}"
    shared, short, halved, local = word("s", 51), word("t", 50), word("h", 300), word("l", 80)
    rows = [(k, f"{own(k)}\n  {shared} \n{short}", f"site{k % 3}") for k in range(6)]
    rows += [(20, rows[2][1], "site9"), (None, rows[2][1], "site9"), (None, f"{own(30)}\n{shared}", "z"), (None, f"{own(31)}\n{shared}", "z")]
    rows += [(40 + k, f"{own(40 + k, 20)}\n{halved}", f"site{k}") for k in range(3)]
    rows += [(50 + k, f"{own(50 + k)}\n{local}", "one site") for k in range(3)]
    rows += [(60, f"{shared}\n{shared}\n{own(60, 300)}", None), (0, f"{own(0)}\nanother text of this id", "y"), (70, shared, "w")]
    rows += [(80, own(80), "a"), (81, own(80), "b"), (None, None, "c"), (90, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS own", "'y' AS passages", "7 AS n_lines")
    got = line_spread.remove_boilerplate(docs.repartition(4), n_lines="lines", n_removed="gone").collect()
    assert sorted(((r.doc_id, r.lines, r.gone, r.text) for r in got), key=str) == plain_removal(rows, 10)
    assert all(r.n_lines == 7 and r.own == "x" for r in got)
    assert len({r.text for r in got if r.text and shared in r.text and r.text != shared}) == 1
    assert sum(halved in (r.text or "") for r in got) == sum(local in (r.text or "") for r in got) == 3


@pytest.mark.parametrize("precision,least", [(8, 10), (4, 10), (8, 2), (5, 30)])
def test_lines_of_many_sites_go(spark, precision, least):
    rows = []
    for n in range(60):
        site = None if n == 7 else f"site{n}"
        shared = [f"on {k} sites" for k in (1, 2, 8, 9, 10, 11, 12, 29, 30, 31, 45, 60) if n < k]
        rows.append((n, "\n".join(["", f"  own line {n}", *shared, "  ", "twice", "twice"]), site))
    rows += [(1, "on 60 sites\n on 60 sites ", "site1"), (2, None, "a"), (3, "", None), (None, "on 60 sites\nmine", "b"), (70, "deep\n" * 3000 + "on 60 sites", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "9L AS n_lines", "'z' AS boilerplate", "0 AS h1")
    got = line_spread.remove_boilerplate(docs, min_sites=least, precision=precision)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == plain_removal(rows, least)
    assert {"boilerplate", "h1"} <= set(got.columns)
    assert line_spread.remove_boilerplate(docs.limit(0)).count() == 0


def test_sketches_estimate_sites(spark):
    lines = spark.range(20_000).select(
        F.lit(1).alias("doc_id"), F.lit("line").alias("text"), F.col("id").cast("string").alias("source")
    )
    (row,) = line_spread.spread(line_spread.site_lines(lines, "doc_id", "text", "source", 10), 10).collect()
    assert abs(row.sites / 20_000 - 1) < 0.15


def test_sites_that_share_registers_are_counted(spark):
    """Ten sites in six registers of 256, and nine of them, which are too few."""
    register = lambda s: xxhash.xxh64_intdigest(f"={s}".encode(), 42) & 255
    sites = [next(s for n in range(10**6) if register(s := f"s{n}x{k}") == k % 6) for k in range(10)]
    rows = [(n, f"own line {n}\non ten sites" + "\non nine sites" * (n < 9), s) for n, s in enumerate(sites)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    (row,) = line_spread.spread(line_spread.site_lines(docs.selectExpr("doc_id", "'x' AS text", "source"), "doc_id", "text", "source", 8), 8).collect()
    assert row.filled == 6
    got = line_spread.remove_boilerplate(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()), key=str) == plain_removal(rows, 10)
    assert [line_spread.fewest_registers(k, 8) for k in (1, 2)] == [1, 1] and 4 <= line_spread.fewest_registers(10, 8) <= 5


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    full: dict = {}
    while True:
        rest = Fraction(sum(sizes.values()) - sum(full.values()))
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: most * sizes[s] for s in over})


def test_targets_follow_the_resharing_rule(spark):
    for sizes in ({"a": 100, "b": 5, "c": 1, None: 50, "é": 3000, "Z": 7}, {"x": 10}, {"a": 0, "b": 9}, {str(n): n * n for n in range(40)}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, total long")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - float(want[s])) < 1e-6 * max(1, got[s]) for s in got)


def _docs(spark):
    rows = [(n, "w " * (1 + n * 7919 % 400), f"s{n % 3}" if n % 5 else "hot") for n in range(3000)]
    rows += [(1, "w " * 30_000, "s0"), (-1, None, "s1"), (-2, " \t", None), (None, "no id at all", None), (-3, "x", None)]
    rows += [(77, "same row again", "s2")] * 500
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS key")


@pytest.mark.parametrize("fan_in", [16, 256])
def test_mix_meets_its_targets(spark, fan_in):
    docs = _docs(spark)
    got = mixing.mix(docs, fan_in=fan_in).collect()
    again = mixing.mix(docs.repartition(13), fan_in=fan_in).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
    totals, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        totals[r.source] += r["size"]
        taken[r.source] += r.taken
    want = plain_targets(dict(totals))
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - float(want[r.source])) < 1e-6 * max(1.0, r.target)
    for s in totals:
        assert abs(taken[s] - float(want[s])) <= 400, s
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rounding_is_fair(spark):
    """Over many sources of the same sizes a document's mean copies come near its expected ones."""
    sources = 240
    rows = [(n + 100 * k, "w " * (5 + n), f"s{k:03}") for k in range(sources) for n in range(12)]
    counts = defaultdict(list)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), fan_in=4).collect():
        counts[r["size"], round(r.target / r.source_size, 6)].append(r.copies)
    for (_, each), copies in counts.items():
        assert abs(sum(copies) / len(copies) - each) < 4 * 0.5 / len(copies) ** 0.5
