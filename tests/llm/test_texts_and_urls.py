import decimal
import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from formfield.llm import fingerprints, licenses, url_filter


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_likeness_estimates_jaccard():
    hasher, draws, errors = fingerprints.Minhash(), np.random.default_rng(2), []
    for size in (3, 12, 60, 400, 2500):
        for part in (0.0, 0.3, 0.8, 1.0):
            a = [f"w{n}" for n in draws.integers(0, 10**9, size)]
            b = a[:int(size * part)] + [f"w{n}" for n in draws.integers(0, 10**9, size - int(size * part))]
            x, y = " ".join(a), " ".join(b)
            true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
            errors.append(hasher.likeness(hasher.fingerprint(x.encode()), hasher.fingerprint(y.encode())) - true)
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and max(map(abs, errors)) < 0.2


def by_key(row):
    """Ids in order, a missing one first, equal ones by the MD5 of their texts."""
    return (row[0] is not None, row[0] or 0, int(hashlib.md5(row[1].encode()).hexdigest()[:15], 16))


def plain_fingerprint(text, bins=256, bits=4, seed=42):
    """Bins, walk and packing one shingle and one bin at a time."""
    mixed = lambda x: int(fingerprints._mixed(np.array([x], dtype=np.uint64))[0])
    draws = np.random.default_rng(seed)
    walks = [draws.permutation(bins).tolist() for _ in range(bins)]
    odd = [int(v) | 1 for v in draws.integers(1, 2**63, size=5, dtype=np.uint64)]
    words = text.encode().lower().split()
    if not words:
        return ""
    least = [None] * bins
    for start in range(max(1, len(words) - 4)):
        total = sum(mixed(xxhash.xxh64_intdigest(w, seed)) * odd[k] for k, w in enumerate(words[start:start + 5])) % 2**64
        value = mixed(total)
        own = value % bins
        least[own] = value // bins if least[own] is None else min(least[own], value // bins)
    full = [least[next(b for b in [n, *walks[n]] if least[b] is not None)] if v is None else v for n, v in enumerate(least)]
    return "".join(f"{mixed(v) % (1 << bits):x}" for v in full)


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_registered_fingerprints_against_a_plain_version(spark, sf_dir):
    from formfield.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    short = [n for n, (_, t) in enumerate(docs) if len(t) < 3000][:80]
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for n in short:
        (own, text), (after, following) = docs[n], docs[(n + 1) % len(docs)]
        edited = fingerprints.edited_text(text, following)
        prints = plain_fingerprint(text), plain_fingerprint(edited)
        row = got[own]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == prints
        assert abs(row.near_edited - plain_likeness(*prints)) < 1e-12
        assert abs(row.near_next - plain_likeness(prints[0], got[after].fingerprint)) < 1e-12


@pytest.mark.parametrize("kind,ids", [
    ("long", [None, 2**60 + 1, 2**60 + 2, 2**60, -5, 2**63 - 1]), ("string", [None, "b", "a", "é", "", "\U0001f600"]),
    ("decimal(38,0)", [None, 10**30, 10**30 + 1, 3, 0, -1]),
])
def test_ids_of_any_kind(spark, kind, ids):
    """Large numbers beside missing ids, texts and decimals; a missing id that a third of the rows share."""
    convert = decimal.Decimal if "decimal" in kind else lambda x: x
    rows = [(None if i is None else convert(i), f"text of {n} " * (n + 1)) for n, i in enumerate(ids)]
    rows += [(None, f"row {n} without an id " * 5) for n in range(40)] + [(rows[1][0], f"again {n} " * 9) for n in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] if kind != "string" else r[0].encode()) if r[0] is not None else 0, by_key(("", r[1]))[2]))
    want = [(str(i), hashlib.sha256(fingerprints.edited_text(t, order[(n + 1) % len(order)][1]).encode()).hexdigest()) for n, (i, t) in enumerate(order)]
    for range_bytes in (1 << 23, 100):
        got = fingerprints.fingerprint_edits(docs.repartition(4), range_bytes=range_bytes).collect()
        assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)


def test_edits_follow_the_next_document(spark):
    rows = [(n * 3, " ".join(f"t{n}x{k}" for k in range(n % 50))) for n in range(400)]
    rows += [(5, None), (6, ""), (None, "no id"), (9, "é日本 " * 9000), (9, "a repeated id"), (9, "a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS `range`")
    for range_bytes in (1 << 23, 2000):
        got = fingerprints.fingerprint_edits(docs, range_bytes=range_bytes).collect()
        order = sorted(((d, t or "") for d, t in rows), key=by_key)
        texts = [t for _, t in order]
        edits = [fingerprints.edited_text(t, texts[(n + 1) % len(texts)]) for n, t in enumerate(texts)]
        want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, t), e in zip(order, edits, strict=True))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert len({r.fingerprint for r in got if r.n_chars == len("a repeated id") and r.doc_id == 9}) == 1
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0
    (one,) = fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_license_scan_of_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "Released under the MIT License."), (4, "mit\nLICENSE and the MIT-license"), (5, "All rights reserved"),
        (6, "word " * 30_000 + "CC BY-NC 4.0"), (6, "nothing"), (7, "the\u212ait license m\u0130t license"),
        (8, "this work: licensed under gnu general public LICENSE, version 3"), (None, "apache license " * 3), (9, "rights all"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS labels", "2 AS words")
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    starts = {k: [p.start for p in r.places] for k, r in got.items()}
    assert starts[3, 5] == [3] and starts[4, 6] == [0, 4] and starts[None, 6] == [0, 2, 4] and starts[6, 30_005] == [30_000]
    assert starts[7, 4] == [] and starts[1, 0] == [] and starts[6, 1] == []
    assert got[8, 10].base_labels == ["gpl"] and "gpl" in got[8, 10].labels
    assert got[5, 3].labels == ["reserved"] and got[5, 3].score == 1.0 and got[9, 2].labels == []
    assert got[1, 0].score == 0.0 and got[3, 5].score == 1.0
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, templates=[]).count() == len(rows)


def test_notices_are_all_found(spark):
    """Every block and template above the threshold, against comparing each with each."""
    draws = np.random.default_rng(4)
    vocabulary = [f"v{n}" for n in range(12)]
    templates = [(f"l{n}", " ".join(draws.choice(vocabulary, draws.integers(1, 8)))) for n in range(8)]
    lines = [" ".join(draws.choice(vocabulary + ["other"], draws.integers(1, 14))) for _ in range(400)]
    docs = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = licenses.notices(docs, templates=templates, threshold=threshold)
        texts = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).dropDuplicates(["a", "b"])
        found = {(r.doc_id, r.label, round(r.containment, 6)) for r in got.join(texts, ["a", "b"]).collect()}
        ids = {r.doc_id for r in texts.collect()}
        want = set()
        for label, tokens in licenses.template_tokens(templates):
            for n in ids:
                share = len(set(tokens) & set(lines[n].split())) / len(tokens)
                if share >= threshold - 1e-9:
                    want.add((n, label, round(share, 6)))
        assert found == want


def test_wrapped_notices_are_found(spark):
    """Notices broken over lines, with comment marks, far into a text; tokens strewn over a text are none."""
    mit, bsd = (next(t for label, t in licenses.TEMPLATES if label == k and len(t) > 60) for k in ("mit", "bsd"))
    lgpl = next(t for label, t in licenses.TEMPLATES if label == "lgpl")

    def wrap(text, mark="", each=5):
        parts = text.split()
        return "\n".join(mark + " ".join(parts[k:k + each]) for k in range(0, len(parts), each))

    rows = [
        (1, wrap(mit)), (2, "some text\n" * 3000 + wrap(bsd, " * ") + "\nmore text" * 50), (3, wrap(lgpl, "REM ", 7)),
        (4, "\n".join(f"{w} " + "filler " * 40 for w in bsd.split())), (5, wrap(bsd, each=1)), (6, "first\n" + bsd + "\nlast"),
        (7, "All\nrights\r\nreserved."), (8, None), (9, "\n\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (set(r.labels), r.score) for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    assert got[1] == ({"mit"}, 1.0) and got[2] == got[5] == got[6] == ({"bsd"}, 1.0) and got[7] == ({"reserved"}, 1.0)
    assert "lgpl" in got[3][0] and got[3][1] == 1.0
    assert got[4] == got[8] == got[9] == (set(), 0.0)


RULES = [("org", "/", "allow"), ("b.org", "/x", "block"), ("a.b.org", "", "allow"), ("org", "/same", "block"), ("org", "/same", "allow"), (None, "/", "block"), ("com", None, "block")]


def plain_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3:]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in RULES if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, "allow"))


@pytest.mark.parametrize("small", [16 << 20, 0])
def test_rules_against_comparing_each(spark, monkeypatch, small):
    monkeypatch.setattr(url_filter, "SMALL_RULES", small)
    urls = [
        None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.b.ORG/x?y#z", "x://b.org/xx", "ftp://a.b.org?q=/x", "http://notorg/",
        "http://b.org/same", "http://c.org/same/1", "a://b://c.org/", "http://com/", "http://x.org/" + "p" * 5000, "http://b.org/x", "http://b.org/x", "\n://q.org/\nx",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS digest", "3 AS b_path")
    got = url_filter.judge(pages, url_filter.rule_table(spark, RULES))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {n: plain_judge(u) for n, u in enumerate(urls)}
    assert got.count() == len(urls) and url_filter.judge(pages.limit(0), url_filter.rule_table(spark, RULES)).count() == 0
    empty = url_filter.judge(pages, url_filter.rule_table(spark, RULES).limit(0))
    assert {r.verdict for r in empty.collect()} == {"allow"}
