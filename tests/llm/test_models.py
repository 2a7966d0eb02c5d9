import random

import numpy as np
import pytest

from formfield.llm import quality, toxicity

SYLLABLES = "an er ti on re st ing the ha ou".split()


def prose(draws, n):
    return " ".join("".join(draws.choices(SYLLABLES, k=draws.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def quality_docs(n, seed):
    draws, out = random.Random(seed), []
    for _ in range(n):
        lines = [prose(draws, draws.randrange(4, 30)) for _ in range(draws.randrange(1, 8))]
        bad = draws.random() < 0.3
        if bad:
            spoil = draws.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: " ".join([t.split()[0]] * 30)])
            at = draws.randrange(len(lines))
            lines[at:] = [spoil(x * 3) for x in lines[at:]]
        out.append(("\n".join(lines), int(not bad)))
    return out


def accuracy(scored):
    return np.mean([(p >= 0.3) == bool(y) for p, y in scored])


def test_chain_marginals_match_enumeration():
    """Forward-backward against the sum over all labellings of a short text."""
    draws = np.random.default_rng(3)
    model = quality.Model(np.zeros(36), draws.normal(size=36), draws.normal(size=(2, 2)))
    text = "Ab c.\n\nDEF!! GHI!!\nx | y | z\nplain words here"
    scores, _ = model.line_scores(text.encode())
    total, good = 0.0, np.zeros(len(scores))
    for code in range(2 ** len(scores)):
        labels = [code >> t & 1 for t in range(len(scores))]
        weight = np.exp(scores @ labels + sum(model.edge[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total, good = total + weight, good + weight * np.array(labels)
    assert np.allclose(model.good_lines(text.encode())[0], good / total)


def test_quality_on_held_out_documents():
    model = quality.fit_model([(t.encode(), y) for t, y in quality_docs(500, 1)])
    assert accuracy([(model.score(t.encode()), y) for t, y in quality_docs(300, 2)]) > 0.93


@pytest.mark.parametrize("samples", [[], [(b"one", 1)], [(b"", 0), (b"", 1)], [(b"a b", 1), (b"A!!", 0)]])
def test_quality_of_small_samples(samples):
    model = quality.fit_model(samples)
    for text in (None, b"", b" \n ", b"words", b"x" * 100_000, b"line\n" * 20_000):
        assert 0 <= model.score(text) <= 1


def toxic_docs(n, seed):
    draws, out = random.Random(seed), []
    insults = ["fool", "rotter", "scoundrel", "kretin", "kretinka", "kretinov"]
    for _ in range(n):
        words = prose(draws, draws.randrange(5, 120)).split()
        bad = draws.random() < 0.12
        for _ in range(draws.randrange(2, 6) if bad else 0):
            words.insert(draws.randrange(len(words)), draws.choice(insults))
        out.append((" ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_documents():
    model = toxicity.fit_model(toxic_docs(1500, 1))
    assert b"fool" in model.voters.lexicon
    scored = [(model.score(t), y) for t, y in toxic_docs(600, 2)]
    assert accuracy(scored) > 0.97
    assert np.mean([p >= 0.3 for p, y in scored if y]) > 0.95


@pytest.mark.parametrize("samples", [[], [("one", 1)], [("", 0), ("", 1)], [("a b", 1), ("A!!", 0)]])
def test_toxicity_of_small_samples(samples):
    model = toxicity.fit_model(samples)
    for text in (None, "", " \n ", "words", "x" * 100_000, "word " * 50_000):
        assert 0 <= model.score(text) <= 1


def test_label_model_trusts_accurate_voters():
    draws = np.random.default_rng(5)
    truth = draws.random(4000) < 0.2
    sure = np.where(truth & (draws.random(4000) < 0.7), 1, 0)
    also = sure.copy()
    noisy = np.where(draws.random(4000) < 0.1, 1, 0)
    against = np.where(~truth & (draws.random(4000) < 0.8), -1, 0)
    found = toxicity.label_model(np.column_stack([sure, also, noisy, against]), 0.2)
    assert found[(sure == 1)].min() > 0.9
    assert ((found >= 0.5) == truth).mean() > 0.93


@pytest.mark.parametrize("module,label,docs", [(quality, "quality", quality_docs), (toxicity, "toxic", toxic_docs)])
def test_tables_with_odd_rows(spark, module, label, docs):
    rows = [(n, t) for n, (t, _) in enumerate(docs(300, 4))]
    odd = [(None, "no id"), (7, None), (8, ""), (9, "word " * 40_000), (0, rows[0][1])]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'q' AS label")
    marks = [(n, y) for n, (_, y) in enumerate(docs(300, 4))] + [(None, 1), (5, None), (6, 7), (0, 1), (9999, 0)]
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int").selectExpr("*", "2 AS text")
    model = module.fit(table, labels, fit_documents=200)
    got = module.score_documents(table, model).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT) for r in got)
    assert module.score_documents(table.limit(0), module.fit(table.limit(0), labels.limit(0))).count() == 0


def test_every_line_of_a_long_document_is_learnt():
    """Bad lines only at the two ends of long documents, which a run from the middle would miss."""
    good, bad = "A plain sentence of some words follows here.\n", "$$ BUY || NOW || 999 !!\n"
    long_bad = bad * 300 + good * 500 + bad * 300
    samples = [((good * (5 + k)).encode(), 1) for k in range(40)] + [(long_bad.encode(), 0)] * 6
    model = quality.fit_model(samples)
    assert model.score((bad * 10).encode()) < 0.3 < 0.7 < model.score((good * 10).encode())
    cut = quality._stretches([np.arange(n) for n in (0, 1, 400, 401, 1000)])
    assert [len(v) for v in cut] == [1, 400, 400, 1, 400, 400, 200]
    assert np.concatenate(cut).sum() == sum(n * (n - 1) // 2 for n in (1, 400, 401, 1000))


def test_quality_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(k, "word " * (k + 1)) for k in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)], "doc_id long, quality int")
    seen = []
    keep = quality.fit_model
    try:
        quality.fit_model = lambda samples: seen.append(samples)
        for most in (quality.FIT_BYTES, 1_000, 0):
            quality.fit(docs, labels, fit_bytes=most)
    finally:
        quality.fit_model = keep
    whole, some, none = seen
    assert sum(len(t) for t, _ in some) <= 1_000 and 0 < len(some) < len(whole)
    assert all(t == b"word " * (len(t) // 5) for t, _ in whole) and {t for t, _ in none} <= {b""}
