"""Registered queries against their SQL or brute force, and the pipeline's stages."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from formfield.llm import decontaminate, token_counts
from formfield.llm.queries import ORACLES, QUERIES
from tests.llm.test_lines_and_mix import plain_removal, plain_targets
from tests.llm.test_near_duplicates import plain_groups

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def plain_rows(rows):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) in (4, 5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain_rows(got.select(columns).collect()) == plain_rows(want.select(", ".join(columns)).fetchall())


def test_token_query_against_encoding_everything(spark, sf_dir):
    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op2_token_counts"](spark, sf_dir).collect():
        text, source = docs[r.doc_id]
        n = len(text)
        edited = text[:n // 2] + text[:n // 25] + text[n // 2 + n // 20:]
        edited = edited[:n // 4] + f"\n\nEdited: {source}'s  " + edited[n // 4:]
        edited = edited[:n // 4 * 3] + edited[n // 4 * 3 + n // 50:]
        encode = counter.encoding.encode_ordinary
        assert (r.n_chars, r.n_tokens, r.n_chars_edited, r.n_tokens_edited) == (n, len(encode(text)), len(edited), len(encode(edited)))


@pytest.mark.parametrize("name,label,folds,fold,least", [("op6_toxicity", "toxic", 4, 2, 0.7), ("op7_quality", "quality", 5, 0, 0.9)])
def test_scores_of_held_out_rows(spark, name, label, folds, fold, least):
    """Whether a held-out document marked 1 scores above one marked 0, over all such pairs."""
    sf_dir = "/root/testdata/sf0.01"
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    one, zero = ([r.score for r in rows if r.held_out and marks.get(r.doc_id) == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero)) > least


def test_pipeline_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(100_001, None, "en", "src1", 0), (100_002, "", None, None, None)], docs.schema)
    docs = docs.union(extra).union(docs.limit(3))
    columns = docs.columns
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = [r.asDict() for r in docs.collect()], spark.read.parquet(str(tmp_path / name))
        kept[name] = after = [r.asDict() for r in docs.collect()]
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.schema["n_chars"].dataType == extra.schema["n_chars"].dataType
        if name == "quality_filter":
            marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            ids = {r["doc_id"] for r in after}
            good = [d for d, q in marks.items() if q == 1]
            bad = [d for d, q in marks.items() if q == 0]
            assert sum(d in ids for d in good) / len(good) > 0.97 and sum(d in ids for d in bad) / len(bad) < 0.3
        elif name == "line_dedup":
            want = plain_removal([(r["doc_id"], r["text"], r["source"]) for r in before], 10)
            assert sorted(((d, t) for d, _, _, t in want), key=str) == sorted(((r["doc_id"], r["text"]) for r in after), key=str)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
        elif name == "simhash_near_dedup":
            root = plain_groups({r["doc_id"]: r["text"] for r in before})
            assert sorted(r["doc_id"] for r in after) == sorted(set(root.values()))
        elif name == "decontamination":
            known = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            windows = {(b" ".join(w[s:s + 13]), str(i)) for i, t in known for w in [decontaminate.words_of(t.encode())] for s in range(max(1, len(w) - 12))}
            texts = {w for w, _ in windows}
            want = []
            for r in before:
                words = decontaminate.words_of((r["text"] or "").encode())
                hit = set()
                for size in {len(w.split()) for w in texts}:
                    for s in range(len(words) - size + 1):
                        if b" ".join(words[s:s + size]) in texts:
                            hit.update(range(s, s + size))
                if not hit or 20 * len(hit) < len(words):
                    want.append(r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        else:
            sizes = {}
            for r in after:
                sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            want = plain_targets(sizes)
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
            assert all(abs(r["target"] - float(want[r["source"]])) < 1e-6 * max(1.0, r["target"]) for r in after)
    assert len(kept["decontamination"]) < len(kept["simhash_near_dedup"]) < len(kept["line_dedup"]) == len(kept["quality_filter"])
    assert corpus_pipeline.run(spark, sf_dir).columns == docs.columns


def test_near_dedup_keeps_texts_of_null_and_repeated_ids(spark, sf_dir):
    """One row of each group of texts is left, though ids are null or stand for several texts."""
    words = lambda seed, n=80: " ".join(f"{seed}w{k * k % 97}x{k}" for k in range(n))
    rows = [
        (None, words("a"), "en"), (None, words("b"), "en"), (None, words("b"), None), (5, words("c"), "en"), (5, words("d"), "en"),
        (7, words("e"), "en"), (7, words("e"), "en"), (3, words("f"), "en"), (None, words("f"), "en"), (9, words("c") + " tail", "en"),
        (5, "head " + words("f"), "en"), (None, None, "en"), (None, "", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    again = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs.repartition(5), sf_dir).collect()]
    assert sorted(got, key=str) == sorted(again, key=str) and set(got) <= set(rows)
    assert sorted((r[1] or "")[:1] for r in got) == ["", "a", "b", "c", "d", "e", "f"]
    assert {(r[0], r[1][0]) for r in got if r[1]} == {(None, "a"), (None, "b"), (5, "c"), (5, "d"), (7, "e"), (3, "f")}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, sf_dir):
    """Columns that stages use themselves come out as they went in; each stage takes a table without rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("n_lines", "n_removed", "found", "row_key", "own", "text_key", "component", "first", "score")
    wide = docs.selectExpr("*", *(f"concat(doc_id, ' {n}') AS `{n}`" for n in names), "doc_id AS `a b.c`")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf_dir)
        if name != "source_mixing":
            assert out.columns == wide.columns
            rows = out.collect()
            assert rows and all(r[n] == f"{r.doc_id} {n}" for r in rows for n in names) and all(r["a b.c"] == r.doc_id for r in rows)
        else:
            assert out.count() == docs.count()
        assert stage(spark, wide.limit(0), sf_dir).count() == 0
