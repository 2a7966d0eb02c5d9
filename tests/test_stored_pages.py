"""Pages as bytes, published views and remembered pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from formfield.plans.extract import runner_forms
from formfield.plans.predict import predict_forms
from formfield.plans.remembered import remember, remembered_forms
from formfield.sources import published as PV
from formfield.sources import raw
from formfield.sources.pages import newest_captures
from suite import page_queries as Q
from tests import page_writer as P

NOON = datetime.datetime(2026, 8, 25, 12)


def naive(content):
    try:
        content.decode("utf-8")
    except UnicodeDecodeError as wrong:
        return wrong.start
    return None


# --- bytes ---------------------------------------------------------------------------------------

def test_broken_files_are_quarantined(spark, tmp_path):
    files = {
        "good": "plain é € 😀\n".encode(), "bom": b"\xef\xbb\xbfwith mark", "empty": b"", "cut": "price €".encode()[:-1],
        "latin": "caf\xe9 au lait".encode("latin-1"), "utf16": "wide".encode("utf-16"), "stray": b"ab\x80cd", "never": b"abc\xffdef",
        "overlong": b"a\xc0\xafb", "surrogate": b"x\xed\xa0\x80", "cut4": "a😀".encode()[:-1], "long": b"e\xcc\x81" * 200_000 + b"\xc3",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    pages = raw.read_raw_pages(spark, str(tmp_path), "*.txt")
    assert pages.columns == list(raw.RAW_COLUMNS)
    pages = pages.withColumn("page_id", F.regexp_extract("page_id", r"(\w+)\.txt$", 1)).withColumn("a.b", F.lit(1))
    good, bad = raw.decode_pages(pages)
    assert good.columns == ["page_id", "captured_at", "a.b", "text"]
    assert {r.page_id: r.text for r in good.collect()} == {"good": "plain é € 😀\n", "bom": "with mark"}  # a file without bytes is not read
    found = {r.page_id: (r.byte_offset, r.reason, bytes(r.content)) for r in bad.collect()}
    reasons = {"cut": raw.CUT, "latin": raw.BROKEN, "utf16": raw.UTF16, "stray": raw.STRAY, "never": raw.NEVER, "overlong": raw.NEVER,
               "surrogate": raw.BROKEN, "cut4": raw.CUT, "long": raw.CUT}
    assert found == {n: (naive(files[n]), why, files[n]) for n, why in reasons.items()}


def test_any_bytes_break_where_a_decoder_says(spark):
    import random

    rng = random.Random(3)
    parts = [b"a", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\x80", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80", b"\xf0\x80", b"\xff"]
    rows = [(i, b"".join(rng.choices(parts, weights=[9, 9, 9, 9, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 8)))) for i in range(4000)]
    good, bad = raw.decode_pages(spark.createDataFrame(rows, "page_id int, content binary"))
    got = {r.page_id: r.byte_offset for r in bad.collect()}
    assert got == {i: naive(b) for i, b in rows if naive(b) is not None}
    assert {r.page_id: r.text for r in good.collect()} == {i: b.decode() for i, b in rows if naive(b) is None}


def test_missing_content_and_taken_names(spark):
    good, bad = raw.decode_pages(spark.createDataFrame([(1, None)], "page_id int, content binary"))
    assert good.count() == 0
    assert bad.select("byte_offset", "reason").collect() == [(None, raw.MISSING)]
    with pytest.raises(ValueError):
        raw.decode_pages(spark.createDataFrame([(b"a", "x")], "content binary, text string"))


def test_a_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_bytes(b"fine")
    (tmp_path / "in" / "two.txt").write_bytes(b"not \xff fine")
    good, bad = raw.decode_pages(raw.read_raw_page_stream(spark, str(tmp_path / "in")))
    for name, part in (("good", good), ("bad", bad)):
        part.writeStream.option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["fine"]
    assert [r.byte_offset for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [4]


# --- published views ------------------------------------------------------------------------------

def view(spark, n, name):
    return spark.range(n).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit(name), "id")).alias("name"), (F.col("id") / 4).alias("v"))


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_a_write_that_dies_leaves_the_old_view(spark, tmp_path, monkeypatch, format):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        PV.read_view(spark, path)
    first = PV.publish_view(view(spark, 1000, "old"), path, "id", format)
    assert (first.number, first.rows) == (1, 1000)
    old = sorted(view(spark, 1000, "old").collect())
    # Some tasks fail after others have written their files
    dying = view(spark, 5000, "new").withColumn("v", F.when(F.col("id") == 4999, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        PV.publish_view(dying, path, "id", format)
    assert sorted(PV.read_view(spark, path, verify=True).collect()) == old
    # Files are complete, the driver dies before manifest and pointer
    monkeypatch.setattr(PV, "_per_file", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        PV.publish_view(view(spark, 10, "new"), path, "id", format)
    monkeypatch.undo()
    reader = PV.read_view(spark, path)
    assert sorted(reader.collect()) == old
    second = PV.publish_view(view(spark, 20, "new"), path, ["id", "name"], format)
    assert second.number == 2
    assert sorted(PV.read_view(spark, path, verify=True).collect()) == sorted(view(spark, 20, "new").collect())
    assert sorted(reader.collect()) == old  # a reader keeps the version it has begun with
    assert PV.drop_superseded(spark, path, keep=1) == [first.version]
    assert [e.version for e in PV.published(spark, path)] == [second.version]


def test_manifest_finds_lost_and_changed_files(spark, tmp_path):
    path = str(tmp_path / "v")
    entry = PV.publish_view(view(spark, 4000, "n"), path, "id", files=4)
    stored = spark.read.parquet(f"{path}/{PV.MANIFESTS}/{entry.version}").orderBy("rows", "file").collect()
    assert sum(r.rows for r in stored) == 4000 and len(stored) == entry.files > 1
    bounds = sorted((int(r.first), int(r.last)) for r in stored)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert PV.damaged_files(spark, path, entry).count() == 0
    PV._stored(spark, path, entry).limit(3).coalesce(1).write.mode("append").parquet(f"{path}/{PV.VERSIONS}/{entry.version}")
    assert PV.damaged_files(spark, path, entry).count() == 1
    with pytest.raises(ValueError, match="manifest"):
        PV.read_view(spark, path, verify=True)


def test_an_empty_view(spark, tmp_path):
    entry = PV.publish_view(view(spark, 0, "x"), str(tmp_path / "v"), "id")
    assert (entry.rows, entry.number) == (0, 1)
    assert PV.read_view(spark, str(tmp_path / "v"), verify=True).count() == 0
    with pytest.raises(ValueError):
        PV.drop_superseded(spark, str(tmp_path / "v"), keep=0)


# --- remembered pages ---------------------------------------------------------------------------

def test_only_unseen_texts_are_parsed(spark, tmp_path):
    store = str(tmp_path / "store")
    texts = [P.page(P.FIELD_A, "weight"), P.page(P.FIELD_B, "money"), "no table here", None, ""]
    schema = "page_id string, captured_at timestamp, text string"

    def log(n):
        return spark.createDataFrame([(f"p{i}-{k}", NOON, t) for i, t in enumerate(texts[:n]) for k in range(3)] + [(None, None, texts[0])], schema)

    def forms(df):
        return sorted(df.select(F.to_json(F.struct(*sorted(df.columns))).alias("row")).collect())

    with pytest.raises(FileNotFoundError):
        remembered_forms(log(1), store)
    assert remember(log(3), store) == 3
    assert remember(log(3), store) == 0
    assert remember(log(5), store, sent_keys=0) == 2
    got = remembered_forms(log(5), store)
    assert got.schema.names == runner_forms(log(5)).schema.names
    assert forms(got) == forms(runner_forms(log(5)))


# --- repeated captures ----------------------------------------------------------------------------

CAPTURES = "page_id string, captured_at timestamp, text string"
EARLIER = NOON - datetime.timedelta(hours=1)


@pytest.mark.parametrize("sent_pages", [1000, 0])
def test_only_newest_captures_are_kept(spark, sent_pages):
    page, other = P.page(P.FIELD_A, "weight"), P.page(P.FIELD_B, "money")
    kept = [("1", NOON, page), ("2", NOON, page), ("2", NOON, other), ("3", None, other), (None, NOON, other), ("4", NOON, None), ("5", NOON, "")]
    more = [
        ("1", EARLIER, other), ("1", None, other), ("1", NOON, page), ("2", EARLIER, page), ("3", None, other), (None, EARLIER, page),
        (None, None, page), ("4", EARLIER, page), ("4", NOON, None), ("5", EARLIER, page),
    ]
    log = spark.createDataFrame(kept + more, CAPTURES)
    newest = newest_captures(log.withColumn("spare", F.lit(1)), sent_pages)
    assert newest.columns == log.columns
    assert sorted(newest.collect(), key=str) == sorted(spark.createDataFrame(kept, CAPTURES).collect(), key=str)

    def predicted(df):
        got = predict_forms(runner_forms(df)).collect()
        return sorted((str(r.race_id), r.tab, r.horse, round(r.p_win, 9)) for r in got)

    if sent_pages:
        assert predicted(newest) == predicted(log)
    assert newest_captures(log.limit(0), sent_pages).count() == 0


def test_repeated_predictions_parse_a_page_once(spark, monkeypatch):
    texts = [P.page(P.FIELD_A, "weight"), P.page(P.FIELD_B, "money")]
    log = spark.createDataFrame([(str(i), NOON, t) for i, t in enumerate(texts)], CAPTURES)
    parsed = []

    def parse(df):
        parsed.extend(df.collect())
        return runner_forms(df)

    monkeypatch.setattr(Q, "pages", lambda *_: log)
    monkeypatch.setattr(Q.E, "runner_forms", parse)
    got = Q.pages_to_predictions_repeated(spark, None)
    assert sorted(parsed) == sorted(log.collect())
    active = [(i, r["tab"]) for i, field in enumerate((P.FIELD_A, P.FIELD_B)) for r in field if not r["scratched"]]
    assert sorted((r.race_id, r.tab) for r in got.collect()) == sorted(active)
