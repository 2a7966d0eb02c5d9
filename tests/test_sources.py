import datetime

from pyspark.sql import functions as F

from formfield.functions import text as X
from formfield.sources.pages import gate_pages, latest_capture, read_page_stream, read_pages, write_view
from formfield.streaming.captures import compact, current_pages, ingest


def test_text_files_are_whole_pages(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\nsecond\n", encoding="utf-8")
    (tmp_path / "two.txt").write_text("x" * 400, encoding="utf-8")
    pages = read_pages(spark, str(tmp_path))
    assert pages.columns == ["page_id", "captured_at", "text"]
    kept, rejected = gate_pages(pages)
    assert [len(r.text) for r in kept.collect()] == [400]
    assert [r.text for r in rejected.collect()] == ["first\nsecond\n"]


def test_newest_capture_wins(spark):
    t = datetime.datetime
    df = spark.createDataFrame([("a", t(2026, 1, 1), "old"), ("a", t(2026, 1, 2), "new"), ("b", t(2026, 1, 1), "only")], "page_id string, captured_at timestamp, text string")
    assert {r.page_id: r.text for r in latest_capture(df).collect()} == {"a": "new", "b": "only"}


def test_stream_replaces_pages_and_survives_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log, check, out = (str(tmp_path / n) for n in ("log", "check", "rejected"))

    def push(name, text):
        (source / name).write_text(text)
        stream = read_page_stream(spark, str(source)).withColumn("page_id", F.regexp_extract("page_id", r"/([a-z]+)[0-9]*\.txt$", 1))
        ingest(stream, log, check, out).awaitTermination()

    push("race1.txt", "A" * 400)
    push("race2.txt", "B" * 500)
    push("short1.txt", "tiny")
    assert {r.page_id: len(r.text) for r in current_pages(spark, log).collect()} == {"race": 500}
    assert spark.read.parquet(out).count() == 1
    compact(spark, log, str(tmp_path / "compacted"))
    assert current_pages(spark, str(tmp_path / "compacted")).count() == 1


def test_csv_has_a_header_and_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    write_view(df.coalesce(1), str(tmp_path / "v"))
    text = next((tmp_path / "v").glob("*.csv")).read_text()
    assert text.splitlines() == ["a,b", "1,", "2,b"]


def test_clean_text(spark):
    raw = "# **Title**  \r\n  - item\t\n> [label](http://x/(y)\\- a\\:b __u__\n * [x](z)　\n"
    got = spark.createDataFrame([(raw,)], "t string").select(X.clean_text("t")).first()[0]
    assert got.split("\n")[0] == "Title" and got.split("\n")[1] == "item"
    assert "http" not in got and "__" not in got and got == "\n".join(x.strip() for x in got.split("\n"))


def test_glued_strip_splits_by_the_next_label(spark):
    strip = "Car 2%-21%-4212m 17%-17%-6Crs 3-2-9Dist 2-2-11Crs & Dist 2-1-4FU 1-0-12U 1-0-13U 0-0-1"
    values = spark.createDataFrame([(strip,)], "t string").select(X.split_glued_pairs("t")).first()[0]
    assert values[:4] == ["2%-21%-42", "17%-17%-6", "3-2-9", "2-2-11"]
    assert values[4:8] == ["2-1-4", "1-0-1", "1-0-1", "0-0-1"]


def test_numbers_and_times(spark):
    row = spark.createDataFrame([("$1,234.5 sec", "12.9", "0:23.31", "x", "1:00", "nan")], "a string, b string, c string, d string, e string, f string")
    got = row.select(X.to_number("a"), X.to_int("b"), X.to_seconds("c"), X.to_number("d", 7.0), X.to_seconds("e"), X.to_int("f", 3)).first()
    assert tuple(got) == (1234.5, 12, 23.31, 7.0, 60.0, 3)


def test_a_new_stream_on_a_compacted_log_keeps_its_pages(spark, tmp_path):
    t = datetime.datetime
    schema = "page_id string, captured_at timestamp, text string"

    def push(folder, check, log, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        ingest(spark.readStream.schema(schema).parquet(str(folder)), log, str(check), min_chars=0).awaitTermination()

    log, small = str(tmp_path / "log"), str(tmp_path / "small")
    push(tmp_path / "in1", tmp_path / "c1", log, [("a", t(2026, 1, 1), "a1"), ("b", t(2026, 1, 1), "b1")])
    push(tmp_path / "in1", tmp_path / "c1", log, [("b", t(2026, 1, 2), "b2")])
    compact(spark, log, small)
    push(tmp_path / "in2", tmp_path / "c2", small, [("c", t(2026, 1, 3), "c1"), ("b", t(2026, 1, 2), "b2 again")])
    push(tmp_path / "in2", tmp_path / "c2", small, [("a", t(2026, 1, 4), "a2")])
    assert {r.page_id: r.text for r in current_pages(spark, small).collect()} == {"a": "a2", "b": "b2 again", "c": "c1"}
