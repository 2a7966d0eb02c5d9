"""Live predictions: waves of captures, late and repeated ones, and a restart between them."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from formfield.plans.extract import runner_forms
from formfield.plans.predict import predict_forms
from formfield.streaming import live
from formfield.streaming.live import changed_pages, current_predictions, predict_stream
from tests import page_writer as P

SCHEMA = "page_id string, captured_at timestamp, text string"
NOON = datetime.datetime(2026, 8, 25, 12)


def at(minutes):
    return NOON + datetime.timedelta(minutes=minutes)


def other_prices(text):
    return text.replace("betfair$", "betfair$1")


def test_waves_of_captures(spark, tmp_path):
    page, second = P.page(P.FIELD_A, "weight"), P.page(P.FIELD_B, "money")
    folder, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    seen = []

    def push(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        query = predict_stream(spark.readStream.schema(SCHEMA).parquet(folder), log, check, delay="2 hours")
        query.awaitTermination()
        seen.extend(rows)
        stored = spark.read.parquet(log)
        last = {r.race_id for r in stored.filter(F.col("batch_id") == stored.agg(F.max("batch_id")).first()[0]).select("race_id").distinct().collect()}
        return last, stored.select("race_id", "captured_at").distinct().count()

    def prices():
        return {(r.race_id, r.tab): round(r.p_bf, 9) for r in current_predictions(spark, log).collect()}

    def expected(rows):
        got = predict_forms(runner_forms(spark.createDataFrame(rows, SCHEMA))).collect()
        return {(r.race_id, r.tab): round(r.p_bf, 9) for r in got}

    push([("one", at(0), other_prices(page)), ("two", at(0), second), (None, at(0), page), ("three", None, page)])
    assert prices() == expected([("one", at(0), other_prices(page)), ("two", at(0), second)])
    # Only the first race has changed; the second is captured again, and once more from before
    changed, _ = push([("one", at(30), page), ("one", at(10), "x" * 400), ("two", at(0), second), ("two", at(-5), page)])
    assert changed == {"one"}
    assert prices() == expected([("one", at(30), page), ("two", at(0), second)])
    # A capture within the delay that comes late, and one of a page not seen before, within it and beyond it
    changed, _ = push([("one", at(20), other_prices(page)), ("four", at(15), second), ("five", at(-300), second)])
    assert changed == {"four"}
    assert prices() == expected([("one", at(30), page), ("two", at(0), second), ("four", at(15), second)])
    # A page that has no table any more, one too short; both take their predictions back
    changed, captures = push([("two", at(60), "no table " * 80), ("four", at(61), "short"), ("one", at(62), page)])
    assert changed == {"one", "two", "four"} and captures == 7
    assert prices() == expected([("one", at(62), page)])


def test_state_goes_with_the_watermark(spark, tmp_path):
    """Entries of pages that the watermark has passed are dropped, those of recent ones stay."""
    folder, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    for minutes, names in ((0, "abcdefgh"), (600, "x"), (601, "y"), (1300, "z")):
        rows = [(n, at(minutes), f"page {n} " * 60) for n in names]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = changed_pages(spark.readStream.schema(SCHEMA).parquet(folder), "1 hour")
        save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{log}/batch_id={n}")
        query = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < 4
    assert sorted(r.page_id for r in spark.read.parquet(log).collect()) == sorted("abcdefghxyz")


def test_texts_go_to_the_state_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """A page captured 200 times in a batch reaches the state function in small parts, as does every page of a task."""
    folder, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    spark.createDataFrame([("one", at(n), f"capture {n} " * 40) for n in range(200)], SCHEMA).coalesce(1).write.parquet(folder)

    def largest(key, parts, state):
        sizes = [len(part) for part in parts]
        yield pd.DataFrame({"page_id": [key[0]], "at": [sum(sizes)], "digest": [max(sizes)], "text": ["x"]})

    monkeypatch.setattr(live, "_newest", largest)
    before = {k: spark.conf.get(k, None) for k in live.STREAM_CONF}
    predict_stream(spark.readStream.schema(SCHEMA).parquet(folder), log, check).awaitTermination()
    [row] = spark.read.parquet(log).select(F.unix_micros("captured_at").alias("rows"), "digest").collect()
    assert row.rows == 200 and row.digest <= 16
    assert {k: spark.conf.get(k, None) for k in live.STREAM_CONF} == before
