"""Merging a capture log by levels: the same state, few rows read, runs that are skipped."""

import datetime

import pytest
from pyspark.sql import functions as F

from formfield.streaming import levels
from formfield.streaming.captures import current_pages

PAGES, CHANGED = 400, 10


def write(spark, log, batch, pages, run="a"):
    time = datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=batch)
    rows = [(f"p{p:05d}", time, f"text {p} of {batch} by {run}") for p in pages]
    spark.createDataFrame(rows, "page_id string, captured_at timestamp, text string").coalesce(1).write.parquet(f"{log}/run={run}/batch_id={batch}")


def state(df):
    return {r.page_id: r.text for r in df.collect()}


def test_fifty_batches(spark, tmp_path):
    log, want, written = str(tmp_path / "log"), {}, 0
    write(spark, log, 0, range(PAGES))
    want.update({f"p{p:05d}": f"text {p} of 0 by a" for p in range(PAGES)})
    for batch in range(1, 51):
        changed = [(batch * 7 + k * 3) % PAGES for k in range(CHANGED)]
        write(spark, log, batch, sorted(set(changed)))
        want.update({f"p{p:05d}": f"text {p} of {batch} by a" for p in changed})
        written += sum(r.pages for r in levels.merge(spark, log, 4)) if batch % 4 == 3 else 0
    assert state(levels.levelled_pages(spark, log)) == want == state(current_pages(spark, log))
    runs = levels.live_runs(spark, log)
    stored = spark.read.parquet(log).count()
    held = sum(r.pages if r.level else CHANGED for r in runs)
    assert len(runs) <= 3 * 4 and held < 2 * PAGES and held < stored / 2
    # What merging wrote grows with the changes (once per level), not with the pages of every merge
    assert written < 4 * (PAGES + 50 * CHANGED) and written < PAGES * 12
    top = max(runs, key=lambda r: r.pages or 0)
    assert top.level == 2 and top.first == "p00000"
    some = ["p00003", "p00399", "none"]
    assert state(levels.levelled_pages(spark, log, some)) == {p: want[p] for p in some[:2]}
    plan = levels.levelled_pages(spark, log, some)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(page_id" in plan


def test_runs_outside_their_bounds_are_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    for batch in range(4):
        write(spark, log, batch, range(100))
    levels.merge(spark, log, 4)
    for batch in range(4, 8):
        write(spark, log, batch, range(200, 300))
    levels.merge(spark, log, 4)
    assert {(r.level, r.first, r.last, r.pages) for r in levels.live_runs(spark, log)} == {(1, "p00000", "p00099", 100), (1, "p00200", "p00299", 100)}
    files = levels.levelled_pages(spark, log, ["p00250"]).inputFiles()
    assert files and all(levels.live_runs(spark, log)[n].path in f for f in files for n, r in enumerate(levels.live_runs(spark, log)) if r.first == "p00200")
    assert levels.levelled_pages(spark, log, ["p00150"]).count() == 0


def test_ties_keep_their_batch_through_merges(spark, tmp_path):
    """A later batch wins an equal time, whatever has been merged when; two streams and a batch of merged age."""
    log, plain = str(tmp_path / "log"), str(tmp_path / "plain")
    time = datetime.datetime(2026, 1, 1)
    for n, (run, batch, text) in enumerate([("a", 0, "a0"), ("a", 5, "a5"), ("b", 3, "b3"), ("b", 4, "b4"), ("a", 1, "a1"), ("b", 2, "b2")]):
        for folder in (log, plain):
            rows = [("one", time, text), (text, time, text), ("two", None if n % 2 else time, text)]
            spark.createDataFrame(rows, "page_id string, captured_at timestamp, text string").write.parquet(f"{folder}/run={run}/batch_id={batch}")
        levels.merge(spark, log, 2)
        assert state(levels.levelled_pages(spark, log)) == state(current_pages(spark, plain))
    assert state(levels.levelled_pages(spark, log))["one"] == "a5"


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    for batch in range(4):
        write(spark, log, batch, range(20))
    before = state(levels.levelled_pages(spark, log))
    create = spark.createDataFrame

    def fails(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(spark), "createDataFrame", fails)
    with pytest.raises(RuntimeError):
        levels.merge(spark, log, 4)
    monkeypatch.undo()
    assert create is not None and [r.level for r in levels.live_runs(spark, log)] == [0] * 4
    assert state(levels.levelled_pages(spark, log)) == before
    levels.merge(spark, log, 4)
    assert [r.level for r in levels.live_runs(spark, log)] == [1]
    assert state(levels.levelled_pages(spark, log)) == before
    assert spark.read.parquet(log).filter(F.col("run").startswith("level-")).count() == 40
    with pytest.raises(ValueError):
        levels.merge(spark, log, 1)
