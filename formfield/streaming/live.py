"""Live predictions: pages stream in, the races whose page has changed are scored again.

The newest capture of every page is keyed state of the stream (its time and a digest, not its text). A capture that is
older than the state's, or the same, goes no further; a newer one replaces the state and is scored. The watermark bounds
the state: a page's entry goes once captures that old would be dropped as late anyway.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formfield import constants as K
from formfield.functions.text import clean_text
from formfield.plans.extract import runner_forms
from formfield.plans.predict import PREDICTION_COLUMNS, predict_forms
from formfield.sources.pages import gate_pages

CHANGED = "page_id string, at long, digest long, text string"
#: How the state function gets and returns texts: whole pages, so a few at a time. Spark's own 10,000 records are a task's
#: whole share, which a worker then holds as Arrow and as Python objects, on both ways. What a run's tasks keep of the state
#: is let go once it is stored, as later tasks and runs read it from the checkpoint.
STREAM_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "16",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _newest(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    best, text = None, None
    for part in parts:
        marks = list(zip(part["at"].tolist(), part["digest"].tolist()))
        own = max(marks)
        if best is None or own > best:
            best, text = own, part["text"].iloc[marks.index(own)]
    own = best
    if not state.exists or own > state.get:
        state.update(own)
        yield pd.DataFrame({"page_id": [key[0]], "at": [own[0]], "digest": [own[1]], "text": [text]})
    state.setTimeoutTimestamp(max(state.get[0] // 1000, state.getCurrentWatermarkMs()) + 1)


@contextlib.contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """``STREAM_CONF`` for the queries that start within; a query keeps the settings of its start, the session its own."""
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    try:
        for k, v in STREAM_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def changed_pages(pages: DataFrame, delay: str) -> DataFrame:
    """A stream of ``(page_id, captured_at, digest, text)``: each capture that becomes the newest of its page.

    ``pages`` is a stream with the page columns. Captures more than ``delay`` behind the newest time seen are dropped as
    late. Of captures of one time the one of larger digest counts, as it does for stored forms. Rows without a page id,
    time or text take no part.
    """
    known = pages.dropna(subset=["page_id", "captured_at", "text"]).select(
        F.col("page_id").cast("string").alias("page_id"), "captured_at", F.unix_micros("captured_at").alias("at"),
        F.xxhash64(clean_text("text")).alias("digest"), "text",
    )
    newest = known.withWatermark("captured_at", delay).groupBy("page_id").applyInPandasWithState(
        _newest, CHANGED, "at long, digest long", "update", GroupStateTimeout.EventTimeTimeout
    )
    return newest.select("page_id", F.timestamp_micros("at").alias("captured_at"), "digest", "text")


def predict_stream(
    pages: DataFrame, log: str, checkpoint: str, delay: str = "7 days", alpha: float = K.MARKET_ALPHA,
    min_chars: int = K.MIN_PAGE_CHARS, trigger: dict | None = None,
):
    """Score the races whose page has changed and append them to ``log``. Returns the running query.

    Each batch is a partition of the log, named by the checkpoint and the batch, so a replayed batch overwrites itself. A
    page that lists no race to predict any more leaves a row without a tab, which takes its old predictions back; so does
    one that has become too short.
    """
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def score(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        if batch.isEmpty():  # as it is whenever it is replayed
            return
        marks = batch.select(F.col("page_id").alias("race_id"), "captured_at", "digest")
        long_enough, _ = gate_pages(batch.select("page_id", "captured_at", "text"), min_chars=min_chars)
        scored = predict_forms(runner_forms(long_enough), alpha).select(*PREDICTION_COLUMNS)
        marks.join(scored, "race_id", "left").write.mode("overwrite").parquet(f"{log}/run={run}/batch_id={batch_id}")
        batch.unpersist()

    writer = (
        changed_pages(pages, delay).writeStream.foreachBatch(score).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    )
    with stream_settings(pages.sparkSession):
        return writer.start()


def current_predictions(spark: SparkSession, log: str) -> DataFrame:
    """The predictions of every page's newest capture. Which one that is comes from an aggregate joined back, so a page
    captured very often does not gather in one task."""
    stored = spark.read.parquet(log)
    mark = F.struct("captured_at", "digest", "batch_id", "run")
    newest = stored.groupBy(F.col("race_id").alias("__race")).agg(F.max(mark).alias("__newest"))
    own = stored.join(newest, (F.col("race_id") == F.col("__race")) & (mark == F.col("__newest")), "left_semi")
    return own.filter("tab is not null").select(*PREDICTION_COLUMNS, "captured_at")
