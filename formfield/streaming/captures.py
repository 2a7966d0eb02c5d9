"""Continuous ingest of captured pages; a new capture of a page replaces the old one.

Each micro-batch is written to its own partition of a capture log, named by the stream's checkpoint and the batch, so a
replayed batch overwrites itself, a stream with another checkpoint never overwrites it, and no batch rewrites the
table. The current state is a read of the log.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield.sources.pages import PAGE_COLUMNS, gate_pages, latest_capture


def ingest(pages: DataFrame, log: str, checkpoint: str, rejected: str | None = None, min_chars: int | None = None, key: str = "page_id", trigger: dict | None = None):
    """Append the newest capture per page of each batch to ``log`` (and short pages to
    ``rejected``). Returns the running query."""
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def save(batch: DataFrame, batch_id: int) -> None:
        kwargs = {} if min_chars is None else {"min_chars": min_chars}
        batch = batch.persist()
        kept, short = gate_pages(batch, **kwargs)
        target = f"run={run}/batch_id={batch_id}"
        latest_capture(kept, key, "captured_at", F.xxhash64("text")).write.mode("overwrite").parquet(f"{log}/{target}")
        if rejected is not None:
            short.write.mode("overwrite").parquet(f"{rejected}/{target}")
        batch.unpersist()

    return (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_pages(spark: SparkSession, log: str, key: str = "page_id") -> DataFrame:
    """Newest capture of every page in the log; a later batch wins an equal time."""
    return latest_capture(
        spark.read.parquet(log), key, "captured_at", F.col("batch_id").desc(), F.xxhash64("text"), F.col("run")
    ).select(*PAGE_COLUMNS)


def compact(spark: SparkSession, log: str, target: str, key: str = "page_id") -> None:
    """Write the current state as a new log. Its partition is one that no stream writes, and its rows give way to any
    batch of the same time."""
    current_pages(spark, log, key).write.mode("overwrite").parquet(f"{target}/run=compacted/batch_id=-1")
