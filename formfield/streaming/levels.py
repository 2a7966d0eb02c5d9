"""Incremental compaction of a capture log: batches become sorted runs, small runs merge into larger ones.

A capture log holds one partition per micro-batch (level 0). ``merge`` turns every ``fanout`` runs of a level into one
run of the next, sorted by page id and holding the newest capture per page, so a capture is rewritten once per level and
not once per compaction. Nothing is deleted or changed in place: an entry per merged run says which runs it replaces, and
it is written after the run. A merge that dies before leaves only files that no entry names; one that is repeated makes
another run of the same rows. Streams go on writing their batches meanwhile.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield.sources.files import exists
from formfield.sources.pages import PAGE_COLUMNS, latest_capture

#: Entries of merged runs; a leading underscore hides them from readers of the log.
ENTRIES = "_levels"
#: Runs of one level that are merged into one of the next.
FANOUT = 8
STORED = "page_id string, captured_at timestamp, text string, from_batch long, from_run string, run string, batch_id long"
ENTRY = "run string, level int, first_page string, last_page string, pages long, replaces array<string>"


@dataclass(frozen=True)
class Run:
    """A partition of the log: ``run=…/batch_id=…``, its level and, where merged, its smallest and largest page id."""

    path: str
    level: int = 0
    first: str | None = None
    last: str | None = None
    pages: int | None = None

    def may_hold(self, pages: list[str]) -> bool:
        return self.level == 0 or any(self.first <= p <= self.last for p in pages)


def _batches(spark: SparkSession, log: str) -> set[str]:
    """The partitions of the log that hold files, as ``run=…/batch_id=…``."""
    files = spark.read.schema(STORED).parquet(log).inputFiles()
    return {"/".join(f.split("/")[-3:-1]) for f in files}


def live_runs(spark: SparkSession, log: str) -> list[Run]:
    """The runs that together hold the current state: what no merged run replaces. One row per merged run is read."""
    entries = []
    if exists(spark, f"{log}/{ENTRIES}"):
        entries = spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(f"{log}/{ENTRIES}").collect()
    merged = {f"run={e.run}/batch_id=-1": Run(f"run={e.run}/batch_id=-1", e.level, e.first_page, e.last_page, e.pages) for e in entries}
    replaced = {path for e in entries for path in e.replaces}
    # A merged run without an entry is what a merge that died has left
    plain = {p for p in _batches(spark, log) if not p.startswith("run=level-")}
    return [r for r in [*(Run(p) for p in sorted(plain)), *merged.values()] if r.path not in replaced]


def _captures(spark: SparkSession, log: str, runs: list[Run]) -> DataFrame:
    """The captures of some runs with the batch and stream that first wrote them."""
    stored = spark.read.schema(STORED).option("basePath", log).parquet(*(f"{log}/{r.path}" for r in runs))
    return stored.select(
        *PAGE_COLUMNS, F.coalesce("from_batch", "batch_id").alias("from_batch"), F.coalesce("from_run", "run").alias("from_run")
    )


def _newest(captures: DataFrame) -> DataFrame:
    """As :func:`formfield.streaming.captures.current_pages` chooses: a later batch wins an equal time."""
    return latest_capture(captures, "page_id", "captured_at", F.col("from_batch").desc(), F.xxhash64("text"), F.col("from_run"))


def merge(spark: SparkSession, log: str, fanout: int = FANOUT) -> list[Run]:
    """Merge while some level has ``fanout`` runs; returns the runs that were made.

    Each merge reads only the runs of its level. Its files cover ranges of page ids and are sorted within, so a reader of
    some pages passes over files and row groups by their bounds. One merge runs at a time on a log.
    """
    if fanout < 2:
        raise ValueError("fanout must be two or more")
    made, live = [], live_runs(spark, log)
    while True:
        levels: dict[int, list[Run]] = {}
        for run in live:
            levels.setdefault(run.level, []).append(run)
        due = next((n for n in sorted(levels) if len(levels[n]) >= fanout), None)
        if due is None:
            return made
        old, name = levels[due], f"level-{due + 1}-{uuid.uuid4().hex}"
        path = f"{log}/run={name}/batch_id=-1"
        newest = _newest(_captures(spark, log, old))
        newest.repartitionByRange("page_id").sortWithinPartitions("page_id").write.parquet(path)
        bounds = spark.read.parquet(path).agg(F.min("page_id"), F.max("page_id"), F.count("*")).first()
        entry = (name, due + 1, bounds[0], bounds[1], bounds[2], [r.path for r in old])
        spark.createDataFrame([entry], ENTRY).coalesce(1).write.parquet(f"{log}/{ENTRIES}/{name}")
        made.append(Run(f"run={name}/batch_id=-1", *entry[1:5]))
        live = [r for r in live if r not in old] + made[-1:]


def levelled_pages(spark: SparkSession, log: str, pages: list[str] | None = None) -> DataFrame:
    """Newest capture of every page, or of some pages, read from the live runs alone.

    With ``pages`` (a short list), runs whose bounds exclude all of them are not opened, and the filter reaches the
    scans of the others.
    """
    runs = live_runs(spark, log)
    if pages is not None:
        runs = [r for r in runs if r.may_hold(pages)]
    if not runs:
        return spark.createDataFrame([], "page_id string, captured_at timestamp, text string")
    captures = _captures(spark, log, runs)
    if pages is not None:
        captures = captures.filter(F.col("page_id").isin(pages))
    return _newest(captures).select(*PAGE_COLUMNS)
