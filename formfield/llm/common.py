"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, or the one that the session was given by call.

    Only a local session without either gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, with its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def utf8(text: str) -> Column:
    """The bytes of a text column; null stays null."""
    return quoted(text).cast("string").cast("binary")


def rows(batches: Iterator[pa.RecordBatch], at_once: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task's Python objects stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            yield batch.slice(start, at_once)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on the fold that is kept for testing. A null id does not."""
    return F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def partitions(df: DataFrame) -> int:
    """How many partitions a key exchange of this session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
