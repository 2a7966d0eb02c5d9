"""Forms of pages that are parsed once: a store of what each text has yielded, by the 128-bit hash of the text.

Captures of a page repeat, and parsing is what costs. The store holds the runner forms of every text seen, without page id and
capture time. The key is of the text as it is, not cleaned, as one of the layouts reads the marks that cleaning removes.
A run looks for unseen keys by the keys alone; only their texts are moved and parsed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield.groups import durable
from formfield.plans.extract import runner_forms
from formfield.sources.files import exists

#: Part of the store's path; raise it with any change to what pages yield, and all texts are parsed anew.
PARSER = 1
#: Unseen keys that are sent to every task (32 bytes each); more of them are joined by an exchange.
SENT_KEYS = 1_000_000


def text_key(text: str = "text") -> Column:
    """Hash of a text; a missing one has a key of its own."""
    return F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("none"))


def _place(store: str) -> str:
    return f"{store.rstrip('/')}/parser={PARSER}"


def _remembered(spark: SparkSession, store: str) -> DataFrame | None:
    place = _place(store)
    if not exists(spark, place):
        return None
    return spark.read.option("recursiveFileLookup", True).parquet(place)


def remember(pages: DataFrame, store: str, sent_keys: int = SENT_KEYS) -> int:
    """Parse the texts of ``pages`` that the store has not seen and add them; returns how many there were.

    Each text is parsed once, however many pages hold it. All rows of a text are in one file, so a run that dies leaves
    whole texts or none, and what is left counts as seen. One run at a time adds to a store.
    """
    spark = pages.sparkSession
    keyed = pages.select(text_key().alias("__key"), "text")
    unseen = keyed.select("__key").distinct()
    known = _remembered(spark, store)
    if known is not None:
        unseen = unseen.join(known.select(F.col("text_key").alias("__key")).distinct(), "__key", "left_anti")
    unseen = durable(unseen)
    n = unseen.count()
    if n == 0:
        return 0
    wanted = F.broadcast(unseen) if n <= sent_keys else unseen
    texts = keyed.join(wanted, "__key", "left_semi").groupBy("__key").agg(F.any_value("text").alias("text"))
    fresh = texts.select(F.col("__key").alias("page_id"), F.lit(None).cast("timestamp").alias("captured_at"), "text")
    parsed = runner_forms(fresh).withColumnRenamed("race_id", "text_key").drop("captured_at")
    parsed.write.parquet(f"{_place(store)}/{uuid.uuid4().hex}")
    return n


def remembered_forms(pages: DataFrame, store: str) -> DataFrame:
    """:func:`formfield.plans.extract.runner_forms` of pages whose texts are all in the store: a join of keys, no parsing."""
    known = _remembered(pages.sparkSession, store)
    if known is None:
        raise FileNotFoundError(f"no remembered pages at {store}")
    mine = pages.select(F.col("page_id").alias("race_id"), "captured_at", text_key().alias("text_key"))
    joined = mine.join(known, "text_key")
    return joined.select("race_id", "captured_at", *[c for c in known.columns if c != "text_key"])
