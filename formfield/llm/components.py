"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, root)``: each linked node and the smallest node it can reach.

    Every round re-links a node's larger neighbours to its smallest one and then its smaller ones likewise; a path
    halves per round, so rounds grow with the logarithm of its length. Each round is joins and combined aggregates
    over the links alone, kept in the checkpoint folder. Nodes without links are not listed; loops and repeated or
    null links are ignored; an empty table gives an empty result.
    """
    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()

    links = checkpointed(tidy(links.where("u is not null and v is not null")))
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select("v", "v").distinct()
            )
        seen = state
        both = links.union(links.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(_nearest(large), "u")
        links = checkpointed(tidy(small.select("v", "m").toDF("u", "v").union(small.select("u", "m").toDF("u", "v"))))
