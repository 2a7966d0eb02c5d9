"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the mix. Null and blank texts pass the stages as their operators define;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield.llm import decontaminate, line_spread, mixing, quality, simhash
from formfield.llm.common import checkpoint_folder, fresh, quoted

#: Documents whose quality score is lower go.
LOWEST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line labels make good."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(model) >= LOWEST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sites carry, and passages that several do, out of the texts; ``n_chars`` follows the text.

    A passage stays in one text. A null text, and one with nothing to lose, is as before.
    """
    counts = {n: fresh(docs, n) for n in ("n_lines", "n_removed")}  # columns of these names are the user's
    cleaned = line_spread.remove_boilerplate(docs, **counts).select(*(quoted(c) for c in docs.columns))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the smallest id, rows without an id last.

    Texts whose five-word shingles have a Jaccard likeness of 0.8 or more belong together. Rows of one id, or of none, are told apart by a hash of all their columns, which also settles ties; of rows that
    are equal in every column one is kept.
    """
    key = fresh(docs, "row_key")
    own = F.struct(*(quoted(c) for c in docs.columns))
    nulls = [quoted(c).isNull() for c in docs.columns]  # a hash passes over nulls
    at = F.struct(
        F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64(own, *nulls).alias("a"),
        F.xxhash64(F.lit(1), own, *nulls).alias("b"),
    )
    keyed = docs.withColumn(key, at)
    classes = simhash.similar_classes(keyed, key)
    kept = classes.where(F.col("first") == F.col("component")).select("first.a", "first.b").distinct()
    marked = docs.withColumns({key + "_a": at["a"], key + "_b": at["b"]})
    found = marked.join(kept, (marked[key + "_a"] == kept["a"]) & (marked[key + "_b"] == kept["b"]), "left_semi")
    return found.dropDuplicates([key + "_a", key + "_b"]).select(*(quoted(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    into = fresh(docs, "found")
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into)
    return found.where(~decontaminate.contaminated(F.col(into))).drop(into)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document that is left enters the mix."""
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: The chain's marginals can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Between stages the rows are written to the shared checkpoint folder and reread."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
