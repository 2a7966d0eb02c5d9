"""The test tables seen as races, runners, past runs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.groups import Groups, Sizes, group_operator, group_sizes
from formfield.operators.history import take_recent

FIELD = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- line items of an order as a field ---------------------------------------------------

def contest_raw(spark, sf_dir) -> DataFrame:
    """Order lines as listed: the tab number can repeat and skip. ``line_no`` is unique."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_linenumber").alias("tab"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        (F.col("l_returnflag") == "R").alias("scratched"),
        (1 + F.col("l_extendedprice") / 10000).alias("tab_odds"),
        (1 + F.col("l_quantity")).alias("bf_odds"),
        F.col("l_extendedprice").alias("price"),
    )


LISTING = ("tab", "part", "supp", "price")


@group_operator
def numbered(df: DataFrame, g: Groups) -> DataFrame:
    """Replace the listed tab by the position in listing order."""
    order = [F.col(c).asc() for c in LISTING]
    return g.rank(df, "__tab", *order).withColumn("tab", F.col("__tab")).drop("__tab")


def contest_sizes(spark, sf_dir) -> Sizes:
    """Which orders are too long for one task, from the stored keys; for all steps of a query."""
    return group_sizes(contest_raw(spark, sf_dir), ["race_id"])


def contest(spark, sf_dir, sizes: Sizes | None = None) -> DataFrame:
    return numbered(contest_raw(spark, sf_dir), sizes or ["race_id"])


def active_contest(spark, sf_dir, sizes: Sizes | None = None) -> DataFrame:
    return contest(spark, sf_dir, sizes).filter(~F.col("scratched"))


# --- customers in nines as runners ------------------------------------------------------------

def letters(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "ABCDEFGHIJ")


def runners(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = c.join(n, "c_nationkey")
    cust, nation = F.col("c_custkey"), F.col("c_nationkey")
    cents = F.abs(F.round(F.col("c_acctbal") * 100)).cast("long")
    tab = (cust % FIELD + 1).cast("int")
    scratched = (F.col("c_mktsegment") == "MACHINERY") & (cents % 3 == 0)
    return c.select(
        F.expr(f"c_custkey div {FIELD}").alias("race_id"),
        tab.alias("tab"),
        F.when(tab <= K.MAX_BOX, tab).otherwise(0).alias("box"),
        F.concat(F.lit("RUNNER "), letters(cust)).alias("horse"),
        ((cents % 80 + 250) / 10.0).alias("weight"),
        F.translate("n_name", "_0123456789", " ABCDEFGHIJ").alias("trainer"),
        scratched.alias("scratched"),
        F.when(scratched, K.NO_PRICE).otherwise((cents % 3000 + 110) / 100.0).alias("tab_odds"),
        F.when(scratched, K.NO_PRICE).otherwise((cents % 7000 + 120) / 100.0).alias("bf_odds"),
        F.lpad((cents % 100000).cast("string"), 5, "0").alias("form"),
        (nation * 2 / 100.0).alias("trainer_win"),
        ((nation * 2 + 20) / 100.0).alias("trainer_place"),
        F.when(cents % 4 == 0, 0.0).otherwise((cents % 300 + 2200) / 100.0).alias("tra_dist_best"),
        (cents % 70).cast("int").alias("dls"),
        (cust % 5 + 1).cast("int").alias("age"),
        (cents % 9000 / 100.0 - 40).alias("roi_percent"),
        cust.alias("cust"),
    )


def races(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {FIELD}").alias("race_id")).distinct()
    return r.select(
        "race_id",
        (300 + 50 * (F.col("race_id") % 6)).cast("int").alias("distance_m"),
        F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("race_id") % 3 + 1).cast("int")).alias("track"),
    )


# --- orders of a customer as past runs -------------------------------------------------------

def run_columns(o: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return o.select(
        F.expr(f"o_custkey div {FIELD}").alias("race_id"),
        (F.col("o_custkey") % FIELD + 1).cast("int").alias("tab"),
        F.col("o_orderdate").cast("date").alias("run_day"),
        key.alias("o_orderkey"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("finish"),
        (key % 4 + 4).cast("int").alias("field"),
        (key % 150 / 10.0).alias("margin"),
        (300 + 50 * (F.month("o_orderdate") % 6)).cast("int").alias("distance"),
        F.col("o_orderstatus").alias("track"),
        F.when(key % 7 != 0, key % 90 / 100.0 - 0.2).alias("bom_adj"),
        (F.floor(F.col("o_totalprice")) % 150 / 100.0).alias("mrk_delta"),
        F.when(key % 5 != 0, (key % 8 + 1)).cast("int").alias("settle_pos"),
        F.when(key % 6 == 0, "Quick to begin")
        .when(key % 6 == 1, "Slow to begin; checked turn")
        .when(key % 6 == 2, "Slowly away")
        .when(key % 6 == 3, "Raced wide").alias("stewards"),
        (key % 400 / 100.0 + 4).alias("first_split"),
        (key % 8 + 1).cast("int").alias("prior_box"),
    )


def run_order():
    return [F.col("run_day").desc(), F.col("o_orderkey").desc()]


def all_runs(spark, sf_dir) -> DataFrame:
    return run_columns(table(spark, sf_dir, "orders"))


def recent(spark, sf_dir) -> DataFrame:
    """The six newest runs of each runner, numbered from the newest."""
    return take_recent(all_runs(spark, sf_dir), ["race_id", "tab"], K.RECENT_RUNS, run_order())


# --- orders of a customer as counts --------------------------------------------------------------

def _counts():
    return [
        F.count_if(F.col("finish") == 1).cast("int").alias("wins"),
        F.count_if(F.col("finish").isin(2, 3)).cast("int").alias("places23"),
        F.count("*").cast("int").alias("starts"),
    ]


KIND_OF_TRACK = {"F": "course", "O": "distance", "P": "course_distance"}


def records(spark, sf_dir) -> DataFrame:
    kind = F.col("track")
    for status, name in KIND_OF_TRACK.items():
        kind = F.when(F.col("track") == status, name).otherwise(kind)
    counts = all_runs(spark, sf_dir).groupBy("race_id", "tab", kind.alias("kind")).agg(*_counts())
    return counts.withColumn("display", F.concat_ws("-", "wins", "places23", "starts"))


def career(spark, sf_dir) -> DataFrame:
    return all_runs(spark, sf_dir).groupBy("race_id", "tab").agg(*_counts())


def box_counts(spark, sf_dir) -> DataFrame:
    return all_runs(spark, sf_dir).groupBy("race_id", "tab", F.col("prior_box").alias("box")).agg(*_counts())
