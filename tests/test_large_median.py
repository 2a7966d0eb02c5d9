"""The median of a large group by narrowing histograms."""

import math
import random
import statistics

from pyspark.sql import functions as F

from formfield.groups import Groups


def medians(df, by=("g",), listed=True):
    got = Groups(list(by), spread=True, listed=listed).median(df, "m", F.col("v"))
    return {r[0]: r[1] for r in got.select(*by, "m").distinct().collect()}


def test_hard_values(spark):
    rng = random.Random(5)
    groups = {
        "ties": [2.0] * 50 + [1.0] * 49, "even": [1.0, 2.0, 4.0, 8.0], "one": [3.5], "zeros": [-0.0, 0.0, -0.0], "gap": [-5.0, 7.0],
        "wide": [s * 10.0 ** e for e in range(-300, 300, 7) for s in (1, -1)] + [1e-310],
        "close": [1.0 + k * 2.0 ** -52 for k in range(1001)], "tiny": [k * 5e-324 for k in range(1, 1000)],
        "ends": [math.inf] * 3 + [-math.inf] * 2, "random": [rng.gauss(0, 1) for _ in range(3001)],
        "powers": [2.0 ** k for k in range(-40, 41)] + [math.nextafter(2.0 ** k, 0) for k in range(-40, 41)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [(None, 1.0), (None, 5.0), ("none", None), ("ties", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    expected = {g: statistics.median(v) for g, v in groups.items()} | {None: 3.0, "none": None}
    assert medians(df) == expected
    assert medians(df, listed=False) == expected


def test_missing_numbers_come_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", math.nan), ("b", math.nan)], "g string, v double")
    got = medians(df.filter("g = 'a'"))
    assert got == {"a": 2.0}
    assert math.isnan(medians(df.filter("g = 'b'"))["b"])


def test_a_million_rows_without_sorting_them(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 1_000_003 / 7.0).alias("v"))
    got = Groups(["g"], spread=True, listed=True).median(df, "m", F.col("v"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and "Window" not in plan
    assert got.select("m").distinct().collect()[0].m == df.agg(F.median("v")).first()[0]
