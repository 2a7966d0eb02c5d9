"""Scores of a runner over its past runs: one aggregate pass per (race, runner).

Runs carry ``k``, their recency (0 = newest) in the full history, so a run without the
wanted value still ages the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions.numbers import finite
from formfield.functions.text import flag_phrases


def take_recent(df: DataFrame, by: list[str] | None = None, n: int = K.RECENT_RUNS, order: list[Column] | None = None) -> DataFrame:
    """The ``n`` newest runs. Without ``k``, ``by`` and ``order`` number the rows first.

    The row_number filter becomes a map-side group limit, so a hot key ships at most
    ``n`` rows per input split.
    """
    if order is not None:
        from pyspark.sql import Window

        df = df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return df.filter(F.col("k") < n)


def with_targets(runs: DataFrame, races: DataFrame, by: str = "race_id") -> DataFrame:
    """Attach the race's distance and track, against which past runs are compared."""
    targets = races.select(
        by, F.col("distance_m").alias("target_distance"), F.col("track").alias("target_track")
    )
    return runs.join(targets, by, "left")


def near_distance(tolerance: int = 40) -> Column:
    target = F.coalesce(F.col("target_distance"), F.lit(0))
    return (target != 0) & (F.abs(F.coalesce(F.col("distance"), F.lit(0)) - target) <= tolerance)


def same_track() -> Column:
    target = F.upper(F.coalesce(F.col("target_track"), F.lit("")))
    return (target != "") & (F.upper(F.coalesce(F.col("track"), F.lit(""))) == target)


def recency_mean(value: Column, decay: float = 0.33, boosts: tuple = (), newest: int = K.RECENT_RUNS) -> Column:
    """Aggregate: mean of the present values with weight ``exp(-decay k)`` times the boosts."""
    weight = F.exp(-decay * F.col("k"))
    for condition, factor in boosts:
        weight = weight * F.when(condition, factor).otherwise(1.0)
    weight = F.when(value.isNotNull() & (F.col("k") < newest), weight)
    return F.try_divide(F.sum(weight * value), F.sum(weight))


def _recent_value(column: str, default: float, negate: bool) -> Column:
    x = F.when(F.col(column).isNotNull(), finite(column, default))
    mean = recency_mean(x, 0.33, ((near_distance(), 1.30), (same_track(), 1.18)))
    return -mean if negate else mean


def recency_weighted_mean(
    df: DataFrame,
    by: list[str],
    value: str,
    default: float,
    decay: float = 0.33,
    boosts: tuple = (),
    negate: bool = False,
    negate_default: bool = False,
    out: str = "score",
) -> DataFrame:
    """Recency-weighted mean per group. The default of a group without values keeps its sign
    unless ``negate_default`` is set."""
    x = F.when(F.col(value).isNotNull(), finite(value, default))
    mean = recency_mean(x, decay, boosts)
    if negate:
        mean = -mean
    fill = -default if negate_default else default
    return df.groupBy(*by).agg(F.coalesce(mean, F.lit(fill)).alias(out))


def _place_share(position: str) -> Column:
    field = F.greatest(F.coalesce(F.col("field"), F.lit(8)), F.lit(2))
    return 1.0 - (F.col(position) - 1) / (field - 1)


def speed_aggregates(negate_default: bool = False) -> dict[str, Column]:
    sign = -1.0 if negate_default else 1.0
    bom = F.coalesce(_recent_value("bom_adj", 0.65, True), F.lit(sign * 0.65))
    mark = F.coalesce(_recent_value("mrk_delta", 0.75, True), F.lit(sign * 0.75))
    return {"speed_raw": 0.58 * bom + 0.42 * mark}


def form_aggregates() -> dict[str, Column]:
    finish = F.greatest(F.col("finish"), F.lit(1))
    field = F.greatest(F.coalesce(F.col("field"), F.lit(8)), F.lit(2))
    share = 1.0 - (finish - 1) / (field - 1)
    value = share - F.least(finite("margin", 5.0), F.lit(15.0)) / 60.0
    value = F.when(F.col("finish").isNotNull(), value)
    return {"form_raw": F.coalesce(recency_mean(value), F.lit(0.35))}


def early_aggregates() -> dict[str, Column]:
    pace = F.when(F.col("settle_pos").isNotNull(), _place_share("settle_pos"))
    base = recency_mean(pace, 0.32, ((near_distance(), 1.25), (same_track(), 1.12)))
    recent = F.col("k") < K.RECENT_RUNS
    quick = F.sum(F.when(recent, flag_phrases("stewards", K.QUICK_PHRASES)).otherwise(0))
    slow = F.sum(F.when(recent, flag_phrases("stewards", K.SLOW_PHRASES)).otherwise(0))
    return {
        "early_raw": F.coalesce(base, F.lit(0.45)) + 0.035 * quick - 0.035 * slow,
        "quick": quick,
        "slow": slow,
    }


def _aggregate(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def speed_score(df: DataFrame, by: list[str], negate_default: bool = False) -> DataFrame:
    return _aggregate(df, by, speed_aggregates(negate_default))


def form_score(df: DataFrame, by: list[str]) -> DataFrame:
    return _aggregate(df, by, form_aggregates())


def early_score(df: DataFrame, by: list[str]) -> DataFrame:
    return _aggregate(df, by, early_aggregates())


def history_aggregates(negate_default: bool = False) -> dict[str, Column]:
    return {
        "n_runs": F.count("*"), **speed_aggregates(negate_default), **form_aggregates(), **early_aggregates(),
    }


def history_scores(df: DataFrame, by: list[str], negate_default: bool = False) -> DataFrame:
    """All run-based scores and the run count in one aggregate."""
    return _aggregate(df, by, history_aggregates(negate_default))
