"""Operators across one race field. ``by`` is any grouping key, not only a race."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions.numbers import clip, finite
from formfield.groups import Groups, group_operator

Z_COLUMNS = [f"{c}_z" for c in K.COMPONENT_WEIGHTS]
RAW_COLUMNS = [f"{c}_raw" for c in K.COMPONENT_WEIGHTS]


def _implied(price) -> Column:
    return 1.0 / F.greatest(finite(price, K.NO_PRICE), F.lit(K.MIN_PRICE))


@group_operator
def devig(df: DataFrame, g: Groups, price: str, out: str = "p") -> DataFrame:
    """Inverse prices normalised to sum to one in the group."""
    df = g.stats(df.withColumn("__inv", _implied(price)), __total=F.sum("__inv"))
    return df.withColumn(out, F.col("__inv") / F.greatest(F.col("__total"), F.lit(1e-12))).drop("__inv", "__total")


def _market_parts(tab: str, bf: str, weights: tuple[float, float]):
    """Columns before, aggregates over and columns after the pass that pools two markets."""
    price = finite(bf, K.NO_PRICE)
    usable = F.when((price > K.MIN_PRICE) & (price < 500), 1.0).otherwise(0.0)
    before = {"__it": _implied(tab), "__ib": _implied(bf), "__usable": usable}
    aggs = {"__st": F.sum("__it"), "__sb": F.sum("__ib"), "__ok": F.avg("__usable")}
    p_tab = F.col("__it") / F.greatest(F.col("__st"), F.lit(1e-12))
    p_bf = F.col("__ib") / F.greatest(F.col("__sb"), F.lit(1e-12))
    pooled = (weights[0] * p_tab + weights[1] * p_bf) / sum(weights)
    after = {"p_tab": p_tab, "p_bf": p_bf, "p_mkt": F.when(F.col("__ok") < 0.5, p_tab).otherwise(pooled)}
    return before, aggs, after


@group_operator
def blend_markets(
    df: DataFrame,
    g: Groups,
    tab: str = "tab_odds",
    bf: str = "bf_odds",
    weights: tuple[float, float] = (K.MARKET_TAB_WEIGHT, K.MARKET_BF_WEIGHT),
) -> DataFrame:
    """``p_tab``, ``p_bf`` and their pool ``p_mkt``; the pool needs half the field priced in both."""
    before, aggs, after = _market_parts(tab, bf, weights)
    df = g.stats(df.withColumns(before), **aggs)
    return df.withColumns(after).drop(*before, *aggs)


@group_operator
def softmax(df: DataFrame, g: Groups, score: str, out: str, scale: float = 1.0) -> DataFrame:
    """Exponentials of the scaled score, relative to the group's best, normalised."""
    df = g.stats(df, __best=F.max(F.col(score) * scale))
    df = df.withColumn("__e", F.exp(clip(F.col(score) * scale - F.col("__best"), -30.0, 30.0)))
    df = g.stats(df, __total=F.sum("__e"))
    return df.withColumn(out, F.col("__e") / F.greatest(F.col("__total"), F.lit(1e-12))).drop(
        "__best", "__e", "__total"
    )


@group_operator
def log_pool(df: DataFrame, g: Groups, first: str, second: str, out: str = "p_win", alpha: float = K.MARKET_ALPHA) -> DataFrame:
    """Weighted geometric mean of two probability columns, renormalised in the group."""
    a = min(max(float(alpha), 0.0), 1.0)
    logs = [F.log(clip(F.col(c), 1e-9, 1.0)) for c in (first, second)]
    df = df.withColumn("__score", a * logs[0] + (1.0 - a) * logs[1])
    return softmax(df, g, "__score", out).drop("__score")


def _z_parts(columns: dict[str, str]):
    """Aggregates over and columns after the pass that standardises columns."""
    aggs, after = {}, {}
    for i, (src, dst) in enumerate(columns.items()):
        aggs[f"__m{i}"] = F.avg(src)
        aggs[f"__s{i}"] = F.stddev_pop(src)
        sd = F.col(f"__s{i}")
        after[dst] = (F.col(src) - F.col(f"__m{i}")) / F.when(sd > 1e-9, sd).otherwise(1.0)
    return aggs, after


@group_operator
def zscores(df: DataFrame, g: Groups, columns: dict[str, str]) -> DataFrame:
    """Standardise finite, non-NULL columns (``source -> output``) in one pass over the group."""
    aggs, after = _z_parts(columns)
    return g.stats(df, **aggs).withColumns(after).drop(*aggs)


@group_operator
def zscore(df: DataFrame, g: Groups, column: str, out: str) -> DataFrame:
    """Standardise a column whose gaps take the group's median; all gaps give zero."""
    df = df.withColumn("__x", finite(column, None))
    df = g.median(g.settle(df), "__mid", F.col("__x"))
    df = df.withColumn("__x", F.coalesce("__x", "__mid", F.lit(0.0)))
    return zscores(df, g, {"__x": out}).drop("__x", "__mid")


@group_operator
def component_zs(df: DataFrame, g: Groups) -> DataFrame:
    """Seven raw component scores to seven z columns."""
    return zscores(df, g, dict(zip(RAW_COLUMNS, Z_COLUMNS)))


@group_operator
def market_and_components(df: DataFrame, g: Groups, n: int = 2, size: str = "n_active") -> DataFrame:
    """Field size (groups below ``n`` are dropped), market pool and component z scores: the
    steps that do not depend on each other share one pass over the group."""
    before, market, probabilities = _market_parts("tab_odds", "bf_odds", (K.MARKET_TAB_WEIGHT, K.MARKET_BF_WEIGHT))
    spread, scores = _z_parts(dict(zip(RAW_COLUMNS, Z_COLUMNS)))
    df = g.stats(df.withColumns(before), **{size: F.count("*")}, **market, **spread)
    df = df.filter(F.col(size) >= n).withColumns({**probabilities, **scores})
    return df.drop(*before, *market, *spread)


@group_operator
def coverage_blend(df: DataFrame, g: Groups, best: str = "tra_dist_best", z: str = "trackdist_z") -> DataFrame:
    """Mix best times into the track/distance score where enough of the field has one."""
    time = finite(best, None)
    df = g.settle(df.withColumn("__best", F.when(time != 0, time)))
    df = g.median(df, "__mid", F.col("__best"))
    df = g.stats(df, __known=F.count("__best"), __n=F.count("*"))
    df = df.withColumn("__best", F.coalesce("__best", "__mid", F.lit(0.0)))
    df = zscores(df, g, {"__best": "__best_z"})
    enough = F.col("__known") >= F.greatest(F.lit(3), F.floor(F.col("__n") / 2))
    blended = 0.70 * F.col(z) + 0.30 * -F.col("__best_z")
    return df.withColumn(z, F.when(enough, blended).otherwise(F.col(z))).drop(
        "__best", "__mid", "__known", "__n", "__best_z"
    )


@group_operator
def rank_field(df: DataFrame, g: Groups, score: str, out: str = "rank", tie: str = "tab") -> DataFrame:
    """Positions 1..n by descending score; ties follow the listing order."""
    return g.rank(df, out, F.col(score).desc(), F.col(tie).asc())


@group_operator
def pace_adjust(df: DataFrame, g: Groups, early: str = "early_z", box_z: str = "box_z", box: str = "box") -> DataFrame:
    """Projected pace, its order, and a bonus for a clear leader or a cost for a clash."""
    df = df.withColumn("pace", 0.72 * F.col(early) + 0.28 * F.col(box_z))
    df = rank_field(g.settle(df), g, "pace", "early_rank")

    def at(position, column):
        return F.max(F.when(F.col("early_rank") == position, F.col(column)))

    df = g.stats(df, __p1=at(1, "pace"), __p2=at(2, "pace"), __b1=at(1, box), __b2=at(2, box))
    clear = F.col("__p1") - F.col("__p2") > 0.55
    clash = (
        (F.col("__b1") != 0) & (F.col("__b2") != 0) & (F.abs(F.col("__b1") - F.col("__b2")) <= 2)
    )
    adjust = (
        F.when(clear & (F.col("early_rank") == 1), 0.22)
        .when(clear, 0.0)
        .when(clash & (F.col("early_rank") <= 2), -0.07)
        .otherwise(0.0)
    )
    return df.withColumn("pace_adjust", adjust).drop("__p1", "__p2", "__b1", "__b2")


@group_operator
def fundamental_probs(df: DataFrame, g: Groups, out: str = "p_fund") -> DataFrame:
    """Weighted component score plus pace adjustment, as probabilities."""
    score = F.col("pace_adjust")
    for name, weight in K.COMPONENT_WEIGHTS.items():
        score = score + weight * F.col(f"{name}_z")
    return softmax(df.withColumn("__fund", score), g, "__fund", out, K.FUND_SCALE).drop("__fund")


def fair_and_ev(df: DataFrame, p: str = "p_win", price: str = "bf_odds") -> DataFrame:
    return df.withColumns({
        "fair": 1.0 / F.greatest(F.col(p), F.lit(1e-9)),
        "ev_win": F.col(p) * finite(price, K.NO_PRICE) - 1.0,
    })


def _row_spread(columns: list[str]) -> Column:
    """Population standard deviation of several columns of one row."""
    mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
    squares = [(F.col(c) - mean) * (F.col(c) - mean) for c in columns]
    return F.sqrt(sum(squares[1:], squares[0]) / len(columns))


@group_operator
def confidence(
    df: DataFrame,
    g: Groups,
    p: str = "p_win",
    rank: str = "pred_rank",
    runs: str = "n_runs",
    cd_starts: str = "cd_starts",
    box_starts: str = "box_starts",
    z_columns: list[str] | None = None,
) -> DataFrame:
    """Whole number 1..9 from data completeness, component agreement and the gap to the next runner."""
    df = g.following(df, "__next", rank, p)
    complete = (
        F.least(F.coalesce(F.col(runs), F.lit(0)) / 5.0, F.lit(1.0))
        + F.when(F.col(cd_starts) > 0, 0.20).otherwise(0.0)
        + F.when(F.col(box_starts) > 0, 0.15).otherwise(0.0)
    )
    complete = F.least(complete / 1.35, F.lit(1.0))
    agreement = 1.0 / (1.0 + _row_spread(z_columns or Z_COLUMNS))
    lead = F.greatest(F.col(p) - F.coalesce(F.col("__next"), F.lit(0.0)), F.lit(0.0))
    value = F.rint(2.0 + 3.0 * complete + 2.0 * agreement + 4.0 * lead)
    return df.withColumn("conf", clip(value, 1.0, 9.0).cast("int")).drop("__next")


def classify(df: DataFrame) -> DataFrame:
    """Recommendation from rank, expected value and top-3 chance."""
    value = (F.col("ev_win") >= 0.12) & (F.col("p_win") >= 0.07)
    return df.withColumn(
        "rec",
        F.when(F.col("pred_rank") == 1, "TOP PICK")
        .when(F.col("pred_rank") <= 3, "DANGER")
        .when(value, "VALUE")
        .when(F.col("top3") >= 0.35, "EXOTICS / PLACE")
        .otherwise("WATCH"),
    )


def overall_confidence(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: field size, confidence, top pick and projected leader."""
    def p_at(position):
        return F.max(F.when(F.col("pred_rank") == position, F.col("p_win")))

    out = df.groupBy(*by).agg(
        F.count("*").alias("n_active"),
        (p_at(1) - F.coalesce(p_at(2), F.lit(0.0))).alias("__gap"),
        F.avg("conf").alias("__conf"),
        F.min_by("tab", "pred_rank").alias("top_pick_tab"),
        F.min_by("tab", "early_rank").alias("leader_tab"),
    )
    value = clip(F.rint(4.0 + 15.0 * F.col("__gap") + F.col("__conf") / 3.0), 1.0, 9.0)
    return out.select(*by, "n_active", value.cast("int").alias("overall_conf"), "top_pick_tab", "leader_tab")


def active(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("scratched"), F.lit(False)))


@group_operator
def require_field(df: DataFrame, g: Groups, n: int = 2) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    return g.stats(df, __n=F.count("*")).filter(F.col("__n") >= n).drop("__n")


def rejected_races(df: DataFrame, by: list[str], n: int = 2) -> DataFrame:
    """Groups whose active rows are fewer than ``n``, with the reason."""
    live = F.sum(F.when(F.coalesce(F.col("scratched"), F.lit(False)), 0).otherwise(1))
    return (
        df.groupBy(*by).agg(live.alias("n_active")).filter(F.col("n_active") < n)
        .withColumn("reason", F.lit(f"fewer than {n} active runners"))
    )
