"""Exact finishing-order probabilities under the Plackett-Luce model.

With win probabilities ``r`` (scaled to sum to one), ordered pairs collapse to sums:

    second(i) = r_i (A - r_i / (1 - r_i)),             A = sum_j r_j / (1 - r_j)
    third(i)  = r_i (W - R_i),  R_i = sum_{k<>i} T(i,k),  W = (sum_i R_i) / 2
    T(i,k)    = r_i r_k (1/(1-r_i) + 1/(1-r_k)) / (1 - r_i - r_k)
    mean position(i) = 1/2 + sum_j r_j / (r_i + r_j)

so no pair of runners is ever emitted as a row. A race field reads its own short list of ``r``. For a group of more than
LISTED_RUNNERS rows the same sums come from power sums, so that the cost grows with its rows and not with their square:

* shares add up to one, so few are above SMALL_SHARE. T(i,k) is summed over those one by one, and over the small ones by the
  powers of r_k / (1 - r_i), a thirty-second at most; a runner above one half, of which there is one at most, sums directly.
* r_j / (r_i + r_j) is summed by bins of a quarter of an octave: with the bin's centre c, r_j = c (1 + d) and
  u = c / (r_i + c) it is u (1 + d) (1 - du + d^2 u^2 - ...), where d is a tenth at most.

What the series leave out lies below the rounding of a double. Both forms give the same values.

Limits: where a share lies below TINY, all shares of the group are lifted by it. A share of zero then comes last, several of
them in any order; behind a certain winner the others follow their shares; a group without any chance is uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.groups import Groups, group_operator, join_back

LISTED_RUNNERS = 64
SMALL_SHARE = 1 / 64
PAIR_POWERS = 12
BINS_PER_OCTAVE = 4
BIN_POWERS = 17
TINY = 1e-9


def _pair(r: Column, s: Column) -> Column:
    rest = F.greatest(1.0 - r - s, F.lit(1e-15))
    return r * s * (1.0 / (1.0 - r) + 1.0 / (1.0 - s)) / rest


def _sum_over(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, s: acc + term(s))


def _without_self(values: Column, r: Column) -> Column:
    """The list less one copy of ``r``; equal values are interchangeable."""
    at = F.array_position(values, r)
    return F.filter(values, lambda s, i: i + 1 != at)


def _finish(df: DataFrame) -> DataFrame:
    r, n = F.col("__share"), F.col("__count")
    second = r * (F.col("__firsts") - r / (1.0 - r))
    third = F.when(n >= 3, r * F.greatest(F.col("__pairs") / 2.0 - F.col("__own_pairs"), F.lit(0.0))).otherwise(0.0)
    top2 = F.when(n <= 2, F.lit(1.0)).otherwise(F.least(r + second, F.lit(1.0)))
    return (
        df.withColumn("top2", top2)
        .withColumn("top3", F.when(n <= 3, F.lit(1.0)).otherwise(F.least(F.col("top2") + third, F.lit(1.0))))
        .withColumn("exp_pos", F.col("__mean"))
        .drop("__share", "__count", "__firsts", "__pairs", "__own_pairs", "__mean", "__sum")
    )


def _share(df: DataFrame, g: Groups, p: str, size: str | None) -> DataFrame:
    aggs = {"__sum": F.sum(p), "__least": F.min(p)}
    if size is None:
        df = g.stats(df, __count=F.count("*"), **aggs)
    else:
        df = g.stats(df, **aggs).withColumn("__count", F.col(size))
    total, n = F.col("__sum"), F.col("__count")
    plain = F.col(p) / F.when(total > 0, total)
    lifted = (F.coalesce(plain, 1.0 / n) + TINY) / (1.0 + n * TINY)
    share = F.when((total > 0) & (F.col("__least") >= TINY * total), plain).otherwise(lifted)
    # a lone runner has r = 1; its pair terms are unused but must stay finite
    return df.withColumn("__share", F.when(n == 1, 0.5).otherwise(share)).drop("__least")


def _in_field(df: DataFrame, g: Groups, p: str, size: str | None) -> DataFrame:
    df = _share(df, g, p, size)
    r = F.col("__share")
    df = g.stats(df, __firsts=F.sum(r / (1.0 - r)), __field=F.collect_list(r))
    df = df.withColumn("__others", _without_self(F.col("__field"), r))
    df = df.withColumns({
        "__own_pairs": _sum_over(F.col("__others"), lambda s: _pair(r, s)),
        "__mean": 1.0 + _sum_over(F.col("__others"), lambda s: s / (r + s)),
    })
    return _finish(g.stats(df, __pairs=F.sum("__own_pairs")).drop("__field", "__others"))


def _power_sums(df: DataFrame, g: Groups) -> DataFrame:
    """One row per group: its shares above SMALL_SHARE, the power sums of the small ones and of each bin, and the pair sum of
    its largest share. Sums are combined before they are exchanged; a task sends a row per bin."""
    r, top = F.col("__share"), F.col("__top")
    octave = F.signum(r) * (F.floor(F.log2(F.abs(r)) * BINS_PER_OCTAVE) + 10_000)
    centre = F.signum("__bin") * F.pow(F.lit(2.0), (F.abs("__bin") - 9_999.5) / BINS_PER_OCTAVE)
    d, small = F.col("__d"), F.when(F.abs(r) <= SMALL_SHARE, r)
    binned = df.withColumn("__bin", octave).withColumn("__centre", centre).withColumn("__d", (r - F.col("__centre")) / F.col("__centre"))
    powers = range(1, PAIR_POWERS + 1)
    bins = binned.groupBy(*g.by, "__bin", "__centre").agg(
        F.array(*[F.sum(F.pow(d, F.lit(k)) * (1.0 + d)) for k in reversed(range(BIN_POWERS))]).alias("__e"),
        F.array(*[F.sum(F.pow(small, F.lit(k))) for k in powers]).alias("__m"),
        F.array(*[F.sum(F.pow(small, F.lit(k)) / (1.0 - small)) for k in powers]).alias("__n"),
        F.collect_list(F.when(F.abs(r) > SMALL_SHARE, r)).alias("__listed"),
        F.sum(F.when(r < top, _pair(top, r))).alias("__of_top"),
    )
    whole = lambda c: F.array(*[F.coalesce(F.sum(F.get(c, k - 1)), F.lit(0.0)) for k in powers])
    return bins.groupBy(*g.by).agg(
        F.collect_list(F.when(F.col("__centre").isNotNull(), F.struct(F.col("__centre").alias("c"), F.col("__e").alias("e")))).alias("__bins"),
        whole("__m").alias("__m"), whole("__n").alias("__n"),
        F.flatten(F.collect_list("__listed")).alias("__listed"), F.coalesce(F.sum("__of_top"), F.lit(0.0)).alias("__of_top"),
    )


def _own_pairs(r: Column) -> Column:
    """Sum of T over all others from the power sums."""
    x = 1.0 / (1.0 - r)
    series = F.lit(0.0)
    terms = F.zip_with("__m", "__n", lambda m, n: x * m + n)
    series = F.aggregate(F.reverse(terms), series, lambda acc, t: (acc + t) * x)
    is_small = F.abs(r) <= SMALL_SHARE
    listed = F.when(is_small, F.col("__listed")).otherwise(_without_self(F.col("__listed"), r))
    summed = _sum_over(listed, lambda s: _pair(r, s)) + r * series - F.when(is_small, _pair(r, r)).otherwise(0.0)
    return F.when(r > 0.5, F.col("__of_top")).otherwise(summed)


def _behind(r: Column) -> Column:
    """Sum of s / (r + s) over all others from the power sums of the bins."""
    near = F.transform("__bins", lambda b: F.struct((b["c"] / (r + b["c"])).alias("u"), b["e"].alias("e")))
    term = lambda b: b["u"] * F.aggregate(b["e"], F.lit(0.0), lambda acc, e: e - acc * b["u"])
    return _sum_over(near, term) - F.when(r == 0.0, 0.0).otherwise(0.5)


def _in_large_group(df: DataFrame, g: Groups, p: str, tie: str, size: str | None) -> DataFrame:
    df = g.settle(_share(g.settle(df), g, p, size))
    r = F.col("__share")
    sums = _power_sums(g.stats(df, __top=F.max("__share")), g)
    rows = join_back(df.select(*g.by, F.col(tie).alias("__tie"), "__share"), sums, g.by, small=g.listed)
    rows = rows.select(*g.by, "__tie", _own_pairs(r).alias("__own_pairs"), _behind(r).alias("__behind"))
    own = rows.groupBy(*g.by, F.col("__tie").alias(tie)).agg(
        F.coalesce(F.sum("__own_pairs"), F.lit(0.0)).alias("__own_pairs"),
        (1.0 + F.coalesce(F.sum("__behind"), F.lit(0.0))).alias("__mean"),
    )
    df = g.settle(join_back(df, own, [*g.by, tie], small=False))
    return _finish(g.stats(df, __firsts=F.sum(r / (1.0 - r)), __pairs=F.sum("__own_pairs")))


@group_operator(limit=LISTED_RUNNERS)
def finish_order_probs(
    df: DataFrame, g: Groups, p: str = "p_win", tie: str = "tab", size: str | None = None
) -> DataFrame:
    """Add ``top2``, ``top3`` and ``exp_pos`` from win probabilities. ``size`` names a column
    with the group's row count. ``tie`` must be unique in a group."""
    if g.spread:
        return _in_large_group(df, g, p, tie, size)
    return _in_field(df, g, p, size)
