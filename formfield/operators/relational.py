"""Joins, set logic and de-duplication over the tall tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions.numbers import box_prior, listed_price
from formfield.groups import Sizes, group_sizes

KEY = ["race_id", "tab"]
GAP_CHUNK = 1024


def first_by_key(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """First row per key in a given order (a map-side group limit keeps one row per split)."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__first", first).filter(F.col("__first") == 1).drop("__first")


def _numbered(df: DataFrame, sizes: Sizes, order: str) -> DataFrame:
    """``__k``: 1-based position in the group, a large group by ranges whose counts are carried on to the next."""
    return sizes.apply(df, lambda d, g: g.rank(d, "__k", F.col(order)))


def zip_assign(
    df: DataFrame,
    by: list[str] | Sizes,
    *,
    taker: Column,
    slot: Column,
    taker_order: str,
    slot_value: str,
    out: str = "box",
    flag: str = "reserve_into_box",
) -> DataFrame:
    """Give the k-th ``taker`` row (by ``taker_order``) the k-th smallest ``slot_value``.

    Every taker is served while slots last. Both sides are numbered in their group, where a large group is ordered by
    many tasks; the rows themselves are joined by key. ``taker_order`` must be unique among the takers of a group.
    ``by`` is the key, or the large groups that have been found already.
    """
    sizes = by if isinstance(by, Sizes) else group_sizes(df, by)
    by = sizes.by
    takers = _numbered(df.filter(taker).select(*by, F.col(taker_order).alias("__id")), sizes, "__id")
    vacant = _numbered(df.filter(slot).select(*by, F.col(slot_value).alias("__slot")).distinct(), sizes, "__slot")
    pairs = (
        takers.join(vacant, [*by, "__k"])
        .select(*[F.col(c).alias(f"__{c}") for c in by], "__id", "__slot")
    )
    match = F.col("__id") == F.when(taker, F.col(taker_order))
    for c in by:
        match = match & (F.col(c) == F.col(f"__{c}"))
    joined = df.join(pairs, match, "left")
    return joined.withColumns({
        out: F.coalesce(F.col("__slot"), F.col(out)),
        flag: F.col("__slot").isNotNull(),
    }).drop("__id", "__slot", *[f"__{c}" for c in by])


def sequence_gaps(df: DataFrame, by: list[str] | Sizes, key: str = "tab") -> DataFrame:
    """Numbers missing from 1..max(key) in each group.

    Each present number, and the zero before them, is compared with the next one, so what is made is the gaps alone, at
    most GAP_CHUNK numbers per row of the plan. In a large group numbers find the next by their rank, which many tasks
    give. ``by`` is the key, or the large groups that have been found already.
    """
    sizes = by if isinstance(by, Sizes) else group_sizes(df, by)
    by = sizes.by
    present = df.select(*by, F.col(key).cast("long").alias(key)).filter(F.col(key) >= 1)
    present = present.unionByName(present.select(*by, F.lit(0).cast("long").alias(key))).distinct()
    followed = sizes.apply(
        present, lambda d, g: g.following(g.rank(d, "__k", F.col(key)), "__next", "__k", key)
    ).select(*by, F.col(key).alias("__before"), F.col("__next").alias(key))
    holes = followed.filter(F.col(key) - F.col("__before") > 1)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({key} - __before - 2) div {GAP_CHUNK * GAP_CHUNK}")))
    wide = holes.withColumn("__wide", chunk).withColumn("__from", F.col("__before") + 1 + F.col("__wide") * GAP_CHUNK * GAP_CHUNK)
    inner = F.sequence(F.col("__from"), F.least(F.col(key) - 1, F.col("__from") + GAP_CHUNK * GAP_CHUNK - 1), F.lit(GAP_CHUNK).cast("long"))
    starts = wide.withColumn("__start", F.explode(inner))
    last = F.least(F.col(key) - 1, F.col("__start") + GAP_CHUNK - 1, F.col("__from") + GAP_CHUNK * GAP_CHUNK - 1)
    numbers = starts.select(*by, F.explode(F.sequence(F.col("__start"), last)).alias(key))
    return numbers.withColumn(key, F.col(key).cast(df.schema[key].dataType))


def dim_lookup(df: DataFrame, box: str = "box", out: str = "prior") -> DataFrame:
    """Look the fixed prior of a box up (eight literal entries, so no join)."""
    return df.withColumn(out, box_prior(box))


def own_box_stats(runners: DataFrame, box_stats: DataFrame, by: list[str] = KEY, box: str = "box") -> DataFrame:
    """A runner's counts from its current box; a missing or zero box has none."""
    own = box_stats.select(
        *by, F.col("box").alias(box), F.col("wins").alias("box_wins"),
        F.col("places23").alias("box_places23"), F.col("starts").alias("box_starts"),
    )
    out = runners.join(own, [*by, box], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("box_wins", "box_places23", "box_starts")})


def attach_details(runners: DataFrame, details: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Left-merge detail fields, fill the defaults and reset prices of scratched runners.

    A bookmaker's price in the details (``tab_price``) stands in for a missing listed one.
    """
    out = runners.join(details.withColumn("has_detail", F.lit(True)), by, "left")
    price = listed_price(F.col("tab_odds"), F.col("tab_price") if "tab_price" in out.columns else F.lit(None))
    out = out.withColumns({
        "has_detail": F.coalesce("has_detail", F.lit(False)),
        "tab_odds": F.when(F.col("scratched"), K.NO_PRICE).otherwise(price),
        "bf_is_proxy": F.col("bf_odds").isNull(),
        "bf_odds": F.when(F.col("scratched"), K.NO_PRICE).otherwise(F.coalesce("bf_odds", price)),
    })
    present = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in K.DEFAULTS.items() if c in out.columns}
    return out.withColumns(present)


def missing_detail(runners: DataFrame, details: DataFrame, by: list[str] = KEY) -> DataFrame:
    return runners.join(details.select(*by).distinct(), by, "left_anti")


def quality_warnings(runners: DataFrame, races: DataFrame, by: str = "race_id") -> DataFrame:
    """Data-quality findings: ``race_id, code, tab, detail``.

    ``runners`` needs tab, horse, box, scratched, has_detail and n_runs.
    """
    live = ~F.col("scratched")

    def row(code, tab, detail):
        return F.struct(
            F.lit(code).alias("code"), F.lit(tab).cast("int").alias("tab") if tab is None else F.col(tab).cast("int").alias("tab"),
            detail.alias("detail"),
        )

    empty = races.join(runners.select(by).distinct(), by, "left_anti").select(
        by, row("no_table", None, F.lit(K.WARN_NO_TABLE)).alias("w")
    )
    undetailed = runners.filter(~F.col("has_detail")).select(
        by, row("no_detail", "tab", F.format_string(K.WARN_NO_DETAIL, F.col("tab").cast("string"), F.col("horse"))).alias("w")
    )
    counts = runners.groupBy(by).agg(
        F.count_if(live & (F.col("box") == 0)).alias("boxless"),
        F.count_if(live & ~F.col("has_detail")).alias("undetailed"),
        F.count_if(live & (F.coalesce("n_runs", F.lit(0)) < 3)).alias("few"),
    )
    per_race = F.array(
        F.when(F.col("boxless") > 0, row("unassigned_reserve", None, F.lit(K.WARN_UNASSIGNED))),
        F.when(F.col("undetailed") > 0, row("details_missing", None, F.format_string(K.WARN_DETAILS_MISSING, F.col("undetailed").cast("string")))),
        F.when(F.col("few") > 0, row("few_runs", None, F.format_string(K.WARN_FEW_RUNS, F.col("few").cast("string")))),
    )
    raced = counts.select(by, F.explode(F.array_compact(per_race)).alias("w"))
    gaps = sequence_gaps(runners, [by]).select(by, row("tab_gap", "tab", F.format_string(K.WARN_TAB_GAP, F.col("tab").cast("string"))).alias("w"))
    return empty.unionByName(undetailed).unionByName(raced).unionByName(gaps).select(by, "w.*")
