"""Registered queries: each operator over whole tables, with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formfield import constants as K
from formfield.functions.numbers import box_score, finite, freshness_score, shrunk_rate, trackdist_score, trainer_score
from formfield.groups import counted_sizes
from formfield.operators import field as W
from formfield.operators import history as H
from formfield.operators import relational as R
from formfield.operators.finish import LISTED_RUNNERS, finish_order_probs
from formfield.plans import predict as PR
from formfield.plans import views as V
from formfield.sources.pages import gate_pages, latest_capture
from suite import bindings as B
from suite.sql import finish_blocks, over, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RACE = ["race_id"]
RUNNER = ["race_id", "tab"]


def field_of(spark, d):
    """The active fields, and which of them are large; the keys are looked at once for all steps."""
    sizes = B.contest_sizes(spark, d)
    return B.active_contest(spark, d, sizes), sizes


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tidy(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """The named columns, doubles rounded and without a negative zero. The small shift keeps
    exact ties of the last digit from falling to either side by summation order."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        (F.round(F.col(f"`{c}`") + F.lit(1e-11), digits) + F.lit(0.0)).alias(c) if isinstance(fields[c], T.DoubleType) else F.col(f"`{c}`")
        for c in (columns or df.columns)
    ])


# --- across the field: order lines as races -------------------------------------------------

@register("w3_devig", over("active_contest", query=f"""
    select race_id, tab, {rounded('p')} from (
        select race_id, tab, 1.0 / tab_odds / sum(1.0 / tab_odds) over (partition by race_id) as p from active_contest)"""))
def w3_devig(spark, d):
    df, sizes = field_of(spark, d)
    return tidy(W.devig(df, sizes, "tab_odds"), "race_id", "tab", "p")


@register("w2_softmax", over("active_contest", query=f"""
    select race_id, tab, {rounded('p')} from (
        select race_id, tab, e / sum(e) over (partition by race_id) as p from (
            select race_id, tab, exp(greatest(0.5 * bf_odds - max(0.5 * bf_odds) over (partition by race_id), -30)) as e
            from active_contest))"""))
def w2_softmax(spark, d):
    df, sizes = field_of(spark, d)
    return tidy(W.softmax(df, sizes, "bf_odds", "p", 0.5), "race_id", "tab", "p")


_GAPPED = "case when price % 7 < 2 then null else price end"


@register("w1_zscore", over("active_contest", query=f"""
    select race_id, tab, {rounded('z')} from (
        select race_id, tab, coalesce((x - avg(x) over f) / case when stddev_pop(x) over f > 1e-9
               then stddev_pop(x) over f else 1 end, 0) as z
        from (select race_id, tab, coalesce({_GAPPED}, median({_GAPPED}) over (partition by race_id), 0) as x from active_contest)
        window f as (partition by race_id))"""))
def w1_zscore(spark, d):
    df, sizes = field_of(spark, d)
    df = df.withColumn("x", F.when(F.col("price") % 7 >= 2, F.col("price")))
    return tidy(W.zscore(df, sizes, "x", "z"), "race_id", "tab", "z")


_BLEND = {"two_prices": (("active_contest",), """
    select race_id, tab, it / sum(it) over f as p_tab, ib / sum(ib) over f as p_bf,
           avg(case when bf_odds > 20 then 0.0 else 1.0 end) over f as ok
    from (select *, 1.0 / tab_odds as it, 1.0 / case when bf_odds > 20 then 999 else bf_odds end as ib from active_contest)
    window f as (partition by race_id)""")}


@register("w4_blend_markets", over("two_prices", extra=_BLEND, query=f"""
    select race_id, tab, {rounded('p_tab', 'p_bf', 'p_mkt')} from (
        select *, case when ok < 0.5 then p_tab else 0.55 * p_tab + 0.45 * p_bf end as p_mkt from two_prices)"""))
def w4_blend_markets(spark, d):
    df, sizes = field_of(spark, d)
    df = df.withColumn("bf_odds", F.when(F.col("bf_odds") > 20, 999.0).otherwise(F.col("bf_odds")))
    return tidy(W.blend_markets(df, sizes), *RUNNER, "p_tab", "p_bf", "p_mkt")


_POOL = {"pool": (("active_contest",), """
    select race_id, tab, a, b, exp(0.6 * ln(a) + 0.4 * ln(b)) as w from (
        select race_id, tab, 1.0 / tab_odds / sum(1.0 / tab_odds) over f as a, 1.0 / bf_odds / sum(1.0 / bf_odds) over f as b
        from active_contest window f as (partition by race_id))""")}
_POOL["pool_p"] = (("pool",), "select race_id, tab, w / sum(w) over (partition by race_id) as p_win from pool")


def _pooled(df: DataFrame, g) -> DataFrame:
    df = W.devig(W.devig(df, g, "tab_odds", "p_a"), g, "bf_odds", "p_b")
    return W.log_pool(df, g, "p_a", "p_b")


@register("w9_log_pool", over("pool_p", extra=_POOL, query=f"select race_id, tab, {rounded('p_win')} from pool_p"))
def w9_log_pool(spark, d):
    df, sizes = field_of(spark, d)
    return tidy(sizes.apply(df, _pooled), "race_id", "tab", "p_win")


@register("d3_rank_field", over("active_contest", query="""
    select race_id, tab, cast(row_number() over (partition by race_id order by tab_odds desc, tab) as integer) as rank
    from active_contest"""))
def d3_rank_field(spark, d):
    df, sizes = field_of(spark, d)
    return W.rank_field(df, sizes, "tab_odds").select("race_id", "tab", "rank")


@register("d4_top1_per_race", over("active_contest", query="""
    select race_id, tab, bf_odds from active_contest
    qualify row_number() over (partition by race_id order by bf_odds, tab) = 1"""))
def d4_top1_per_race(spark, d):
    df, sizes = field_of(spark, d)
    ranked = W.rank_field(df.withColumn("score", -F.col("bf_odds")), sizes, "score")
    return V.top1_per_race(ranked, "rank").select("race_id", "tab", "bf_odds")


@register("j7_finish_order_probs", over("finish", extra={**_POOL, **finish_blocks("pool_p")}, query=f"""
    select race_id, tab, {rounded('top2', 'top3', 'exp_pos')} from finish"""))
def j7_finish_order_probs(spark, d):
    sizes = counted_sizes(B.contest_raw(spark, d), RACE, LISTED_RUNNERS)
    df = sizes.apply(B.active_contest(spark, d, sizes), _pooled)
    return tidy(finish_order_probs(df, sizes), *RUNNER, "top2", "top3", "exp_pos")


_SEGMENTS = {"segment": ((), "select c_mktsegment as race_id, c_custkey as tab, c_acctbal + 2000.0 as p_win from customer")}


@register("j7_finish_large_groups", over("finish", extra={**_SEGMENTS, **finish_blocks("segment")}, query=f"""
    select race_id, tab, {rounded('top2', 'top3', 'exp_pos')} from finish"""))
def j7_finish_large_groups(spark, d):
    """The customers of a market segment as one field, far larger than a race."""
    customers = B.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("race_id"), F.col("c_custkey").alias("tab"), (F.col("c_acctbal") + 2000.0).alias("p_win"))
    return tidy(finish_order_probs(customers, RACE), *RUNNER, "top2", "top3", "exp_pos")


@register("w10_fair_and_ev", over("active_contest", "pool_p", extra=_POOL, query=f"""
    select race_id, tab, {rounded('fair', 'ev_win')} from (
        select race_id, tab, 1.0 / greatest(p_win, 1e-9) as fair, p_win * bf_odds - 1 as ev_win
        from pool_p join active_contest using (race_id, tab))"""))
def w10_fair_and_ev(spark, d):
    df, sizes = field_of(spark, d)
    df = sizes.apply(df, _pooled)
    return tidy(W.fair_and_ev(df), *RUNNER, "fair", "ev_win")


@register("f1_active", over("contest_raw", query="select race_id, tab, part, tab_odds from contest_raw where not scratched"))
def f1_active(spark, d):
    return W.active(B.contest_raw(spark, d)).select("race_id", "tab", "part", "tab_odds")


@register("f2_require_field", over("active_contest", query="""
    select race_id, tab from active_contest qualify count(*) over (partition by race_id) >= 2"""))
def f2_require_field(spark, d):
    df, sizes = field_of(spark, d)
    return W.require_field(df, sizes).select("race_id", "tab")


@register("f2_rejected_races", over("contest_raw", query="""
    select race_id, cast(count_if(not scratched) as bigint) as n_active, 'fewer than 2 active runners' as reason
    from contest_raw group by race_id having count_if(not scratched) < 2"""))
def f2_rejected_races(spark, d):
    return W.rejected_races(B.contest_raw(spark, d), RACE)


@register("f7_listing_metrics", over("contest_raw", query="""
    select race_id, count(*) as listed, cast(count_if(not scratched) as bigint) as active, cast(count_if(scratched) as bigint) as scratched
    from contest_raw group by race_id"""))
def f7_listing_metrics(spark, d):
    return V.listing_metrics(B.contest_raw(spark, d))


# --- table shaping over raw order lines --------------------------------------------------------

@register("d1_first_by_key", over("contest_raw", query="""
    select race_id, tab, part, scratched from contest_raw
    qualify row_number() over (partition by race_id, tab order by part, supp, price) = 1"""))
def d1_first_by_key(spark, d):
    df = R.first_by_key(B.contest_raw(spark, d), RUNNER, F.col("part"), F.col("supp"), F.col("price"))
    return df.select("race_id", "tab", "part", "scratched")


_FIRST = {"listing": (("contest_raw",), """
    select * from contest_raw qualify row_number() over (partition by race_id, tab order by part, supp, price) = 1""")}
_ZIP = {
    **_FIRST,
    "takers": (("listing",), """select race_id, tab, row_number() over (partition by race_id order by part, supp) as rn
        from listing where tab > 4 and not scratched"""),
    "vacant": (("listing",), """select race_id, tab as slot, row_number() over (partition by race_id order by tab) as rn
        from listing where tab <= 4 and scratched"""),
}


def _listing(spark, d):
    return R.first_by_key(B.contest_raw(spark, d), RUNNER, F.col("part"), F.col("supp"), F.col("price"))


@register("j3_zip_assign", over("listing", "takers", "vacant", extra=_ZIP, query="""
    select l.race_id, l.tab, coalesce(v.slot, case when l.tab <= 4 then l.tab else 0 end) as box,
           v.slot is not null as reserve_into_box
    from listing l left join takers t on l.race_id = t.race_id and l.tab = t.tab
    left join vacant v on v.race_id = t.race_id and v.rn = t.rn"""))
def j3_zip_assign(spark, d):
    tab = F.col("tab")
    df = _listing(spark, d).withColumns({
        "box": F.when(tab <= 4, tab).otherwise(0),
        "line": F.struct("part", "supp", "tab"),
    })
    out = R.zip_assign(
        df, RACE, taker=(tab > 4) & ~F.col("scratched"), slot=(tab <= 4) & F.col("scratched"),
        taker_order="line", slot_value="tab",
    )
    return out.select("race_id", "tab", "box", "reserve_into_box")


@register("j4_sequence_gaps", over("contest_raw", query="""
    select race_id, cast(unnest(list_filter(range(1, cast(max(tab) as bigint)), lambda x: not list_contains(list(tab), cast(x as integer)))) as integer) as tab
    from contest_raw group by race_id"""))
def j4_sequence_gaps(spark, d):
    return R.sequence_gaps(B.contest_raw(spark, d), RACE)


_DETAIL = {"detail": ((), "select distinct o_custkey // 9 as race_id, cast(o_custkey % 9 + 1 as integer) as tab from orders group by all having bool_or(o_orderpriority = '1-URGENT')")}


def _detail(spark, d):
    o = B.table(spark, d, "orders")
    found = o.groupBy(F.expr("o_custkey div 9").alias("race_id"), (F.col("o_custkey") % 9 + 1).cast("int").alias("tab")).agg(
        F.max(F.col("o_orderkey") % 40).cast("int").alias("dls"),
        F.max(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 50 + 2)).cast("double").alias("bf_odds"),
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("found"),
    )
    return found.filter("found").drop("found")


@register("j1_attach_details", over("runners", query="""
    select race_id, tab, coalesce(dls, 14) as dls, case when scratched then 999.0 else price end as tab_odds,
           cast(case when scratched then 999.0 else coalesce(bf, price) end as double) as bf_odds,
           dls is not null as has_detail, bf is null as bf_is_proxy
    from (select r.race_id, r.tab, scratched, d.dls, d.bf,
                 cast(case when r.tab <> 5 then tab_odds when d.dls % 2 = 0 then d.dls + 2.0 else 999.0 end as double) as price
          from runners r left join (
        select o_custkey // 9 as race_id, cast(o_custkey % 9 + 1 as integer) as tab, cast(max(o_orderkey % 40) as integer) as dls,
               cast(max(case when o_orderkey % 3 = 0 then o_orderkey % 50 + 2 end) as double) as bf
        from orders group by all having bool_or(o_orderpriority = '1-URGENT')) d using (race_id, tab))"""))
def j1_attach_details(spark, d):
    listed = B.runners(spark, d).select("race_id", "tab", "scratched", F.when(F.col("tab") != 5, F.col("tab_odds")).alias("tab_odds"))
    details = _detail(spark, d).withColumn("tab_price", F.when(F.col("dls") % 2 == 0, F.col("dls") + 2.0))
    return R.attach_details(listed, details).select(
        "race_id", "tab", "dls", "tab_odds", "bf_odds", "has_detail", "bf_is_proxy"
    )


@register("j2_missing_detail", over("runners", "detail", extra=_DETAIL, query="""
    select race_id, tab, horse from runners r where not exists (select 1 from detail d where d.race_id = r.race_id and d.tab = r.tab)"""))
def j2_missing_detail(spark, d):
    return R.missing_detail(B.runners(spark, d), _detail(spark, d)).select("race_id", "tab", "horse")


@register("j5_dim_lookup", "select l_orderkey, l_partkey, l_linenumber as box, cast(case l_linenumber "
          + " ".join(f"when {b} then {v}" for b, v in K.BOX_PRIOR.items() if b < 7)
          + " else 0.125 end as double) as prior from (select l_orderkey, l_partkey, case when l_linenumber = 7 then 0 else l_linenumber end as l_linenumber from lineitem)")
def j5_dim_lookup(spark, d):
    box = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber")).alias("box")
    return R.dim_lookup(B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", box))


@register("j6_own_box_stats", over("runners", "box_counts", query="""
    select race_id, tab, box, coalesce(wins, 0) as box_wins, coalesce(places23, 0) as box_places23, coalesce(starts, 0) as box_starts
    from runners left join box_counts using (race_id, tab, box)"""))
def j6_own_box_stats(spark, d):
    return R.own_box_stats(B.runners(spark, d), B.box_counts(spark, d)).select(
        "race_id", "tab", "box", "box_wins", "box_places23", "box_starts"
    )


_LISTED_DETAIL = {
    **_DETAIL,
    "judged": (("runners", "detail", "run_counts"), """
        select r.* replace (cast(case when r.race_id % 2 = 1 and r.tab >= 4 then r.tab + 1 else r.tab end as integer) as tab),
            d.race_id is not null as has_detail, coalesce(n_runs, 0) as n_runs
        from runners r left join detail d on d.race_id = r.race_id and d.tab = r.tab
        left join run_counts c on c.race_id = r.race_id and c.tab = r.tab"""),
}


@register("j8_quality_warnings", over("judged", "races", extra=_LISTED_DETAIL, query="""
    select race_id, 'no_table' as code, cast(null as integer) as tab, 'Could not locate the runners table.' as detail
    from (select race_id from races union select -1) where race_id not in (select race_id from judged)
    union all select race_id, 'no_detail', tab, 'No detail block found for #' || tab || ' ' || horse || '.' from judged where not has_detail
    union all select race_id, 'unassigned_reserve', null, 'One or more active reserves could not be assigned to a vacant box.'
        from judged where not scratched and box = 0 group by race_id
    union all select race_id, 'details_missing', null, 'Detailed form was not parsed for ' || count(*) || ' active runner(s).'
        from judged where not scratched and not has_detail group by race_id
    union all select race_id, 'few_runs', null, count(*) || ' active runner(s) have fewer than three parsed recent runs; model confidence is reduced.'
        from judged where not scratched and n_runs < 3 group by race_id
    union all select race_id, 'tab_gap', tab, 'Tab number ' || tab || ' is missing from the parsed field.' from (
        select race_id, unnest(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], lambda x: x < max(tab) and not list_contains(list(tab), x))) as tab
        from judged group by race_id)"""))
def j8_quality_warnings(spark, d):
    """All runners; in odd races those from the fourth on are listed one number higher, so a number is missing."""
    listed = B.runners(spark, d)
    counts = B.all_runs(spark, d).groupBy(*RUNNER).agg(F.count("*").alias("n_runs"))
    detail = _detail(spark, d).select(*RUNNER, F.lit(True).alias("has_detail"))
    listed = listed.join(detail, RUNNER, "left").join(counts, RUNNER, "left").withColumn(
        "has_detail", F.coalesce("has_detail", F.lit(False))
    ).withColumn("tab", F.when((F.col("race_id") % 2 == 1) & (F.col("tab") >= 4), F.col("tab") + 1).otherwise(F.col("tab")))
    races = B.races(spark, d).select("race_id").unionByName(spark.range(1).select((F.col("id") - 1).alias("race_id")))
    return R.quality_warnings(listed, races)


# --- scores over past runs ---------------------------------------------------------------------------

def _weighed(spark, d):
    return H.with_targets(B.recent(spark, d), B.races(spark, d))


@register("d2_take_recent", over("recent", query="select race_id, tab, o_orderkey, k, finish from recent"))
def d2_take_recent(spark, d):
    return B.recent(spark, d).select("race_id", "tab", "o_orderkey", "k", "finish")


@register("a1_recency_weighted_mean", over("weighed", query=f"""
    select race_id, tab, {rounded('score')} from (
        select race_id, tab, coalesce(-sum(bom_adj * w) / sum(case when bom_adj is not null then w end), 0.65) as score
        from (select *, exp(-0.33 * k) * case when near then 1.30 else 1 end * case when same then 1.18 else 1 end as w from weighed)
        group by race_id, tab)"""))
def a1_recency_weighted_mean(spark, d):
    boosts = ((H.near_distance(), 1.30), (H.same_track(), 1.18))
    return tidy(H.recency_weighted_mean(_weighed(spark, d), RUNNER, "bom_adj", 0.65, boosts=boosts, negate=True))


for _name, _fn, _column in (
    ("a2_speed_score", H.speed_score, "speed_raw"), ("a5_form_score", H.form_score, "form_raw"),
):
    register(_name, over("history", query=f"select race_id, tab, {rounded(_column)} from history"))(
        lambda spark, d, fn=_fn: tidy(fn(_weighed(spark, d), RUNNER))
    )


@register("a6_early_score", over("history", query=f"select race_id, tab, {rounded('early_raw')}, quick, slow from history"))
def a6_early_score(spark, d):
    return tidy(H.early_score(_weighed(spark, d), RUNNER))


@register("a3_shrunk_rate", over("career", query=f"""
    select race_id, tab, {rounded('rate')} from (
        select race_id, tab, (wins + 1.0) / (starts + 8.0) + 0.35 * (wins + places23 + 3.0) / (starts + 8.0) as rate from career)"""))
def a3_shrunk_rate(spark, d):
    return tidy(B.career(spark, d).withColumn("rate", shrunk_rate("wins", "places23", "starts")), *RUNNER, "rate")


@register("a4_box_score", over("raw", query=f"select race_id, tab, {rounded('box_raw')} from raw"))
def a4_box_score(spark, d):
    df = R.own_box_stats(W.active(B.runners(spark, d)), B.box_counts(spark, d))
    return tidy(df.withColumn("box_raw", box_score("box", "box_wins", "box_places23", "box_starts")), *RUNNER, "box_raw")


@register("a7_trackdist_score", over("raw", query=f"select race_id, tab, {rounded('trackdist_raw')} from raw"))
def a7_trackdist_score(spark, d):
    df = W.active(B.runners(spark, d)).join(PR.record_columns(B.records(spark, d)), RUNNER, "left")
    triples = [[f"{k}_{p}" for p in ("wins", "places23", "starts")] for k in PR.SCORED_RECORDS]
    return tidy(df.withColumn("trackdist_raw", trackdist_score(*triples)), *RUNNER, "trackdist_raw")


@register("a8_freshness_score", f"""
    select o_orderkey, {rounded('score')} from (select o_orderkey, cast(case when d <= 2 then 0.45 when d <= 12 then 1.0 - abs(d - 7.0) / 25.0
        when d <= 28 then 0.75 - (d - 12.0) / 80.0 when d <= 56 then 0.55 - (d - 28.0) / 100.0 else 0.25 end as double) as score
        from (select o_orderkey, greatest(o_orderkey % 90 - 5, 0) as d from orders))""")
def a8_freshness_score(spark, d):
    days = F.col("o_orderkey") % 90 - 5
    return tidy(B.table(spark, d, "orders").select("o_orderkey", freshness_score(days).alias("score")))


@register("a9_trainer_score", over("runners", query=f"""
    select race_id, tab, {rounded('score')} from (select race_id, tab, 0.72 * trainer_win + 0.28 * trainer_place as score from runners)"""))
def a9_trainer_score(spark, d):
    return tidy(B.runners(spark, d).withColumn("score", trainer_score("trainer_win", "trainer_place")), *RUNNER, "score")


# --- the model over customers in nines --------------------------------------------------------------------

def _history(spark, d) -> dict[str, DataFrame]:
    return {
        "records": B.records(spark, d), "box_stats": B.box_counts(spark, d), "runs": B.recent(spark, d),
        "races": B.races(spark, d),
        "run_counts": B.career(spark, d).select(*RUNNER, F.col("starts").alias("n_runs")),
    }


def _in_races(spark, d, fn) -> DataFrame:
    history = _history(spark, d)
    return PR.by_race(B.runners(spark, d), lambda live, g: fn((PR.raw_components if g.spread else PR.tagged_components)(live, **history), g))


def _upto(*steps):
    def run(df, g):
        df = W.require_field(df, g, 2)
        for step in steps:
            df = step(df, g)
        return df

    return run


@register("w5_component_zs", over("standard", query="select race_id, tab, " + ", ".join(
    f"round({c}_z0 + 1e-11, 8) + 0.0 as {c}_z" for c in K.COMPONENT_WEIGHTS) + " from standard"))
def w5_component_zs(spark, d):
    return tidy(_in_races(spark, d, _upto(W.component_zs)), *RUNNER, *W.Z_COLUMNS)


@register("w6_coverage_blend", over("covered", query=f"select race_id, tab, {rounded('trackdist_z')} from covered"))
def w6_coverage_blend(spark, d):
    return tidy(_in_races(spark, d, _upto(W.component_zs, W.coverage_blend)), *RUNNER, "trackdist_z")


@register("w7_pace_adjust", over("paced", query=f"select race_id, tab, early_rank, {rounded('pace', 'pace_adjust')} from paced"))
def w7_pace_adjust(spark, d):
    df = _in_races(spark, d, _upto(W.component_zs, W.pace_adjust))
    return tidy(df, *RUNNER, "early_rank", "pace", "pace_adjust")


@register("w8_fundamental_probs", over("fundamental", query=f"select race_id, tab, {rounded('p_fund')} from fundamental"))
def w8_fundamental_probs(spark, d):
    steps = (W.component_zs, W.coverage_blend, W.pace_adjust, W.fundamental_probs)
    return tidy(_in_races(spark, d, _upto(*steps)), *RUNNER, "p_fund")


def predictions(spark, d) -> DataFrame:
    return PR.predict(B.runners(spark, d), **_history(spark, d))


@register("w11_confidence", over("rated", query="select race_id, tab, conf from rated"))
def w11_confidence(spark, d):
    return predictions(spark, d).select(*RUNNER, "conf")


@register("w12_classify", over("predicted", query="select race_id, tab, rec from predicted"))
def w12_classify(spark, d):
    return predictions(spark, d).select(*RUNNER, "rec")


@register("w13_overall_confidence", over("predicted", query="""
    select race_id, count(*) as n_active, cast(greatest(1, least(9, round_even(4.0 + 15.0 * (max(case when pred_rank = 1 then p_win end)
           - coalesce(max(case when pred_rank = 2 then p_win end), 0)) + avg(conf) / 3.0, 0))) as integer) as overall_conf,
           min_by(tab, pred_rank) as top_pick_tab, min_by(tab, early_rank) as leader_tab
    from predicted group by race_id"""))
def w13_overall_confidence(spark, d):
    return PR.race_summary(predictions(spark, d))


_NUMBERS = ["p_mkt", "p_tab", "p_bf", "p_fund", "p_win", "top2", "top3", "exp_pos", "fair", "ev_win"] + W.Z_COLUMNS + W.RAW_COLUMNS


@register("w14_predict", over("predicted", query=f"""
    select race_id, tab, box, horse, pred_rank, early_rank, conf, rec, {rounded(*_NUMBERS)} from predicted"""))
def w14_predict(spark, d):
    return tidy(predictions(spark, d), *RUNNER, "box", "horse", "pred_rank", "early_rank", "conf", "rec", *_NUMBERS)


def _fixed(x: str, digits: int = 1, sign: str = "") -> str:
    return f"printf('%{sign}.{digits}f', {x})"


_WHY = f"""'Projected early position ' || early_rank || ' of ' || n_active || '. Current box ' || box || ' history: '
        || {_fixed('box_win_rate * 100')} || '% win, ' || {_fixed('box_place_rate * 100')} || '% top-3 equivalent over ' || box_starts
        || ' starts. Market ' || {_fixed('p_mkt * 100')} || '% vs fundamental ' || {_fixed('p_fund * 100')} || '%; blended win '
        || {_fixed('p_win * 100')} || '%.' || case when quick > 0 or slow > 0
           then ' Recent steward starts: ' || quick || ' quick / ' || slow || ' slow to begin.' else '' end
        || ' Model fair odds $' || {_fixed('fair', 2)} || '; listed exchange odds $' || {_fixed('bf_odds', 2)} || '; EV '
        || {_fixed('ev_win', 2, '+')} || '.'"""


@register("t30_explain_text", over("predicted", query=f"select race_id, tab, {_WHY} as why from predicted"))
def t30_explain_text(spark, d):
    return predictions(spark, d).select(*RUNNER, "why")


_VIEW = {"p": (("predicted",), "select * from predicted")}


def _times100(**columns: str) -> str:
    return ", ".join(f'round({c} * 100 + 1e-11, 8) + 0.0 as "{name}"' for name, c in columns.items())


@register("f4_prediction_view", over("predicted", query="""
    select race_id, pred_rank as "Pred", tab as "Tab", box as "Box", horse as "Greyhound", early_rank as "Early", """
    + _times100(**{"Market%": "p_mkt", "Fund%": "p_fund", "Win%": "p_win", "Top2%": "top2", "Top3%": "top3"}) + """,
    round(exp_pos + 1e-11, 8) as "E[pos]", round(fair + 1e-11, 8) as "Fair$", bf_odds as "BF$", round(ev_win + 1e-11, 8) + 0.0 as "EV", conf as "Conf", """
    + ", ".join(f'round({c} + 1e-11, 8) + 0.0 as "{n}"' for n, c in (("Speed Z", "speed_z"), ("Early Z", "early_z"), ("Box Z", "box_z"),
                                                             ("C&D Z", "trackdist_z"), ("Form Z", "form_z")))
    + ', rec as "Recommendation" from predicted'))
def f4_prediction_view(spark, d):
    return tidy(V.prediction_view(predictions(spark, d)))


@register("f5_speed_map_view", over("predicted", query="""
    select race_id, early_rank as "Early Rank", box as "Box", horse as "Greyhound", round(early_raw + 1e-11, 8) + 0.0 as "Early Score", """
    + _times100(**{"Win%": "p_win"}) + " from predicted"))
def f5_speed_map_view(spark, d):
    return tidy(V.speed_map_view(predictions(spark, d)))


@register("f6_explain_view", over("predicted", query="""
    select race_id, pred_rank as "Pred", rec as "Recommendation", pred_rank || '. Box ' || box || ' · ' || horse || ' — Win '
        || """ + _fixed("p_win * 100") + """ || '% · ' || rec as "Heading", """
    + ", ".join(f'round({c} + 1e-11, 8) + 0.0 as "{n}"' for n, c in (
        ("Speed Z", "speed_z"), ("Early Z", "early_z"), ("Box Z", "box_z"), ("Track/Dist Z", "trackdist_z"),
        ("Form Z", "form_z"), ("Trainer Z", "trainer_z"), ("Freshness Z", "freshness_z")))
    + f', {_WHY} as "Why" from predicted'))
def f6_explain_view(spark, d):
    return tidy(V.explain_view(predictions(spark, d)))


@register("f7_race_metrics", over("runners", "predicted", query="""
    select race_id, listed, active, scratched, leader, top_pick from (
        select race_id, count(*) as listed, cast(count_if(not scratched) as bigint) as active, cast(count_if(scratched) as bigint) as scratched from runners group by race_id)
    left join (select race_id, min_by(horse, early_rank) as leader, min_by(horse, pred_rank) as top_pick from predicted group by race_id)
    using (race_id)"""))
def f7_race_metrics(spark, d):
    return V.race_metrics(B.runners(spark, d), predictions(spark, d))


@register("f3_parsed_view", over("runners", "records", "box_counts", "recent", query="""
    select r.race_id, r.tab as "Tab", nullif(r.box, 0) as "Box", horse as "Greyhound", case when scratched then 'Y' else '' end as "Scr",
        weight as "Wt", trainer as "Trainer", tab_odds as "TAB$", bf_odds as "BF$", form as "Form",
        round(trainer_win * 100 + 1e-11, 8) as "Tra W%", round(trainer_place * 100 + 1e-11, 8) as "Tra P%", nullif(tra_dist_best, 0) as "Tra/Dist Best",
        '0-0-0' as "Career", """ + ", ".join(
        f"coalesce((select wins || '-' || places23 || '-' || starts from records c where c.race_id = r.race_id and c.tab = r.tab and kind = '{k}'), '0-0-0') as \"{n}\""
        for k, n in (("course", "Course"), ("distance", "Dist"), ("course_distance", "C&D"))) + """,
        dls as "DLS", coalesce(b.wins || '-' || b.starts, '0-0') as "Box W-S", finish as "Last Fin", margin as "Last Mgn",
        round(mrk_delta + 1e-11, 8) as "Last MRKΔ", round(first_split + 1e-11, 8) as "Last Split", settle_pos as "Last Settle", coalesce(stewards, '') as "Last Note"
    from runners r left join box_counts b on b.race_id = r.race_id and b.tab = r.tab and b.box = r.box
    left join (select * from recent where k = 0) l on l.race_id = r.race_id and l.tab = r.tab"""))
def f3_parsed_view(spark, d):
    return tidy(V.parsed_view(B.runners(spark, d), B.records(spark, d), B.box_counts(spark, d), B.recent(spark, d)))


@register("t29_race_labels", over("races", query="""
    select race_id, track || case when race_id % 4 <> 0 then ' · R' || race_id % 4 else '' end
           || case when race_id % 5 = 0 then '' else ' · CUP ' || race_id end as title,
           distance_m || 'm' || case when race_id % 2 = 0 then ' | GRASS' else '' end || ' | GOOD' as subtitle from races"""))
def t29_race_labels(spark, d):
    i = F.col("race_id")
    races = B.races(spark, d).withColumns({
        "race_no": (i % 4).cast("int"),
        "race_name": F.when(i % 5 != 0, F.concat(F.lit("CUP "), i.cast("string"))),
        "surface": F.when(i % 2 == 0, "GRASS"), "going": F.lit("GOOD"), "race_type": F.lit(""),
        "prize": F.lit(None).cast("string"), "date": F.lit(None).cast("string"),
    })
    return V.race_labels(races).select("race_id", "title", "subtitle")


# --- events as captures and notes ----------------------------------------------------------------------------

@register("s4_latest_capture", """
    select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def s4_latest_capture(spark, d):
    ev = B.table(spark, d, "events")
    return latest_capture(ev, "user_id", "ts", F.col("event_id").desc()).select("user_id", "event_id", "event_type", "value")


@register("t28_flag_phrases", """
    select user_id, cast(sum(case when contains(lower(event_type), 'click') then 1 else 0 end) as bigint) as quick,
           cast(sum(case when contains(lower(event_type), 'err') or contains(lower(event_type), 'view') then 1 else 0 end) as bigint) as slow
    from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 6) group by user_id""")
def t28_flag_phrases(spark, d):
    from formfield.functions.text import flag_phrases

    newest = H.take_recent(
        B.table(spark, d, "events"), ["user_id"], 6, [F.col("ts").desc(), F.col("event_id").desc()]
    )
    return newest.groupBy("user_id").agg(
        F.sum(flag_phrases("event_type", ("click",))).alias("quick"),
        F.sum(flag_phrases("event_type", ("err", "view"))).alias("slow"),
    )
