"""Runners and their history to ranked predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions.numbers import box_rates, finite, freshness_score, trainer_score, trackdist_score
from formfield.functions.text import parse_record
from formfield.groups import Groups, by_group_size
from formfield.operators import field as W
from formfield.operators.finish import LISTED_RUNNERS, finish_order_probs
from formfield.operators.history import history_aggregates, history_scores, with_targets
from formfield.operators.relational import own_box_stats
from formfield.plans.views import explain_text

KEY = ["race_id", "tab"]
SCORED_RECORDS = ("course_distance", "distance", "course")


def record_columns(records: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Counts of the three scored record kinds as columns, one row per runner."""
    aggs = []
    for kind in SCORED_RECORDS:
        for part in ("wins", "places23", "starts"):
            aggs.append(F.max(F.when(F.col("kind") == kind, F.col(part))).alias(f"{kind}_{part}"))
    return records.filter(F.col("kind").isin(*SCORED_RECORDS)).groupBy(*by).agg(*aggs)


def raw_components(
    runners: DataFrame, records: DataFrame, box_stats: DataFrame, runs: DataFrame, races: DataFrame,
    run_counts: DataFrame | None = None, negate_default: bool = False,
) -> DataFrame:
    """Active runners with the seven raw component scores and the facts behind them.

    History is reduced to one row per runner before it meets the runners. ``run_counts``
    gives ``n_runs`` of the full history where ``runs`` holds only its newest part.
    """
    scored = history_scores(with_targets(runs, races), KEY, negate_default)
    if run_counts is not None:
        scored = scored.drop("n_runs").join(run_counts, KEY, "full")
    df = W.active(runners).join(scored, KEY, "left")
    df = df.join(record_columns(records), KEY, "left")
    df = own_box_stats(df, box_stats)
    return with_raw_scores(df, negate_default)


#: What the scores read of a past run.
RUN_VALUES = ("k", "bom_adj", "mrk_delta", "distance", "track", "finish", "field", "margin", "settle_pos", "stewards")


def tagged_components(
    runners: DataFrame, records: DataFrame, box_stats: DataFrame, runs: DataFrame, races: DataFrame,
    run_counts: DataFrame | None = None, negate_default: bool = False,
) -> DataFrame:
    """The rows of :func:`raw_components` through one exchange and without a join.

    Runners, runs, records, box counts and races become one stream, each row with the columns of its own table. It is
    dealt by race once; the race's distance and track are then spread over its rows, and each runner's rows are reduced
    to one by what they are. What follows across the field works on the same dealing. A race lies in one task with its
    history, so this is the plan for races of ordinary size. ``runners`` holds a tab once.
    """
    facts = [c for c in runners.columns if c not in KEY]
    run_values = [F.col(c) if c in runs.columns else F.lit(None).alias(c) for c in RUN_VALUES]
    parts = [
        runners.select(*KEY, F.struct(*facts).alias("runner")),
        runs.select(*KEY, F.lit(True).alias("is_run"), *run_values),
        records.filter(F.col("kind").isin(*SCORED_RECORDS)).select(*KEY, F.struct("kind", "wins", "places23", "starts").alias("record")),
        box_stats.select(*KEY, F.struct("box", "wins", "places23", "starts").alias("in_box")),
        races.select("race_id", F.struct("distance_m", "track").alias("target")),
    ]
    if run_counts is not None:
        parts.append(run_counts.select(*KEY, F.col("n_runs").alias("run_count")))
    stream = parts[0]
    for part in parts[1:]:
        stream = stream.unionByName(part, allowMissingColumns=True)
    # The finer window first: its order serves the other one and the reduction too
    own_box = F.max("runner.box").over(Window.partitionBy(*KEY))
    target = F.max("target").over(Window.partitionBy("race_id"))
    stream = stream.withColumn("own_box", own_box).withColumn("target", target).filter("tab is not null").withColumns({
        "target_distance": F.col("target.distance_m"), "target_track": F.col("target.track"),
    })
    record, here = F.col("record"), F.col("in_box.box") == F.col("own_box")
    counts = {
        f"{kind}_{part}": F.max(F.when(record["kind"] == kind, record[part]))
        for kind in SCORED_RECORDS for part in ("wins", "places23", "starts")
    }
    counts |= {f"box_{part}": F.coalesce(F.max(F.when(here, F.col(f"in_box.{part}"))), F.lit(0)) for part in ("wins", "places23", "starts")}
    n_runs = F.count("is_run") if run_counts is None else F.max("run_count")
    scores = {**history_aggregates(negate_default), "n_runs": n_runs, **counts}
    each = stream.groupBy(*KEY).agg(F.first("runner", ignorenulls=True).alias("runner"), *[a.alias(n) for n, a in scores.items()])
    return with_raw_scores(each.filter("runner is not null").select(*KEY, "runner.*", *scores), negate_default)


def with_raw_scores(df: DataFrame, negate_default: bool = False) -> DataFrame:
    sign = -1.0 if negate_default else 1.0
    triples = {k: [f"{k}_{p}" for p in ("wins", "places23", "starts")] for k in SCORED_RECORDS}
    win, place = box_rates("box", "box_wins", "box_places23", "box_starts")
    return df.withColumns({
        "n_runs": F.coalesce("n_runs", F.lit(0)),
        "speed_raw": F.coalesce("speed_raw", F.lit(sign * (0.58 * 0.65 + 0.42 * 0.75))),
        "form_raw": F.coalesce("form_raw", F.lit(0.35)),
        "early_raw": F.coalesce("early_raw", F.lit(0.45)),
        "quick": F.coalesce("quick", F.lit(0)),
        "slow": F.coalesce("slow", F.lit(0)),
        "box_win_rate": win,
        "box_place_rate": place,
        "box_raw": win + 0.32 * place,
        "trackdist_raw": trackdist_score(*[triples[k] for k in SCORED_RECORDS]),
        "trainer_raw": trainer_score("trainer_win", "trainer_place"),
        "freshness_raw": freshness_score(finite("dls", K.DEFAULTS["dls"])),
        "cd_starts": F.coalesce("course_distance_starts", F.lit(0)),
    })


def score_field(df: DataFrame, g: Groups, alpha: float = K.MARKET_ALPHA) -> DataFrame:
    """Raw component scores to predictions, inside each race."""
    df = W.market_and_components(df, g)
    df = W.coverage_blend(df, g)
    df = W.pace_adjust(df, g)
    df = W.fundamental_probs(df, g)
    df = W.log_pool(df, g, "p_mkt", "p_fund", "p_win", alpha)
    df = W.rank_field(g.settle(df), g, "p_win", "pred_rank")
    df = finish_order_probs(df, g, "p_win", size="n_active")
    df = W.confidence(g.settle(df), g)
    return explain_text(W.classify(W.fair_and_ev(df)))


def by_race(runners: DataFrame, fn, *, bounded: bool = False) -> DataFrame:
    """``fn(active runners, groups)`` with the plan that fits the field sizes.

    Sizes are counted on the runners alone, before history is joined. ``bounded`` says that
    the source keeps races small (a page holds at most ten tabs), so nothing is counted.
    """
    live = W.active(runners)
    if bounded:
        return fn(live, Groups(["race_id"]))
    return by_group_size(live, ["race_id"], fn, LISTED_RUNNERS)


def predict(
    runners: DataFrame, records: DataFrame, box_stats: DataFrame, runs: DataFrame, races: DataFrame,
    alpha: float = K.MARKET_ALPHA, *, run_counts: DataFrame | None = None, negate_default: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Predictions of every race that has at least two active runners."""
    def run(live, g):
        components = raw_components if g.spread else tagged_components
        return score_field(components(live, records, box_stats, runs, races, run_counts, negate_default), g, alpha)

    return by_race(runners, run, bounded=bounded)


def rejected_forms(forms: DataFrame) -> DataFrame:
    """Races that :func:`predict_forms` leaves out: fewer than two active runners in the newest capture."""
    from formfield.plans.extract import latest_forms, runners

    return W.rejected_races(runners(latest_forms(forms)), ["race_id"])


def form_components(forms: DataFrame) -> DataFrame:
    """Active runners of nested forms with their raw component scores.

    Records and box counts are picked out of the runner's own arrays. Past runs are opened beside the race's distance
    and track and reduced again within the partitioning by race that ``forms`` has, so nothing is joined.
    """
    from formfield.plans.extract import NESTED, past_runs

    live = W.active(forms.filter("tab is not null"))
    facts = [c for c in live.columns if c not in NESTED and c not in KEY]
    own = F.filter("box_stats", lambda b: b["box"] == F.col("box"))
    counts = {f"box_{c}": F.coalesce(F.get(own, 0)[c], F.lit(0)) for c in ("wins", "places23", "starts")}
    texts = {k: F.get(F.filter("record_values", lambda r: r["kind"] == k), 0)["value"] for k in SCORED_RECORDS}
    live = live.select(
        *KEY, F.struct(*facts).alias("facts"), F.struct(*[v.alias(k) for k, v in counts.items()]).alias("own_box"),
        F.struct(*[v.alias(k) for k, v in texts.items()]).alias("texts"),
        F.col("race.distance_m").alias("target_distance"), F.col("race.track").alias("target_track"), "run_lines",
    )
    runs = past_runs(live, [*KEY, "facts", "own_box", "texts", "target_distance", "target_track"], without=True)
    whole = {c: F.first(c).alias(c) for c in ("facts", "own_box", "texts")}
    scores = {**history_aggregates(), "n_runs": F.count("k")}
    scored = runs.groupBy(*KEY).agg(*whole.values(), *[a.alias(n) for n, a in scores.items()])
    records = {k: parse_record(F.col(f"texts.{k}")) for k in SCORED_RECORDS}
    df = scored.withColumns(records).select(
        *KEY, "facts.*", "own_box.*", *scores,
        *[F.col(f"{k}.{p}").alias(f"{k}_{p}") for k in SCORED_RECORDS for p in ("wins", "places23", "starts")],
    )
    return with_raw_scores(df)


def predict_forms(forms: DataFrame, alpha: float = K.MARKET_ALPHA) -> DataFrame:
    """Predictions straight from the nested extraction, of the newest capture of each page.

    The forms are read once, and the one exchange is the one that brings a race together: choosing the capture, reducing
    the history and all steps across the field work within it. A page lists at most ten tabs, so races are small.
    """
    from formfield.plans.extract import latest_forms

    return score_field(form_components(latest_forms(forms)), Groups(["race_id"]), alpha)


def race_summary(predictions: DataFrame) -> DataFrame:
    return W.overall_confidence(predictions, ["race_id"])


PREDICTION_COLUMNS = [
    "race_id", "tab", "box", "horse", "p_mkt", "p_tab", "p_bf", "p_fund", "p_win", "top2", "top3", "exp_pos",
    "fair", "ev_win", "pred_rank", "early_rank", "conf", "rec", "why", *W.Z_COLUMNS, *W.RAW_COLUMNS,
]
