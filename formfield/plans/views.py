"""Display tables over extraction and prediction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions.numbers import finite, fixed_point

KEY = ["race_id", "tab"]


def _text(c) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _filled(*parts: Column) -> list[Column]:
    return [F.nullif(p, F.lit("")) for p in parts]


def race_labels(races: DataFrame) -> DataFrame:
    """Title and subtitle of a race from its non-empty parts."""
    number = F.when(F.col("race_no") != 0, F.concat(F.lit("R"), F.col("race_no")))
    metres = F.when(F.col("distance_m") != 0, F.concat(F.col("distance_m"), F.lit("m")))
    title = F.concat_ws(" · ", *_filled(F.btrim(_text("track")), _text(number), F.btrim(_text("race_name"))))
    rest = [_text(c) for c in ("surface", "going", "race_type", "prize", "date")]
    return races.withColumns({
        "title": F.when(title != "", title).otherwise("Parsed race"),
        "subtitle": F.concat_ws(" | ", *_filled(_text(metres), *rest)),
    })


def explain_text(df: DataFrame) -> DataFrame:
    """One paragraph per runner on why it is rated as it is."""
    parts = [
        F.format_string("Projected early position %d of %d.", "early_rank", "n_active"),
        F.format_string(
            "Current box %d history: %.1f%% win, %.1f%% top-3 equivalent over %d starts.",
            "box", fixed_point(_percent("box_win_rate"), 1), fixed_point(_percent("box_place_rate"), 1), "box_starts",
        ),
        F.format_string(
            "Market %.1f%% vs fundamental %.1f%%; blended win %.1f%%.",
            *[fixed_point(_percent(c), 1) for c in ("p_mkt", "p_fund", "p_win")],
        ),
        F.when(
            (F.col("quick") > 0) | (F.col("slow") > 0),
            F.format_string("Recent steward starts: %d quick / %d slow to begin.", "quick", "slow"),
        ),
        F.format_string(
            "Model fair odds $%.2f; listed exchange odds $%.2f; EV %+.2f.",
            *[fixed_point(x, 2) for x in ("fair", finite("bf_odds", K.NO_PRICE), "ev_win")],
        ),
    ]
    return df.withColumn("why", F.concat_ws(" ", *parts))


def parsed_view(runners: DataFrame, records: DataFrame, box_stats: DataFrame, runs: DataFrame) -> DataFrame:
    """The parsed-field display: 24 columns with own-box record and last run."""
    shown = ("career", "course", "distance", "course_distance")
    display = records.filter(F.col("kind").isin(*shown)).groupBy(*KEY).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("display"))).alias(k) for k in shown]
    )
    own = box_stats.select(*KEY, "box", F.concat_ws("-", "wins", "starts").alias("own_box"))
    last = runs.filter(F.col("k") == 0).select(
        *KEY, "finish", "margin", "mrk_delta", "first_split", "settle_pos", "stewards"
    )
    df = runners.join(display, KEY, "left").join(own, [*KEY, "box"], "left").join(last, KEY, "left")

    def record(kind):
        return F.coalesce(F.col(kind), F.lit(K.NO_RECORD))

    return df.select(
        "race_id",
        F.col("tab").alias("Tab"),
        F.when(F.col("box") != 0, F.col("box")).alias("Box"),
        F.col("horse").alias("Greyhound"),
        F.when(F.col("scratched"), "Y").otherwise("").alias("Scr"),
        F.col("weight").alias("Wt"),
        F.col("trainer").alias("Trainer"),
        F.col("tab_odds").alias("TAB$"),
        F.col("bf_odds").alias("BF$"),
        F.coalesce("form", F.lit("")).alias("Form"),
        (F.col("trainer_win") * 100).alias("Tra W%"),
        (F.col("trainer_place") * 100).alias("Tra P%"),
        F.when(F.col("tra_dist_best") != 0, F.col("tra_dist_best")).alias("Tra/Dist Best"),
        record("career").alias("Career"),
        record("course").alias("Course"),
        record("distance").alias("Dist"),
        record("course_distance").alias("C&D"),
        F.col("dls").alias("DLS"),
        F.coalesce("own_box", F.lit("0-0")).alias("Box W-S"),
        F.col("finish").alias("Last Fin"),
        F.col("margin").alias("Last Mgn"),
        F.col("mrk_delta").alias("Last MRKΔ"),
        F.col("first_split").alias("Last Split"),
        F.col("settle_pos").alias("Last Settle"),
        F.coalesce("stewards", F.lit("")).alias("Last Note"),
    )


def _percent(c: str) -> Column:
    return F.col(c) * 100


def prediction_view(predictions: DataFrame, ordered: bool = True) -> DataFrame:
    """The prediction display by predicted rank. Sorting is for people and files: leave it
    out (``ordered=False``) when the result feeds another job."""
    out = predictions.select(
        "race_id",
        F.col("pred_rank").alias("Pred"), F.col("tab").alias("Tab"), F.col("box").alias("Box"),
        F.col("horse").alias("Greyhound"), F.col("early_rank").alias("Early"),
        _percent("p_mkt").alias("Market%"), _percent("p_fund").alias("Fund%"), _percent("p_win").alias("Win%"),
        _percent("top2").alias("Top2%"), _percent("top3").alias("Top3%"), F.col("exp_pos").alias("E[pos]"),
        F.col("fair").alias("Fair$"), F.col("bf_odds").alias("BF$"), F.col("ev_win").alias("EV"),
        F.col("conf").alias("Conf"), F.col("speed_z").alias("Speed Z"), F.col("early_z").alias("Early Z"),
        F.col("box_z").alias("Box Z"), F.col("trackdist_z").alias("C&D Z"), F.col("form_z").alias("Form Z"),
        F.col("rec").alias("Recommendation"),
    )
    return out.orderBy("race_id", "Pred") if ordered else out


def speed_map_view(predictions: DataFrame, ordered: bool = True) -> DataFrame:
    out = predictions.select(
        "race_id", F.col("early_rank").alias("Early Rank"), F.col("box").alias("Box"),
        F.col("horse").alias("Greyhound"), F.col("early_raw").alias("Early Score"), _percent("p_win").alias("Win%"),
    )
    return out.orderBy("race_id", "Early Rank") if ordered else out


def explain_view(predictions: DataFrame, ordered: bool = True) -> DataFrame:
    heading = F.format_string(
        "%d. Box %d · %s — Win %.1f%% · %s", "pred_rank", "box", "horse",
        fixed_point(_percent("p_win"), 1), "rec",
    )
    out = predictions.select(
        "race_id", F.col("pred_rank").alias("Pred"), heading.alias("Heading"),
        F.col("rec").alias("Recommendation"), F.col("why").alias("Why"),
        F.col("speed_z").alias("Speed Z"), F.col("early_z").alias("Early Z"), F.col("box_z").alias("Box Z"),
        F.col("trackdist_z").alias("Track/Dist Z"), F.col("form_z").alias("Form Z"),
        F.col("trainer_z").alias("Trainer Z"), F.col("freshness_z").alias("Freshness Z"),
    )
    return out.orderBy("race_id", "Pred") if ordered else out


def listing_metrics(runners: DataFrame) -> DataFrame:
    """Listed, active and scratched counts per race."""
    off = F.coalesce(F.col("scratched"), F.lit(False))
    return runners.groupBy("race_id").agg(
        F.count("*").alias("listed"), F.count_if(~off).alias("active"), F.count_if(off).alias("scratched")
    )


def race_metrics(runners: DataFrame, predictions: DataFrame) -> DataFrame:
    """Listing counts with projected leader and top pick, where a race was predicted."""
    picks = predictions.groupBy("race_id").agg(
        F.min_by("horse", "early_rank").alias("leader"), F.min_by("horse", "pred_rank").alias("top_pick")
    )
    return listing_metrics(runners).join(picks, "race_id", "left")


def top1_per_race(predictions: DataFrame, rank: str = "pred_rank") -> DataFrame:
    """The row ranked first in each race: the top pick, or the leader by ``early_rank``."""
    return predictions.filter(F.col(rank) == 1)
