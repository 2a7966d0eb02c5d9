"""Pages to typed tables without a shuffle.

A page is one row, so everything that belongs to it is found inside that row: its lines,
the field table, the block of each runner and the runs in a block. The plan is a scan,
projections and one explode per output level. ``runner_forms`` is the nested result; write
it once and take the tall tables from it by column-pruned scans.

Arrays are opened by the outer generators, and empty ones are dropped by a filter on what
they produce. The inner generators imply a filter on their input, which would be pushed
down through every projection and compute the whole extraction once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions import layouts as L
from formfield.functions import patterns as P
from formfield.functions.numbers import listed_price
from formfield.functions.text import (
    clean_text, count_rows, extract, extract_comments, extract_facts, extract_metrics,
    first_line_after, let, parse_record, section, split_glued_pairs, split_lines, strip, to_number, to_seconds,
)


def explode_lines(df: DataFrame, col: str, key: str) -> DataFrame:
    """Numbered lines of a text column."""
    lines = df.select(key, F.posexplode_outer(split_lines(col)).alias("line_no", "line"))
    return lines.filter("line_no is not null")


def race_header(text: Column) -> Column:
    """Header fields of a cleaned page as a struct."""
    numbered = F.regexp_extract(text, P.TRACK_AND_RACE, 0)
    distance = F.regexp_extract(text, P.CONDITIONS, 0)
    date = F.regexp_extract(text, P.RACE_DATE, 0)
    day = F.regexp_extract(date, P.RACE_DATE, 2)
    plain_day = F.regexp_replace(day, r"(\d+)(?:st|nd|rd|th)\b", "$1")
    fastest = extract(text, P.FASTEST)
    prize = extract(text, P.PRIZE)
    track = F.when(numbered != "", extract(numbered, P.TRACK_AND_RACE, 1)).otherwise(extract(text, P.TRACK_ONLY))
    return F.struct(
        strip(track).alias("track"),
        extract(numbered, P.TRACK_AND_RACE, 2).try_cast("int").alias("race_no"),
        F.when(date != "", F.concat(F.regexp_extract(date, P.RACE_DATE, 1), F.lit(", "), day)).alias("date"),
        F.coalesce(
            F.try_to_timestamp(plain_day, F.lit("d MMMM yyyy")), F.try_to_timestamp(plain_day, F.lit("d MMM yyyy"))
        ).cast("date").alias("race_date"),
        extract(text, P.RACE_TIME).alias("time"),
        strip(extract(text, P.RACE_NAME)).alias("race_name"),
        strip(extract(text, P.RACE_TYPE)).alias("race_type"),
        fastest.alias("fastest_time"),
        to_seconds(fastest).alias("fastest_time_s"),
        F.concat(F.lit("AUD $"), prize).alias("prize"),
        to_number(prize, None).alias("prize_amount"),
        extract(distance, P.CONDITIONS, 1).try_cast("int").alias("distance_m"),
        F.upper(strip(extract(distance, P.CONDITIONS, 2))).alias("surface"),
        F.upper(extract(distance, P.CONDITIONS, 3)).alias("going"),
    )


def read_fields(pages: DataFrame) -> DataFrame:
    """Per page: cleaned text and lines, the header, and the runners of the first layout that
    yields any."""
    df = pages.withColumn("body", clean_text("text"))
    df = df.withColumn("lines", F.split("body", "\n"))
    df = df.withColumn("listed", L.pipe_table(F.col("text")))
    df = df.withColumn("columns", L.find_table_columns(F.col("lines"), F.col("body")))
    none = F.size("listed") == 0
    df = df.withColumn("listed", F.when(none, L.field_table(F.col("lines"), F.col("columns"))).otherwise(F.col("listed")))
    df = df.withColumn("listed", F.when(none, L.anchored_rows(F.col("lines"))).otherwise(F.col("listed")))
    df = df.withColumn("segment", F.when(none, L.table_segment(F.col("body"))))
    df = df.withColumn("listed", F.when(none, L.group_records(F.col("segment"))).otherwise(F.col("listed")))
    df = df.withColumn("listed", L.first_per_tab(F.col("listed")))
    return df.withColumn("listed", L.seat_reserves(F.col("listed"))).drop("columns", "segment")


def find_block_starts(lines: Column, runners: Column) -> Column:
    """``(tab, line)`` of the first ``NAME <n>yo`` line of each runner, in page order."""
    marked = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("name"), i.alias("line"))), lambda h: h["name"].rlike(P.BLOCK_MARK)
    )
    heads = F.transform(marked, lambda h: F.struct(
        F.upper(F.regexp_extract(h["name"], P.BLOCK_HEADER, 1)).alias("name"), h["line"].alias("line")))

    def of_runners(heads):
        return F.transform(runners, lambda r: F.struct(
            F.get(F.filter(heads, lambda h: h["name"] == r["horse"]), 0)["line"].alias("line"), r["tab"].alias("tab")
        ))

    return F.array_sort(F.filter(let(heads, of_runners), lambda s: s["line"].isNotNull()))


#: Lines before a block that are looked at first for the text before it.
NEAR_LINES = 12


def assign_blocks(df: DataFrame) -> DataFrame:
    """One row per listed runner with its own block: the text from its header to the next
    one's, the end of the text before it (PREFIX_CHARS, for form and price), and NULLs where the page has no block."""
    df = df.withColumn("starts", find_block_starts(F.col("lines"), F.col("listed")))
    keep = [c for c in df.columns if c not in ("text", "body", "lines", "listed", "starts")]
    df = df.select(*keep, "lines", "starts", F.posexplode_outer("listed").alias("listed_no", "runner"))
    own = F.get(F.filter("starts", lambda s: s["tab"] == F.col("runner")["tab"]), 0)["line"]
    df = df.withColumn("first", own)
    later = F.get(F.filter("starts", lambda s: s["line"] > F.col("first")), 0)["line"]
    first = F.col("first")
    near = F.array_join(F.slice("lines", F.greatest(first - NEAR_LINES, F.lit(0)) + 1, F.least(first, F.lit(NEAR_LINES))), "\n")
    df = df.withColumns({
        "block_lines": F.slice("lines", first + 1, F.coalesce(later, F.size("lines")) - first), "near": near,
    })
    # The lines next to the block nearly always hold enough; if not, all lines above it are taken
    enough = (first <= NEAR_LINES) | (F.length(F.rtrim("near", F.lit("\n"))) >= K.PREFIX_CHARS)
    above = F.when(enough, F.col("near")).otherwise(F.array_join(F.slice("lines", F.lit(1), first), "\n"))
    df = df.withColumn("above", above).drop("lines", "starts", "first", "near")
    df = df.withColumn("filled", F.rtrim("above", F.lit("\n")))
    return df.withColumns({
        "block": F.array_join("block_lines", "\n"),
        "before": F.right(F.concat("filled", F.lit("\n")), F.lit(K.PREFIX_CHARS)),
        "blank_lines": F.length("above") - F.length("filled"),
    }).drop("above", "filled")


def form_and_price(before: Column, block: Column, blank_lines: Column) -> Column:
    """Form figures and the market line: the last pair within reach before the block, or the
    first pair near its beginning (which can belong to the next runner, hence the flag)."""
    def pairs(text):
        return F.regexp_extract_all(text, F.lit(P.FORM_AND_PRICE), F.lit(0))

    last = F.try_element_at(pairs(F.right(before, F.lit(K.PREFIX_CHARS))), F.lit(-1))
    room = F.greatest(K.FALLBACK_CHARS - F.coalesce(blank_lines, F.lit(0)), F.lit(0))
    near = F.get(pairs(F.substr(block, F.lit(1), room)), 0)
    pair = F.coalesce(last, near)
    return F.struct(
        F.lower(extract(pair, P.FORM_AND_PRICE, 1)).alias("form"),
        F.lower(extract(pair, P.FORM_AND_PRICE, 2)).alias("market"),
        to_number(extract(pair, P.FORM_AND_PRICE, 3), None).alias("price"),
        (last.isNull() & pair.isNotNull()).alias("fallback"),
    )


def profile(block: Column) -> Column:
    """Age, colour, sex, trainer's last fifty and best time at track and distance."""
    line = F.regexp_extract(F.substring_index(block, "\n", 1), P.PROFILE, 0)
    glued = F.regexp_extract(block, P.TRAINER_L50, 0)
    below = first_line_after(block, "Tra L50")

    def last_fifty(group):
        return F.when(glued != "", extract(glued, P.TRAINER_L50, group)).otherwise(extract(below, P.TRIPLE, group))

    same_line = extract(block, P.BEST_TIME)
    next_line = first_line_after(block, "Tra/Dist Best Time")
    next_line = F.when(~next_line.rlike(P.DASHES), extract(next_line, P.ANY_TIME, 0))
    return F.struct(
        extract(line, P.PROFILE, 1).try_cast("int").alias("age"),
        strip(extract(line, P.PROFILE, 2)).alias("colour"),
        extract(line, P.PROFILE, 3).alias("sex"),
        (last_fifty(1).try_cast("double") / 100.0).alias("trainer_win"),
        (last_fifty(2).try_cast("double") / 100.0).alias("trainer_place"),
        last_fifty(3).try_cast("int").alias("trainer_l50_n"),
        to_seconds(F.coalesce(same_line, next_line)).alias("tra_dist_best"),
    )


def record_values(block: Column, strip_values: Column) -> Column:
    """Kind and written value of eight records: from the glued strip, else from the line after
    the label."""
    rows = []
    for i, label in enumerate(K.RECORD_LABELS):
        if label in K.RECORD_KINDS:
            value = F.coalesce(F.nullif(F.get(strip_values, i), F.lit("")), first_line_after(block, label))
            rows.append(F.struct(F.lit(K.RECORD_KINDS[label]).alias("kind"), value.alias("value")))
    return F.array(*rows)


def unpivot_counts(block: Column) -> Column:
    """Three labelled rows of eight counts as one struct per box."""
    rows = {"wins": "Win", "places23": "2nd/3rd", "starts": "Starts"}
    cells = F.arrays_zip(
        F.sequence(F.lit(1), F.lit(K.MAX_BOX)).alias("box"),
        *[F.coalesce(count_rows(block, label), F.array_repeat(F.lit(0), K.MAX_BOX)).alias(name) for name, label in rows.items()],
    )
    return F.transform(cells, lambda x: F.struct(*[
        F.coalesce(x[c], F.lit(0)).cast("int").alias(c) for c in ("box", "wins", "places23", "starts")
    ]))


def resolve_freshness(block: Column, facts: Column) -> Column:
    """Days since the last run (written text beats the fact strip, which beats the label line),
    days since the last win, and runs in this campaign."""
    written = F.regexp_extract(block, P.DAYS_SINCE, 0)

    def labelled(label):
        return extract(first_line_after(block, label), r"\d+", 0).try_cast("int")

    return F.struct(
        F.coalesce(extract(written, P.DAYS_SINCE, 1).try_cast("int"), facts["dls"], labelled("DLS")).alias("dls"),
        F.coalesce(facts["dlw"], labelled("DLW")).alias("dlw"),
        extract(written, P.DAYS_SINCE, 2).try_cast("int").alias("runs_this_prep"),
    )


def run_lines(lines: Column, lookback: int = K.RUN_LOOKBACK) -> Column:
    """Run lines of a block with the nearest finish and mark lines before each, newest first."""
    def is_run(x):
        found = ~F.contains(x, F.lit(P.TRIAL_WORD))
        for word in P.RUN_WORDS:
            found = found & F.contains(x, F.lit(word))
        return found

    numbered = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda r: is_run(r["line"])
    )

    def with_context(r, k):
        first = F.greatest(r["i"] - lookback, F.lit(0))
        above = F.slice(lines, first + 1, r["i"] - first)

        def nearest(pattern):
            return F.try_element_at(F.filter(above, lambda x: x.rlike(pattern)), F.lit(-1))

        return F.struct(
            k.cast("int").alias("k"), r["line"].alias("line"),
            nearest(P.FINISH_LINE).alias("finish_line"), nearest(P.MARK_LINE).alias("mark_line"),
        )

    return F.transform(numbered, with_context)


def past_runs(df: DataFrame, keep: list[str], without: bool = False) -> DataFrame:
    """Typed fields of past runs, one row per entry of ``run_lines``; with ``without`` also one of NULLs where there is none."""
    df = df.select(*keep, F.inline_outer("run_lines"))
    df = df if without else df.filter("k is not null")
    line = F.col("line")
    df = extract_metrics(df, "line").withColumn("notes", extract_comments(line))
    return df.select(
        *keep, "k",
        extract(line, P.RUN_DATE).alias("run_date"),
        F.upper(strip(extract(line, P.RUN_TRACK))).alias("track"),
        F.regexp_extract("finish_line", P.FINISH_LINE, 1).try_cast("int").alias("finish"),
        F.regexp_extract("finish_line", P.FINISH_LINE, 2).try_cast("int").alias("field"),
        F.regexp_extract("mark_line", P.MARK_LINE, 1).try_cast("int").alias("mrk_rank"),
        F.regexp_extract("mark_line", P.MARK_LINE, 2).try_cast("double").alias("mrk_delta"),
        *P.RUN_METRICS, "notes.*",
    )


def runner_forms(pages: DataFrame) -> DataFrame:
    """One row per listed runner: header, market, profile, records, box counts and the lines of
    its past runs.

    A page without a field table keeps one row with a NULL tab.
    """
    df = read_fields(pages)
    df = df.withColumns({"race": race_header(F.col("body")), "page_hash": F.xxhash64("body")})
    df = assign_blocks(df)
    block = F.col("block")
    df = df.withColumn("pair", form_and_price(F.col("before"), block, F.col("blank_lines")))
    df = df.withColumn("facts_text", section(block, P.FACTS))
    df = df.withColumn("strip_values", split_glued_pairs(section(block, P.FILTERS)))
    df = df.withColumn("facts", extract_facts("facts_text"))
    df = df.withColumn("fresh", resolve_freshness(block, F.col("facts")))
    df = df.withColumn("profile", profile(block))
    df = df.withColumn("run_lines", run_lines(F.col("block_lines")))
    known = block.isNotNull()
    runner, pair = F.col("runner"), F.col("pair")
    tab_odds = listed_price(runner["tab_odds"], F.when(pair["market"] == "tab", pair["price"]))
    bf_price = F.when(F.coalesce(pair["market"], F.lit("")) != "tab", pair["price"])
    return df.select(
        F.col("page_id").alias("race_id"), "captured_at", "page_hash", "race", "listed_no", "runner.tab", "runner.box",
        "runner.horse", "runner.weight", "runner.trainer", "runner.scratched", "runner.reserve_into_box",
        F.when(runner["scratched"], K.NO_PRICE).otherwise(tab_odds).alias("tab_odds"),
        F.when(runner["scratched"], K.NO_PRICE).otherwise(F.coalesce(bf_price, tab_odds)).alias("bf_odds"),
        bf_price.isNull().alias("bf_is_proxy"),
        F.coalesce(pair["form"], F.lit(K.DEFAULTS["form"])).alias("form"),
        pair["fallback"].alias("form_is_fallback"),
        "profile.age", "profile.colour", "profile.sex",
        F.coalesce("profile.trainer_win", F.lit(K.DEFAULTS["trainer_win"])).alias("trainer_win"),
        F.coalesce("profile.trainer_place", F.lit(K.DEFAULTS["trainer_place"])).alias("trainer_place"),
        "profile.trainer_l50_n",
        F.coalesce("profile.tra_dist_best", F.lit(K.DEFAULTS["tra_dist_best"])).alias("tra_dist_best"),
        F.coalesce("fresh.dls", F.lit(K.DEFAULTS["dls"])).alias("dls"),
        "fresh.dlw", "fresh.runs_this_prep", "facts.roi", "facts.career_pm", "facts.pm_12m",
        known.alias("has_detail"),
        record_values(block, F.col("strip_values")).alias("record_values"),
        unpivot_counts(block).alias("box_stats"),
        "run_lines",
    )


NESTED = ("captured_at", "page_hash", "race", "listed_no", "record_values", "box_stats", "run_lines")


def latest_forms(forms: DataFrame) -> DataFrame:
    """The rows of the newest capture of each page, each listed runner once.

    One exchange on ``race_id``, which whatever works inside a race shares. Of captures of the same time one is taken.
    """
    capture = F.struct("captured_at", "page_hash")
    page, runner = Window.partitionBy("race_id"), Window.partitionBy("race_id", "listed_no", "tab").orderBy("captured_at")
    dealt = forms.repartition("race_id").withColumns({"__newest": F.max(capture).over(page), "__this": capture})
    newest = dealt.filter(F.col("__this").eqNullSafe(F.col("__newest"))).drop("__newest", "__this")
    return newest.withColumn("__copy", F.row_number().over(runner)).filter("__copy = 1").drop("__copy")


def races(forms: DataFrame) -> DataFrame:
    """One row per page, taken from its first listed runner (or from its empty row)."""
    return forms.filter(F.coalesce("listed_no", F.lit(0)) == 0).select("race_id", "captured_at", "race.*")


def runners(forms: DataFrame) -> DataFrame:
    return forms.filter("tab is not null").select(*[c for c in forms.columns if c not in NESTED], "listed_no")


def _tall(forms: DataFrame, column: str) -> DataFrame:
    return forms.filter("tab is not null").select("race_id", "tab", F.inline_outer(column))


def runner_records(forms: DataFrame) -> DataFrame:
    tall = _tall(forms, "record_values").withColumn("record", parse_record("value"))
    return tall.select("race_id", "tab", "kind", "record.*")


def box_stats(forms: DataFrame) -> DataFrame:
    return _tall(forms, "box_stats")


def recent_runs(forms: DataFrame) -> DataFrame:
    return past_runs(forms, ["race_id", "tab"])


def extract_tables(forms: DataFrame) -> dict[str, DataFrame]:
    """The tall tables of the nested result, of the newest capture of each page."""
    forms = latest_forms(forms)
    return {
        "races": races(forms), "runners": runners(forms), "runner_records": runner_records(forms),
        "box_stats": box_stats(forms), "recent_runs": recent_runs(forms),
    }
