"""Form pages written by Spark from the test tables, to be read back by the extraction.

Nine customers make a page, and a customer's six newest orders are its shown runs, so a
page is bounded by its keys. The field table takes one of five layouts by race number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suite import bindings as B

KEY = ["race_id", "tab"]


def _f(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in cols])


def ordinal(n: Column) -> Column:
    suffix = (
        F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def run_line(alias_of_settled: str = "settle_pos") -> Column:
    """The metrics line of a past run; a missing value has no entry."""
    return F.concat_ws(
        " ",
        F.date_format("run_day", "dd MMM yyyy"), F.lit("(7d ago)"), F.col("track"), F.lit("(AUSTRALIA):"),
        _f("Margin %.1fL Distance %dm Surface AW SOT G", "margin", "distance"),
        _f("Class GR %d Prize AUD $1,530 API 0.24", "field"),
        _f("Race Time %d:%05.2f BOM %.2fsec", F.expr("o_orderkey % 2"), F.expr("20 + o_orderkey % 500 / 100D"), F.expr("19 + o_orderkey % 700 / 100D")),
        F.when(F.col("bom_adj").isNotNull(), _f("BOM Time Adj %+.2fsec", "bom_adj")),
        _f("Runner Time %.2f 1st Split %.2f R.WT %.1fkg", F.expr("21 + o_orderkey % 600 / 100D"), "first_split", F.expr("25 + o_orderkey % 90 / 10D")),
        _f("BP %d SP $%.2f Trainer SOME ONE", "prior_box", F.expr("1 + o_orderkey % 3000 / 100D")),
        F.when(F.col("stewards").isNotNull(), F.concat(F.lit("Stewards "), F.col("stewards"), F.lit("."))),
        F.lit("Inrunning Position"),
        F.when(F.col(alias_of_settled).isNotNull(), F.concat(ordinal(F.col(alias_of_settled)), F.lit(" Place on settling"))),
        F.when(
            F.col(alias_of_settled).isNotNull() & (F.col("o_orderkey") % 3 == 0),
            F.concat(ordinal(F.col("field")), F.lit(" Place on turn")),
        ),
        F.lit("Runner Sectional 5.31sec Race/Horse Sectionals: L3m (16.91 3rd) |"),
        F.concat(F.lit("L1m (5.31 "), ordinal(F.col("prior_box")), F.lit(")")),
    )


def run_text() -> Column:
    """A past run as page lines: finish, age of the run, mark, metrics, comment."""
    return F.concat_ws(
        "\n", _f("%d of %d", "finish", "field"), F.lit("7d"), F.lit("MRK"),
        F.concat(ordinal((F.col("o_orderkey") % 40 + 1)), _f(" %+.2f", "mrk_delta")),
        run_line(), F.lit("| Your Comment: Comment"),
    )


def _run_sections(spark, d) -> DataFrame:
    runs = B.recent(spark, d).select(*KEY, "k", run_text().alias("text"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("runs")).select(
        *KEY, F.array_join(F.transform("runs", lambda r: r["text"]), "\n").alias("runs")
    )


def _record_strips(spark, d) -> DataFrame:
    aggs = [
        F.max(F.when(F.col("kind") == k, F.col("display"))).alias(k) for k in ("course", "distance", "course_distance")
    ]
    by_kind = B.records(spark, d).groupBy(*KEY).agg(*aggs)
    return B.career(spark, d).select(*KEY, "wins", "places23", "starts").join(by_kind, KEY, "full")


def _box_rows(spark, d) -> DataFrame:
    def row(label, part):
        cells = [F.coalesce(F.sum(F.when(F.col("box") == b, F.col(part))), F.lit(0)).cast("string") for b in range(1, 9)]
        return F.concat_ws("\t", F.lit(label), *cells).alias(part)

    rows = B.box_counts(spark, d).groupBy(*KEY).agg(
        row("Win", "wins"), row("2nd/3rd", "places23"), row("Starts", "starts")
    )
    return rows.select(*KEY, F.concat_ws("\n", "wins", "places23", "starts").alias("box_rows"))


def has_block() -> Column:
    return F.col("form").cast("int") % 50 != 7


def shown_market() -> Column:
    """Some runners show a bookmaker price, which is not an exchange price."""
    return F.when(F.col("form").cast("int") % 10 == 3, "Tab$").otherwise("betfair$")


def _blocks(spark, d) -> DataFrame:
    df = B.runners(spark, d).join(_run_sections(spark, d), KEY, "left").join(
        _record_strips(spark, d), KEY, "left").join(_box_rows(spark, d), KEY, "left")
    zero = F.lit("0-0-0")
    counts = F.coalesce(F.when(F.col("starts").isNotNull(), F.concat_ws("-", "wins", "places23", "starts")), zero)
    percent = F.concat(
        F.round(F.col("wins") * 100 / F.col("starts")).cast("int"), F.lit("%-"),
        F.round((F.col("wins") + F.col("places23")) * 100 / F.col("starts")).cast("int"), F.lit("%-"), F.col("starts"),
    )
    career = F.when(F.col("tab") % 2 == 0, F.coalesce(percent, zero)).otherwise(counts)
    best = F.col("tra_dist_best")
    df = df.withColumn("prize", (F.col("race_id") * 7 + F.col("tab") * 13) % 900 + 100)
    block = F.concat_ws(
        "\n",
        F.lit(""),
        F.col("form"),
        F.concat(shown_market(), _f("%.2f", F.when(F.col("scratched"), F.lit(4.2)).otherwise(F.col("bf_odds")))),
        F.concat(F.col("horse"), F.lit("  "), F.col("age"), F.lit("yo DK BDL D")),
        F.concat(F.lit("Trainer"), F.col("trainer")),
        F.concat(
            F.lit("Tra L50"), F.when(F.col("tab") == 5, "\n").otherwise(""),
            F.round(F.col("trainer_win") * 100).cast("int"), F.lit("%-"),
            F.round(F.col("trainer_place") * 100).cast("int"), F.lit("%-50"),
        ),
        F.when(best == 0, F.lit("Tra/Dist Best Time-")).otherwise(
            F.concat(F.lit("Tra/Dist Best Time\n"), F.when(F.col("tab") % 2 == 0, "0:").otherwise(""), _f("%.2f", best))),
        F.lit(""),
        F.lit("Box Stats\t1\t2\t3\t4\t5\t6\t7\t8"),
        F.col("box_rows"),
        F.lit("FiltersWPS WPS(%)"),
        F.concat(F.lit("Car\n"), career, F.lit("12m\n"), career, F.lit("Crs\n"), F.coalesce("course", zero), F.lit("Dist\n"),
                 F.coalesce("distance", zero), F.lit("Crs & Dist\n"), F.coalesce("course_distance", zero),
                 F.lit("FU\n0-0-02U\n1-0-13U\n0-1-1ClockW\n0-0-0AClockW\n0-0-0Dirt\n0-0-0Sand\n0-0-0")),
        F.lit("Facts"),
        F.concat(F.lit("Car PM\n$"), F.expr("prize div 10"), F.lit("."), F.col("prize") % 10,
                 F.when(F.col("tab") % 2 == 0, F.lit("k12m PM\n$1,196DLS\n")).otherwise(
                     F.concat(F.lit("k\n12m PM\n$"), F.col("prize") % 7 + 1, F.lit(".5M\nDLS\n"))), F.col("dls"),
                 F.lit("DLW\n20(3)ROI\n"), _f("%.2f%%", "roi_percent"), F.lit("For-Against\n20-17")),
        F.lit("Best Winning Times at Other Tracks"),
        F.when(F.col("tab") % 3 == 0, F.concat(F.lit("Days Since Last Run: "), F.col("dls") + 1, F.lit(" days ("), F.col("age"), F.lit("U)"))),
        F.col("runs"),
    )
    return df.withColumn("block", F.when(has_block(), block))


def _row(layout: Column) -> Column:
    price = F.when(F.col("scratched"), "Scr").otherwise(_f("%.2f", "tab_odds"))
    tab, horse, trainer, weight = F.col("tab").cast("string"), F.col("horse"), F.col("trainer"), _f("%.1f", "weight")
    spare = F.when(F.col("scratched"), "Scr").otherwise("")
    return (
        F.when(layout == 0, F.concat_ws("\t", tab, horse, weight, trainer, spare, price))
        .when(layout == 1, F.concat_ws("\t", tab, horse, F.lit("$45.5k"), trainer, F.lit("$64.3k"), spare, price))
        .when(layout == 2, F.concat(
            F.lit("| "), tab, F.lit(" | [**"), horse, F.lit("**](https://example.org/a) | "), weight, F.lit(" | ["), trainer,
            F.lit("](https://example.org/b) | "), spare, F.lit(" | "), price, F.lit(" |")))
        .when(layout == 3, F.concat_ws("\n", tab, horse, weight, trainer, F.when(F.col("scratched"), spare), price))
        .otherwise(F.concat_ws("   ", tab, horse, weight, trainer, price))
    )


def _table_header(layout: Column) -> Column:
    return (
        F.when(layout == 0, "Tab\tRunner\tWT\tTrainer\t\t")
        .when(layout == 1, "Tab\tRunner\tTot $PM\tTrainer\tTra L50\tBet\tTab")
        .when(layout == 2, "| Tab | Runner | WT | Trainer | | |\n| --- | --- | --- | --- | --- | --- |")
        .when(layout == 3, "Tab\nRunner\nWT\nTrainer")
        .otherwise("Field")
    )


def race_day() -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), (F.col("race_id") % 365).cast("int"))


#: Pages that a task writes, about 7 MB.
TASK_PAGES = 250


def partitions(spark, d) -> int:
    """How many tasks the pages are dealt over once, when they are brought together; what reads them keeps that dealing."""
    written = B.table(spark, d, "customer").count() // (B.FIELD * TASK_PAGES)
    return max(spark.sparkContext.defaultParallelism, written)


def pages(spark, d) -> DataFrame:
    """``page_id, captured_at, text``, one page per nine customers."""
    layout = F.col("race_id") % 5
    runners = _blocks(spark, d).select(*KEY, _row(layout).alias("row"), "block").repartition(partitions(spark, d), "race_id")
    fields = runners.groupBy("race_id").agg(F.sort_array(F.collect_list(F.struct("tab", "row", "block"))).alias("field"))
    df = fields.join(B.races(spark, d), "race_id")
    day = race_day()
    text = F.concat_ws(
        "\n",
        F.lit("Form\nRacing\nSearch for runners, trainer etc...\n"),
        F.concat(F.col("track"), F.lit(" Form Guide (Race "), (F.col("race_id") % 12 + 1).cast("string"), F.lit(") | Enhanced Form")),
        F.concat(F.date_format(day, "EEEE"), F.lit(", "), ordinal(F.dayofmonth(day)), F.date_format(day, " MMMM yyyy")),
        F.lit("Meeting Info\nRace 1\nFull Fields\n"),
        F.lit("9"),
        _f("%d:%02d", F.col("race_id") % 10 + 10, F.col("race_id") % 60),
        F.lit("(local)"),
        F.concat(F.lit("CUP NUMBER "), F.col("race_id").cast("string")),
        _f("Type: Grade %d Fastest Time: 0:%.2f Someone 05 June 2026", F.col("race_id") % 7, F.expr("22 + race_id % 300 / 100D")),
        _f(" AUD $%d,530", F.col("race_id") % 9 + 1),
        F.concat(F.col("distance_m"), F.lit("m ALL WEATHER "), F.when(F.col("race_id") % 2 == 0, "SLOW").otherwise("GOOD")),
        _table_header(layout),
        F.array_join(F.transform("field", lambda r: r["row"]), "\n"),
        F.lit("Explanations \n   Show 5 Runs Show 10 Runs Show All"),
        F.array_join(F.transform("field", lambda r: r["block"]), "\n"),
    )
    return df.select(
        F.col("race_id").cast("string").alias("page_id"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("race_id")).alias("captured_at"),
        text.alias("text"),
    )
