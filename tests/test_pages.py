import datetime

import pytest
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions import patterns as PT
from formfield.plans import extract as E
from formfield.plans.predict import predict_forms, race_summary, rejected_forms
from formfield.plans.views import parsed_view
from formfield.operators.relational import quality_warnings
from tests import page_writer as P

LAYOUTS = ("weight", "money", "pipe", "anchor", "cells")
SPLIT_HEADER_GAP = "\n" * 3


@pytest.fixture(scope="module")
def tables(spark):
    now = datetime.datetime(2026, 8, 25)
    rows = [(f"{n}-{layout}", now, P.page(field, layout)) for n, field in (("A", P.FIELD_A), ("B", P.FIELD_B)) for layout in LAYOUTS]
    rows.append(("bare", now, P.page(P.FIELD_A[:4], "weight", with_blocks=False)))
    rows.append(("empty", now, "no table here\n" * 40))
    late = [dict(r) for r in P.FIELD_B]
    text = P.page(late, "money").replace("\nLAUNCH MODE  2yo", SPLIT_HEADER_GAP + "LAUNCH MODE  2yo").replace("Tra L5014%-54%-50", "Tra L50\n\n14%-54%-50")
    rows.append(("gaps", now, text))
    pages = spark.createDataFrame(rows, "page_id string, captured_at timestamp, text string")
    forms = E.runner_forms(pages).cache()
    return {"forms": forms, **{k: v for k, v in E.extract_tables(forms).items()}}


def by_key(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


@pytest.mark.parametrize("name,field", [("A", P.FIELD_A), ("B", P.FIELD_B)])
def test_golden_values_in_every_layout(tables, name, field):
    runners = by_key(tables["runners"], "race_id", "tab")
    records = by_key(tables["runner_records"], "race_id", "tab", "kind")
    boxes = by_key(tables["box_stats"], "race_id", "tab", "box")
    runs = by_key(tables["recent_runs"], "race_id", "tab", "k")
    for layout in LAYOUTS:
        race = f"{name}-{layout}"
        assert sum(k[0] == race for k in runners) == len(field)
        for want in field:
            got = runners[race, want["tab"]]
            assert (got.horse, got.scratched, got.form) == (want["name"], want["scratched"], want["form"])
            assert got.trainer_win == pytest.approx(want["profile"][0] / 100) and got.trainer_place == pytest.approx(want["profile"][1] / 100)
            assert got.tra_dist_best == pytest.approx(float(want["best"] or 0))
            if want["scratched"]:
                assert (got.tab_odds, got.bf_odds) == (999.0, 999.0)
                continue
            assert got.bf_odds == pytest.approx(float(want["market"].split("$")[1]))
            # an integer price on its own line closes a record of the one-cell layout, so it is written with a dollar sign
            assert got.tab_odds == pytest.approx(float(want["listed"]))
            assert got.weight == (None if layout == "money" else 27.5)
            assert got.dls == want["dls"]
            box = want["box"]
            assert got.box == box[0]
            own = boxes[race, want["tab"], got.box]
            assert (own.wins, own.starts) == box[1:]
            for kind, text in zip(("career", "course", "distance", "course_distance"), want["records"]):
                assert records[race, want["tab"], kind].display == text
            last = runs[race, want["tab"], 0]
            assert (last.finish, last.field, last.margin, last.mrk_delta, last.first_split, last.settle_pos) == want["last"]


def test_trial_is_no_run_and_second_run_is_typed(tables):
    runs = tables["recent_runs"].filter("race_id = 'A-weight' and tab = 1").orderBy("k").collect()
    assert len(runs) == 2
    r = runs[1]
    assert (r.stewards, r.settle_pos, r.turn_pos, r.split_rank, r.mrk_rank) == ("Slow to begin; Checked", 2, 5, 6, 3)
    assert (r.track, r.run_date, r.distance, r.race_time, r.bom, r.bom_adj, r.sp, r["class"]) == (
        "Q PARK", "18 Aug 2026", 520, 30.02, 29.52, 0.5, 4.6, "GR 5")


def test_header(tables):
    r = tables["races"].filter("race_id = 'B-money'").first()
    assert (r.track, r.race_no, r.date, r.race_date, r.time) == (
        "Q Lakeside", 9, "Tuesday, 25th August 2026", datetime.date(2026, 8, 25), "17:55")
    assert (r.race_name, r.race_type, r.fastest_time_s, r.prize, r.prize_amount) == ("SOME CUP", "5th Grade", 30.18, "AUD $7,000", 7000.0)
    assert (r.distance_m, r.surface, r.going) == (550, "ALL WEATHER", "GOOD")


def test_reserve_takes_the_first_vacant_box(tables):
    r = tables["runners"].filter("race_id = 'A-weight' and tab = 9").first()
    assert (r.box, r.reserve_into_box) == (2, True)


def test_blank_lines_before_a_block_and_next_line_values(tables):
    r = tables["runners"].filter("race_id = 'gaps' and tab = 2").first()
    assert (r.form, r.bf_odds, r.form_is_fallback) == ("22428", 15.5, False)
    assert (r.trainer_win, r.trainer_place, r.trainer_l50_n) == (0.14, 0.54, 50)


def test_defaults_without_detail(tables):
    r = tables["runners"].filter("race_id = 'bare' and tab = 3").first()
    assert (r.form, r.bf_odds, r.bf_is_proxy, r.dls, r.tra_dist_best, r.has_detail) == ("", 61.0, True, 14, 0.0, False)
    assert (r.trainer_win, r.trainer_place) == (0.10, 0.35)


def test_warnings(tables):
    runners = E.runners(tables["forms"].withColumn("n_runs", F.size("run_lines")))
    got = {(r.race_id, r.code, r.tab) for r in quality_warnings(runners, tables["races"]).collect()}
    assert ("empty", "no_table", None) in got
    assert {("bare", "no_detail", t) for t in (1, 2, 3, 4)} <= got
    assert ("bare", "details_missing", None) in got and ("A-weight", "few_runs", None) in got
    assert not any(code in ("tab_gap", "unassigned_reserve") for _, code, _ in got)


def test_predictions_of_pages(tables):
    p = predict_forms(tables["forms"]).cache()
    sums = p.groupBy("race_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("p_win", "top2", "top3", "exp_pos")]).collect()
    assert len(sums) == 12
    for r in sums:
        assert r.p_win == pytest.approx(1) and r.top2 == pytest.approx(2) and r.top3 == pytest.approx(3)
        assert r.exp_pos == pytest.approx(r.n * (r.n + 1) / 2)
    best = {r.race_id: r.horse for r in p.filter("pred_rank = 1").collect()}
    assert best["A-weight"] == best["A-pipe"] == "SCARY STORM" and best["B-money"] == "NANGAR ZARA"
    summary = {r.race_id: r for r in race_summary(p).collect()}
    assert summary["A-weight"].n_active == 7 and 1 <= summary["A-weight"].overall_conf <= 9


def test_parsed_view(tables):
    df = parsed_view(tables["runners"], tables["runner_records"], tables["box_stats"], tables["recent_runs"])
    assert len(df.columns) == 25  # race_id and 24 display columns
    r = df.filter("race_id = 'A-weight' and Tab = 9").first()
    assert (r["Box"], r["Box W-S"], r["Career"], r["Last Fin"], r["Scr"]) == (2, "1-3", "5%-26%-19", 6, "")


def test_extraction_needs_no_shuffle(tables, spark):
    pages = spark.createDataFrame([("x", datetime.datetime(2026, 1, 1), "t")], "page_id string, captured_at timestamp, text string")
    plan = E.runner_forms(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("label", ["Runner", "Dog", "GREYHOUND"])
def test_header_with_blanks_before_the_tab_and_other_labels(spark, label):
    now = datetime.datetime(2026, 8, 25)
    rows = []
    for name, field, layout in (("A", P.FIELD_A, "weight"), ("B", P.FIELD_B, "money")):
        text = P.page(field, layout)
        assert "\nTab\tRunner\t" in text
        rows.append((name, now, text.replace("\nTab\tRunner\t", f"\ntAB \t {label} \t")))
    forms = E.runner_forms(spark.createDataFrame(rows, "page_id string, captured_at timestamp, text string"))
    got = by_key(E.runners(forms), "race_id", "tab")
    for name, field in (("A", P.FIELD_A), ("B", P.FIELD_B)):
        assert {k[1] for k in got if k[0] == name} == {r["tab"] for r in field}
        for want in field:
            runner = got[name, want["tab"]]
            assert runner.horse == want["name"] and runner.weight == (27.5 if name == "A" else None)


def test_only_the_newest_capture_counts(spark):
    day = datetime.datetime(2026, 8, 25)
    one = P.page(P.FIELD_A, "weight")
    old = one.replace("betfair$22", "betfair$2").replace("\nFADE OUT", "\nOLD NAME")
    kind = "page_id string, captured_at timestamp, text string"
    plain = spark.createDataFrame([("A", day, one), ("B", day, P.page(P.FIELD_B, "money"))], kind)
    more = plain.union(spark.createDataFrame([("A", day - datetime.timedelta(hours=1), old), ("A", day, one), ("A", None, old)], kind))
    a, b = (sorted(predict_forms(E.runner_forms(p)).collect(), key=lambda r: (r.race_id, r.tab)) for p in (plain, more))
    assert len(a) == 14 and a == b
    assert {k: d.count() for k, d in E.extract_tables(E.runner_forms(more)).items()} == {
        k: d.count() for k, d in E.extract_tables(E.runner_forms(plain)).items()
    }


def test_forms_are_predicted_with_one_exchange_and_no_join(spark, tmp_path):
    pages = spark.createDataFrame([("A", datetime.datetime(2026, 8, 25), P.page(P.FIELD_A, "weight"))], "page_id string, captured_at timestamp, text string")
    E.runner_forms(pages).write.parquet(str(tmp_path / "forms"))
    plan = predict_forms(spark.read.parquet(str(tmp_path / "forms")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("FileScan") == 1


def test_races_that_are_too_small_are_returned(spark):
    day = datetime.datetime(2026, 8, 25)
    lone = [dict(r, scratched=n > 0) for n, r in enumerate(P.FIELD_B)]
    pages = spark.createDataFrame([("A", day, P.page(P.FIELD_A, "weight")), ("one", day, P.page(lone, "money"))], "page_id string, captured_at timestamp, text string")
    forms = E.runner_forms(pages)
    assert [(r.race_id, r.n_active) for r in rejected_forms(forms).collect()] == [("one", 1)]
    assert {r.race_id for r in predict_forms(forms).collect()} == {"A"}


def test_white_space_classes_hold_the_listed_characters(spark):
    """Visible ASCII is turned away first; that changes no character of the class."""
    listed = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    for new, old in ((f"^[{PT.WS}]\\z", f"^[{listed}]\\z"), (f"(?s)^[^{PT.WS}]\\z", f"(?s)^[^{listed}]\\z")):
        assert chars.filter(F.col("c").rlike(new) != F.col("c").rlike(old)).count() == 0
    texts = [" a  b\n\tc \u00a0 d\r\n e\u2003f  ", "\n\n x \n", "a b", "\u00a0", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.regexp_replace("t", PT.WS_RUN, " ").alias("new"), F.regexp_replace("t", f"[{listed}]+", " ").alias("old")).collect()
    assert all(r.new == r.old for r in got)


def test_text_before_a_block_is_its_end_only(spark):
    """However long a page is, a runner carries PREFIX_CHARS of what stands before its block; blank lines count from all of it."""
    names = ["ALPHA ONE", "BRAVO TWO", "CHARLIE THREE"]
    gaps = [["word " * 30] * 40, ["x"] * 5 + [""] * 400, ["12345", "betfair$4.50", "", ""]]
    lines, listed = ["Tab"], []
    for tab, (name, gap) in enumerate(zip(names, gaps), 1):
        lines += [*gap, f"{name}  3yo BK D"]
        listed.append((tab, name))
    lines = [x.strip() for x in lines]
    df = spark.createDataFrame([("p", lines, listed)], "page_id string, lines array<string>, listed array<struct<tab:int,horse:string>>")
    for r in E.assign_blocks(df).collect():
        above = "\n".join(lines[: lines.index(f"{r.runner.horse}  3yo BK D")])
        filled = above.rstrip("\n")
        assert r.before == (filled + "\n")[-K.PREFIX_CHARS:] and r.blank_lines == len(above) - len(filled)
