import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formfield import groups as G
from formfield.functions.numbers import fixed_point, freshness_score
from formfield.operators import field as W
from formfield.operators import history as H
from formfield.operators import relational as R
from formfield.operators.finish import SMALL_SHARE, TINY, _power_sums, finish_order_probs
from formfield.plans import predict as PR
from suite import bindings as B


def brute_force(p):
    """Finishing-order probabilities by walking every ordered first three."""
    n, total = len(p), sum(p)
    p = [x / total for x in p]
    top2, top3 = [0.0] * n, [0.0] * n
    for a, b in itertools.permutations(range(n), 2):
        chance = p[a] * p[b] / (1 - p[a])
        for i in (a, b):
            top2[i] += chance
        for c in range(n):
            if c not in (a, b):
                third = chance * p[c] / (1 - p[a] - p[b])
                for i in (a, b, c):
                    top3[i] += third
    mean = [1 + sum(p[j] / (p[i] + p[j]) for j in range(n) if j != i) for i in range(n)]
    return top2, top3 if n > 2 else [1.0] * n, mean


@pytest.mark.parametrize("n", [2, 3, 8, 100])
def test_finish_probabilities_against_brute_force(spark, n):
    rng = random.Random(n)
    p = [rng.random() ** 4 + 1e-6 for _ in range(n)]
    p[n // 2] = p[0]
    if n == 100:
        p[7] = 40.0
    df = spark.createDataFrame([(1, i, x / sum(p)) for i, x in enumerate(p)], "race_id int, tab int, p_win double")
    got = finish_order_probs(df, ["race_id"]).orderBy("tab").collect()
    for r, t2, t3, e in zip(got, *brute_force(p)):
        assert r.top2 == pytest.approx(t2, abs=1e-9)
        assert r.top3 == pytest.approx(t3, abs=1e-7)
        assert r.exp_pos == pytest.approx(e, abs=1e-7)


def skewed(spark):
    """One race holds a third of all rows."""
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(1000 + F.expr("id div 9")).alias("race_id"), F.col("id").cast("int").alias("tab"),
        (1.2 + F.col("id") * 37 % 101 / 10).alias("tab_odds"), (1.1 + F.col("id") * 53 % 97 / 5).alias("bf_odds"),
        F.when(F.col("id") % 4 != 0, F.col("id") * 7919 % 1000 / 7.0).alias("x"),
    )


OPERATORS = {
    "devig": lambda d, g: W.devig(d, g, "tab_odds"),
    "blend": lambda d, g: W.blend_markets(d, g),
    "softmax": lambda d, g: W.softmax(d, g, "bf_odds", "p"),
    "zscore": lambda d, g: W.zscore(d, g, "x", "z"),
    "rank": lambda d, g: W.rank_field(d, g, "tab_odds"),
    "pool": lambda d, g: W.log_pool(W.blend_markets(d, g), g, "p_tab", "p_bf"),
    "require": lambda d, g: W.require_field(d, g, 10),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_hot_group_gives_the_same_rows(spark, name):
    df, fn = skewed(spark), OPERATORS[name]
    plain = G.by_group_size(df, ["race_id"], fn, limit=10_000)
    split = G.by_group_size(df, ["race_id"], fn, limit=50)
    assert sorted(plain.columns) == sorted(split.columns)
    columns = sorted(plain.columns)
    a, b = (sorted(d.select(columns).collect(), key=lambda r: r.tab) for d in (plain, split))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c in columns:
            assert x[c] == (pytest.approx(y[c], rel=1e-9, abs=1e-12) if isinstance(x[c], float) else y[c])


def test_many_large_groups_are_split_by_joins(spark, monkeypatch):
    monkeypatch.setattr(G, "LISTED_KEYS", 2)
    df, fn = skewed(spark), OPERATORS["devig"]
    a = G.by_group_size(df, ["race_id"], fn, limit=10_000).orderBy("tab").collect()
    b = G.by_group_size(df, ["race_id"], fn, limit=3).orderBy("tab").collect()
    assert [round(r.p, 12) for r in a] == [round(r.p, 12) for r in b]


def test_whole_prediction_with_a_hot_race(spark, sf_dir):
    runners = B.runners(spark, sf_dir)
    history = dict(records=B.records(spark, sf_dir), box_stats=B.box_counts(spark, sf_dir), runs=B.recent(spark, sf_dir), races=B.races(spark, sf_dir))
    plain = PR.by_race(runners, lambda live, g: PR.score_field(PR.raw_components(live, **history), g))
    spread = G.Groups(["race_id"], spread=True, listed=True)
    split = PR.score_field(PR.raw_components(W.active(runners), **history), spread)
    keep = ["race_id", "tab", "pred_rank", "early_rank", "conf", "rec", "p_win", "top2", "top3", "exp_pos"]
    a, b = (sorted(d.select(keep).collect()) for d in (plain, split))
    assert len(a) == len(b) > 100
    for x, y in zip(a, b):
        assert x[:6] == y[:6]
        assert list(x[6:]) == pytest.approx(list(y[6:]), abs=1e-8)


def test_alpha_one_follows_the_market(spark, sf_dir):
    history = dict(records=B.records(spark, sf_dir), box_stats=B.box_counts(spark, sf_dir), runs=B.recent(spark, sf_dir), races=B.races(spark, sf_dir))
    p = PR.predict(B.runners(spark, sf_dir), **history, alpha=1.0)
    assert p.filter(F.abs(F.col("p_win") - F.col("p_mkt")) > 1e-9).count() == 0


def test_zscore_edges(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, 5.0), (2, 2, 5.0), (3, 1, 1.0), (3, 2, float("nan")), (3, 3, 3.0)], "race_id int, tab int, x double")
    got = {(r.race_id, r.tab): r.z for r in W.zscore(df, ["race_id"], "x", "z").collect()}
    assert all(got[k] == 0 for k in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 2)))
    assert got[3, 3] == pytest.approx(1.5 ** 0.5)


def test_no_history_keeps_the_sign_of_its_default(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, 0.2)], "tab int, k int, v double")
    plain = {r.tab: r.score for r in H.recency_weighted_mean(df, ["tab"], "v", 0.65, negate=True).collect()}
    assert plain == {1: 0.65, 2: -0.2}
    turned = {r.tab: r.score for r in H.recency_weighted_mean(df, ["tab"], "v", 0.65, negate=True, negate_default=True).collect()}
    assert turned[1] == -0.65


def test_box_zero_is_no_clash_and_a_lone_race_is_rejected(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0, 0.0), (1, 2, 1, 0.9, 0.0), (2, 1, 1, 0.0, 0.0), (2, 2, 3, 0.1, 0.0)], "race_id int, tab int, box int, early_z double, box_z double")
    got = {(r.race_id, r.tab): r.pace_adjust for r in W.pace_adjust(df, ["race_id"]).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.0, (2, 1): -0.07, (2, 2): -0.07}
    lone = spark.createDataFrame([(1, False), (1, True), (2, False), (2, False)], "race_id int, scratched boolean")
    assert [r.race_id for r in W.rejected_races(lone, ["race_id"]).collect()] == [1]


def test_zip_assign_leaves_surplus_takers(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, True, 5), (1, 3, 3, True, 1), (1, 9, 0, False, 3), (1, 10, 0, False, 2), (1, 11, 0, False, 9)], "race_id int, tab int, box int, scratched boolean, line int")
    out = R.zip_assign(df, ["race_id"], taker=(F.col("tab") > 8) & ~F.col("scratched"), slot=(F.col("tab") <= 8) & F.col("scratched"), taker_order="line", slot_value="tab")
    assert {r.tab: r.box for r in out.collect()} == {1: 1, 3: 3, 9: 3, 10: 1, 11: 0}


def test_fixed_point_rounds_the_binary_value(spark):
    values = [22.25, 0.15, 2.5, 0.35, -0.04, 0.05, 1.005, 14.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(F.format_string("%.1f", fixed_point("v", 1))).collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_freshness_pieces(spark):
    days = [-3, 2, 7, 12, 13, 28, 56, 57]
    df = spark.createDataFrame([(float(d),) for d in days], "d double")
    got = [r[0] for r in df.select(freshness_score("d")).collect()]
    assert got == pytest.approx([.45, .45, 1.0, .8, .7375, .55, .27, .25])


def test_zip_assign_serves_every_taker_while_slots_last(spark):
    rows = [(1, n, 0, True, n) for n in range(1, 13)] + [(1, n, 0, False, 100 - n) for n in range(21, 33)]
    df = spark.createDataFrame(rows, "race_id int, tab int, box int, scratched boolean, line int")
    out = R.zip_assign(df, ["race_id"], taker=~F.col("scratched"), slot=F.col("scratched"), taker_order="line", slot_value="tab")
    assert {r.tab: r.box for r in out.filter("reserve_into_box").collect()} == {n: 33 - n for n in range(21, 33)}


@pytest.mark.parametrize("p", [(1.0, 0.0, 0.0), (0.7, 0.3, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1e-30, 2e-30), (0.0, 1.0)])
def test_finish_probabilities_of_sure_and_hopeless_runners(spark, p):
    df = spark.createDataFrame([(1, n, float(x)) for n, x in enumerate(p)], "race_id int, tab int, p_win double")
    for limit in (64, 1):
        got = by_group_size_finish(df, limit)
        n = len(p)
        assert sum(r.top2 for r in got) == pytest.approx(min(n, 2), abs=1e-5)
        assert sum(r.top3 for r in got) == pytest.approx(min(n, 3), abs=1e-5)
        assert sum(r.exp_pos for r in got) == pytest.approx(n * (n + 1) / 2, abs=1e-5)
        if p[0] == 1.0:
            assert got[0].exp_pos == pytest.approx(1.0, abs=1e-6)
        if p == (0.7, 0.3, 0.0, 0.0):
            assert got[2].top2 < 1e-6 and got[2].exp_pos == pytest.approx(3.5, abs=1e-6)
            assert got[2].top3 == pytest.approx(0.5, abs=1e-6)


def by_group_size_finish(df, limit):
    out = G.by_group_size(df, ["race_id"], lambda d, g: finish_order_probs(d, g), limit)
    return out.orderBy("tab").collect()


@pytest.mark.parametrize("n", [64, 65, 3000])
def test_finish_probabilities_are_the_same_in_one_task_and_spread(spark, n):
    rng = random.Random(n)
    p = [rng.random() ** 3 + 1e-4 for _ in range(n)]
    df = spark.createDataFrame([(1, i, x / sum(p)) for i, x in enumerate(p)], "race_id int, tab int, p_win double")
    spread = by_group_size_finish(df, 10)
    if n < 1000:
        for a, b in zip(by_group_size_finish(df, 10_000), spread):
            assert (a.top2, a.top3, a.exp_pos) == pytest.approx((b.top2, b.top3, b.exp_pos), abs=1e-12)
    assert sum(r.top2 for r in spread) == pytest.approx(2) and sum(r.top3 for r in spread) == pytest.approx(3)
    assert sum(r.exp_pos for r in spread) == pytest.approx(n * (n + 1) / 2)


@pytest.mark.parametrize("largest", [0.0, 0.02, 0.4, 0.9, 0.99])
def test_finish_probabilities_of_a_large_group_by_power_sums(spark, largest):
    """Against all pairs, with shares of many magnitudes; what a row meets does not grow with the group."""
    rng = np.random.default_rng(7)
    p = np.concatenate([10.0 ** rng.uniform(-6, 0, 2500), np.full(500, 0.01)])
    p = p / p.sum() * (1 - largest)
    if largest:
        p = np.append(p, largest)
    rows = [(1, i, float(x)) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "race_id int, tab int, p_win double")
    got = by_group_size_finish(df, 10)
    if p.min() < TINY:
        p = (p + TINY) / (1 + len(p) * TINY)
    r, s = p[:, None], p[None, :]
    pair = r * s * (1 / (1 - r) + 1 / (1 - s)) / np.maximum(1 - r - s, 1e-15)
    np.fill_diagonal(pair, 0.0)
    own, behind = pair.sum(1), (s / (r + s)).sum(1) - 0.5
    firsts = (p / (1 - p)).sum()
    top2 = p + p * (firsts - p / (1 - p))
    top3 = top2 + p * np.maximum(own.sum() / 2 - own, 0.0)
    assert [x.top2 for x in got] == pytest.approx(np.minimum(top2, 1.0), abs=1e-12)
    assert [x.top3 for x in got] == pytest.approx(np.minimum(top3, 1.0), abs=1e-11)
    assert [x.exp_pos for x in got] == pytest.approx(1 + behind, rel=1e-12)
    shares = df.select("race_id", F.col("p_win").alias("__share"), F.lit(float(p.max())).alias("__top"))
    met = _power_sums(shares, G.Groups(["race_id"], spread=True, listed=True)).first()
    assert len(met["__bins"]) < 100 and len(met["__listed"]) < 1 / SMALL_SHARE


def test_sequence_gaps_are_whole(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 1_050_000), (2, 1), (2, 2), (3, None), (3, 4), (4, -2)], "race_id int, tab int")
    got = R.sequence_gaps(df, ["race_id"])
    counts = {r.race_id: r.n for r in got.groupBy("race_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 1_050_000 - 2, 3: 3}
    assert got.distinct().count() == got.count() and got.join(df, ["race_id", "tab"]).count() == 0


def test_frequent_keys_are_found_in_one_pass(spark):
    """A group is large above the limit if it holds a thousandth of the rows; all of those are found, also where keys share counters."""
    hot = spark.range(30_000).select(F.lit("hot").alias("race_id"))
    some = spark.range(9_000).select(F.concat(F.lit("some"), (F.col("id") % 3)).alias("race_id"))
    none = spark.range(5_000).select(F.lit(None).cast("string").alias("race_id"))
    rest = spark.range(40_000).select((F.col("id") % 20_000).cast("string").alias("race_id"))
    df = hot.union(some).union(none).union(rest).repartition(6)
    keys = {r[0]: r[1] for r in df.select("race_id", F.xxhash64("race_id")).distinct().collect()}
    names = {v: k for k, v in keys.items()}
    large = lambda limit: {names[v] for v in G.group_sizes(df, ["race_id"], limit).keys}
    assert large(10_000) == {"hot"}
    assert large(4_999) == {"hot", None} and large(5_000) == {"hot"}
    assert large(2_999) == large(10) == {"hot", None, "some0", "some1", "some2"}
    assert G.group_sizes(df.limit(0), ["race_id"], 1).keys == []


def test_one_decision_serves_all_steps(spark, monkeypatch):
    df = skewed(spark)
    sizes = G.group_sizes(df, ["race_id"], 50)
    assert len(sizes.keys) == 1
    monkeypatch.setattr(G, "group_sizes", None)
    monkeypatch.setattr(G, "counted_sizes", None)
    for fn in OPERATORS.values():
        plain, split = (sorted(map(tuple, fn(df, g).select("tab").collect())) for g in (G.Groups(["race_id"]), sizes))
        assert plain == split


@pytest.mark.parametrize("name", ["w1_zscore", "w3_devig", "w4_blend_markets", "w9_log_pool", "d3_rank_field", "f2_require_field", "j7_finish_order_probs"])
def test_a_query_looks_at_its_keys_once(spark, sf_dir, name, monkeypatch):
    from suite import bindings
    from suite.queries import QUERIES

    looks = []
    for at, fn in ((G, "group_sizes"), (G, "counted_sizes"), (bindings, "group_sizes")):
        old = getattr(at, fn)
        monkeypatch.setattr(at, fn, lambda *args, old=old: (looks.append(old), old(*args))[1])
    import suite.queries as Q

    old = Q.counted_sizes
    monkeypatch.setattr(Q, "counted_sizes", lambda *args: (looks.append(old), old(*args))[1])
    QUERIES[name](spark, sf_dir)
    assert len(looks) == 1


def test_stored_tables_are_predicted_with_one_exchange_and_no_join(spark, sf_dir, tmp_path):
    """The tagged stream gives the rows that joins give, also without a count of runs."""
    tables = {
        "runners": B.runners(spark, sf_dir), "records": B.records(spark, sf_dir), "box_stats": B.box_counts(spark, sf_dir),
        "runs": B.recent(spark, sf_dir), "races": B.races(spark, sf_dir), "counts": B.career(spark, sf_dir).select("race_id", "tab", F.col("starts").alias("n_runs")),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    live, records, boxes, runs, races, counts = (spark.read.parquet(str(tmp_path / n)) for n in tables)
    for more in (None, counts):
        args = (W.active(live), records, boxes, runs, races, more)
        joined, tagged = PR.raw_components(*args), PR.tagged_components(*args)
        assert sorted(joined.columns) == sorted({*tagged.columns, *(c for c in joined.columns if c.startswith("target_"))} & set(joined.columns))
        columns = [c for c in joined.columns if c in tagged.columns]
        plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()), key=str)
        assert plain(joined) == plain(tagged)
    plan = PR.predict(live, records, boxes, runs, races, run_counts=counts, bounded=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_seats_and_gaps_of_a_hot_race(spark):
    """One race with a third of the rows gives what windows give, with no window of that race alone."""
    hot = spark.range(3_000).select(F.lit(-1).cast("long").alias("race_id"), (F.col("id") * 7 % 4_001 + 1).alias("tab"), (F.col("id") % 2 == 0).alias("scratched"))
    rest = spark.range(6_000).select((F.col("id") % 900).alias("race_id"), (F.col("id") * 5 % 23 + 1).alias("tab"), (F.col("id") % 3 == 0).alias("scratched"))
    df = hot.union(rest).withColumns({"line_no": F.monotonically_increasing_id(), "box": F.lit(0).cast("long")}).repartition(5)
    df = G.durable(df)
    plain, found = G.Sizes(["race_id"], []), G.group_sizes(df, ["race_id"], 100)
    assert len(found.keys) == 1
    seats = dict(taker=~F.col("scratched"), slot=F.col("scratched"), taker_order="line_no", slot_value="tab")
    a, b = (sorted(map(tuple, R.zip_assign(df, g, **seats).select("race_id", "tab", "line_no", "box", "reserve_into_box").collect())) for g in (plain, found))
    assert a == b and sum(r[4] for r in a) > 1_000
    a, b = (sorted(map(tuple, R.sequence_gaps(df, g).select("race_id", "tab").collect())) for g in (plain, found))
    have = {r[0] for r in df.filter("race_id = -1").select("tab").distinct().collect()}
    assert a == b and [t for r, t in b if r == -1] == sorted(set(range(1, max(have))) - have)
    assert R.sequence_gaps(df.limit(0), ["race_id"]).count() == 0
