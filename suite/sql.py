"""SQL building blocks over the same tables, for checking results with another engine."""

from __future__ import annotations

from formfield import constants as K

# name -> (needed blocks, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "contest_raw": ((), """
        select l_orderkey as race_id, l_linenumber as tab, l_partkey as part, l_suppkey as supp,
               l_returnflag = 'R' as scratched, 1 + l_extendedprice / 10000 as tab_odds,
               1 + l_quantity as bf_odds, l_extendedprice as price
        from lineitem"""),
    "contest": (("contest_raw",), """
        select * replace (cast(row_number() over (partition by race_id order by tab, part, supp, price) as integer) as tab)
        from contest_raw"""),
    "active_contest": (("contest",), "select * from contest where not scratched"),
    "cust": ((), """
        select *, cast(abs(round(c_acctbal * 100)) as bigint) as cents, cast(c_custkey % 9 + 1 as integer) as seat
        from customer join nation on n_nationkey = c_nationkey"""),
    "runners": (("cust",), """
        select c_custkey // 9 as race_id, seat as tab, case when seat <= 8 then seat else 0 end as box,
               'RUNNER ' || translate(cast(c_custkey as varchar), '0123456789', 'ABCDEFGHIJ') as horse,
               cast((cents % 80 + 250) / 10.0 as double) as weight,
               translate(n_name, '_0123456789', ' ABCDEFGHIJ') as trainer,
               c_mktsegment = 'MACHINERY' and cents % 3 = 0 as scratched,
               cast(case when c_mktsegment = 'MACHINERY' and cents % 3 = 0 then 999.0
                    else (cents % 3000 + 110) / 100.0 end as double) as tab_odds,
               cast(case when c_mktsegment = 'MACHINERY' and cents % 3 = 0 then 999.0
                    else (cents % 7000 + 120) / 100.0 end as double) as bf_odds,
               lpad(cast(cents % 100000 as varchar), 5, '0') as form,
               cast(c_nationkey * 2 / 100.0 as double) as trainer_win,
               cast((c_nationkey * 2 + 20) / 100.0 as double) as trainer_place,
               cast(case when cents % 4 = 0 then 0.0 else (cents % 300 + 2200) / 100.0 end as double) as tra_dist_best,
               cast(cents % 70 as integer) as dls, cast(c_custkey % 5 + 1 as integer) as age,
               cast(cents % 9000 / 100.0 - 40 as double) as roi_percent, c_custkey as cust
        from cust"""),
    "races": ((), """
        select race_id, cast(300 + 50 * (race_id % 6) as integer) as distance_m,
               list_extract(['F', 'O', 'P'], race_id % 3 + 1) as track
        from (select distinct c_custkey // 9 as race_id from customer)"""),
    "all_runs": ((), """
        select o_custkey // 9 as race_id, cast(o_custkey % 9 + 1 as integer) as tab,
               cast(o_orderdate as date) as run_day, o_orderkey,
               cast(left(o_orderpriority, 1) as integer) as finish,
               cast(o_orderkey % 4 + 4 as integer) as field,
               cast(o_orderkey % 150 / 10.0 as double) as margin,
               cast(300 + 50 * (month(o_orderdate) % 6) as integer) as distance, o_orderstatus as track,
               cast(case when o_orderkey % 7 <> 0 then o_orderkey % 90 / 100.0 - 0.2 end as double) as bom_adj,
               cast(floor(o_totalprice) % 150 / 100.0 as double) as mrk_delta,
               cast(case when o_orderkey % 5 <> 0 then o_orderkey % 8 + 1 end as integer) as settle_pos,
               case o_orderkey % 6 when 0 then 'Quick to begin' when 1 then 'Slow to begin; checked turn'
                    when 2 then 'Slowly away' when 3 then 'Raced wide' end as stewards,
               cast(o_orderkey % 400 / 100.0 + 4 as double) as first_split,
               cast(o_orderkey % 8 + 1 as integer) as prior_box
        from orders"""),
    "numbered_runs": (("all_runs",), """
        select *, cast(row_number() over (partition by race_id, tab order by run_day desc, o_orderkey desc) - 1 as integer) as k
        from all_runs"""),
    "recent": (("numbered_runs",), "select * from numbered_runs where k < 6"),
    "career": (("all_runs",), """
        select race_id, tab, cast(count_if(finish = 1) as integer) as wins,
               cast(count_if(finish in (2, 3)) as integer) as places23, cast(count(*) as integer) as starts
        from all_runs group by all"""),
    "records": (("all_runs",), """
        select race_id, tab, case track when 'F' then 'course' when 'O' then 'distance' when 'P' then 'course_distance'
               else track end as kind, cast(count_if(finish = 1) as integer) as wins,
               cast(count_if(finish in (2, 3)) as integer) as places23, cast(count(*) as integer) as starts
        from all_runs group by all"""),
    "box_counts": (("all_runs",), """
        select race_id, tab, prior_box as box, cast(count_if(finish = 1) as integer) as wins,
               cast(count_if(finish in (2, 3)) as integer) as places23, cast(count(*) as integer) as starts
        from all_runs group by all"""),
    # --- scores over past runs
    "weighed": (("recent", "races"), """
        select r.*, distance_m as target_distance, t.track as target_track,
               abs(r.distance - distance_m) <= 40 as near, upper(r.track) = upper(t.track) as same
        from recent r join races t using (race_id)"""),
    "history": (("weighed",), """
        select race_id, tab,
               0.58 * coalesce(-sum(bom_adj * w) / sum(case when bom_adj is not null then w end), 0.65)
               + 0.42 * coalesce(-sum(mrk_delta * w) / sum(case when mrk_delta is not null then w end), 0.75) as speed_raw,
               coalesce(sum(e * (1.0 - (settle_pos - 1) / (greatest(field, 2) - 1))) / sum(case when settle_pos is not null then e end), 0.45)
               + 0.035 * sum(quick) - 0.035 * sum(slow) as early_raw,
               coalesce(sum(d * (1.0 - (greatest(finish, 1) - 1) / (greatest(field, 2) - 1) - least(margin, 15.0) / 60.0)) / sum(d), 0.35) as form_raw,
               cast(sum(quick) as bigint) as quick, cast(sum(slow) as bigint) as slow
        from (select *, exp(-0.33 * k) as d,
                     exp(-0.33 * k) * case when near then 1.30 else 1 end * case when same then 1.18 else 1 end as w,
                     exp(-0.32 * k) * case when near then 1.25 else 1 end * case when same then 1.12 else 1 end as e,
                     case when contains(lower(coalesce(stewards, '')), 'quick to begin') then 1 else 0 end as quick,
                     case when contains(lower(coalesce(stewards, '')), 'slow to begin')
                            or contains(lower(coalesce(stewards, '')), 'slowly away') then 1 else 0 end as slow
              from weighed)
        group by race_id, tab"""),
    "record_columns": (("records",), """
        select race_id, tab, """ + ", ".join(
            f"max(case when kind = '{k}' then {p} end) as {k}_{p}"
            for k in ("course_distance", "distance", "course") for p in ("wins", "places23", "starts")
        ) + " from records group by race_id, tab"),
    "run_counts": (("all_runs",), "select race_id, tab, count(*) as n_runs from all_runs group by race_id, tab"),
    "raw": (("runners", "history", "record_columns", "box_counts", "run_counts"), """
        select *, (box_wins + prior * 6.0) / (box_starts + 6.0) as box_win_rate,
               (box_wins + box_places23 + 0.375 * 6.0) / (box_starts + 6.0) as box_place_rate,
               (box_wins + prior * 6.0) / (box_starts + 6.0)
               + 0.32 * (box_wins + box_places23 + 0.375 * 6.0) / (box_starts + 6.0) as box_raw,
               0.48 * ((cdw + 1.0) / (cds + 8.0) + 0.35 * (cdw + cdp + 3.0) / (cds + 8.0))
               + 0.31 * ((dw + 1.0) / (ds + 8.0) + 0.35 * (dw + dp + 3.0) / (ds + 8.0))
               + 0.21 * ((cw + 1.0) / (cs + 8.0) + 0.35 * (cw + cp + 3.0) / (cs + 8.0)) as trackdist_raw,
               0.72 * trainer_win + 0.28 * trainer_place as trainer_raw,
               cast(case when dls <= 2 then 0.45 when dls <= 12 then 1.0 - abs(dls - 7.0) / 25.0
                    when dls <= 28 then 0.75 - (dls - 12.0) / 80.0 when dls <= 56 then 0.55 - (dls - 28.0) / 100.0
                    else 0.25 end as double) as freshness_raw,
               cds as cd_starts
        from (select r.*, coalesce(h.speed_raw, 0.58 * 0.65 + 0.42 * 0.75) as speed_raw,
                     coalesce(h.early_raw, 0.45) as early_raw, coalesce(h.form_raw, 0.35) as form_raw,
                     coalesce(h.quick, 0) as quick, coalesce(h.slow, 0) as slow, coalesce(n.n_runs, 0) as n_runs,
                     coalesce(b.wins, 0) as box_wins, coalesce(b.places23, 0) as box_places23,
                     coalesce(b.starts, 0) as box_starts,
                     coalesce(c.course_distance_wins, 0) as cdw, coalesce(c.course_distance_places23, 0) as cdp,
                     coalesce(c.course_distance_starts, 0) as cds, coalesce(c.distance_wins, 0) as dw,
                     coalesce(c.distance_places23, 0) as dp, coalesce(c.distance_starts, 0) as ds,
                     coalesce(c.course_wins, 0) as cw, coalesce(c.course_places23, 0) as cp,
                     coalesce(c.course_starts, 0) as cs,
                     cast(case r.box """ + " ".join(f"when {b} then {v}" for b, v in K.BOX_PRIOR.items())
            + f" else {K.BOX_PRIOR_OTHER} end as double) as prior" + """
              from runners r left join history h using (race_id, tab) left join run_counts n using (race_id, tab)
              left join record_columns c using (race_id, tab) left join box_counts b using (race_id, tab, box)
              where not scratched)"""),
    # --- across the field
    "fielded": (("raw",), "select * from raw qualify count(*) over (partition by race_id) >= 2"),
    "market": (("fielded",), """
        select *, case when avg(ok) over f < 0.5 then p_tab else 0.55 * p_tab + 0.45 * p_bf end as p_mkt
        from (select *, it / sum(it) over f as p_tab, ib / sum(ib) over f as p_bf
              from (select *, 1.0 / greatest(tab_odds, 1.01) as it, 1.0 / greatest(bf_odds, 1.01) as ib,
                           case when bf_odds > 1.01 and bf_odds < 500 then 1.0 else 0.0 end as ok from fielded)
              window f as (partition by race_id))
        window f as (partition by race_id)"""),
    "standard": (("market",), "select *, " + ", ".join(
        f"({c}_raw - avg({c}_raw) over f) / case when stddev_pop({c}_raw) over f > 1e-9 "
        f"then stddev_pop({c}_raw) over f else 1 end as {c}_z0"
        for c in K.COMPONENT_WEIGHTS) + """,
        nullif(tra_dist_best, 0) as best
        from market window f as (partition by race_id)"""),
    "covered": (("standard",), "select * exclude (filled, known, n), " + ", ".join(
        f"{c}_z0 as {c}_z" for c in K.COMPONENT_WEIGHTS if c != "trackdist") + """,
        case when known >= greatest(3, n // 2) then 0.70 * trackdist_z0 - 0.30 * (filled - avg(filled) over f)
             / case when stddev_pop(filled) over f > 1e-9 then stddev_pop(filled) over f else 1 end
             else trackdist_z0 end as trackdist_z
        from (select *, count(best) over f as known, count(*) over f as n,
                     coalesce(best, median(best) over f, 0) as filled
              from standard window f as (partition by race_id))
        window f as (partition by race_id)"""),
    "paced": (("covered",), """
        select *, case when p1 - p2 > 0.55 then case when early_rank = 1 then 0.22 else 0 end
                       when b1 <> 0 and b2 <> 0 and abs(b1 - b2) <= 2 and early_rank <= 2 then -0.07
                       else 0 end as pace_adjust
        from (select *, max(case when early_rank = 1 then pace end) over f as p1,
                     max(case when early_rank = 2 then pace end) over f as p2,
                     max(case when early_rank = 1 then box end) over f as b1,
                     max(case when early_rank = 2 then box end) over f as b2
              from (select *, cast(row_number() over (partition by race_id order by pace desc, tab) as integer) as early_rank
                    from (select *, 0.72 * early_z + 0.28 * box_z as pace from covered))
              window f as (partition by race_id))"""),
    "fundamental": (("paced",), """
        select *, e / sum(e) over f as p_fund
        from (select *, exp(greatest(least(s - max(s) over f, 30), -30)) as e
              from (select *, 1.10 * (""" + " + ".join(f"{w} * {c}_z" for c, w in K.COMPONENT_WEIGHTS.items())
            + """ + pace_adjust) as s from paced)
              window f as (partition by race_id))
        window f as (partition by race_id)"""),
    "pooled": (("fundamental",), """
        select * exclude (s, e), e2 / sum(e2) over f as p_win
        from (select *, exp(greatest(least(t - max(t) over f, 30), -30)) as e2
              from (select *, 0.6 * ln(least(greatest(p_mkt, 1e-9), 1)) + 0.4 * ln(least(greatest(p_fund, 1e-9), 1)) as t
                    from fundamental)
              window f as (partition by race_id))
        window f as (partition by race_id)"""),
    "ranked": (("pooled",), """
        select *, cast(row_number() over (partition by race_id order by p_win desc, tab) as integer) as pred_rank from pooled"""),
}


def finish_blocks(source: str, p: str = "p_win") -> dict[str, tuple[tuple[str, ...], str]]:
    """Finishing-order probabilities by explicit pairs and triples (for small fields only)."""
    return {
        "share": ((source,), f"select race_id, tab, {p} / sum({p}) over (partition by race_id) as r, "
                  f"count(*) over (partition by race_id) as n from {source}"),
        "twos": (("share",), """
            select a.race_id, a.tab, sum(b.r * a.r / greatest(1 - b.r, a.r)) as second, sum(b.r / (a.r + b.r)) as behind
            from share a join share b on a.race_id = b.race_id and a.tab <> b.tab group by all"""),
        "threes": (("share",), """
            select a.race_id, a.tab, sum(b.r * c.r / (1 - b.r) * a.r / greatest(1 - b.r - c.r, a.r)) as third
            from share a join share b on a.race_id = b.race_id and a.tab <> b.tab
            join share c on a.race_id = c.race_id and a.tab <> c.tab and b.tab <> c.tab group by all"""),
        "finish": (("share", "twos", "threes"), """
            select race_id, tab, case when n <= 2 then 1 else r + coalesce(second, 0) end as top2,
                   case when n <= 3 then 1 else r + coalesce(second, 0) + coalesce(third, 0) end as top3,
                   1 + coalesce(behind, 0) as exp_pos
            from share left join twos using (race_id, tab) left join threes using (race_id, tab)"""),
    }


BLOCKS.update(finish_blocks("ranked"))
BLOCKS["rated"] = (("ranked", "finish"), """
    select *, 1.0 / greatest(p_win, 1e-9) as fair, p_win * bf_odds - 1.0 as ev_win,
           cast(greatest(1, least(9, round_even(2.0 + 3.0 * least((least(n_runs / 5.0, 1.0)
                + case when cd_starts > 0 then 0.20 else 0 end + case when box_starts > 0 then 0.15 else 0 end) / 1.35, 1.0)
                + 2.0 / (1.0 + list_stddev_pop([speed_z, early_z, box_z, trackdist_z, form_z, trainer_z, freshness_z]))
                + 4.0 * greatest(p_win - coalesce(lead(p_win) over (partition by race_id order by pred_rank), 0), 0), 0))) as integer) as conf,
           count(*) over (partition by race_id) as n_active
    from ranked join finish using (race_id, tab)""")
BLOCKS["predicted"] = (("rated",), """
    select *, case when pred_rank = 1 then 'TOP PICK' when pred_rank <= 3 then 'DANGER'
                   when ev_win >= 0.12 and p_win >= 0.07 then 'VALUE' when top3 >= 0.35 then 'EXOTICS / PLACE'
                   else 'WATCH' end as rec from rated""")


def over(*needed: str, query: str, extra: dict | None = None) -> str:
    """``query`` with every block it needs in front of it, each once and in order."""
    blocks = {**BLOCKS, **(extra or {})}
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for inner in blocks[name][0]:
                add(inner)
            done[name] = blocks[name][1]

    for name in needed:
        add(name)
    if not done:
        return query
    return "with " + ",\n".join(f"{n} as ({b})" for n, b in done.items()) + "\n" + query


def rounded(*columns: str, digits: int = 8) -> str:
    return ", ".join(f"round(cast({c} as double) + 1e-11, {digits}) + 0.0 as {c.split('.')[-1]}" for c in columns)
