"""Registered queries over text: the given texts, and form pages written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formfield.functions import layouts as L
from formfield.functions import text as X
from formfield.groups import durable
from formfield.plans import extract as E
from formfield.plans import predict as PR
from formfield.operators import relational as R
from formfield.plans.remembered import remember, remembered_forms
from formfield.sources.published import publish_view, read_view
from formfield.sources.raw import decode_pages
from formfield.sources.pages import gate_pages, newest_captures, read_pages, spread, write_view
from formfield.plans import views as V
from formfield.streaming.captures import current_pages, ingest
from formfield.streaming.levels import levelled_pages, merge
from formfield.streaming.live import current_predictions, predict_stream
from suite import bindings as B
from suite import render
from suite.queries import _NUMBERS, register, tidy
from suite.sql import over, rounded

_PAGES: dict[tuple[str, str], DataFrame] = {}


def dealt(scan: DataFrame) -> DataFrame:
    """The small test tables over all cores."""
    return spread(scan, scan.sparkSession.sparkContext.defaultParallelism)


def pages(spark, d) -> DataFrame:
    """Rendered pages, written once per application and read by every query."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PAGES:
        _PAGES[key] = durable(render.pages(spark, d))
    return _PAGES[key]


def shared_folder(spark, name: str) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        durable(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/formfield-{name}-{uuid.uuid4().hex}"


def fields(spark, d) -> DataFrame:
    return E.read_fields(pages(spark, d))


def blocks(spark, d) -> DataFrame:
    return E.assign_blocks(fields(spark, d)).filter("runner is not null").withColumns({
        "race_id": F.col("page_id").cast("long"), "tab": F.col("runner.tab"),
    })


def forms(spark, d) -> DataFrame:
    return E.runner_forms(pages(spark, d)).withColumn("race_id", F.col("race_id").cast("long"))


# --- what the pages must yield, from the tables ------------------------------------------------------

PAGE = {
    "page_runners": (("runners",), f"""
        select r.race_id, r.tab,
               case when r.tab <= 8 then r.tab when r.scratched then 0
                    else coalesce(min(case when r.scratched and r.tab <= 8 then r.tab end) over (partition by r.race_id), 0) end as box,
               r.horse, case when r.race_id % 5 = 1 then null else r.weight end as weight, r.trainer, r.scratched, r.tab_odds,
               case when r.scratched then 999.0 when not shown or cast(r.form as integer) % 10 = 3 then r.tab_odds else r.bf_odds end as bf_odds,
               case when shown then r.form else '' end as form, case when shown then r.trainer_win else 0.10 end as trainer_win,
               case when shown then r.trainer_place else 0.35 end as trainer_place,
               case when shown then r.tra_dist_best else 0 end as tra_dist_best,
               case when not shown then 14 when r.tab % 3 = 0 then r.dls + 1 else r.dls end as dls, shown, r.age, r.cust,
               r.roi_percent, r.weight as block_weight, r.form as written_form, r.dls as strip_dls, r.bf_odds as listed_bf
        from (select *, cast(form as integer) % 50 <> 7 as shown from runners) r"""),
    "shown_runs": (("all_runs", "page_runners"), """
        select a.* from all_runs a join page_runners p on p.race_id = a.race_id and p.tab = a.tab where p.shown"""),
    "page_runs": (("shown_runs",), """
        select * from (select *, cast(row_number() over (partition by race_id, tab order by run_day desc, o_orderkey desc) - 1 as integer) as k
        from shown_runs) where k < 6"""),
}
def _end_to_end(query: str) -> str:
    """The prediction SQL with runners and runs replaced by what the pages show."""
    from suite.sql import BLOCKS

    base = {"all_cust_runners": BLOCKS["runners"], "every_run": BLOCKS["all_runs"]}
    shown = (("all_cust_runners",), PAGE["page_runners"][1].replace("from runners)", "from all_cust_runners)"))
    runs = (("every_run", "runners"), """
        select a.* from every_run a join runners p on p.race_id = a.race_id and p.tab = a.tab where p.shown""")
    return over("predicted", extra={**base, "runners": shown, "all_runs": runs}, query=query)


# --- plain text operators over the given tables ------------------------------------------------------------

_CLEAN = "html"
for _old, _new in (("\\\\-", "-"), ("\\\\:", ":"), ("\\\\&", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_old[-2:]}', '{_new}')"
_CLEAN = f"regexp_replace({_CLEAN}, '\\[([^\\]]+)\\]\\([^\\n]*?\\)', '\\1', 'g')"
for _mark in ("***", "**", "__"):
    _CLEAN = f"replace({_CLEAN}, '{_mark}', '')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?m)^[#>*]+\\s*', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?m)^\\s*[-*]\\s+([A-Za-z\\[])', '\\1', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '\\n$', '')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?m)^[ \\t]+|[ \\t]+$', '', 'g')"


@register("t1_clean_text", f"select page_id, {_CLEAN} as clean from (select page_id, replace(replace(html, '<p>', chr(10) || ' - '), '<a href=\"', '[x]( ') as html from pages)")
def t1_clean_text(spark, d):
    html = F.replace(F.replace("html", F.lit("<p>"), F.lit("\n - ")), F.lit('<a href="'), F.lit("[x]( "))
    return dealt(B.table(spark, d, "pages")).select("page_id", X.clean_text(html).alias("clean"))


@register("t2_explode_lines", """
    select doc_id, cast(i - 1 as integer) as line_no, lines[i] as line
    from (select doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) as lines from documents), range(1, len(lines) + 1) t(i)""")
def t2_explode_lines(spark, d):
    return E.explode_lines(dealt(B.table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id")


@register("t3_split_cells", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, len(cells) as n, cells[1] as first, cells[3] as third, len(list_filter(cells, lambda c: c <> '')) as filled
    from (select *, case when l_linenumber % 2 = 0 then [cast(l_linenumber as varchar), l_returnflag, '', l_linestatus]
          else [cast(l_linenumber as varchar), l_returnflag, l_linestatus] end as cells from lineitem)""")
def t3_split_cells(spark, d):
    li = B.table(spark, d, "lineitem")
    number = F.col("l_linenumber").cast("string")
    line = F.when(
        F.col("l_linenumber") % 2 == 0, F.concat_ws("\t", number, F.concat(F.lit(" "), "l_returnflag"), F.lit(""), "l_linestatus")
    ).otherwise(F.concat_ws("   ", number, "l_returnflag", "l_linestatus"))
    df = li.withColumn("line", line).withColumns({
        "cells": X.split_cells("line"), "some": X.split_cells("line", keep_empty=False)})
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.size("cells").cast("long").alias("n"), F.get("cells", F.lit(0)).alias("first"),
        F.get("cells", F.lit(2)).alias("third"), F.size("some").cast("long").alias("filled"),
    )


@register("t4_normalise_name", """
    select conv_id, turn, upper(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g'), ' ')) as name from conversations""")
def t4_normalise_name(spark, d):
    plain = F.replace("text", F.lit("ß"), F.lit("ss"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", X.normalise_name(plain).alias("name"))


@register("t5_to_number", f"""
    select event_id, {rounded('amount')}, whole, {rounded('filled')} from (
        select event_id, case when event_id % 10 = 0 then -1 else value end as amount,
               case when event_id % 10 = 0 then -1 else cast(trunc(value) as integer) end as whole,
               case when event_id % 10 = 3 then 7.5 else value end as filled from events)""")
def t5_to_number(spark, d):
    value = F.col("value").cast("string")
    money = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.concat(F.lit(" $"), value, F.lit(" sec")))
    plain = F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.concat(F.lit(" "), value))
    gap = F.when(F.col("event_id") % 10 == 3, float("inf")).otherwise(F.col("value"))
    from formfield.functions.numbers import finite

    return tidy(B.table(spark, d, "events").select(
        "event_id", X.to_number(money, -1.0).alias("amount"), X.to_int(plain, -1).alias("whole"), finite(gap, 7.5).alias("filled")
    ))


@register("t11_segment_between", """
    select doc_id, case when s is null then null else array_to_string(case when e > s then lines[s + 1 : e - 1] else lines[s + 1 :] end, chr(10)) end as segment
    from (select doc_id, lines, list_position(list_transform(lines, lambda x: ends_with(x, '.')), true) as s,
                 coalesce(list_position(list_transform(lines, lambda x: contains(x, ',')), true), 0) as e
          from (select doc_id, string_split(text, chr(10)) as lines from documents))""")
def t11_segment_between(spark, d):
    part = X.segment_between("text", r"(?md)^[^\n]*\.$", r"(?md)^[^\n]*,[^\n]*$")
    return dealt(B.table(spark, d, "documents")).select("doc_id", F.regexp_replace(part, r"\A\n|\n\z", "").alias("segment"))


@register("t18_parse_record", over("career", query="""
    select race_id, tab, case when tab % 2 = 0 then a || '%-' || b || '%-' || starts else wins || '-' || places23 || '-' || starts end as display,
        case when tab % 2 = 0 then cast(round_even(starts * a / 100.0, 0) as integer) else wins end as wins,
        case when tab % 2 = 0 then greatest(greatest(cast(round_even(starts * a / 100.0, 0) as integer), least(cast(round_even(starts * b / 100.0, 0) as integer), starts)) - cast(round_even(starts * a / 100.0, 0) as integer), 0) else places23 end as places23,
        starts from (select *, cast(wins * 100 // starts as integer) as a, cast((wins + places23) * 100 // starts as integer) as b from career)"""))
def t18_parse_record(spark, d):
    percent = F.concat(
        F.floor(F.col("wins") * 100 / F.col("starts")).cast("string"), F.lit("%-"),
        F.floor((F.col("wins") + F.col("places23")) * 100 / F.col("starts")).cast("string"), F.lit("% - "), F.col("starts"))
    text = F.when(F.col("tab") % 2 == 0, percent).otherwise(F.concat_ws("-", "wins", "places23", "starts"))
    return B.career(spark, d).select("race_id", "tab", X.parse_record(text).alias("r")).select("race_id", "tab", "r.*")


@register("t21_to_seconds", f"""
    select o_orderkey, {rounded('seconds')} from (select o_orderkey,
        cast(case when o_orderkey % 2 = 0 then o_orderkey % 3 * 60 + 20 + o_orderkey % 500 / 100.0 else 20 + o_orderkey % 500 / 100.0 end as double) as seconds from orders)""")
def t21_to_seconds(spark, d):
    tail = F.format_string("%05.2f", F.expr("20 + o_orderkey % 500 / 100D"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat((F.col("o_orderkey") % 3).cast("string"), F.lit(":"), tail)).otherwise(tail)
    return tidy(B.table(spark, d, "orders").select("o_orderkey", X.to_seconds(text).alias("seconds")))


@register("s2_gate_pages", """
    select doc_id, length(trim(text, ' ' || chr(10) || chr(9))) >= 300 as kept from documents""")
def s2_gate_pages(spark, d):
    kept, rejected = gate_pages(dealt(B.table(spark, d, "documents").select("doc_id", "text")))
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(rejected.select("doc_id", F.lit(False).alias("kept")))


@register("s1_decode_pages", """
    select doc_id, case when text is not null and doc_id % 5 in (0, 2) then md5(text) end as digest,
        case when text is null then null when doc_id % 5 = 1 then octet_length(encode(text))
            when doc_id % 5 = 3 then octet_length(encode(substr(text, 1, length(text) // 2))) when doc_id % 5 = 4 then 0 end as byte_offset,
        case when text is null then 'no content' when doc_id % 5 = 1 then 'ends within a character'
            when doc_id % 5 = 3 then 'byte that UTF-8 never has' when doc_id % 5 = 4 then 'continuation byte without a start' end as reason
    from documents""")
def s1_decode_pages(spark, d):
    """Whole texts as bytes, four in five of them with a byte order mark, cut at the end, or with a wrong byte inside or before."""
    docs = dealt(B.table(spark, d, "documents")).select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    utf8 = lambda c: F.encode(c, "UTF-8")
    byte = lambda x: F.unhex(F.lit(x))
    kind, whole = F.col("doc_id") % 5, utf8(F.col("text"))
    content = (
        F.when(kind == 1, F.concat(whole, byte("E282"))).when(kind == 2, F.concat(byte("EFBBBF"), whole))
        .when(kind == 3, F.concat(utf8(F.substr("text", F.lit(1), half)), byte("FF"), utf8(F.substr("text", half + 1))))
        .when(kind == 4, F.concat(byte("80"), whole)).otherwise(whole)
    )
    good, bad = decode_pages(docs.select("doc_id", content.alias("content")))
    return good.select("doc_id", F.md5("text").alias("digest")).unionByName(bad.drop("content"), allowMissingColumns=True)


@register("s3_write_view", over("contest_raw", query="""
    select race_id, count(*) as listed, cast(count_if(not scratched) as bigint) as active, cast(count_if(scratched) as bigint) as scratched
    from contest_raw group by race_id"""))
def s3_write_view(spark, d):
    path = shared_folder(spark, "view")
    write_view(V.listing_metrics(B.contest_raw(spark, d)), path)
    return spark.read.schema("race_id long, listed long, active long, scratched long").csv(path, header=True)


@register("s3_publish_view", over("contest_raw", query="""
    select race_id, count(*) as listed, cast(count_if(not scratched) as bigint) as active, cast(count_if(scratched) as bigint) as scratched
    from contest_raw group by race_id"""))
def s3_publish_view(spark, d):
    """Published without its scratched runners, then whole; what is read is the second version, compared with its manifest."""
    path, listed = shared_folder(spark, "published"), B.contest_raw(spark, d)
    publish_view(V.listing_metrics(listed.filter("not scratched")), path, "race_id")
    publish_view(V.listing_metrics(listed), path, "race_id")
    return read_view(spark, path, verify=True)


@register("s4_stream_captures", """
    select cast(user_id as varchar) as page_id, event_type as text from events
    qualify row_number() over (partition by user_id order by ts desc) = 1""")
def s4_stream_captures(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).select(
        F.col("user_id").cast("string").alias("page_id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("text"))
    log = shared_folder(spark, "captures")
    ingest(stream, f"{log}/log", f"{log}/checkpoint", min_chars=0).awaitTermination()
    return current_pages(spark, f"{log}/log").select("page_id", "text")


@register("s4_levelled_captures", """
    select cast(user_id as varchar) as page_id, event_type as text from events
    qualify row_number() over (partition by user_id order by ts desc) = 1""")
def s4_levelled_captures(spark, d):
    """The events in twelve files, a micro-batch each; small runs merge after every stream."""
    folder = shared_folder(spark, "levels")
    events = B.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("page_id"), F.col("ts").alias("captured_at"), F.col("event_type").alias("text"))
    for part in range(3):
        own = events.where(F.pmod(F.xxhash64("captured_at"), F.lit(3)) == part)
        own.repartition(4, "captured_at").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest(stream, f"{folder}/log", f"{folder}/checkpoint", min_chars=0).awaitTermination()
        merge(spark, f"{folder}/log", fanout=3)
    return levelled_pages(spark, f"{folder}/log").select("page_id", "text")


@register("s4_stream_predictions", _end_to_end(f"select race_id, tab, box, horse, pred_rank, early_rank, conf, rec, {rounded(*_NUMBERS)} from predicted"))
def s4_stream_predictions(spark, d):
    """Three waves: every page with other prices; as it is, beside repeats; captures that come late, and repeats again."""
    now = pages(spark, d).select("page_id", "captured_at", "text")
    other = F.regexp_replace("text", r"(?m)\$(\d+)", r"\$1$1")
    earlier = lambda hours: now.withColumn("captured_at", F.col("captured_at") - F.expr(f"interval {hours} hours")).withColumn("text", other)
    folder = shared_folder(spark, "live")
    for wave in (earlier(1), now.union(earlier(1)), earlier(2).union(now)):
        wave.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(now.schema).parquet(f"{folder}/in")
        predict_stream(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    df = current_predictions(spark, f"{folder}/log").withColumn("race_id", F.col("race_id").cast("long"))
    return tidy(df, "race_id", "tab", "box", "horse", "pred_rank", "early_rank", "conf", "rec", *_NUMBERS)


# --- reading the rendered pages back ---------------------------------------------------------------------------

@register("s1_read_pages", over("races", query="select cast(race_id as varchar) as page_id, 'CUP NUMBER ' || race_id as race_name from races"))
def s1_read_pages(spark, d):
    """Pages written as one text file each into 64 folders and read back; the whole text tells which page it is.

    Every task puts its files in place itself, as a commit by the driver moves them one by one; they are listed by folder,
    as a pattern of files is looked up file by file.
    """
    path = shared_folder(spark, "pages")
    written = pages(spark, d).select("page_id", "text")
    dealt = written.select("text", F.pmod(F.xxhash64("page_id"), F.lit(64)).alias("folder"))
    moved = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    dealt.write.options(**moved).partitionBy("folder").text(path)
    read = read_pages(spark, path).filter("captured_at is not null").select(
        F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"), E.race_header(X.clean_text("text"))["race_name"].alias("race_name"))
    known = written.select("page_id", F.md5("text").alias("digest"))
    return known.join(read, "digest").select("page_id", "race_name")


@register("t6_extract_race_header", over("races", query="""
    select race_id, track, cast(race_id % 12 + 1 as integer) as race_no, strftime(day, '%A, ') || day(day) ||
        case when day(day) in (11, 12, 13) then 'th' when day(day) % 10 = 1 then 'st' when day(day) % 10 = 2 then 'nd' when day(day) % 10 = 3 then 'rd' else 'th' end
        || strftime(day, ' %B %Y') as date, day as race_date, printf('%d:%02d', race_id % 10 + 10, race_id % 60) as time,
        'CUP NUMBER ' || race_id as race_name, 'Grade ' || race_id % 7 as race_type, printf('0:%.2f', 22 + race_id % 300 / 100.0) as fastest_time,
        round(22 + race_id % 300 / 100.0 + 1e-11, 8) + 0.0 as fastest_time_s, 'AUD $' || (race_id % 9 + 1) || ',530' as prize,
        cast((race_id % 9 + 1) * 1000 + 530 as double) as prize_amount, distance_m, 'ALL WEATHER' as surface,
        case when race_id % 2 = 0 then 'SLOW' else 'GOOD' end as going
    from (select *, cast(date '2026-01-01' + cast(race_id % 365 as integer) as date) as day from races)"""))
def t6_extract_race_header(spark, d):
    cleaned = pages(spark, d).withColumn("body", X.clean_text("text"))
    return tidy(cleaned.select(F.col("page_id").cast("long").alias("race_id"), E.race_header(F.col("body")).alias("h")).select("race_id", "h.*"))


@register("t7_find_table_columns", over("races", query="""
    select race_id, case when race_id % 5 < 2 then 17 end as line, case when race_id % 5 < 2 then 1 end as name,
           case when race_id % 5 < 2 then 3 end as trainer, case when race_id % 5 = 0 then 2 end as weight from races"""))
def t7_find_table_columns(spark, d):
    df = pages(spark, d).withColumn("body", X.clean_text("text")).withColumn("lines", F.split("body", "\n"))
    df = df.select("page_id", "lines", L.find_table_columns(F.col("lines"), F.col("body")).alias("c"))
    return df.select(F.col("page_id").cast("long").alias("race_id"), "c.line", "c.name", "c.trainer", "c.weight")


def _listed(df: DataFrame) -> DataFrame:
    df = df.select(F.col("page_id").cast("long").alias("race_id"), F.inline_outer("listed")).filter("tab is not null")
    return tidy(df.select("race_id", "tab", "horse", "weight", "trainer", "scratched", "tab_odds"))


def _layout_sql(which: str) -> str:
    return over("page_runners", extra=PAGE, query=f"select race_id, tab, horse, {rounded('weight')}, trainer, scratched, {rounded('tab_odds')} from page_runners where race_id % 5 in ({which})")


def _lines(spark, d) -> DataFrame:
    return pages(spark, d).withColumn("body", X.clean_text("text")).withColumn("lines", F.split("body", "\n"))


@register("t8_extract_field_table", _layout_sql("0, 1"))
def t8_extract_field_table(spark, d):
    df = _lines(spark, d).withColumn("columns", L.find_table_columns(F.col("lines"), F.col("body")))
    return _listed(df.withColumn("listed", L.field_table(F.col("lines"), F.col("columns"))))


@register("t9_extract_pipe_table", _layout_sql("2"))
def t9_extract_pipe_table(spark, d):
    return _listed(pages(spark, d).withColumn("listed", L.pipe_table(F.col("text"))))


@register("t10_extract_rows_by_anchor", _layout_sql("4"))
def t10_extract_rows_by_anchor(spark, d):
    # the layout is a fallback for pages that have no header row
    df = _lines(spark, d).withColumn("columns", L.find_table_columns(F.col("lines"), F.col("body")))
    rows = F.when(F.col("columns").isNull(), L.anchored_rows(F.col("lines")))
    return _listed(df.withColumn("listed", rows))


@register("t12_group_records", _layout_sql("3"))
def t12_group_records(spark, d):
    df = _lines(spark, d).withColumn("segment", L.table_segment(F.col("body")))
    return _listed(df.withColumn("listed", L.group_records(F.col("segment"))))


@register("t13_first_non_empty", over("page_runners", extra=PAGE, query=f"""
    select race_id, tab, box, horse, {rounded('weight')}, trainer, scratched, {rounded('tab_odds')}, tab > 8 and box > 0 as reserve_into_box from page_runners"""))
def t13_first_non_empty(spark, d):
    df = fields(spark, d).select(F.col("page_id").cast("long").alias("race_id"), F.inline_outer("listed"))
    return tidy(df.filter("tab is not null"))


@register("t13_remembered_forms", over("page_runners", extra=PAGE, query=f"""
    select race_id, tab, box, horse, {rounded('weight')}, trainer, scratched, {rounded('tab_odds')}, tab > 8 and box > 0 as reserve_into_box from page_runners"""))
def t13_remembered_forms(spark, d):
    """All but every twentieth page are parsed and remembered, then only the pages that are new; forms of all come from the store."""
    log, store = pages(spark, d), shared_folder(spark, "remembered")
    remember(log.filter("page_id % 20 > 0"), store)
    remember(log, store)
    forms = remembered_forms(log, store).withColumn("race_id", F.col("race_id").cast("long")).filter("tab is not null")
    return tidy(forms, "race_id", "tab", "box", "horse", "weight", "trainer", "scratched", "tab_odds", "reserve_into_box")


@register("t14_find_block_starts", over("page_runners", extra=PAGE, query="""
    select race_id, tab, row_number() over (partition by race_id order by tab) as nth from page_runners where shown"""))
def t14_find_block_starts(spark, d):
    df = fields(spark, d).withColumn("starts", E.find_block_starts(F.col("lines"), F.col("listed")))
    df = df.select(F.col("page_id").cast("long").alias("race_id"), F.posexplode_outer("starts").alias("n", "s")).filter("n is not null")
    return df.select("race_id", "s.tab", (F.col("n") + 1).cast("long").alias("nth"))


@register("t15_assign_blocks", over("page_runners", "page_runs", extra=PAGE, query="""
    select r.race_id, r.tab, case when shown then horse || '  ' || age || 'yo DK BDL D' end as header,
           case when shown then (select count(*) from page_runs n where n.race_id = r.race_id and n.tab = r.tab) end as run_lines
    from page_runners r"""))
def t15_assign_blocks(spark, d):
    block = F.col("block")
    return blocks(spark, d).select(
        "race_id", "tab", F.substring_index(block, "\n", 1).alias("header"),
        F.size(F.regexp_extract_all(block, F.lit("Runner Time"), F.lit(0))).cast("long").alias("run_lines"),
    ).withColumn("run_lines", F.when(F.col("header").isNotNull(), F.col("run_lines")))


@register("t16_lookback_form_price", over("page_runners", extra=PAGE, query=f"""
    select race_id, tab, case when shown then written_form end as form, case when shown then case when cast(written_form as integer) % 10 = 3 then 'tab' else 'betfair' end end as market,
           {rounded('price')} from (select *, case when not shown then null when scratched then 4.2 else listed_bf end as price from page_runners)"""))
def t16_lookback_form_price(spark, d):
    pair = E.form_and_price(F.col("before"), F.col("block"), F.col("blank_lines"))
    return tidy(blocks(spark, d).withColumn("pair", pair).select("race_id", "tab", "pair.form", "pair.market", "pair.price"))


@register("t17_value_after_label", over("page_runners", extra=PAGE, query="""
    select race_id, tab, case when shown and tra_dist_best <> 0 then case when tab % 2 = 0 then '0:' else '' end || printf('%.2f', tra_dist_best) end as best,
           case when shown then '$' || (p // 10) || '.' || (p % 10) || 'k' || case when tab % 2 = 0 then '12m PM' else '' end end as prize
    from (select *, (race_id * 7 + tab * 13) % 900 + 100 as p from page_runners)"""))
def t17_value_after_label(spark, d):
    return blocks(spark, d).select(
        "race_id", "tab", X.first_line_after("block", "Tra/Dist Best Time").alias("best"), X.first_line_after("block", "car pm").alias("prize")
    )


_STRIPS = {
    **PAGE,
    "shown_records": (("page_runners", "career", "records"), """
        select p.race_id, p.tab, p.shown, k.kind,
            case when not shown then 0 when k.kind in ('career', '12m') then coalesce(c.wins, 0) when k.kind = '2u' then 1 else coalesce(r.wins, 0) end as w,
            case when not shown then 0 when k.kind in ('career', '12m') then coalesce(c.places23, 0) when k.kind = '3u' then 1 else coalesce(r.places23, 0) end as p,
            case when not shown then 0 when k.kind in ('career', '12m') then coalesce(c.starts, 0) when k.kind in ('2u', '3u') then 1 else coalesce(r.starts, 0) end as s,
            shown and k.kind in ('career', '12m') and p.tab % 2 = 0 and c.starts is not null as in_percent
        from page_runners p cross join (select unnest(['career', '12m', 'course', 'distance', 'course_distance', 'fu', '2u', '3u']) as kind) k
        left join career c on c.race_id = p.race_id and c.tab = p.tab
        left join records r on r.race_id = p.race_id and r.tab = p.tab and r.kind = k.kind"""),
}


@register("t19_split_glued_pairs", over("shown_records", extra=_STRIPS, query="""
    select race_id, tab, kind, case when in_percent then a || '%-' || b || '%-' || s else w || '-' || p || '-' || s end as display,
        case when in_percent then cast(wa as integer) else w end as wins,
        case when in_percent then cast(greatest(greatest(wa, least(wb, s)) - wa, 0) as integer) else p end as places23, s as starts
    from (select *, round_even(s * a / 100.0, 0) as wa, round_even(s * b / 100.0, 0) as wb
          from (select *, cast(round(w * 100 / greatest(s, 1)) as integer) as a, cast(round((w + p) * 100 / greatest(s, 1)) as integer) as b from shown_records))"""))
def t19_split_glued_pairs(spark, d):
    return E.runner_records(forms(spark, d))


@register("t20_extract_facts", over("page_runners", extra=PAGE, query=f"""
    select race_id, tab, case when shown then strip_dls end as dls, case when shown then 20 end as dlw,
           {rounded('roi', 'career_pm', 'pm_12m')} from (
        select *, case when shown then roi_percent / 100 end as roi, case when shown then p * 100.0 end as career_pm,
               case when shown and tab % 2 = 1 then (p % 7 + 1.5) * 1e6 end as pm_12m
        from (select *, (race_id * 7 + tab * 13) % 900 + 100 as p from page_runners))"""))
def t20_extract_facts(spark, d):
    facts = X.extract_facts(X.section("block", E.P.FACTS))
    df = blocks(spark, d).withColumn("f", facts).select("race_id", "tab", "f.dls", "f.dlw", "f.roi", "f.career_pm", "f.pm_12m")
    return tidy(df)


@register("t22_unpivot_counts", over("page_runners", "box_counts", extra=PAGE, query="""
    select p.race_id, p.tab, b.box, cast(case when shown then coalesce(c.wins, 0) else 0 end as integer) as wins,
           cast(case when shown then coalesce(c.places23, 0) else 0 end as integer) as places23, cast(case when shown then coalesce(c.starts, 0) else 0 end as integer) as starts
    from page_runners p cross join (select cast(unnest(range(1, 9)) as integer) as box) b
    left join box_counts c on c.race_id = p.race_id and c.tab = p.tab and c.box = b.box"""))
def t22_unpivot_counts(spark, d):
    return E.box_stats(forms(spark, d))


@register("t23_extract_runs", over("page_runs", extra=PAGE, query=f"""
    select race_id, tab, k, strftime(run_day, '%d %b %Y') as run_date, track, finish, field, cast(o_orderkey % 40 + 1 as integer) as mrk_rank, {rounded('mrk_delta')} from page_runs"""))
def t23_extract_runs(spark, d):
    return tidy(E.recent_runs(forms(spark, d)), "race_id", "tab", "k", "run_date", "track", "finish", "field", "mrk_rank", "mrk_delta")


@register("t24_extract_metrics", over("all_runs", query=f"""
    select o_orderkey, distance, prior_box, 'GR ' || field as class, {rounded('margin', 'bom_adj', 'first_split', 'race_time', 'bom', 'runner_time', 'sp', 'weight')} from (
        select *, o_orderkey % 2 * 60 + 20 + o_orderkey % 500 / 100.0 as race_time, 19 + o_orderkey % 700 / 100.0 as bom,
               21 + o_orderkey % 600 / 100.0 as runner_time, 1 + o_orderkey % 3000 / 100.0 as sp, 25 + o_orderkey % 90 / 10.0 as weight from all_runs)"""))
def t24_extract_metrics(spark, d):
    lines = dealt(B.all_runs(spark, d)).select("o_orderkey", render.run_line().alias("line"))
    return tidy(X.extract_metrics(lines, "line").drop("line"))


@register("t25_extract_comments", over("all_runs", query="""
    select o_orderkey, stewards, settle_pos, case when settle_pos is not null and o_orderkey % 3 = 0 then field end as turn_pos, prior_box as split_rank from all_runs"""))
def t25_extract_comments(spark, d):
    lines = dealt(B.all_runs(spark, d)).select("o_orderkey", X.extract_comments(render.run_line()).alias("c"))
    return lines.select("o_orderkey", "c.*")


@register("t26_extract_profile", over("page_runners", extra=PAGE, query=f"""
    select race_id, tab, case when shown then age end as age, case when shown then 'DK BDL' end as colour, case when shown then 'D' end as sex,
        {rounded('win', 'place', 'best')}, case when shown then 50 end as trainer_l50_n from (
        select *, case when shown then trainer_win end as win, case when shown then trainer_place end as place,
               case when shown and tra_dist_best <> 0 then tra_dist_best end as best from page_runners)"""))
def t26_extract_profile(spark, d):
    p = blocks(spark, d).withColumn("p", E.profile(F.col("block")))
    return tidy(p.select("race_id", "tab", "p.age", "p.colour", "p.sex", F.col("p.trainer_win").alias("win"),
                         F.col("p.trainer_place").alias("place"), F.col("p.tra_dist_best").alias("best"), "p.trainer_l50_n"))


@register("t27_resolve_freshness", over("page_runners", extra=PAGE, query="""
    select race_id, tab, case when shown then dls end as dls, case when shown then 20 end as dlw, case when shown and tab % 3 = 0 then age end as runs_this_prep from page_runners"""))
def t27_resolve_freshness(spark, d):
    df = blocks(spark, d).withColumn("facts", X.extract_facts(X.section("block", E.P.FACTS)))
    df = df.withColumn("f", E.resolve_freshness(F.col("block"), F.col("facts")))
    return df.select("race_id", "tab", "f.dls", "f.dlw", "f.runs_this_prep")


@register("pages_to_runners", over("page_runners", extra=PAGE, query=f"""
    select race_id, tab, box, horse, trainer, scratched, form, dls, shown as has_detail, {rounded('weight', 'tab_odds', 'bf_odds', 'trainer_win', 'trainer_place', 'tra_dist_best')} from page_runners"""))
def pages_to_runners(spark, d):
    return tidy(E.runners(forms(spark, d)), "race_id", "tab", "box", "horse", "trainer", "scratched", "form", "dls", "has_detail",
                "weight", "tab_odds", "bf_odds", "trainer_win", "trainer_place", "tra_dist_best")


@register("pages_to_warnings", over("page_runners", "page_runs", "races", extra=PAGE, query="""
    with judged as (select p.*, (select count(*) from page_runs n where n.race_id = p.race_id and n.tab = p.tab) as n_runs from page_runners p)
    select race_id, 'no_detail' as code, tab, 'No detail block found for #' || tab || ' ' || horse || '.' as detail from judged where not shown
    union all select race_id, 'unassigned_reserve', null, 'One or more active reserves could not be assigned to a vacant box.'
        from judged where not scratched and box = 0 group by race_id
    union all select race_id, 'details_missing', null, 'Detailed form was not parsed for ' || count(*) || ' active runner(s).'
        from judged where not scratched and not shown group by race_id
    union all select race_id, 'few_runs', null, count(*) || ' active runner(s) have fewer than three parsed recent runs; model confidence is reduced.'
        from judged where not scratched and n_runs < 3 group by race_id""").replace("\n    with judged as (", ",\njudged as (", 1))
def pages_to_warnings(spark, d):
    # Warnings read the runners several times, so what they need of the forms is stored first
    f = forms(spark, d).select(
        "race_id", "captured_at", "race", "listed_no", "tab", "horse", "box", "scratched", "has_detail", F.size("run_lines").alias("n_runs"))
    f = durable(f)
    return R.quality_warnings(E.runners(f), E.races(f))


@register("pages_to_predictions", _end_to_end(f"select race_id, tab, box, horse, pred_rank, early_rank, conf, rec, {rounded(*_NUMBERS)} from predicted"))
def pages_to_predictions(spark, d):
    df = PR.predict_forms(forms(spark, d))
    return tidy(df, "race_id", "tab", "box", "horse", "pred_rank", "early_rank", "conf", "rec", *_NUMBERS)


@register("pages_to_predictions_repeated", _end_to_end(f"select race_id, tab, box, horse, pred_rank, early_rank, conf, rec, {rounded(*_NUMBERS)} from predicted"))
def pages_to_predictions_repeated(spark, d):
    """Every page was captured before with other prices, and once more as it is."""
    now = pages(spark, d)
    before = now.withColumn("captured_at", F.col("captured_at") - F.expr("interval 1 hour")).withColumn(
        "text", F.regexp_replace("text", r"(?m)\$(\d+)", r"\$1$1"))
    captures = newest_captures(now.union(before).union(now))
    df = PR.predict_forms(E.runner_forms(captures).withColumn("race_id", F.col("race_id").cast("long")))
    return tidy(df, "race_id", "tab", "box", "horse", "pred_rank", "early_rank", "conf", "rec", *_NUMBERS)
