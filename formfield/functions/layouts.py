"""The four layouts of a field table, each read from one page's own lines.

Every function takes array columns of lines and returns an array of the same runner struct,
so a page never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions import patterns as P
from formfield.functions.text import (
    let, normalise_name, one_line_ends, segment_between, split_cells, split_lines, strip, to_number,
)

RUNNER = (
    "array<struct<tab:int,box:int,horse:string,weight:double,trainer:string,"
    "scratched:boolean,tab_odds:double>>"
)


def _runner(tab, horse, weight, trainer, scratched, price) -> Column:
    return F.struct(
        tab.alias("tab"),
        F.when(tab <= K.MAX_BOX, tab).otherwise(0).alias("box"),
        horse.alias("horse"),
        weight.alias("weight"),
        trainer.alias("trainer"),
        scratched.alias("scratched"),
        F.when(scratched, K.NO_PRICE).otherwise(price).alias("tab_odds"),
    )


def _valid(runners: Column) -> Column:
    return F.filter(
        runners, lambda r: r["tab"].between(1, K.MAX_TAB) & r["horse"].rlike(P.LETTER)
    ).cast(RUNNER)


def _tab(cell: Column) -> Column:
    return F.when(cell.rlike(P.TAB_CELL), cell.try_cast("int"))


def _cell(cells: Column, index: Column) -> Column:
    return F.coalesce(F.get(cells, index), F.lit(""))


def _last_price(cells: Column, pattern: str) -> Column:
    prices = F.filter(cells, lambda c: c.rlike(pattern))
    return to_number(F.try_element_at(prices, F.lit(-1)), K.NO_PRICE)


def _from(cells: Column, index: Column) -> Column:
    """Cells from a 0-based index on."""
    return F.slice(cells, index + 1, F.greatest(F.size(cells) - index, F.lit(0)))


def _first_of(cells: Column, labels) -> Column:
    """0-based place of the first cell that is one of the labels."""
    hits = F.filter(F.transform(cells, lambda c, i: F.when(c.isin(*labels), i)), lambda i: i.isNotNull())
    return F.get(hits, 0)


def find_table_columns(lines: Column, text: Column) -> Column:
    """Line and column numbers of the first ``Tab | Runner | … | Trainer`` header, by label."""
    candidates = F.regexp_extract_all(text, F.lit(P.TABLE_HEADER), F.lit(0))
    cells = F.transform(candidates, lambda x: F.struct(
        x.alias("x"), F.transform(split_cells(x), lambda c: F.lower(c)).alias("low")))
    valid = F.filter(cells, lambda h: (F.size(h["low"]) >= 3) & (F.get(h["low"], 0) == "tab")
                     & F.exists(h["low"], lambda c: c.isin(*P.NAME_HEADERS)))
    return F.get(F.transform(F.slice(valid, 1, 1), lambda h: F.struct(
        (F.array_position(lines, h["x"]) - 1).cast("int").alias("line"),
        _first_of(h["low"], P.NAME_HEADERS).alias("name"),
        _first_of(h["low"], ("trainer",)).alias("trainer"),
        _first_of(h["low"], P.WEIGHT_HEADERS).alias("weight"),
    )), 0)


def field_table(lines: Column, header: Column) -> Column:
    """Rows under a header row: name, trainer and weight by label, price by position."""
    below = F.slice(lines, header["line"] + 2, F.greatest(F.size(lines) - header["line"] - 1, F.lit(0)))
    rows = F.transform(F.filter(below, lambda x: x.rlike(P.TABLE_ROW)), lambda x: split_cells(x))
    after = F.coalesce(header["trainer"], header["name"]) + 1

    def runner(cells):
        weight = _cell(cells, header["weight"])
        return _runner(
            _tab(F.get(cells, 0)), normalise_name(_cell(cells, header["name"])),
            F.when(weight != "", to_number(weight)), normalise_name(_cell(cells, header["trainer"])),
            F.exists(cells, lambda c: c.rlike(P.WHOLE_SCRATCH)),
            _last_price(_from(cells, after), P.PRICE_CELL),
        )

    found = F.when(header["line"].isNotNull(), _valid(F.transform(rows, runner)))
    return F.coalesce(found, F.array().cast(RUNNER))


def pipe_table(raw: Column) -> Column:
    """Markdown rows ``| 1 | [NAME](…) | weight | [TRAINER](…) | …`` of uncleaned text."""
    rows = F.regexp_extract_all(one_line_ends(raw), F.lit(P.PIPE_ROW), F.lit(0))
    rows = F.transform(
        rows, lambda x: F.transform(F.split(F.btrim(strip(x), F.lit("|")), r"\|"), strip)
    )

    def label(cell):
        linked = F.regexp_extract(cell, P.PIPE_LINK, 1)
        return normalise_name(F.when(cell.rlike(P.PIPE_LINK), linked).otherwise(
            F.regexp_replace(cell, r"[\[\]*]", "")))

    def runner(cells):
        rest = _from(cells, F.lit(4))
        plain = F.transform(rest, lambda c: strip(F.regexp_replace(c, r"[*$]", "")))
        return _runner(
            F.regexp_replace(F.get(cells, 0), r"\D", "").try_cast("int"), label(F.get(cells, 1)),
            to_number(F.get(cells, 2)), label(F.get(cells, 3)),
            F.exists(rest, lambda c: c.rlike(P.WORD_SCRATCH)), _last_price(plain, P.PLAIN_NUMBER),
        )

    runners = F.transform(F.filter(rows, lambda c: F.size(c) >= 5), runner)
    found = F.filter(
        runners,
        lambda r: r["tab"].between(1, K.MAX_TAB) & (r["horse"] != "") & ~F.startswith(r["horse"], F.lit("HTTP")),
    ).cast(RUNNER)
    return F.when(raw.rlike(P.PIPE_NUMBER), found).otherwise(F.array().cast(RUNNER))


def anchored_rows(lines: Column) -> Column:
    """Rows without a header: the first two-digit weight cell anchors trainer and price."""
    rows = F.transform(F.filter(lines, lambda x: x.rlike(P.TABLE_ROW)), lambda x: split_cells(x, keep_empty=False))

    def anchor(cells):
        at = F.filter(
            F.transform(cells, lambda c, i: F.when((i >= 2) & c.rlike(P.WEIGHT_CELL), i)), lambda i: i.isNotNull()
        )
        return F.struct(cells.alias("cells"), F.get(at, 0).alias("at"))

    def runner(row):
        cells, at = row["cells"], row["at"]
        return _runner(
            _tab(F.get(cells, 0)), normalise_name(F.get(cells, 1)), to_number(F.get(cells, at)),
            normalise_name(_cell(cells, at + 1)), F.exists(cells, lambda c: c.rlike(P.WORD_SCRATCH)),
            _last_price(_from(cells, at + 2), P.PRICE_CELL),
        )

    anchored = F.filter(
        F.transform(F.filter(rows, lambda c: F.size(c) >= 4), anchor), lambda r: r["at"].isNotNull()
    )
    return _valid(F.transform(anchored, runner))


def group_records(lines: Column) -> Column:
    """One cell per line: a number line opens a record of name, weight, trainer and then any
    scratch mark or price up to the next number line."""
    filled = F.filter(lines, lambda x: (x != "") & ~x.rlike(P.RULE_LINE))
    found = let(filled, lambda cells: let(F.transform(cells, lambda x, i: i), lambda places: _records(cells, places)))
    return F.coalesce(found.cast(RUNNER), F.array().cast(RUNNER))


def _records(lines: Column, positions: Column) -> Column:
    def opens(i):
        return (
            _tab(F.get(lines, i)).between(1, K.MAX_TAB) & (i + 3 < F.size(lines))
            & F.upper(F.get(lines, i + 1)).rlike("[A-Z]") & F.get(lines, i + 2).rlike(P.WEIGHT_CELL)
        )

    starts = F.filter(positions, opens)
    # a record owns the three lines after its number, so none of them opens another one
    starts = F.aggregate(
        starts, F.array().cast("array<int>"),
        lambda acc, i: F.when(
            i > F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-9)) + 3, F.array_append(acc, i)
        ).otherwise(acc),
    )

    def runner(i):
        stop = F.get(F.filter(positions, lambda j: (j >= i + 4) & F.get(lines, j).rlike(P.TAB_CELL)), 0)
        tail = F.slice(lines, i + 5, F.greatest(F.coalesce(stop, F.size(lines)) - i - 4, F.lit(0)))
        scratched = F.exists(tail, lambda x: x.rlike(P.WORD_SCRATCH))
        return _runner(
            _tab(F.get(lines, i)), normalise_name(F.get(lines, i + 1)), to_number(F.get(lines, i + 2)),
            normalise_name(F.get(lines, i + 3)), scratched, _last_price(tail, P.PRICE_CELL),
        )

    return F.transform(starts, runner)


def table_segment(text: Column) -> Column:
    """Lines of the field table in the one-cell-per-line layout."""
    glued = segment_between(text, P.GLUED_HEADER, P.TABLE_END)
    return split_lines(F.coalesce(glued, segment_between(text, P.SPLIT_HEADER, P.TABLE_END)))


def first_per_tab(runners: Column) -> Column:
    """Keep the first listed runner of each tab."""
    tabs = F.transform(runners, lambda r: r["tab"])
    return F.filter(runners, lambda r, i: F.array_position(tabs, r["tab"]) == i + 1)


def seat_reserves(runners: Column) -> Column:
    """Active reserves take the vacant boxes: listing order against ascending box."""
    vacant = F.array_sort(F.transform(
        F.filter(runners, lambda r: r["scratched"] & (r["tab"] <= K.MAX_BOX)), lambda r: r["tab"]
    ))
    takers = F.transform(
        F.filter(runners, lambda r: ~r["scratched"] & (r["tab"] > K.MAX_BOX)), lambda r: r["tab"]
    )

    def seated(r):
        seat = F.get(vacant, (F.array_position(takers, r["tab"]) - 1).cast("int"))
        seat = F.when(~r["scratched"] & (r["tab"] > K.MAX_BOX), seat)
        return r.withField("box", F.coalesce(seat, r["box"])).withField("reserve_into_box", seat.isNotNull())

    return F.transform(runners, seated)
