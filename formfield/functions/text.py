"""Column functions over text. Nothing here needs more than the row it is given."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from formfield import constants as K
from formfield.functions import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(col, pattern: str, group: int = 1) -> Column:
    """A captured group, NULL where it is empty or the pattern is absent."""
    return F.nullif(F.regexp_extract(_col(col), pattern, group), F.lit(""))


def strip(col) -> Column:
    return F.btrim(_col(col), F.lit(P.WS_CHARS))


def _if_rare(text: Column, handled: Column) -> Column:
    """Skip the handling of rare white space for texts that have none."""
    return F.when(text.rlike(P.RARE_WS), handled).otherwise(text)


def one_line_ends(col) -> Column:
    """Every line end as a newline, without the one that ends the text."""
    text = _if_rare(_col(col), F.regexp_replace(_col(col), P.LINE_END, "\n"))
    return F.when(F.endswith(text, F.lit("\n")), F.regexp_replace(text, r"\n\z", "")).otherwise(text)


def split_lines(col) -> Column:
    return F.split(one_line_ends(col), "\n")


def unmark(col) -> Column:
    """Text without link targets, emphasis, heading marks and bullets."""
    t = _if_rare(_col(col), F.translate(_col(col), P.WIDE_SPACES, " " * len(P.WIDE_SPACES)))
    for old, new in P.ESCAPED.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, P.LINK, "$1")
    for mark in P.EMPHASIS:
        t = F.replace(t, F.lit(mark), F.lit(""))
    t = F.regexp_replace(t, P.LINE_MARK, "")
    return F.regexp_replace(t, P.BULLET, "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. A plain reuse of an expression computes it
    again wherever a lambda or a branch keeps Spark from sharing it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_lines(text: Column) -> Column:
    """Every line stripped; texts without rare white space need only look for blanks and tabs."""
    ws = P.NOT_NL_WS
    general = F.regexp_replace(one_line_ends(text), rf"(?md)^[{ws}]++|(?<![{ws}])[{ws}]++(?=\n|\z)", "")
    simple = F.regexp_replace(text, r"(?=[ \t\n])(?:\n\z|(?md)^[ \t]++|(?<![ \t])[ \t]++(?=\n|\z))", "")
    return F.when(text.rlike(P.RARE_WS), general).otherwise(simple)


def clean_text(col) -> Column:
    """Text without common Markdown marks, every line stripped; lines and pipes are kept."""
    return let(unmark(col), strip_lines)


def split_cells(col, keep_empty: bool = True) -> Column:
    """Cells of a row: tab-separated if it has a tab, else separated by two or more spaces."""
    line = _col(col)
    cells = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(
        F.split(line, rf"[{P.WS}]{{2,}}")
    )
    cells = F.transform(cells, strip)
    return cells if keep_empty else F.filter(cells, lambda c: c != "")


def normalise_name(col) -> Column:
    name = F.coalesce(_col(col), F.lit(""))
    return F.upper(strip(F.regexp_replace(name, rf"[{P.WS}]+", " ")))


_NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)$"


def _as_double(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_number(col, default: float | None = 0.0) -> Column:
    """Number without its dollar sign, commas or ``sec``; ``default`` if it is none."""
    text = strip(F.regexp_replace(_col(col).cast("string"), r"[$,]|sec", ""))
    return F.coalesce(_as_double(text), F.lit(default).cast("double"))


def to_int(col, default: int | None = 0) -> Column:
    """Whole number, truncated toward zero through a double."""
    value = _as_double(strip(_col(col).cast("string")))
    value = F.when(~F.isnan(value), F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)))
    return F.coalesce(value.try_cast("int"), F.lit(default).cast("int"))


def to_seconds(col) -> Column:
    """``0:23.31`` or ``23.31`` as seconds."""
    text = strip(_col(col))
    head = F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 1)
    tail = F.regexp_extract(text, r"(?s)^(.*):([^:]*)$", 2)
    whole = F.when(text.isNotNull(), to_number(text))
    return F.when(F.contains(text, F.lit(":")), to_number(head) * 60.0 + to_number(tail)).otherwise(whole)


def parse_record(col) -> Column:
    """``3-6-26`` or ``3%-29%-34`` as a struct of display text and three counts."""
    text = F.regexp_replace(F.coalesce(_col(col), F.lit("")), rf"[{P.WS}]+", "")
    whole = F.regexp_extract(text, P.PERCENT_RECORD, 0)
    win_text, top_text = (F.regexp_extract(whole, P.PERCENT_RECORD, i) for i in (1, 2))
    starts = F.regexp_extract(whole, P.PERCENT_RECORD, 3).try_cast("int")
    wins = F.rint(starts * win_text.try_cast("double") / 100.0).cast("int")
    top3 = F.rint(starts * top_text.try_cast("double") / 100.0).cast("int")
    top3 = F.greatest(wins, F.least(top3, starts))
    counts = F.regexp_extract(text, P.COUNT_RECORD, 0)
    c = [F.regexp_extract(counts, P.COUNT_RECORD, i).try_cast("int") for i in (1, 2, 3)]

    def record(display, w, p, s):
        return F.struct(
            display.alias("display"), w.alias("wins"), p.alias("places23"), s.alias("starts")
        )

    percent = record(
        F.concat(win_text, F.lit("%-"), top_text, F.lit("%-"), starts.cast("string")),
        wins, F.greatest(top3 - wins, F.lit(0)), starts,
    )
    plain = record(F.concat_ws("-", *[x.cast("string") for x in c]), *c)
    none = record(F.lit(K.NO_RECORD), F.lit(0), F.lit(0), F.lit(0))
    return F.when(whole != "", percent).when(counts != "", plain).otherwise(none)


def section(text, pattern: str) -> Column:
    """The captured section on one line, or the whole text where its marker is missing."""
    text = _col(text)
    part = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)
    return F.regexp_replace(part, P.WS_RUN, " ")


def split_glued_pairs(col, labels=K.RECORD_LABELS, value: str = P.RECORD_VALUE, last: str = "Facts") -> Column:
    """Values of ordered labels in a strip whose values run into the next label.

    One pattern takes all labels in one pass. Every label is optional, and its value ends
    where a later label (or ``last``, or the end) can start, which decides how glued digits
    are split. The result is an array in label order, '' for an absent label.
    """
    parts = []
    for i, label in enumerate(labels):
        stops = "|".join([re.escape(x) for x in labels[i + 1:]] + [re.escape(last), r"\z"])
        parts.append(rf"(?:.*?{re.escape(label)}\s*({value})(?=\s*(?:{stops})))?")
    pattern = r"(?is)\A" + "".join(parts) + r".*\z"
    groups = "\n".join(f"${i}" for i in range(1, len(labels) + 1))
    return F.split(F.regexp_replace(_col(col), pattern, groups), "\n", -1)


def _money(text: Column, pattern: str) -> Column:
    amount = to_number(F.regexp_extract(text, pattern, 1))
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scaled = amount * F.when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)
    return F.when(text != "", scaled)


def extract_facts(col) -> Column:
    """Struct of days since last run and win, return on investment and prize money."""
    text = _col(col)
    return F.struct(
        extract(text, P.FACT_DLS).try_cast("int").alias("dls"),
        extract(text, P.FACT_DLW).try_cast("int").alias("dlw"),
        (extract(text, P.FACT_ROI).try_cast("double") / 100.0).alias("roi"),
        _money(F.regexp_extract(text, P.FACT_CAREER_PM, 0), P.FACT_CAREER_PM).alias("career_pm"),
        _money(F.regexp_extract(text, P.FACT_12M_PM, 0), P.FACT_12M_PM).alias("pm_12m"),
    )


def _captured_number(text: Column) -> Column:
    """A run of digits and dots: NULL if absent, 0 if malformed."""
    return F.when(text != "", F.coalesce(text.try_cast("double"), F.lit(0.0)))


_METRIC_TYPES = {
    "number": _captured_number,
    "int": lambda text: text.try_cast("int"),
    "time": lambda text: to_seconds(F.nullif(text, F.lit(""))),
    "text": lambda text: F.nullif(strip(text), F.lit("")),
}


def metric_texts(col, specs: dict[str, tuple[str, str]] = P.RUN_METRICS) -> dict[str, Column]:
    """The written value of each metric, '' if absent."""
    return {name: F.regexp_extract(_col(col), pattern, 1) for name, (pattern, _) in specs.items()}


def metric_values(texts: dict[str, Column], specs: dict[str, tuple[str, str]] = P.RUN_METRICS) -> dict[str, Column]:
    """Typed values of written metrics."""
    return {name: _METRIC_TYPES[kind](texts[name]) for name, (_, kind) in specs.items()}


def extract_metrics(df, line: str, specs: dict[str, tuple[str, str]] = P.RUN_METRICS):
    """Add typed columns found by one pattern each. The written values form a projection of
    their own, so that each pattern runs once per line."""
    texts = {f"__{name}": text for name, text in metric_texts(line, specs).items()}
    values = metric_values({name: F.col(f"__{name}") for name in specs}, specs)
    return df.withColumns(texts).withColumns(values).drop(*texts)


def extract_comments(col) -> Column:
    """Struct of the steward note, in-running positions and last sectional rank."""
    line = _col(col)
    note = F.regexp_replace(strip(F.regexp_extract(line, P.STEWARDS, 1)), r"\.+\z", "")
    labelled = F.regexp_extract(line, P.SETTLED_LABELLED, 0)
    settled = F.when(labelled != "", labelled).otherwise(F.regexp_extract(line, P.SETTLED_BARE, 0))
    return F.struct(
        F.nullif(note, F.lit("")).alias("stewards"),
        extract(settled, P.SETTLED_BARE, 1).try_cast("int").alias("settle_pos"),
        extract(settled, P.SETTLED_BARE, 2).try_cast("int").alias("turn_pos"),
        extract(line, P.SPLIT_RANK).try_cast("int").alias("split_rank"),
    )


def flag_phrases(col, phrases) -> Column:
    """1 where the note has any of the phrases, else 0."""
    note = F.lower(F.coalesce(_col(col), F.lit("")))
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(note, F.lit(phrase))
    return hit.cast("int")


def first_line_after(text, label: str, within: int = 3) -> Column:
    """First non-blank line among the ``within`` lines after a line that is the label."""
    blank = rf"(?:[{P.NOT_NL_WS}]*\n){{0,{within - 1}}}"
    pattern = rf"(?mid)^[{P.NOT_NL_WS}]*{re.escape(label)}[{P.NOT_NL_WS}]*\n{blank}([^\n]*[^{P.WS}][^\n]*)$"
    return F.nullif(strip(F.regexp_extract(_col(text), pattern, 1)), F.lit(""))


def segment_between(text, start: str, end: str) -> Column:
    """Text after the first line matching ``start`` up to the first ``end`` line of the text.

    An ``end`` that lies before the start is no end. NULL without a start. Neither pattern
    may capture groups.
    """
    text = _col(text)
    upto = F.regexp_extract(text, rf"\A(?s:.*?){start}", 0)
    after = F.regexp_extract(text, rf"{start}((?s:.*))\z", 1)
    cut = F.regexp_extract(after, rf"\A((?s:.*?)){end}", 1)
    return F.when(
        text.rlike(start), F.when(after.rlike(end) & ~upto.rlike(end), cut).otherwise(after)
    )


def count_rows(text, label: str) -> Column:
    """Eight or more whole numbers of the first line that begins with the label, else NULL."""
    pattern = rf"(?mid)^[{P.NOT_NL_WS}]*\|?[{P.NOT_NL_WS}]*{re.escape(label)}\b[{P.NOT_NL_WS}]*\|?([^\n]*)$"
    numbers = F.regexp_extract_all(F.regexp_extract(_col(text), pattern, 1), F.lit(P.WHOLE_NUMBER), F.lit(0))
    numbers = F.transform(numbers, lambda x: x.try_cast("int"))
    return F.when(F.size(numbers) >= 8, F.slice(numbers, 1, 8))
