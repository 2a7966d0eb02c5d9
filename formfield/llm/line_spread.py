"""Cross-site boilerplate lines and passages, found by HyperLogLog sketches of the sites that carry a line."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed, fresh, quoted

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: Words beyond which a line is a passage, and distinct sites from which a passage counts as repeated.
PASSAGE_WORDS = 50
PASSAGE_SITES = 2
#: Registers of a sketch, as a power of two.
PRECISION = 8
#: Standard errors around the threshold within which sites are counted exactly.
BAND = 4.0
#: Chance at most that a line at the threshold fills too few registers to be counted.
MISSED = 1e-9


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(F.trim(line)).alias("h1"), F.xxhash64(F.trim(line), F.lit(1)).alias("h2")]


def _lines(text: str) -> Column:
    return F.split(quoted(text).cast("string"), "\n")


def text_key(text: str) -> Column:
    """A number for the whole text: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(quoted(text).cast("string")), 1, 15), 16, 10).cast("long")


def _is_passage(line: Column, words: int) -> Column:
    return (F.length(line) > 2 * words) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) > words)


def site_lines(
    documents: DataFrame, doc_id: str, text: str, site: str, precision: int, passage_words: int = PASSAGE_WORDS
) -> DataFrame:
    """One row per non-blank line: its two hashes, its text's key, its site, and the site's register and rank in a sketch."""
    h = F.xxhash64("site")
    rest = F.shiftrightunsigned(h, precision)
    rank = F.lit(64 - precision + 1) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    sited = documents.select(
        quoted(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), quoted(site).cast("string")), F.lit("")).alias("site"),
        text_key(text).alias("own"), _lines(text).alias("lines"),
    )
    sited = sited.select(
        "doc_id", "site", "own", h.bitwiseAND(F.lit((1 << precision) - 1)).cast("int").alias("register"),
        rank.cast("int").alias("rank"), F.explode("lines").alias("line"),
    )
    return sited.where(F.trim("line") != "").select(
        "doc_id", "site", "own", "register", "rank", _is_passage(F.col("line"), passage_words).alias("passage"), *_line_key(F.col("line"))
    )


def fewest_registers(sites: int, precision: int, missed: float = MISSED) -> int:
    """Registers that so many sites fill at least, but for a chance of ``missed``."""
    m = 1 << precision
    chance = [1.0] + [0.0] * min(sites, m)
    for _ in range(sites):
        chance = [0.0] + [chance[n] * n / m + chance[n - 1] * (m - n + 1) / m for n in range(1, len(chance))]
    fewer = 0.0
    for n, p in enumerate(chance):
        fewer += p
        if fewer > missed:
            return n
    return len(chance) - 1


def spread(lines: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``(h1, h2, passage, sites, filled, first, last)``: estimated distinct sites of each line, how many registers they
    fill, and the smallest and largest key of its texts.

    A sketch is kept as rows of (line, register, highest rank), so sketches merge by an ordinary maximum that is
    combined before the exchange; a line never has more rows than registers, however many sites carry it.
    """
    m = 1 << precision
    alpha = 0.7213 / (1 + 1.079 / m)
    ends = lambda low, high: [F.min(low).alias("first"), F.max(high).alias("last")]
    registers = lines.groupBy("h1", "h2", "passage", "register").agg(F.max("rank").alias("rank"), *ends("own", "own"))
    merged = registers.groupBy("h1", "h2", "passage").agg(
        F.count("*").alias("n"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("z"), *ends("first", "last")
    )
    raw = F.lit(alpha * m * m) / (F.col("z") + m - F.col("n"))
    few = F.lit(float(m)) * F.log(F.lit(float(m)) / (F.lit(float(m)) - F.col("n")))
    sites = F.when((raw <= 2.5 * m) & (F.col("n") < m), few).otherwise(raw)
    return merged.select("h1", "h2", "passage", sites.alias("sites"), F.col("n").alias("filled"), "first", "last")


def boilerplate(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
    precision: int = PRECISION, band: float = BAND, passage_words: int = PASSAGE_WORDS, passage_sites: int = PASSAGE_SITES,
) -> DataFrame:
    """``(doc_id, own, h1, h2, passage)``: the lines that should go from each text, given by its id and its key ``own``.

    Short lines go where at least ``min_sites`` sites carry them. A passage, a line of more than ``passage_words`` words,
    goes where at least ``passage_sites`` sites and two different texts carry it, from all but the text of smallest key.
    Lines whose estimate lies clearly above their threshold are taken, those near it are counted exactly. The error model
    is one of large counts, so with a threshold below the number of registers a line is also counted where it fills as
    many registers as that many sites fill almost surely.
    """
    lines = site_lines(documents, doc_id, text, site, precision, passage_words)
    error = band * 1.04 / sqrt(1 << precision)

    def near(sites: int) -> Column:
        likely = F.col("sites") >= sites * (1 - error)
        return likely | (F.col("filled") >= fewest_registers(sites, precision)) if sites < 1 << precision else likely

    # Kept, so that the join reads plain exchanges
    wanted = F.when(F.col("passage"), (F.col("first") < F.col("last")) & near(passage_sites)).otherwise(near(min_sites))
    likely = checkpointed(spread(lines, precision).where(wanted).select("h1", "h2", "passage", "sites", "first"))
    # Dealt anew by document, so that a very common line can be split in the join and does not meet in one task after it
    joined = lines.select("doc_id", "own", "site", "h1", "h2").join(likely, ["h1", "h2"]).repartition("h1", "h2", "doc_id", "own")
    found = checkpointed(joined.groupBy("h1", "h2", "passage", "doc_id", "own", "site").agg(F.max("sites").alias("sites"), F.max("first").alias("first")))
    least = F.when(F.col("passage"), passage_sites).otherwise(min_sites)
    near_it = found.where(F.col("sites") <= least * (1 + error)).select("h1", "h2", "passage", "site").distinct()
    exact = near_it.groupBy("h1", "h2", "passage").count().where(F.col("count") >= least).select("h1", "h2")
    sure = found.where(F.col("sites") > least * (1 + error)).select("h1", "h2").distinct()
    going = found.where(~F.col("passage") | (F.col("own") != F.col("first"))).select("doc_id", "own", "h1", "h2", "passage").distinct()
    return going.join(exact.union(sure), ["h1", "h2"], "left_semi")


def remove_boilerplate(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
    n_lines: str = "n_lines", n_removed: str = "n_removed", **options,
) -> DataFrame:
    """``documents`` with boilerplate lines taken out of ``text``, and the counts ``n_lines`` and ``n_removed``.

    Lines end at a line feed and are compared without outer blanks. A short line of at least ``min_sites`` sites goes in
    every document. A repeated passage (see :func:`boilerplate`) stays in the text of smallest key, and in its exact
    copies, and goes in all others; but where passages make up half of a text's characters or more they stay, as that
    is a copy, not a page with a quotation. A document with nothing but lines to go keeps its text for the same reason.
    Copies are left to document deduplication.

    Blank lines are neither counted nor removed. A null site counts as one site. Null texts stay null with zero lines;
    rows of one id are told apart by their texts, and equal rows are treated alike, with an id or without. Columns with
    the names of the two counts are replaced.
    """
    found = boilerplate(documents, doc_id, text, site, min_sites, **options)
    short, long, lines, left, gone = (fresh(documents, n) for n in ("boilerplate", "passages", "lines_of_text", "lines_left", "passage_size"))
    key, own = fresh(documents, "boilerplate_of"), fresh(documents, "boilerplate_text")
    pair = F.struct("h1", "h2")
    listed = found.groupBy(F.col("doc_id").alias(key), F.col("own").alias(own)).agg(
        F.collect_set(F.when(~F.col("passage"), pair)).alias(short), F.collect_set(F.when(F.col("passage"), pair)).alias(long)
    )
    marked = documents.withColumn(fresh(documents, "text_key"), text_key(text))
    same = quoted(doc_id).eqNullSafe(F.col(key)) & (F.col(fresh(documents, "text_key")) == F.col(own))
    cut = marked.join(listed, same, "left").withColumn(lines, F.coalesce(_lines(text), F.expr("cast(array() as array<string>)")))
    blank = lambda line: F.trim(line) == ""
    size = lambda kept: F.aggregate(F.filter(lines, kept), F.lit(0), lambda n, line: n + F.length(line))
    among = lambda names, line: F.array_contains(names, F.struct(*_line_key(line)))
    cut = cut.withColumn(gone, F.when(F.size(long) > 0, size(lambda line: among(long, line))).otherwise(F.lit(0)))
    copy = F.col(gone) * 2 >= size(lambda line: ~blank(line))
    cut = cut.withColumn(short, F.when((F.col(gone) > 0) & ~copy, F.array_union(short, long)).otherwise(F.col(short)))
    cut = cut.withColumn(
        left, F.when(F.coalesce(F.size(short), F.lit(0)) == 0, F.col(lines)).otherwise(
            F.filter(lines, lambda line: blank(line) | ~among(short, line))
        ),
    )
    n_all, n_left = (F.size(F.filter(c, lambda line: ~blank(line))).cast("long") for c in (lines, left))
    touched = (n_left > 0) & (n_left < n_all)
    others = [c for c in documents.columns if c.lower() not in (n_lines.lower(), n_removed.lower())]
    new_text = F.when(touched, F.array_join(left, "\n")).otherwise(quoted(text))
    return cut.select(
        *[(new_text.alias(text) if c == text else quoted(c)) for c in others], n_all.alias(n_lines),
        F.when(touched, n_all - n_left).otherwise(F.lit(0).cast("long")).alias(n_removed),
    )
