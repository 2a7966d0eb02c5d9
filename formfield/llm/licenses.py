"""License notices by phrases, and by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import quoted

#: Phrases and the labels they give. Fixed values.
PHRASES = [
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
]

#: Templates of common notices and their labels.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
]
THRESHOLD = 0.8
#: Words of a window over wrapped lines, as a multiple of the template's words.
WINDOW = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = "".join(map(chr, range(128))).translate(str.maketrans("", "", _UPPER + _LOWER + "0123456789\n"))


def _plain(text: Column, breaks: str = _BREAKS + "\n") -> Column:
    """A-Z lower-cased and each ASCII character that is no letter or digit turned into a blank; null gives an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER + breaks, _LOWER + " " * len(breaks))


def words(text: Column) -> Column:
    return F.array_remove(F.split(_plain(text), " "), "")


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Label and words of each template that has any."""
    known = []
    for label, text in templates:
        plain = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text).translate(
            str.maketrans(_UPPER, _LOWER)
        )
        known.append((label, plain.split()))
    return [(label, found) for label, found in known if found]


def template_tokens(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Label and distinct tokens of each template."""
    return [(label, list(dict.fromkeys(found))) for label, found in template_words(templates)]


def blocks(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b, line)``: each line with blanks between its words, under a 128-bit hash of the text it stands in."""
    own = quoted(text).cast("string")
    lines = F.split(_plain(own, _BREAKS), "\n")
    return documents.select(F.xxhash64(own).alias("a"), F.xxhash64(own, F.lit(1)).alias("b"), F.explode(lines).alias("line"))


def wrapped(documents: DataFrame, side: DataFrame, text: str = "text") -> DataFrame:
    """``(a, b, label, containment)``: templates found in windows of words that may run over line ends.

    A window that meets the threshold holds a prefix token of the template, so only the windows around such tokens are
    compared: first all words that a window with it can reach, then each window. Texts of one line are left to
    :func:`notices`.
    """
    own = quoted(text).cast("string")
    several = documents.where(own.contains("\n")).select(
        F.xxhash64(own).alias("a"), F.xxhash64(own, F.lit(1)).alias("b"), words(own).alias("words")
    )
    placed = several.select("a", "b", "words", F.posexplode("words").alias("pos", "token")).join(F.broadcast(side), "token")
    first = F.greatest(F.col("pos") - F.col("width") + 1, F.lit(0))
    near = placed.select(
        "a", "b", "label", "tokens", "need", "width",
        F.slice("words", first + 1, F.col("pos") + F.col("width") - first).alias("near"),
    ).where(F.size(F.array_intersect("tokens", "near")) >= F.col("need"))
    held = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("width") + 1, F.lit(1))),
        lambda start: F.size(F.array_intersect("tokens", F.slice("near", start, F.col("width")))),
    )
    # By a generator, as the optimizer would move this filter into the join, which then copied all words for each word
    best = near.select("a", "b", "label", "tokens", "need", F.explode_outer(F.array(F.array_max(held))).alias("best")).where("best >= need")
    return best.select("a", "b", "label", (F.col("best") / F.size("tokens")).alias("containment"))


def notices(
    documents: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(a, b, label, containment)``: every block that holds at least ``threshold`` of a template's tokens.

    A block is a line, or in a text of several lines any run of twice a template's words, so that notices wrapped
    over lines are found too (see :func:`wrapped`).

    Tokens are ordered by how often the whole corpus has them, rarest first. Only a template's first
    ``n - ceil(threshold * n) + 1`` tokens are joined with, as a block that meets the threshold holds one of them.
    Of a pair's common prefix tokens only the first makes a candidate. It must have enough tokens (length filter) and
    enough left on both sides from the joined position on (positional filter) before the sets are compared.
    The templates are a rule table written down in code, so what is broadcast of them does not grow with the data.
    """
    spark = documents.sparkSession
    known = template_words(templates)
    if not known:
        return spark.createDataFrame([], "a long, b long, label string, containment double")
    vocabulary = sorted({t for _, tokens in known for t in tokens})
    corpus = blocks(documents, text)
    asked = corpus.select("a", "b", "line", F.explode(F.split("line", " ")).alias("token"))
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    counted = asked.select("token").join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    frequency = {r["token"]: r["n"] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t))
    place = {t: n for n, t in enumerate(order)}
    prefixes = []
    for label, whole in known:
        tokens = sorted(set(whole), key=place.__getitem__)
        need = ceil(round(threshold * len(tokens), 9))
        for i in range(len(tokens) - need + 1):
            prefixes.append((tokens[i], label, tokens, need, i, tokens[:i], WINDOW * len(whole)))
    side = spark.createDataFrame(
        prefixes, "token string, label string, tokens array<string>, need int, i int, earlier array<string>, width int"
    )
    # The block's template tokens, in the order of the vocabulary, that is by frequency
    held = F.array_intersect(F.array(*map(F.lit, order)), F.split("line", " "))
    pairs = asked.join(F.broadcast(side), "token").select("*", held.alias("held")).where(
        (F.size("held") >= F.col("need")) & ~F.arrays_overlap("earlier", "held")
        & (F.least(F.size("tokens") - F.col("i"), F.size("held") - F.array_position("held", F.col("token")) + 1) >= F.col("need"))
    )
    share = F.size(F.array_intersect("tokens", "held"))
    in_lines = pairs.where(share >= F.col("need")).select("a", "b", "label", (share / F.size("tokens")).alias("containment"))
    return in_lines.union(wrapped(documents, side, text))


def scan(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, n_words, places, base_labels, labels, score)``, one row per input row.

    ``places`` lists ``(start, label)`` of each phrase of :data:`PHRASES`, words counted from 0. ``labels`` adds those of
    :func:`notices`; both label lists are distinct and sorted. ``score`` is 1 with a phrase, else the largest
    containment found, else 0. Null and blank texts have no words and score 0; rows with the same text get the same
    findings; other columns are ignored.
    """
    own = quoted(text).cast("string")
    kept = documents.select(
        quoted(doc_id).alias("doc_id"), F.xxhash64(own).alias("a"), F.xxhash64(own, F.lit(1)).alias("b"), words(own).alias("words")
    )
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    none = F.expr("cast(array() as array<struct<start:bigint,label:string>>)")

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split()
        here = F.filter(
            F.sequence(F.lit(0), F.size("words") - len(parts)), lambda n: F.slice("words", n + 1, len(parts)) == F.array(*map(F.lit, parts))
        )
        found = F.transform(here, lambda n: F.struct(n.cast("long").alias("start"), F.lit(label).alias("label")))
        return F.when(F.col("padded").contains(f" {phrase} "), found).otherwise(none)

    based = kept.withColumn("padded", padded).select(
        "doc_id", "a", "b", F.size("words").cast("long").alias("n_words"),
        F.array_sort(F.concat(*(starts(p, label) for p, label in PHRASES))).alias("places"),
    )
    found = notices(documents, text, templates, threshold).groupBy("a", "b").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment")
    )
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    joined = based.join(found, ["a", "b"], "left").withColumn("base_labels", base)
    more = F.coalesce("more", F.expr("cast(array() as array<string>)"))
    return joined.select(
        "doc_id", "n_words", "places", "base_labels", F.array_sort(F.array_union("base_labels", more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
