"""Benchmark decontamination with Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import fresh, quoted, rows, utf8

#: Lower-cases A-Z and blanks what is no digit, letter or byte of a longer character.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words per block of the shift tables.
BLOCK = 3
#: Benchmark windows that one pass over the documents looks for; this bounds what is broadcast.
SHARD_WINDOWS = 200_000
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WuManber:
    """Finds patterns of one common length in a list of words.

    A block of words at a window's end that occurs in no pattern lets the search skip past it; one that occurs only
    further left skips to where it would be last. A block that ends a pattern selects a bucket of patterns, which are
    compared with the window, first word first.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.size = len(next(iter(patterns)))
        self.block = min(BLOCK, self.size)
        self.skip = self.size - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, payload in patterns.items():
            for end in range(self.block, self.size + 1):
                part = pattern[end - self.block:end]
                self.shift[part] = min(self.size - end, self.shift.get(part, self.skip))
            self.bucket[pattern[-self.block:]].append((pattern[0], list(pattern), payload))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, payload) of every occurrence."""
        size, block, skip, shift = self.size, self.block, self.skip, self.shift.get
        at, last = size, len(words)
        while at <= last:
            part = tuple(words[at - block:at])
            if step := shift(part, skip):
                at += step
                continue
            start = at - size
            for head, pattern, payload in self.bucket[part]:
                if words[start] == head and words[start:at] == pattern:
                    yield start, payload
            at += 1


class Searcher:
    """A Wu-Manber search for each pattern length."""

    def __init__(self, windows: list[tuple[bytes, str | None]]):
        self.items = sorted({item for _, item in windows if item is not None})
        number = {item: n for n, item in enumerate(self.items)}
        by_size: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for window, item in windows:
            pattern = tuple(window.split())
            owners = by_size[len(pattern)][pattern]
            if item is not None:
                owners.append(number[item])
        self.machines = [WuManber(patterns) for patterns in by_size.values()]

    def find(self, text: bytes | None) -> dict:
        words = words_of(text)
        hit, owners = None, set()
        for machine in self.machines:
            for start, payload in machine.search(words):
                hit = hit or bytearray(len(words))
                hit[start:start + machine.size] = b"\1" * machine.size
                owners.update(payload)
        spans = [{"start": m.start(), "end": m.end() - 1} for m in re.finditer(b"\1+", hit or b"")]
        return {"n_words": len(words), "spans": spans, "items": [self.items[n] for n in sorted(owners)]}


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """Distinct ``(window, item)``: runs of ``size`` words of an item, or its whole text if shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 64):
            found = []
            for item, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(content)
                starts = range(max(1, len(words) - size + 1)) if words else ()
                found += {(b" ".join(words[s:s + size]), item) for s in starts}
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())],
                ["window", "item"],
            )

    kept = benchmark.select(quoted(item_id).cast("string").alias("item"), utf8(text).alias("text"))
    return kept.mapInArrow(run, "window binary, item string").distinct()


def _finder(spark, shard: DataFrame):
    known = spark.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in shard.toLocalIterator()])

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(known.value)
        kind = pa.struct([
            ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("items", pa.list_(pa.string())),
        ])
        for texts in batches:
            parts = range(0, len(texts), 512)
            yield pa.chunked_array(
                [pa.array([searcher.find(t) for t in texts.slice(p, 512).to_pylist()], kind) for p in parts], kind
            ).combine_chunks()

    return find


def annotate(
    documents: DataFrame, benchmark: DataFrame, into: str, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = 13, shard_windows: int = SHARD_WINDOWS,
) -> DataFrame:
    """``documents`` with a struct column ``into``: ``n_words``, hit ``spans`` (inclusive, merged) and ``items``.

    The benchmark's windows are counted first. Up to ``shard_windows`` of them go to the tasks at once, and the
    documents are then scanned without an exchange; more are dealt over several passes, whose findings are merged
    by a 128-bit hash of the text. Null texts have no words; windows of a null item id hit but name no item; an empty
    benchmark hits nothing.
    """
    spark = documents.sparkSession
    known = windows(benchmark, item_id, item_text, size)
    shards = max(1, ceil(known.count() / shard_windows))
    dealt = [known.where(F.pmod(F.xxhash64("window", "item"), F.lit(shards)) == s) for s in range(shards)]
    if shards == 1:
        return documents.withColumn(into, _finder(spark, known)(utf8(text)))
    key = F.struct(F.xxhash64(utf8(text)).alias("a"), F.xxhash64(utf8(text), F.lit(1)).alias("b"))
    texts = documents.select(utf8(text).alias("text"), key.alias("key")).groupBy("key").agg(F.first("text").alias("text"))
    passes = [texts.select("key", _finder(spark, shard)(F.col("text")).alias("found")) for shard in dealt]
    merged = passes[0]
    for more in passes[1:]:
        merged = merged.union(more.where("size(found.items) > 0 or size(found.spans) > 0"))
    merged = merged.groupBy("key").agg(
        F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
    )
    found = F.struct("n_words", _joined_spans("spans").alias("spans"), "items").alias(into)
    own = fresh(documents, "text_key")
    side = merged.select(F.col("key").alias(own), found)
    return documents.withColumn(own, key).join(side, own).drop(own)


def _joined_spans(spans: str) -> Column:
    """Sorted spans with touching or overlapping ones joined."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return F.aggregate(
        F.array_sort(F.col(spans)), empty,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"] - 1),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def n_hit(found: Column) -> Column:
    """Words inside any span."""
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] + 1)


def contaminated(found: Column, share: int = 20) -> Column:
    """Whether at least one word in ``share`` is hit."""
    hits = n_hit(found)
    return (hits > 0) & (hits * share >= found["n_words"])


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans, contaminated)``, one row per input row. See :func:`annotate`."""
    into = fresh(documents, "found")
    found = F.col(into)
    return annotate(documents.select(quoted(doc_id), quoted(text)), benchmark, into, text, **options).select(
        quoted(doc_id).alias("doc_id"), found["n_words"].alias("n_words"), n_hit(found).alias("n_hit"),
        found["items"].alias("items"), found["spans"].alias("spans"), contaminated(found).alias("contaminated"),
    )
