"""Ranked lexical search that scores each bag of words once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed, quoted, rows, utf8
from formfield.llm.grid import NO_SCORE, Best

#: Distinct (item, term) pairs that one pass over the documents serves; this bounds what is broadcast.
SHARD_TERMS = 500_000
#: Lower-cases A-Z and blanks what is no digit, letter or byte of a longer character.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Classes scored together.
CLASSES = 1024
#: Text bytes cut into terms at a time.
PIECE = 1 << 16


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, list by list, so that a long text never becomes one list."""
    if not text:
        return
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = start + PIECE
        end = len(text) if end >= len(text) else text.find(b" ", end)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def bags(documents: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``(doc_id, n, bag)`` of each document with a term: its number of terms, and what it holds of the vocabulary.

    A bag is a run of (term number, occurrences) as 32-bit integers, ascending, so equal bags are equal bytes.
    """
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in rows(batches, 256):
            sizes, found = [], []
            for content in batch.column(1):
                n, count = 0, Counter()
                for words in terms(content.as_py()):
                    n += len(words)
                    count.update(map(number, words))
                count.pop(None, None)
                sizes.append(n)
                found.append(np.array(sorted(count.items()), dtype="<u4").tobytes())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "bag"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    kept = documents.select(quoted(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    return kept.mapInArrow(run, "doc_id long, n long, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the column, term, occurrences) of all bags in it."""
    parts = column.to_pylist()
    flat = np.frombuffer(b"".join(parts), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts]), flat[:, 0], flat[:, 1]


def document_counts(held: DataFrame, size: int) -> DataFrame:
    """``(term, df)`` over the bags, counted inside each task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in rows(batches, 4096):
            total += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    counts = held.select("bag").mapInArrow(run, "term long, df long")
    return counts.groupBy("term").agg(F.sum("df").alias("df"))


class Scorer:
    """Scores of classes for all items of a shard, term by term."""

    def __init__(self, weights: np.ndarray, owners: list[tuple[np.ndarray, np.ndarray]], items: int):
        self.weights, self.owners, self.items = weights, owners, items

    def scores(self, bag: pa.Array, m: np.ndarray) -> np.ndarray:
        """(item, class) scores."""
        at, term, tf = _pairs(bag)
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        out = np.zeros((self.items, len(m)), dtype=np.int64)
        order = np.argsort(term, kind="stable")
        at, term, gain = at[order], term[order], gain[order]
        cuts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else []
        for start, end in zip(cuts, [*cuts[1:], len(term)], strict=True):
            owners, times = self.owners[term[start]]
            # A class holds a term once, so no place occurs twice
            out[np.ix_(owners, at[start:end])] += times[:, None] * gain[start:end]
        return out


def _best_classes(classes: DataFrame, weights: np.ndarray, owners: list[tuple[np.ndarray, np.ndarray]], items: int, k: int) -> DataFrame:
    """``(item, score, members)``: each task's ``k`` best classes of every item, equal scores by their first member."""
    known = classes.sparkSession.sparkContext.broadcast((weights, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best, lists = Scorer(*known.value, items), Best(items, k), {}
        number = 0
        for batch in rows(batches, CLASSES):
            scores = scorer.scores(batch.column("bag"), batch.column("m").to_numpy())
            # Rows come by first member, so a class number orders equal scores
            bar = np.maximum(best.bar, 0)[:, None]
            if scores.shape[1] > k:
                bar = np.maximum(bar, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None])
            at, which = np.nonzero((scores >= bar) & (scores > 0))
            if len(at):
                best.add(at, scores[at, which], number + which)
                members = batch.column("members")
                lists.update({number + w: members[w].as_py() for w in np.unique(which).tolist()})
                kept = set(best.ids[best.scores > NO_SCORE].tolist())
                lists = {n: lists[n] for n in kept}
            number += batch.num_rows
        at, scores, ids = best.found()
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(scores), pa.array([lists[n] for n in ids.tolist()], pa.list_(pa.int64()))], ["item", "score", "members"]
        )

    ordered = classes.sortWithinPartitions(F.col("members")[0].asc_nulls_last())
    return ordered.select("bag", "m", "members").mapInArrow(run, "item long, score long, members array<bigint>")


def classes_of(held: DataFrame, n_docs: int, n_terms: int, k: int, b: int = 75) -> DataFrame:
    """``(m, bag, members)``: classes of documents with equal bag and ``m``, each with its ``k`` smallest ids.

    Rows are dealt and sorted by a hash of both; bags of one hash are compared byte by byte, so only documents that are
    truly equal share a class. All but ``k`` of a class's rows on a task go before the exchange and again after it, so
    no class is ever gathered whole.
    """
    m = F.expr(f"{100 - b} + ({b} * n * cast({n_docs} as bigint)) div {n_terms}").alias("m")
    keyed = held.where(F.length("bag") > 0).select("doc_id", "bag", m).withColumn("h", F.xxhash64("bag", "m"))
    order = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    few = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    listed = few.groupBy("h", "m", "bag").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("members"))
    return listed.select("m", "bag", F.col("members.doc_id").alias("members"))


def _shard(documents: DataFrame, items: list[tuple[int, int, bytes | None]], doc_id: str, text: str, k: int) -> DataFrame:
    """``(item row, rank, doc_id, score)`` of a bounded number of items, given as (row, id, text)."""
    spark = documents.sparkSession
    counts = [Counter(t for part in terms(content) for t in part) for _, _, content in items]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
    held = checkpointed(bags(documents, vocabulary, doc_id, text))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in document_counts(held, len(vocabulary)).toLocalIterator():
        weights[term] = floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))
    owners: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
    for n, count in enumerate(counts):
        for term, times in count.items():
            owners[vocabulary[term]].append((n, times))
    packed = [(np.array([n for n, _ in o]), np.array([t for _, t in o])) for o in owners]
    found = _best_classes(classes_of(held, n_docs, max(1, n_terms), k), weights, packed, len(items), k)
    # A document that ranks k-th has fewer than k classes before its own
    classes = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(F.col("members")[0]))
    best = found.withColumn("place", F.row_number().over(classes)).where(F.col("place") <= k)
    each = best.select("item", "score", F.explode("members").alias("doc_id"))
    members = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = each.withColumn("rank", F.row_number().over(members)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (_, i, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = 10, shard_terms: int = SHARD_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, scores above zero only.

    Terms are runs of ASCII letters, digits and all longer characters, A-Z lower-cased. Documents keep only what they
    hold of the items' vocabulary; those with the same occurrences and the same length norm ``m`` form a class, which is
    scored once and then stands for its members by ascending id. All arithmetic but a term's weight is in integers.

    Items are dealt by the size of their texts over passes of about ``shard_terms`` terms each, which bounds what the
    tasks are sent (one item is never divided). Null and empty texts have no term: such documents count nowhere, such
    items have no row. Equal scores go by ascending id, a missing id last; repeated document rows are ranked each,
    repeated item rows have a list each. Tables may be empty; other columns are ignored.
    """
    spark = documents.sparkSession
    sized = checkpointed(items.select(
        F.monotonically_increasing_id().alias("row"), quoted(item_id).cast("long").alias("item_id"), utf8(item_text).alias("text"),
    ).where(F.length("text") > 0))
    # Two bytes a term at least
    bound = sized.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0))).first()[0]
    shards = max(1, ceil(bound / shard_terms))
    found = []
    for n in range(shards):
        own = sized.where(F.pmod(F.xxhash64("row"), F.lit(shards)) == n)
        if rows_of := [(r[0], r[1], bytes(r[2])) for r in own.toLocalIterator()]:
            part = _shard(documents, rows_of, doc_id, text, k)
            found.append(checkpointed(part) if shards > 1 else part)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out
