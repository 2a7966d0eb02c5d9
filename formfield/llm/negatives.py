"""Hard negatives by rotated one-bit codes whose intervals decide what is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed, quoted
from formfield.llm.grid import NO_SCORE, Best, ids_of, in_cells, longs, matrix, scaled, shape

#: One-bit codes of a row, each of what the codes before it leave over.
LEVELS = 6
#: Bits of a rotated query component.
QUERY_BITS = 8
#: Rounds of sign flips and Hadamard transforms; two spread any vector over all dimensions.
ROUNDS = 2
CODED = "row long, id long, label long, v array<int>, codes binary, align binary, rest binary"


def dimensions(width: int) -> int:
    """A power of two, and whole 64-bit words."""
    return max(64, 1 << max(0, width - 1).bit_length())


def rotate(values: np.ndarray, size: int) -> np.ndarray:
    """Rows turned by a fixed rotation of ``size`` dimensions, which leaves inner products as they are."""
    out = np.zeros((len(values), size))
    out[:, :values.shape[1]] = values
    for turn in range(ROUNDS):
        out *= [1 - 2 * (xxhash.xxh64_intdigest(b"%d" % d, turn) & 1) for d in range(size)]
        width = 1
        while width < size:
            pairs = out.reshape(len(out), -1, 2, width)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            width *= 2
        out /= np.sqrt(size)
    return out


def encode(values: np.ndarray, size: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, word), alignments and residual norms (row, level).

    A code is the signs of what is left; as a unit vector it has the stored inner product with it, the alignment,
    and the part along the code is taken off before the next level.
    """
    left = rotate(values, size)
    codes = np.empty((len(values), levels, size // 64), dtype="<u8")
    align, rest = np.empty((len(values), levels)), np.empty((len(values), levels))
    for n in range(levels):
        ones = left >= 0
        codes[:, n] = np.packbits(ones, axis=1, bitorder="little").view("<u8")
        align[:, n] = np.abs(left).sum(axis=1) / np.sqrt(size)
        left -= np.where(ones, 1.0, -1.0) * (align[:, n] / np.sqrt(size))[:, None]
        rest[:, n] = np.linalg.norm(left, axis=1)
    return codes, align, rest


def coded(rows: DataFrame, size: int, levels: int) -> DataFrame:
    """``rows`` with their codes, alignments and residual norms: the index, one entry for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                found = encode(matrix(part.column("v")), size, levels)
                packed = [pa.array([row.tobytes() for row in c], pa.binary()) for c in found]
                yield pa.RecordBatch.from_arrays([*part.columns, *packed], [*part.schema.names, "codes", "align", "rest"])

    return rows.select("row", "id", "label", "v").mapInArrow(run, CODED)


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: str, *sizes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *sizes)


class IntervalSearch:
    """The best rows inside score windows for a block of queries.

    The rotated query is rounded to ``QUERY_BITS`` bits; its inner product with a code is then counted bits of the code
    in each bit plane. Codes times alignments estimate the score, and by Cauchy-Schwarz the residual norm times the
    query's norm, plus the rounding's largest effect, bounds the error. Rows whose interval misses every window or ends
    below the ``k``-th best go, level by level; what is left is scored in integers, so the result is exact.
    """

    def __init__(self, queries: pa.Table, k: int, same: bool, size: int, levels: int):
        self.rows = queries["row"].combine_chunks().to_numpy()
        self.labels = queries["label"].combine_chunks().to_numpy()
        self.size, self.levels, self.same, self.k = size, levels, same, k
        self.values = matrix(queries["v"])
        self.width = self.values.shape[1]
        self.windows, self.owner = [], []
        for n, spans in enumerate(queries["windows"].to_pylist()):
            self.windows.append([(len(self.owner) + j, s["low"], s["high"]) for j, s in enumerate(spans)])
            self.owner += [(n, s["ask"]) for s in spans]
        self.best = Best(len(self.owner), k)
        turned = rotate(self.values, size)
        self.norms = np.linalg.norm(turned, axis=1)
        self.base = turned.min(axis=1)
        self.unit = np.maximum((turned.max(axis=1) - self.base) / ((1 << QUERY_BITS) - 1), 1e-12)
        digits = np.rint((turned - self.base[:, None]) / self.unit[:, None]).astype(np.int64)
        rounded = self.base[:, None] + digits * self.unit[:, None]
        self.sums = rounded.sum(axis=1)
        self.off = np.abs(turned - rounded).sum(axis=1) / np.sqrt(size)
        self.planes = np.stack(
            [np.packbits((digits >> b) & 1 == 1, axis=1, bitorder="little").view("<u8") for b in range(QUERY_BITS)], axis=1
        )
        self.seen = self.scored = 0

    def feed(self, batch: pa.RecordBatch) -> None:
        words = self.size // 64
        codes = np.ascontiguousarray(_unpacked(batch.column("codes"), "<u8", self.levels, words).transpose(1, 2, 0))
        align = np.ascontiguousarray(_unpacked(batch.column("align"), "<f8", self.levels).T)
        rest = np.ascontiguousarray(_unpacked(batch.column("rest"), "<f8", self.levels).T)
        counts = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        ids, rows = longs(batch.column("id")), batch.column("row").to_numpy()
        labels, values = batch.column("label").to_numpy(), matrix(batch.column("v"), self.width)
        for n, spans in enumerate(self.windows):
            if spans:
                fits = (labels == self.labels[n]) == self.same
                which = np.flatnonzero(fits & (rows != self.rows[n]))
                self._query(n, spans, which, codes, counts, align, rest, values, ids)

    def _query(self, n, spans, which, codes, counts, align, rest, values, ids) -> None:
        estimate, error = np.zeros(len(which)), np.zeros(len(which))
        self.seen += len(which)
        root = np.sqrt(self.size)
        for level in range(self.levels):
            ones = np.zeros(len(which))
            for w in range(self.size // 64):
                own = codes[level, w, which]
                for b in range(QUERY_BITS):
                    ones += np.bitwise_count(own & self.planes[n, b, w]) * float(1 << b)
            dot = (2 * (self.base[n] * counts[level, which] + self.unit[n] * ones) - self.sums[n]) / root
            along = align[level, which]
            estimate += along * dot
            error += along * self.off[n]
            bound = (error + rest[level, which] * self.norms[n]) * (1 + 1e-9) + 1e-6
            low, high = estimate - bound, estimate + bound
            alive = np.zeros(len(which), dtype=bool)
            for slot, least, most in spans:
                bar = max(least, int(self.best.bar[slot]))
                sure = low[(low >= least) & (high <= most)]
                if len(sure) >= self.k:  # so many rows surely reach this
                    bar = max(bar, np.partition(sure, len(sure) - self.k)[len(sure) - self.k])
                alive |= (high >= bar) & (low <= most)
            which, estimate, error = which[alive], estimate[alive], error[alive]
            if not len(which):
                return
        scores = values[which] @ self.values[n]
        self.scored += len(which)
        for slot, least, most in spans:
            fits = (scores >= max(least, int(self.best.bar[slot]))) & (scores <= most)
            if fits.any():
                self.best.add(np.full(fits.sum(), slot), scores[fits], ids[which[fits]])

    def result(self) -> pa.RecordBatch:
        at, scores, ids = self.best.found()
        owner = np.array(self.owner, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.rows[owner[at, 0]]), pa.array(owner[at, 1]), ids_of(ids), pa.array(scores)], ["row", "ask", "id", "score"]
        )


def _best(asked: DataFrame, index: DataFrame, groups: tuple[int, int], k: int, same: bool, size: int, levels: int) -> DataFrame:
    """``(row, ask, rank, id, score)``: the ``k`` best rows of each query's window."""
    none = F.lit(None).cast(asked.schema["windows"].dataType)
    found = in_cells(
        asked, index.withColumn("windows", none), groups, lambda table: IntervalSearch(table, k, same, size, levels),
        "row long, ask long, id long, score long",
    )
    order = Window.partitionBy("row", "ask").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined_label(vec_id: str, label: str) -> Column:
    """The label, moved on by one (of ten) where the id is divisible by seven."""
    own = quoted(label).cast("long")
    return F.when(quoted(vec_id) % 7 == 0, (own + 1) % 10).otherwise(own).alias("label")


def hard_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label", positives: int = 5,
    negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: int = 256, levels: int = LEVELS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are rows whose id is divisible by ``every``; scores are inner products of ``floor(scale * x)`` in integers,
    higher first, equal ones by ascending id, a missing id last. An anchor's positives are its ``positives`` best other
    rows of its label. For each the best ``negatives`` rows of other labels follow whose score is at least ``low`` and
    at most ``high`` percent of the positive's; a positive of negative score has none, and one without any gives no row.

    Rows without a label or vector, or with a component that is null, not finite or beyond 2^24 when scaled, take no
    part. Shorter vectors count as filled with zeros. A row is not its own positive, but another of its id may be; each
    row of a repeated anchor id has lists of its own. The largest 64-bit integer as an id counts as missing. An empty
    table gives an empty result; other columns are ignored. ``label`` is a column name or a column called ``label``.
    """
    own = quoted(label).cast("long").alias("label") if isinstance(label, str) else label
    known = scaled(vectors, vec_id, embedding, scale, own).where("label is not null")
    is_anchor = F.col("id") % every == 0
    n, n_asked, width = known.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    size = dimensions(width)
    index = checkpointed(coded(known, size, levels))
    groups = shape(n, n_asked, known.sparkSession.sparkContext.defaultParallelism)
    anchors = index.where(is_anchor)
    span = lambda ask, least, most: F.struct(ask.cast("long").alias("ask"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    everything = F.array(span(F.lit(0), F.lit(NO_SCORE), F.lit(-NO_SCORE)))
    friends = checkpointed(_best(anchors.withColumn("windows", everything), index, groups, positives, True, size, levels))
    # The least and the greatest integer that the two comparisons let through
    least, most = F.expr(f"({low} * score + 99) div 100"), F.expr(f"({high} * score) div 100")
    windows = friends.where("score >= 0").groupBy("row").agg(F.collect_list(span(F.col("rank"), least, most)).alias("windows"))
    found = _best(anchors.join(windows, "row"), index, groups, negatives, False, size, levels)
    pairs = found.select("row", F.col("ask").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = friends.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(
        "row", F.col("rank").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return pairs.join(named, ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
