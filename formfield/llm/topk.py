"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formfield.llm.grid import NO_SCORE, Best, ids_of, in_cells, longs, matrix, scaled, shape

#: Dimensions that are added to the scores between two looks at the bounds.
BLOCK = 16
#: Share of (query, row) pairs alive below which they are kept as a list.
DENSE = 1 / 16
#: Pairs scored together.
PAIRS = 1 << 21


class BranchAndBound:
    """The highest inner products of a block of queries with rows that stream past.

    Rows lie dimension by dimension, the dimensions of most query mass first. Scores grow block by block. After each,
    a pair can gain at most the sum over the blocks left of both sides' norms in that block (Cauchy-Schwarz), so
    pairs that cannot reach the query's k-th best any more are dropped; once few are alive they go on as a list
    that shrinks with every block.
    """

    def __init__(self, queries: pa.Table, k: int, block: int = BLOCK, dense: float = DENSE):
        self.rows = queries["row"].combine_chunks().to_numpy()
        values = matrix(queries["v"])
        self.width = values.shape[1]
        self.order = np.argsort(-(values.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.values = values[:, self.order]
        self.cuts = [(s, min(s + block, self.width)) for s in range(0, self.width, block)] or [(0, 0)]
        self.norms = self._norms(self.values.T)
        self.dense = dense
        self.best = Best(len(values), k)
        self.by_row = np.argsort(self.rows, kind="stable")
        self.scored = 0

    def _norms(self, columns: np.ndarray) -> np.ndarray:
        return np.array([np.sqrt((columns[a:b].astype(np.float64) ** 2).sum(axis=0)) for a, b in self.cuts])

    def feed(self, batch: pa.RecordBatch) -> None:
        columns = np.ascontiguousarray(matrix(batch.column("v"), self.width)[:, self.order].T)
        ids, rows = longs(batch.column("id")), batch.column("row").to_numpy()
        most = self.width * max(1, int(np.abs(self.values).max(initial=0)) * int(np.abs(columns).max(initial=0)))
        # Integers are exact in all three; the bounds need some bits more
        kind = np.float32 if most < 1 << 22 else np.float64 if most < 1 << 50 else np.int64
        x, norms = columns.astype(kind), self._norms(columns)
        place = np.searchsorted(self.rows[self.by_row], rows)
        place[place == len(self.rows)] = 0
        same = self.by_row[place]
        own = np.flatnonzero(self.rows[same] == rows)
        step = max(1, PAIRS // len(rows))
        for start in range(0, len(self.rows), step):
            part = slice(start, start + step)
            mine = own[(same[own] >= start) & (same[own] < start + step)]
            at, which, scores = self._part(self.values[part].astype(kind), x, self.norms[:, part], norms, part, (same[mine] - start, mine), most)
            real = scores > NO_SCORE / 2
            self.best.add(at[real] + start, scores[real], ids[which[real]])

    def _part(self, q, x, q_norms, x_norms, part, own, most):
        bar = self.best.bar[part]
        known = bar > NO_SCORE
        scores = np.zeros((len(q), x.shape[1]), dtype=q.dtype)
        scores[own] = NO_SCORE
        goal = np.where(known, bar - 0.5 - 1e-9 * most, -np.inf)[:, None]
        for n, (a, b) in enumerate(self.cuts):
            scores += q[:, a:b] @ x[a:b]
            self.scored += scores.size * (b - a)
            if n + 1 < len(self.cuts) and known.all():
                most_left = (q_norms[n + 1:].T @ x_norms[n + 1:]) * (1 + 1e-5)
                alive = scores + most_left >= goal
                if np.count_nonzero(alive) <= self.dense * alive.size:
                    at, which = np.nonzero(alive)
                    return self._list(q, x, q_norms, x_norms, at, which, scores[at, which], goal[:, 0], n + 1)
        if not known.all():
            k = min(self.best.k, scores.shape[1])
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            bar = np.maximum(bar, kth.astype(np.int64))
        at, which = np.nonzero(scores >= bar[:, None])
        return at, which, scores[at, which].astype(np.int64)

    def _list(self, q, x, q_norms, x_norms, at, which, scores, goal, n):
        for m in range(n, len(self.cuts)):
            for d in range(*self.cuts[m]):
                scores += q[at, d] * x[d, which]
            self.scored += len(at) * (self.cuts[m][1] - self.cuts[m][0])
            left = sum((q_norms[j, at] * x_norms[j, which] for j in range(m + 1, len(self.cuts))), np.zeros(len(at)))
            alive = scores + left * (1 + 1e-5) >= goal[at]
            at, which, scores = at[alive], which[alive], scores[alive]
        return at, which, scores.astype(np.int64)

    def result(self) -> pa.RecordBatch:
        at, scores, ids = self.best.found()
        return pa.RecordBatch.from_arrays([pa.array(self.rows[at]), ids_of(ids), pa.array(scores)], ["row", "vec_id", "score"])


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, every: int = 20, scale: int = 64,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the ``k`` rows of highest score.

    Components become ``floor(scale * x)``, the score is their inner product in integers. Ranks start at one; equal
    scores go by ascending id, a missing id last. A query is not compared with its own row, but with others of its id;
    each row of a repeated query id has a list of its own.

    Rows with a null vector or a component that is null, not finite or beyond 2^24 when scaled take no part; a vector
    shorter than another counts as filled with zeros, an empty one scores zero. The largest 64-bit integer as an id
    counts as missing. An empty table gives an empty result; other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be positive")
    known = scaled(vectors, vec_id, embedding, scale)
    asked = known.where(F.col("id") % every == 0)
    n, n_asked = known.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    found = in_cells(
        asked, known, shape(n, n_asked, known.sparkSession.sparkContext.defaultParallelism),
        lambda table: BranchAndBound(table, k), "row long, vec_id long, score long",
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
