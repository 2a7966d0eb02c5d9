"""A stated set of query vectors against all rows of a table, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed, quoted

#: Queries of a cell, and rows that stream past them in it.
CELL_QUERIES = 4096
CELL_ROWS = 1 << 20
#: Rows that a search looks at together.
STEP = 8192
#: Scaled components beyond this make inner products that need not fit in 64 bits.
LARGEST = 1 << 24
#: Sorts after every id; stands for a missing one.
NO_ID = np.iinfo(np.int64).max
#: Below every score.
NO_SCORE = -(1 << 62)


def scaled(vectors: DataFrame, vec_id: str, embedding: str, scale: int, *more: Column) -> DataFrame:
    """``(row, id, v, …)`` of the usable rows, kept in the checkpoint folder.

    ``v`` holds ``floor(scale * x)`` as integers. Rows with a null vector, or any component that is null, not finite or
    beyond ``LARGEST`` when scaled, are left out. ``row`` tells rows of one id apart.
    """
    times = F.transform(quoted(embedding), lambda x: F.lit(float(scale)) * x.cast("double"))
    usable = vectors.select(quoted(vec_id).cast("long").alias("id"), times.alias("v"), *more).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    )
    whole = F.transform("v", lambda x: F.floor(x).cast("int"))
    return checkpointed(usable.withColumn("v", whole).withColumn("row", F.monotonically_increasing_id()))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones are filled with zeros, places beyond ``width`` are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    own = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    fits = at < width
    out[own[fits], at[fits]] = flat[fits]
    return out


def longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers, a missing one as ``NO_ID``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


class Best:
    """The ``k`` highest scores of each of ``n`` lists, equal ones by ascending id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), NO_SCORE, dtype=np.int64)
        self.ids = np.full((n, k), NO_ID, dtype=np.int64)

    @property
    def bar(self) -> np.ndarray:
        """What a score must reach to enter each list."""
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offers many (list, score, id) at once."""
        lists = np.unique(at)
        at = np.concatenate([at, np.repeat(lists, self.k)])
        scores = np.concatenate([scores.astype(np.int64), self.scores[lists].ravel()])
        ids = np.concatenate([ids, self.ids[lists].ravel()])
        order = np.lexsort((ids, -scores, at))
        at = at[order]
        first = np.searchsorted(at, lists)
        chosen = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.scores[lists] = scores[chosen].reshape(-1, self.k)
        self.ids[lists] = ids[chosen].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.scores > NO_SCORE)
        return at, self.scores[at, place], self.ids[at, place]


def ids_of(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def shape(rows: int, queries: int, parallelism: int) -> tuple[int, int]:
    """Groups of rows and of queries: cells of bounded size, and several for each core."""
    by_query = max(1, ceil(queries / CELL_QUERIES))
    by_row = max(ceil(rows / CELL_ROWS), min(ceil(4 * parallelism / by_query), ceil(rows / 1024)), 1)
    return by_row, by_query


def in_cells(queries: DataFrame, rows: DataFrame, groups: tuple[int, int], finder: Callable, schema: str) -> DataFrame:
    """Each query meets each row in one cell of a grid of row groups and query groups.

    Both tables have ``row`` and the same columns. In a cell the queries come first and make ``finder(table)``; the
    rows then stream through its ``feed(batch)``, and its ``result()`` batch is returned. A cell holds its queries and
    one batch of rows, and is computed anew on its own if it is lost.
    """
    by_row, by_query = groups
    cell = lambda a, b: (a * by_query + b).cast("int").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("a", every(by_row)).select(
        cell(F.col("a"), F.pmod("row", F.lit(by_query))), F.lit(0).alias("side"), *queries.columns
    )
    told = rows.withColumn("b", every(by_query)).select(
        cell(F.pmod("row", F.lit(by_row)), F.col("b")), F.lit(1).alias("side"), *queries.columns
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, search = None, [], None
        for batch in batches:
            key = 2 * batch.column("cell").to_numpy().astype(np.int64) + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                piece, own = batch.slice(start, end - start), int(key[start])
                if own // 2 != at:
                    if search is not None:
                        yield search.result()
                    at, held, search = own // 2, [], None
                if own % 2 == 0:
                    held.append(piece)
                elif held:
                    search = search or finder(pa.Table.from_batches(held))
                    for step in range(0, piece.num_rows, STEP):
                        search.feed(piece.slice(step, STEP))
        if search is not None:
            yield search.result()

    # Cells are numbered, so each can be a partition of its own
    dealt = asked.unionByName(told).repartitionById(by_row * by_query, F.col("cell")).sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(run, schema)
