"""Whole-group statistics that survive a group holding a third of all rows.

Race fields are tiny, so the normal plan is one exchange on the group key and
windows on top of it. That plan breaks when a single key is huge, because a
window partition is one task. ``group_operator`` therefore counts rows per key
first (one column, combined map-side). If every group fits in a task only the
window plan is built. Otherwise the oversized groups are cut out and go through
aggregates that are joined back, and through ranks over a range-partitioned
layout; both spread one group over many tasks. Both plans return the same rows.
"""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_GROUP_ROWS = 10_000
LISTED_KEYS = 1_000


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so that every later branch reads the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="formfield-"))
    return df.checkpoint()


def join_back(df: DataFrame, table: DataFrame, by: list[str], *, small: bool, how: str = "inner") -> DataFrame:
    """Join per-group columns to their rows; NULL keys form a group, as they do in a window."""
    keys = {c: f"__{c}" for c in by}
    right = table.withColumnsRenamed(keys)
    cond = functools.reduce(
        Column.__and__, [df[c].eqNullSafe(right[k]) for c, k in keys.items()]
    )
    return df.join(F.broadcast(right) if small else right, cond, how).drop(*keys.values())


class Groups:
    """Statistics, ranks and neighbours inside the groups of ``by``.

    ``spread=False`` uses windows (each group fits in a task), ``spread=True`` uses
    aggregates joined back. ``listed`` says that at most LISTED_KEYS groups exist, which
    bounds every per-group table and makes broadcasting it safe.
    """

    def __init__(self, by: list[str], *, spread: bool = False, listed: bool = False):
        self.by = list(by)
        self.spread = spread
        self.listed = listed
        self.window = Window.partitionBy(*self.by)

    def settle(self, df: DataFrame) -> DataFrame:
        """Fix the rows before they are read by several branches of a spread plan."""
        return durable(df) if self.spread else df

    def stats(self, df: DataFrame, **aggs: Column) -> DataFrame:
        if not self.spread:
            return df.withColumns({n: a.over(self.window) for n, a in aggs.items()})
        table = df.groupBy(*self.by).agg(*[a.alias(n) for n, a in aggs.items()])
        return join_back(df, table, self.by, small=self.listed)

    def rank(self, df: DataFrame, name: str, *order: Column) -> DataFrame:
        """1-based position; ``order`` must end in a column that is unique in the group."""
        if not self.spread:
            return df.withColumn(name, F.row_number().over(self.window.orderBy(*order)))
        part = ["__part"]
        ranged = durable(
            df.repartitionByRange(*[F.col(c) for c in self.by], *order)
            .withColumn("__part", F.spark_partition_id())
        )
        pieces = ranged.groupBy(*self.by, *part).agg(F.count("*").alias("__n"))
        earlier = self.window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = pieces.select(
            *self.by, *part, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
        )
        inner = F.row_number().over(Window.partitionBy(*self.by, *part).orderBy(*order))
        ranked = join_back(ranged.withColumn("__inner", inner), offsets, self.by + part, small=False)
        return ranked.withColumn(name, (F.col("__before") + F.col("__inner")).cast("int")).drop(
            "__part", "__before", "__inner"
        )

    def following(self, df: DataFrame, name: str, rank: str, value: str) -> DataFrame:
        """Value of the row ranked next, NULL for the last one."""
        if not self.spread:
            return df.withColumn(name, F.lead(value).over(self.window.orderBy(rank)))
        nxt = df.select(*self.by, (F.col(rank) - 1).alias(rank), F.col(value).alias(name))
        return join_back(df, nxt, self.by + [rank], small=False, how="left")

    def median(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """Exact median of the non-NULL values."""
        if not self.spread:
            return df.withColumn(name, F.median(value).over(self.window))
        return join_back(df, self._selected(df, name, value.cast("double")), self.by, small=self.listed, how="left")

    def _selected(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """The median per group by narrowing, without sorting rows.

        A histogram per group finds the bin of the middle, and the next one divides that bin between its own smallest and
        largest value. Binary magnitudes come first, so a bin spans a factor of two at most, which holds 2^52 doubles; four
        divisions by 2^14 leave one value of them. Counts are combined before each exchange: a task sends a row per bin.
        """
        known = durable(df.select(*self.by, value.alias("__v")).filter("__v is not null"))
        v = F.col("__v")
        magnitude = F.floor(F.least(F.log2(F.abs(v)), F.lit(1_100.0))).cast("int") + 2_000
        coarse = F.when(F.isnan(v), 9_999).when(v == 0.0, 0).when(v < 0.0, -magnitude).otherwise(magnitude)
        held = [F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")]
        bins = known.groupBy(*self.by, coarse.alias("bin")).agg(*held)
        table = bins.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("bins"), F.sum("n").alias("n"))
        ranks = F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))
        table = table.select(*self.by, "bins", F.posexplode(ranks).alias("side", "rank"))
        for _ in range(NARROWINGS):
            table = table.select(*self.by, "side", _bin_of_rank("bins", "rank").alias("at"))
            sides = table.groupBy(*self.by).agg(F.collect_list(F.struct("side", "at")).alias("__sides"))
            inside = lambda s: v.between(s["at"]["lo"], s["at"]["hi"])
            near = join_back(known, sides, self.by, small=self.listed).filter(F.exists("__sides", inside))
            near = near.select(*self.by, "__v", F.explode(F.filter("__sides", inside)).alias("s")).select(*self.by, "__v", "s.side", "s.at.*")
            step = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
            near = near.withColumn("bin", F.when(F.col("lo") == F.col("hi"), 0).otherwise(step))
            bins = near.groupBy(*self.by, "side", "bin").agg(*held, F.max("rank").alias("rank"))
            table = bins.groupBy(*self.by, "side").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("bins"), F.max("rank").alias("rank"))
        at = _bin_of_rank("bins", "rank")
        one = F.when(at["lo"] == at["hi"], at["lo"]).otherwise(F.raise_error(F.lit("a bin of the median holds several values")))
        return table.groupBy(*self.by).agg(F.avg(one).alias(name))


#: Bins that each narrowing of a median makes, and how often it narrows; see Groups.median.
BINS = 1 << 14
NARROWINGS = 4


def _bin_of_rank(bins: str, rank: str) -> Column:
    """The bin in which the value of a rank lies, with the rank inside it."""
    start = F.struct(F.col(rank).cast("long").alias("rank"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))

    def step(acc, x):
        here = x["n"] >= acc["rank"]
        return F.when(acc["done"], acc).otherwise(F.struct(
            F.when(here, acc["rank"]).otherwise(acc["rank"] - x["n"]).alias("rank"), F.when(here, x["lo"]).alias("lo"),
            F.when(here, x["hi"]).alias("hi"), here.alias("done")))

    return F.aggregate(bins, start, step)


class Sizes:
    """Which groups of ``by`` are too large for one task, found once and handed to every operator of a pipeline.

    It holds for any table whose groups are no larger than those it was found on, such as what a filter leaves of them.
    """

    def __init__(self, by: list[str], keys: list[int], table: DataFrame | None = None):
        self.by, self.keys, self.table = list(by), keys, table

    def apply(self, df: DataFrame, fn) -> DataFrame:
        """``fn(rows, groups)`` with windows, and apart from them for the large groups."""
        if not self.keys:
            return fn(df, Groups(self.by))
        key = F.xxhash64(*self.by)
        if self.table is None:
            is_large = key.isin(self.keys)
            rest, cut = df.filter(~is_large), df.filter(is_large)
        else:
            hashed = df.withColumn("__key", key)
            rest = hashed.join(self.table, "__key", "left_anti").drop("__key")
            cut = hashed.join(self.table, "__key", "left_semi").drop("__key")
        groups = Groups(self.by, spread=True, listed=self.table is None)
        return fn(rest, Groups(self.by)).unionByName(fn(cut, groups))


#: Counters of the sketch of frequent keys; an ordinary one gets a small part of what makes a group large.
COUNTERS = 1 << 14
#: A group is large only if it also holds this share of all rows; so there are a thousand large ones at most.
LARGE_SHARE = 1 / 1_000


def group_sizes(df: DataFrame, by: list[str], limit: int = TASK_GROUP_ROWS) -> Sizes:
    """One pass over the keys of ``df``, into a fixed number of counters that their hashes share.

    Counters are summed before the exchange, so it carries no more than they are, however many keys there are. Large is a
    group of more than ``limit`` rows that holds a thousandth of all rows; a smaller one is small change for the task
    that it falls to. A counter is never below its largest group, so only the keys of those that reach the bound are
    counted exactly.
    """
    key = F.xxhash64(*by)
    keyed = df.select(key.alias("__key"), F.pmod(key, F.lit(COUNTERS)).cast("int").alias("__at"))
    full = F.collect_list(F.when(F.col("count") > limit, F.struct("__at", "count")))
    found = keyed.groupBy("__at").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), full.alias("full")).first()
    least = max(limit + 1, found["n"] * LARGE_SHARE)
    likely = [c["__at"] for c in found["full"] if c["count"] >= least]
    if not likely:
        return Sizes(by, [])
    counts = keyed.filter(F.col("__at").isin(likely)).groupBy("__key").count()
    return Sizes(by, [r[0] for r in counts.filter(F.col("count") >= least).collect()])


def counted_sizes(df: DataFrame, by: list[str], limit: int) -> Sizes:
    """Every group above ``limit`` rows, by counting all of them; for steps whose cost grows faster than a group."""
    key = F.xxhash64(*by)
    large = (
        df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select(key.alias("__key"))
    )
    keys = [r[0] for r in large.take(LISTED_KEYS + 1)]
    return Sizes(by, keys, durable(large) if len(keys) > LISTED_KEYS else None)


def by_group_size(df: DataFrame, by, fn, limit: int = TASK_GROUP_ROWS) -> DataFrame:
    """Run ``fn(rows, groups)`` with windows, and separately for groups above ``limit`` rows.

    ``by`` is the key, or the :class:`Sizes` that an earlier step of the pipeline has found.
    """
    return (by if isinstance(by, Sizes) else counted_sizes(df, by, limit)).apply(df, fn)


def group_operator(fn=None, *, limit: int | None = None):
    """Let ``fn(df, groups, …)`` also be called as ``fn(df, ["key", …], …)`` or with :class:`Sizes`.

    With a ``limit`` every group above it is found, else those that hold a fair share of all rows.
    """
    if fn is None:
        return functools.partial(group_operator, limit=limit)

    @functools.wraps(fn)
    def call(df: DataFrame, by, *args, **kwargs) -> DataFrame:
        if isinstance(by, Groups):
            return fn(df, by, *args, **kwargs)
        if not isinstance(by, Sizes):
            by = [by] if isinstance(by, str) else list(by)
            by = group_sizes(df, by) if limit is None else counted_sizes(df, by, limit)
        return by.apply(df, lambda d, g: fn(d, g, *args, **kwargs))

    return call
