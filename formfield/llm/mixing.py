"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed, quoted

#: Items that one node of the tree reduces to one residual.
FAN_IN = 256
#: Times that a document may be repeated.
MOST = 3
#: Sources up to which their table is sent to all tasks; more are joined by an exchange.
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``sources(source, total)`` with ``target``: what of all words the source is to supply.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``most`` times the source's
    own words; the excess goes to the others by weight until none is above. As sources reach their limit in order of
    limit per weight, one ordered pass finds the final level. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limit = (F.col("total") * most).cast("double")
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    weighed = sources.withColumn("weight", turn).withColumn("limit", limit).withColumn("all", F.sum("total").over(whole).cast("double"))
    level = (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = weighed.withColumn("full", F.col("limit") <= level * F.col("weight"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0.0))
    return ranked.withColumn(
        "target", F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), rest * F.col("weight") / open_weight))
    ).select("source", "total", "target")


def _by_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a table that has one row per source ``of``; a source may hold most of the rows, so its
    rows are not brought together where the table is small enough to be sent."""
    side = F.broadcast(table) if table.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else table
    return rows.join(side, F.col("source").eqNullSafe(F.col("of")), how).drop("of")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _settle(seed: int, level: int):
    """One step of the pivotal method on the item carried along and the next one.

    Words move between the two until one of them is taken or left for good; which way, is drawn so that each item's
    expected copies stay what they are. Their words together stay the same.
    """

    def step(state: Column, x: Column) -> Column:
        r = state["left"]
        up = F.least((1 - r["p"]) * r["s"], x["p"] * x["s"])
        down = F.least(r["p"] * r["s"], (1 - x["p"]) * x["s"])
        rise = _uniform(F.lit(seed), F.lit(level), r["key"], x["key"]) * (up + down) < down
        ends = F.when(rise, (1 - r["p"]) * r["s"] <= x["p"] * x["s"]).otherwise(r["p"] * r["s"] <= (1 - x["p"]) * x["s"])
        moved = F.when(rise, up).otherwise(-down)
        unit = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        item = lambda of, p: F.struct(of["key"].alias("key"), of["s"].alias("s"), unit(p).alias("p"))
        left = F.when(ends, item(x, x["p"] - moved / x["s"])).otherwise(item(r, r["p"] + moved / r["s"]))
        # The item that ends went up if it is the carried one and rose, or the next one and the carried one fell
        done = F.struct(F.when(ends, r["key"]).otherwise(x["key"]).alias("key"), (rise == ends).alias("up"))
        return F.when(r.isNull(), F.struct(state["done"].alias("done"), x.alias("left"))).otherwise(
            F.struct(F.concat(state["done"], F.array(done)).alias("done"), left.alias("left"))
        )

    return step


def _reduce(items: DataFrame, level: int, seed: int, fan_in: int, key_type: str) -> DataFrame:
    """``(source, n, done, left)``: items of a node folded into decisions and one residual.

    A source's items are dealt over nodes by hash, ``n`` is how many items the level has; in a node larger documents
    come first, so that what is left at the end tends to be small.
    """
    nodes = F.ceil(F.col("n") / fan_in)
    node = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), nodes)
    kind = f"struct<key:{key_type},s:double,p:double>"
    start = F.expr(f"named_struct('done', cast(array() as array<struct<key:{key_type},up:boolean>>), 'left', cast(null as {kind}))")
    entry = F.struct((-F.col("s")).alias("order"), F.xxhash64("key").alias("tie"), F.struct("key", "s", "p").alias("item"))
    gathered = items.groupBy("source", "n", node.alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    in_order = F.transform("items", lambda e: e["item"])
    return gathered.select(
        "source", nodes.alias("n"), F.aggregate(in_order, start, _settle(seed, level)).alias("folded")
    ).select("source", "n", "folded.done", "folded.left")


def _tree(items: DataFrame, level: int, seed: int, fan_in: int, key_type: str) -> tuple[DataFrame, DataFrame]:
    """Decisions ``(key, up)`` on ``items(source, key, s, p)``, and the one item per source left over with its ``p``."""
    counts = items.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "of")
    counts = checkpointed(counts)
    largest = counts.agg(F.max("n")).first()[0] or 0
    items = _by_source(items, counts)
    decided = None
    for depth in range(max(1, ceil(log(max(largest, 2)) / log(fan_in)))):
        folded = checkpointed(_reduce(items, level + depth, seed, fan_in, key_type))
        done = folded.select(F.explode("done").alias("d")).select("d.key", "d.up")
        decided = done if decided is None else decided.union(done)
        items = folded.where("left is not null").select("source", "left.key", "left.s", "left.p", "n")
    return decided, items.select("source", "key", "s", "p")


def mix(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 1, fan_in: int = FAN_IN,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per input row.

    ``size`` counts a text's words and ``copies`` says how often the mix takes it, 0 to ``most``. A source's
    expected copies per document are its target over its words; the fraction above whole copies is rounded by the
    pivotal method, which keeps the source's words at its target. Draws depend on ids, sizes
    and the seed alone, so a rerun agrees.

    Null and blank texts have size 0 and nothing to take. Rows that agree in source, id and size are counted together
    first, so that no group holds more than about ``fan_in`` items, and share their copies evenly. Documents above a
    source's mean size are rounded first; what their last one takes too much or too little is given back by the
    smaller ones, so a source misses its target by a small document. A null source is a source of its own. An empty table gives an empty result; other columns are ignored.
    """
    sized = documents.select(
        quoted(doc_id).alias("doc_id"), quoted(source).cast("string").alias("source"), word_count(quoted(text)).alias("size")
    )
    classes = checkpointed(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")))
    sources = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("total")), weights, most)
    sources = checkpointed(sources.withColumnRenamed("source", "of"))
    each = F.when(F.col("total") > 0, F.col("rows") * F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    priced = _by_source(classes, sources).withColumn("each", each)
    priced = priced.withColumn("whole", F.floor("each")).withColumn("p", F.col("each") - F.col("whole"))
    priced = checkpointed(priced.withColumn("key", F.struct("source", "doc_id", "size")).drop("source", "doc_id", "size", "each"))
    key_type = priced.schema["key"].dataType.simpleString()
    open_items = priced.where("p > 0 and key.size > 0").select("key.source", "key", F.col("key.size").cast("double").alias("s"), "p")
    light = F.col("s") <= F.col("mean")
    shape = checkpointed(open_items.groupBy("source").agg(F.avg("s").alias("mean")).withColumnRenamed("source", "of"))
    sided = _by_source(open_items, shape).withColumn("light", light).drop("mean")
    heavy, last = _tree(sided.where("not light").drop("light"), 0, seed, fan_in, key_type)
    # Words that the last heavy document takes above or below its part are given back by the light ones
    last = last.withColumn("up", _uniform(F.lit(seed), F.lit(-1), "key") < F.col("p"))
    rest = sided.where("light").drop("light")
    slack = rest.groupBy("source").agg(F.sum("s").alias("slack")).withColumnRenamed("source", "of")
    over = last.select(F.col("source").alias("by"), ((F.col("up").cast("double") - F.col("p")) * F.col("s")).alias("over"))
    owed = slack.join(over, F.col("of").eqNullSafe(F.col("by")), "left").select("of", (F.coalesce("over", F.lit(0.0)) / F.col("slack")).alias("owed"))
    rest = _by_source(rest, checkpointed(owed)).withColumn(
        "p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - F.col("owed")))
    ).drop("owed")
    rest = checkpointed(rest)
    fixed = rest.where("p <= 0 or p >= 1").select("key", (F.col("p") >= 1).alias("up"))
    fine, end = _tree(rest.where("p > 0 and p < 1"), 100, seed, fan_in, key_type)
    end = end.select("key", (_uniform(F.lit(seed), F.lit(-1), "key") < F.col("p")).alias("up"))
    decided = heavy.union(last.select("key", "up")).union(fixed).union(fine).union(end).withColumnRenamed("key", "of")
    copies = F.col("whole") + F.coalesce(F.col("up").cast("long"), F.lit(0))
    rounded = priced.join(decided, priced["key"].eqNullSafe(decided["of"]), "left").withColumn("all", copies)
    # Rows of a class are listed in two steps, so no array grows with a class
    spread = rounded.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 4096))))
    here = F.least(F.lit(4096).cast("long"), F.col("rows") - F.col("from") * 4096) - 1
    first = F.col("from") * 4096
    spread = spread.withColumn("at", F.explode(F.sequence(first, first + here)))
    own = F.floor(F.col("all") / F.col("rows")) + (F.col("at") < F.col("all") % F.col("rows")).cast("long")
    return spread.select(
        "key.doc_id", "key.source", "key.size", F.col("total").alias("source_size"), "target", own.alias("copies"),
        (own * F.col("key.size")).alias("taken"),
    )
