"""Near-duplicate documents by SimHash, found with sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import checkpointed, quoted, rows, utf8
from formfield.llm.components import components

#: Fingerprints that a shard should hold on average, and that one tree holds at most; larger shards become several trees.
SHARD = 2048
TREE = 4096
#: Entries below which a subtree is kept as a flat leaf.
LEAF = 24


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number.

    A-Z is lower-cased, words are what ASCII white space separates, and every occurrence of a shingle counts. A text
    of fewer words is one shingle; a text without words has fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(g, seed) for g in grams], dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start:start + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kept = documents.select(quoted(doc_id).alias("doc_id"), utf8(text).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema[0].dataType.simpleString()}, fp long")


class BKTree:
    """A BK-tree over 64-bit values: a node's children are keyed by their integer Hamming distance to it.

    Built and searched for many values at once: a node compares itself with all values that reach it.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.compared = 0
        self.root = self._node(np.arange(len(values))) if len(values) else None

    def _node(self, entries: np.ndarray) -> tuple:
        first: list = [None]
        waiting = [(entries, first, 0)]
        while waiting:
            entries, into, key = waiting.pop()
            if len(entries) <= LEAF:
                into[key] = (None, entries)
                continue
            head, rest = entries[0], entries[1:]
            apart = np.bitwise_count(self.values[rest] ^ self.values[head])
            children: dict[int, tuple] = {}
            into[key] = (head, children)
            for d in np.unique(apart).tolist():
                waiting.append((rest[apart == d], children, d))
        return first[0]

    def depth(self) -> int:
        """Nodes on the longest way down."""
        most, waiting = 0, [(self.root, 1)] if self.root else []
        while waiting:
            (head, below), level = waiting.pop()
            most = max(most, level)
            waiting += [(child, level + 1) for child in below.values()] if head is not None else []
        return most

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Stars (position in the tree, positions in ``queries``) within the radius."""
        waiting = [(self.root, np.arange(len(queries)))] if self.root and len(queries) else []
        while waiting:
            (head, below), asked = waiting.pop()
            if head is None:
                self.compared += len(below) * len(asked)
                for entry in below.tolist():
                    near = asked[np.bitwise_count(queries[asked] ^ self.values[entry]) <= radius]
                    if len(near):
                        yield entry, near
                continue
            self.compared += len(asked)
            apart = np.bitwise_count(queries[asked] ^ self.values[head]).astype(np.int16)
            if len(near := asked[apart <= radius]):
                yield int(head), near
            for d, child in below.items():
                if len(go := asked[np.abs(apart - d) <= radius]):
                    waiting.append((child, go))


def _forest(values: np.ndarray, stars: Iterator[tuple[int, np.ndarray]], shift: int) -> np.ndarray:
    """Links that join what the stars join, one per value at most: each value to the smallest of its group."""
    label = np.arange(len(values))
    for centre, near in stars:
        own, others = label[centre], label[near + shift]
        if len(others := np.unique(others[others != own])):
            label[np.isin(label, np.append(others, own))] = min(own, others[0])
    signed = values.view(np.int64)
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    links = np.column_stack([signed, least[label]])
    return links[links[:, 0] != links[:, 1]]


def block_widths(n: int, radius: int, shard: int) -> tuple[list[int], int]:
    """Widths of the blocks a fingerprint is cut into, and how many bits of a choice of them make ``shard`` values meet.

    Two fingerprints within the radius agree on all blocks but ``radius`` at most. One block more than that is enough as
    long as its bits are; very many fingerprints need choices of two blocks or more.
    """
    bits = max(0, ceil(log2(max(1, n) / shard)))
    blocks = next(m for m in range(radius + 1, 65) if (m - radius) * (64 // m) >= bits or m == 64)
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)], min(bits, (blocks - radius) * (64 // blocks))


def _keys(widths: list[int], radius: int, bits: int) -> list[Column]:
    """A shard key for each choice of blocks that may be the ones on which two close fingerprints agree."""
    fp, start, cut = F.col("fp"), 0, []
    for width in widths:
        cut.append(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)))
        start += width
    keys = []
    for n, chosen in enumerate(combinations(range(len(widths)), len(widths) - radius)):
        key = F.lit(0).cast("long")
        for b in chosen:
            key = F.shiftleft(key, widths[b]).bitwiseOR(cut[b])
        keys.append(key.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(n << bits)))
    return keys


def _search_shards(radius: int):
    """Runs over rows (key, i, j, side, fp) sorted by (key, i, j): one tree per cell, then its lookups."""

    def cell(side: np.ndarray, fp: np.ndarray) -> np.ndarray:
        tree = BKTree(fp[side == 0])
        asked = fp[side == 1]
        if not len(asked):
            return _forest(tree.values, tree.search(tree.values, radius), 0)
        both = np.concatenate([tree.values, asked])
        return _forest(both, tree.search(asked, radius), len(tree.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        held: list[list[np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            links = np.concatenate([np.empty((0, 2), dtype=np.int64), *out])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

        def close() -> None:
            if held:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                if len(whole[0]) > 1:
                    out.append(cell(whole[3], whole[4].view(np.uint64)))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            same = np.ones(batch.num_rows - 1, dtype=bool)
            for c in columns[:3]:
                same &= c[1:] == c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [batch.num_rows]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                piece = [c[a:b] for c in columns]
                if held and any(held[-1][k][-1] != piece[k][0] for k in range(3)):
                    close()
                held.append(piece)
                if b < batch.num_rows:
                    close()
            if len(out) > 1 << 12:
                yield batch_of()
        close()
        yield batch_of()

    return run


def links(prints: DataFrame, radius: int = 3, shard: int = SHARD, tree: int = TREE) -> DataFrame:
    """``(u, v)``: links that connect the distinct ``fp`` values exactly as all pairs within the radius do.

    Fingerprints are cut into blocks; each choice of blocks on which two fingerprints within the radius may agree gives a
    shard key, of as many bits as leave about ``shard`` values together. A shard's values become BK-trees of at most
    ``tree`` entries; each tree is sent to the shard's other lookups, which follow only edges within the radius. Shards
    of one value are left out. A shard with many trees becomes a grid of (tree, lookups) cells, so no task holds a shard
    whole. Cells return links to the smallest value of each group found, never all pairs.
    """
    values = prints.select("fp").distinct()
    widths, bits = block_widths(prints.agg(F.approx_count_distinct("fp")).first()[0], radius, shard)
    sharded = values.select("fp", F.explode(F.array(*_keys(widths, radius, bits))).alias("key"))
    counted = sharded.groupBy("key").count().where("count > 1").select(
        "key", F.ceil(F.col("count") / tree).cast("int").alias("trees")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    placed = sharded.join(counted, "key").withColumn("own", own)
    cells = placed.select("key", "fp", F.explode(_grid()).alias("at")).select("key", "at.i", "at.j", "at.side", "fp")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_search_shards(radius), "u long, v long")


def shingle_marks(text: bytes | None, shingle: int, keys: int) -> tuple[int, int, int, list[int | None], bytes]:
    """Two hashes of the text's words, the SimHash of its distinct shingles, ``keys`` least hashes and all shingles.

    Texts of equal words are one class. The least hashes are taken under as many fixed mixings of the shingles' hashes;
    the shingles are kept as sorted 32-bit hashes.
    """
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = {joined} if words else set()
    else:
        grams = set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    own = [_signed(xxhash.xxh64_intdigest(joined, seed)) for seed in (0, 1)]
    if not grams:
        return own[0], own[1], 0, [None] * keys, b""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype="<u8")
    least = [_signed(int((hashes * np.uint64(digest(b"%d" % k) | 1)).min())) for k in range(keys)]
    return own[0], own[1], _signed(_majority(hashes)), least, np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Sets:
    """Shingle sets of a cell, numbered together so that one set can be laid against many at once."""

    def __init__(self, packed: list[bytes]):
        self.sizes = np.array([len(x) // 4 for x in packed])
        values, self.flat = np.unique(np.frombuffer(b"".join(packed), dtype="<u4"), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.mark = np.zeros(len(values), dtype=bool)

    def jaccard(self, centre: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.ends[centre] - self.sizes[centre]:self.ends[centre]]
        self.mark[own] = True
        starts, sizes = self.ends[others] - self.sizes[others], self.sizes[others]
        first = np.cumsum(sizes) - sizes
        shared = np.add.reduceat(self.mark[self.flat[np.repeat(starts - first, sizes) + np.arange(sizes.sum())]], first, dtype=np.int64)
        self.mark[own] = False
        return shared / (len(own) + sizes - shared)


class Groups:
    """Entries joined by what has been found equal or close enough."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def _verify_cells(radius: int, similarity: float):
    """Runs over rows (key, at, i, j, side, node, fp, shingles) sorted by cell: a tree, its lookups, exact checks."""

    def cell(side: np.ndarray, nodes: np.ndarray, prints: np.ndarray, shingles: list[bytes]) -> list[tuple[int, int]]:
        sets = Sets(shingles)
        held, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        asked = asked if len(asked) else held
        tree, groups, found = BKTree(prints[held]), Groups(len(nodes)), []
        for entry, near in tree.search(prints[asked], radius):
            centre, others = int(held[entry]), asked[near]
            own, sizes = groups.find(centre), sets.sizes[others]
            # Sizes too far apart can't be alike; two in one group need no link of their own
            fits = np.minimum(sizes, sets.sizes[centre]) >= similarity * np.maximum(sizes, sets.sizes[centre])
            others = np.array([x for x in others[fits].tolist() if groups.find(x) != own], dtype=np.int64)
            for start in range(0, len(others), 256):
                part = others[start:start + 256]
                for other in part[sets.jaccard(centre, part) >= similarity].tolist():
                    if groups.find(centre) != groups.find(other):
                        groups.join(centre, other)
                        found.append((int(nodes[centre]), int(nodes[other])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def close() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            numbers = [whole[c].to_numpy() for c in ("side", "node", "fp")]
            found = cell(numbers[0], numbers[1], numbers[2].view(np.uint64), whole["shingles"].to_pylist())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("place", "key", "i", "j")]
            cuts = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in names:
                cuts |= c[1:] != c[:-1]
            starts = [0, *(np.flatnonzero(cuts) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                own = tuple(int(c[start]) for c in names)
                if held and own != at:
                    yield close()
                at = own
                held.append(batch.slice(start, end - start))
        if held:
            yield close()

    return run


def similar_classes(
    documents: DataFrame, key: str, text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 18,
    keys: int = 4, tree: int = 1024,
) -> DataFrame:
    """``(a, b, first, component)``: each class of texts with equal words, its smallest ``key`` and that of its group.

    Groups join classes whose sets of ``shingle``-word shingles have a Jaccard likeness of at least ``similarity``. At
    0.8 a pair's SimHash values lie about ten bits apart, too far for blocks of equal bits, so shards come from ``keys``
    least shingle hashes: two such texts share none of four with a chance under 0.2 percent. A shard's values are
    BK-trees of at most ``tree`` entries, searched within ``radius`` bits (at 0.8 about one pair in a hundred lies
    further apart); every pair found is checked by its shingles. A shard of many trees is a grid of cells. Cells
    return no link between entries that others already join.

    Null and empty texts are one class. Rows with a null key count, but never name a group that has another.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 256):
            found = [shingle_marks(t.as_py(), shingle, keys) for t in batch.column(1)]
            longs = [[a, b, fp, *low] for a, b, fp, low, _ in found]
            columns = [pa.array(c, pa.int64()) for c in zip(*longs, strict=True)] or [pa.array([], pa.int64())] * (3 + keys)
            shingles = pa.array([f[-1] for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, shingles], ["own", "a", "b", "fp", *least, "shingles"])

    least = [f"least_{k}" for k in range(keys)]
    kept = documents.select(quoted(key).alias("own"), utf8(text).alias("text"))
    schema = f"own {kept.schema['own'].dataType.simpleString()}, a long, b long, fp long, {', '.join(f'{c} long' for c in least)}, shingles binary"
    marked = checkpointed(kept.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()))
    classes = checkpointed(marked.groupBy("a", "b").agg(
        F.min("own").alias("first"), F.min("id").alias("node"), *(F.min(c).alias(c) for c in ["fp", *least])
    ))
    sharded = classes.select("node", "fp", F.posexplode(F.array(*least)).alias("place", "key")).where("key is not null")
    counted = sharded.groupBy("place", "key").count().where("count > 1").select(
        "place", "key", F.ceil(F.col("count") / tree).cast("int").alias("trees")
    )
    placed = sharded.join(counted, ["place", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"))
    cells = checkpointed(placed.select("place", "key", "node", "fp", F.explode(_grid()).alias("at")).select("place", "key", "at.*", "node", "fp"))
    told = cells.join(marked.select(F.col("id").alias("node"), "shingles"), "node").select(
        "place", "key", "i", "j", "side", "node", "fp", "shingles"
    )
    dealt = told.repartition("place", "key", "i", "j").sortWithinPartitions("place", "key", "i", "j")
    roots = components(dealt.mapInArrow(_verify_cells(radius, similarity), "u long, v long"))
    linked = classes.join(roots, "node").select("node", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(smallest, "root").select("node", "component")
    return classes.join(named, "node", "left").select("a", "b", "first", F.coalesce("component", "first").alias("component"))


def _grid() -> Column:
    """The cells of a value in the tree ``own`` of ``trees``: its own tree, and as a lookup those of smaller number."""
    return F.transform(
        F.sequence(F.lit(0), F.col("trees") - 1),
        lambda o: F.struct(
            F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"),
            (F.col("own") > o).cast("int").alias("side"),
        ),
    )


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``fingerprint`` is 16 lowercase hex digits. Documents whose fingerprints differ in at most ``radius`` bits are
    linked, and ``component_id`` is the smallest id that can be reached, the row's own included.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each get a row. A null id
    never becomes a component id while its group has another. Other columns of ``documents`` are ignored.
    """
    prints = checkpointed(fingerprints(documents, doc_id, text, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = checkpointed(components(links(prints, radius)))
    members = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "first")
    smallest = members.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = members.join(smallest, "root").select(F.col("node").alias("fp"), "smallest")
    # Kept, so that the join below reads two plain exchanges and a very common fingerprint can be split
    named = checkpointed(classes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")))
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
