"""Edit-aware token counts: a segment tree over a document's pre-tokens is kept, and edits re-encode only their surroundings."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import quoted, rows

#: Where the vocabulary of public tokenizers lies; only the driver reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts a text before merging. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of one leaf.
LEAF = 64
#: Characters right of a pre-token that the pattern looks at before it ends there.
AHEAD = 2
#: Pre-tokens whose token counts a task remembers.
REMEMBERED = 1 << 18


class Counter:
    """Token counts of pre-tokens."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        found = list(map(known.get, parts))
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            for part in set(parts):
                if part not in known:
                    known[part] = len(self.encoding.encode_ordinary(part))
            found = list(map(known.get, parts))
        return found

    def full(self, text: str) -> int:
        return sum(self.counts(self.cut.findall(text)))


@dataclass
class Tree:
    """Leaves hold runs of pre-tokens as (their lengths, their token counts); ``sums`` are the levels of a segment tree
    over the leaves' (characters, tokens), leaves first, two children to a node."""

    leaves: list[tuple[list[int], list[int]]]
    sums: list[list[tuple[int, int]]]

    @property
    def tokens(self) -> int:
        return self.sums[-1][0][1] if self.leaves else 0


def _leaf(lengths: list[int], tokens: list[int]) -> list[tuple[list[int], list[int]]]:
    return [(lengths[k:k + LEAF], tokens[k:k + LEAF]) for k in range(0, len(lengths), LEAF)]


def _sum(leaf: tuple[list[int], list[int]]) -> tuple[int, int]:
    return sum(leaf[0]), sum(leaf[1])


def _above(level: list[tuple[int, int]], k: int) -> tuple[int, int]:
    a = level[2 * k]
    b = level[2 * k + 1] if 2 * k + 1 < len(level) else (0, 0)
    return a[0] + b[0], a[1] + b[1]


def _levels(base: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    sums = [base]
    while len(sums[-1]) > 1:
        sums.append([_above(sums[-1], k) for k in range((len(sums[-1]) + 1) // 2)])
    return sums


def build(counter: Counter, text: str) -> Tree:
    parts = counter.cut.findall(text)
    leaves = _leaf([len(p) for p in parts], counter.counts(parts))
    return Tree(leaves, _levels([_sum(x) for x in leaves]))


def _seek(tree: Tree, at: int) -> tuple[int, int]:
    """The leaf that holds the character ``at``, and the characters before that leaf; found from the root down."""
    k, before = 0, 0
    for level in reversed(tree.sums[:-1]):
        k *= 2
        if k + 1 < len(level) and at >= before + level[k][0]:
            before += level[k][0]
            k += 1
    return k, before


def edit(counter: Counter, tree: Tree, text: str, start: int, end: int, new: str) -> tuple[str, int]:
    """Replaces ``text[start:end]`` by ``new`` in the text and its tree; returns the new text and how many characters were
    cut and encoded again.

    Cutting is from left to right and looks at most :data:`AHEAD` characters past a pre-token, so pre-tokens that end
    earlier than that before the edit stay. From there the new text is cut until a cut right of the edit falls on
    an old one; what follows is as before. The leaves touched are rebuilt. If their number stays, only the sums on
    their paths to the root are renewed, else all sums of the levels are added up again, without encoding anything.
    """
    start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
    end = max(start, end)
    after = text[:start] + new + text[end:]
    if not tree.leaves:
        fresh = build(counter, after)
        tree.leaves, tree.sums = fresh.leaves, fresh.sums
        return after, len(after)
    first, base = _seek(tree, max(0, start - AHEAD))
    lengths, tokens = tree.leaves[first]
    keep, at = 0, base
    while keep < len(lengths) and at + lengths[keep] + AHEAD <= start:
        at += lengths[keep]
        keep += 1
    # A pre-token further left may still look into the edit if it ends right before the leaf
    while not keep and first and at + AHEAD > start:
        first -= 1
        lengths, tokens = tree.leaves[first]
        base -= tree.sums[0][first][0]
        keep, at = 0, base
        while keep < len(lengths) and at + lengths[keep] + AHEAD <= start:
            at += lengths[keep]
            keep += 1
    moved = len(new) - (end - start)
    new_lengths, new_tokens = lengths[:keep], tokens[:keep]
    # Old cuts right of the edit, one leaf at a time
    last, old_at, inner = first, at, keep
    found: list[str] = []
    place = at
    cuts = counter.cut.finditer(after, at)
    while place < len(after):
        if place >= start + len(new):
            goal = place - moved
            while last < len(tree.leaves) and old_at < goal:
                if inner == len(tree.leaves[last][0]):
                    last, inner = last + 1, 0
                    continue
                old_at += tree.leaves[last][0][inner]
                inner += 1
            if old_at == goal:
                break
        found.append(next(cuts).group())
        place += len(found[-1])
    else:
        last, inner = len(tree.leaves), 0
    new_lengths = new_lengths + [len(p) for p in found]
    new_tokens = new_tokens + counter.counts(found)
    if last < len(tree.leaves):
        new_lengths += tree.leaves[last][0][inner:]
        new_tokens += tree.leaves[last][1][inner:]
        last += 1
    built = _leaf(new_lengths, new_tokens)
    same = len(built) == last - first
    tree.leaves[first:last] = built
    if same:
        tree.sums[0][first:last] = [_sum(x) for x in built]
        low, high = first, last - 1
        for depth in range(1, len(tree.sums)):
            low, high = low // 2, high // 2
            for k in range(low, high + 1):
                tree.sums[depth][k] = _above(tree.sums[depth - 1], k)
    else:
        tree.sums = _levels(tree.sums[0][:first] + [_sum(x) for x in built] + tree.sums[0][last:])
    return after, place - at


def _vocabulary(spark, path: str):
    """The vocabulary's bytes, a few megabytes, read once and sent to the tasks."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _apply(counter: Counter, tree: Tree, text: str, edits: list[dict] | None) -> tuple[str, int]:
    again = 0
    for e in edits or []:
        if e is not None and e["start"] is not None:
            end = e["start"] if e["end"] is None else e["end"]
            text, n = edit(counter, tree, text, e["start"], end, e["new"] or "")
            again += n
    return text, again


def count_with_edits(
    documents: DataFrame, edits: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``(doc_id, n_chars, n_tokens, n_chars_edited, n_tokens_edited, n_encoded_again)``, one row per input row, without an exchange.

    ``edits`` names an ``array<struct<start,end,new>>`` column: replacements that are applied in turn, in characters
    of the text as it is by then; places outside are moved to its ends. ``n_encoded_again`` says how many characters the
    edits made the tokenizer look at. A null text is empty; null edits, and edits with a null start, do nothing;
    a null end inserts at the start, a null replacement deletes.
    """
    sent = _vocabulary(documents.sparkSession, vocabulary)
    kept = documents.select(
        quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"),
        quoted(edits).cast("array<struct<start:bigint,end:bigint,new:string>>").alias("edits"),
    )
    names = ["doc_id", "n_chars", "n_tokens", "n_chars_edited", "n_tokens_edited", "n_encoded_again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in rows(batches):
            found = []
            for content, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content = content or ""
                tree = build(counter, content)
                before = tree.tokens
                after, again = _apply(counter, tree, content, wanted)
                found.append((len(content), before, len(after), tree.tokens, again))
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names)

    kind = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


TREES = "text string, lengths array<array<int>>, tokens array<array<int>>, n_tokens long"
_NESTED = pa.list_(pa.list_(pa.int32()))


def _tree_batch(ids: pa.Array, texts: list[str], trees: list[Tree]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        ids, pa.array(texts, pa.string()), pa.array([[x[0] for x in t.leaves] for t in trees], _NESTED),
        pa.array([[x[1] for x in t.leaves] for t in trees], _NESTED), pa.array([t.tokens for t in trees], pa.int64()),
    ], ["doc_id", "text", "lengths", "tokens", "n_tokens"])


def build_trees(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text, lengths, tokens, n_tokens)``: each document's leaves, to be stored and given to :func:`apply_edits`."""
    sent = _vocabulary(documents.sparkSession, vocabulary)
    kept = documents.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in rows(batches, 128):
            texts = batch.column(1).to_pylist()
            yield _tree_batch(batch.column(0), texts, [build(counter, t) for t in texts])

    return kept.mapInArrow(run, f"doc_id {kept.schema[0].dataType.simpleString()}, {TREES}")


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Stored trees after ``edits(doc_id, seq, start, end, new)``, applied in the order of ``seq``.

    Edits meet their document by one join on the id. Documents without edits stay as they are, edits without a document are
    left out. Rows that repeat an id all take its edits.
    """
    sent = _vocabulary(trees.sparkSession, vocabulary)
    listed = edits.groupBy(F.col("doc_id").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("edits")
    )
    kept = trees.select("doc_id", "text", "lengths", "tokens").join(listed, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "text", "lengths", "tokens", "edits"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in rows(batches, 128):
            columns = [batch.column(k).to_pylist() for k in range(1, 5)]
            texts, done = [], []
            for content, lengths, tokens, wanted in zip(*columns, strict=True):
                leaves = list(zip(lengths, tokens, strict=True))
                tree = Tree(leaves, _levels([_sum(x) for x in leaves]))
                texts.append(_apply(counter, tree, content, wanted)[0])
                done.append(tree)
            yield _tree_batch(batch.column(0), texts, done)

    return kept.mapInArrow(run, f"doc_id {kept.schema[0].dataType.simpleString()}, {TREES}")
