"""Document fingerprints by one-permutation MinHash with optimal densification and low-order bits."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import partitions, quoted, rows, utf8

BINS = 256
#: Low-order bits kept of each bin.
BITS = 4
SHINGLE = 5
#: Bytes of text that one range of ids holds, about.
RANGE_BYTES = 8 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a sum depend on all bits of its parts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Minhash:
    """Fingerprints of byte texts as hex strings.

    Words are what ASCII white space separates, A-Z lower-cased; a text of fewer words than a shingle is one shingle, a
    text without words has an empty fingerprint. Each shingle is hashed once: the hash picks a bin and a value, and a
    bin keeps its least value. An empty bin copies one that is not: it walks through the bins in a random order
    of its own, the same for all documents, to the first filled one. The low bits of each bin are packed.
    """

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE, seed: int = 42):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two and bits one of 1, 2, 4, 8")
        self.bins, self.bits, self.shingle, self.seed = bins, bits, shingle, seed
        draws = np.random.default_rng(seed)
        self.walk = np.array([draws.permutation(bins) for _ in range(bins)], dtype=np.int32)
        self.place = [np.uint64(v) for v in draws.integers(1, 2**63, size=shingle, dtype=np.uint64) | np.uint64(1)]
        self.known: dict[bytes, int] = {}

    def _words(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > 1 << 18:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w, self.seed)
            found = list(map(known.get, words))
        return np.array(found, dtype=np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        words = self._words(text)
        n = max(1, len(words) - self.shingle + 1)
        if not len(words):
            return words
        total = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.shingle, len(words))):
            total += _mixed(words[k:k + n]) * self.place[k]
        return _mixed(total)

    def fingerprint(self, text: bytes | None) -> str:
        hashes = self.shingles(text or b"")
        if not len(hashes):
            return ""
        mask = np.uint64(self.bins - 1)
        shift = np.uint64(self.bins.bit_length() - 1)
        least = np.full(self.bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, (hashes & mask).astype(np.int64), hashes >> shift)
        filled = least != np.iinfo(np.uint64).max
        if not filled.all():
            empty = np.flatnonzero(~filled)
            order = self.walk[empty]
            least[empty] = least[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        low = (_mixed(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        packed = np.zeros(self.bins // per, dtype=np.uint8)
        for k in range(per):
            packed |= low[k::per] << np.uint8(self.bits * (per - 1 - k))
        return packed.tobytes().hex()

    def likeness(self, a: str, b: str) -> float:
        """Estimated Jaccard likeness: equal bins, less those that equal low bits make equal by chance."""
        if not a or not b:
            return float(a == b)
        x, y = (np.frombuffer(bytes.fromhex(t), dtype=np.uint8) for t in (a, b))
        differ, part = x ^ y, (1 << self.bits) - 1
        same = sum(int(((differ >> np.uint8(self.bits * k)) & np.uint8(part) == 0).sum()) for k in range(8 // self.bits))
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (same / self.bins - chance) / (1 - chance)))


def fingerprint_table(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **shape) -> DataFrame:
    """``(doc_id, fingerprint)`` for every row, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Minhash(**shape)
        for batch in rows(batches):
            found = [hasher.fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    kept = documents.select(quoted(doc_id).alias("doc_id"), utf8(text).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema[0].dataType.simpleString()}, fingerprint string")


def by_neighbours(
    documents: DataFrame, work: Callable[[pa.Array, list[str], list[str]], pa.RecordBatch], schema: str,
    doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``work(ids, texts, next_texts)`` over documents in the order of their ids, a run of them at a time.

    Ids are of any type that can be sorted. Null ids come first, equal ids follow each other by the MD5 of their texts;
    a null text is empty. Keys are cut into ranges of about ``range_bytes`` of text, or one per shuffle partition if that
    is more, at places that Spark's own range exchange finds; the driver gets the first key of each. Every range is a
    partition of its own, read in order and never held whole, and the first document of a range is also sent to the
    range before it, the very first to the last. So texts are exchanged once, and many rows of one id, or of none, are
    split like any others unless their texts are equal too.
    """
    spark = documents.sparkSession
    kept = documents.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    kept = kept.select("doc_id", "text", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("digest"))
    size = kept.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    ranges = max(-(-size // range_bytes), partitions(documents))
    key = lambda name: F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest").alias(name)
    keys = kept.select(key("key")).repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part"))
    firsts = spark.sparkContext.broadcast(sorted(
        ((r.first.known, r.first.doc_id, r.first.digest) for r in keys.agg(F.min("key").alias("first")).collect()),
        key=lambda k: (k[0], k[1] if k[0] else 0, k[2]),
    ))

    @F.arrow_udf("array<struct<range:int,guest:boolean>>")
    def ranges_of(ids: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        edges = [(known, v if known else 0, digest) for known, v, digest in firsts.value]
        number = {k: n for n, k in enumerate(edges)}
        kind = pa.list_(pa.struct([("range", pa.int32()), ("guest", pa.bool_())]))
        for column, digests in ids:
            out = []
            for v, digest in zip(column.to_pylist(), digests.to_pylist(), strict=True):
                own = (v is not None, 0 if v is None else v, digest)
                places = [{"range": bisect_right(edges, own) - 1, "guest": False}]
                if own in number:
                    places.append({"range": (number[own] - 1) % len(edges), "guest": True})
                out.append(places)
            yield pa.array(out, kind)

    dealt = kept.select("doc_id", "text", "digest", F.explode(ranges_of("doc_id", "digest")).alias("at")).select(
        "at.range", "at.guest", "doc_id", "digest", "text"
    )
    sorted_rows = dealt.repartitionById(max(1, len(firsts.value)), F.col("range")).sortWithinPartitions(
        F.desc("guest"), F.asc_nulls_first("doc_id"), "digest"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guest, ids, texts = None, [], []
        for batch in rows(batches, 512):
            own = batch.filter(pc.invert(batch.column("guest")))
            if guest is None and own.num_rows < batch.num_rows:
                guest = batch.column("text")[0].as_py()  # the first that is sent
            if own.num_rows:
                new = own.column("text").to_pylist()
                if texts:
                    yield work(pa.concat_arrays(ids), texts, [*texts[1:], new[0]])
                ids, texts = [own.column("doc_id")], new
        if texts:
            yield work(pa.concat_arrays(ids), texts, [*texts[1:], guest])

    return sorted_rows.mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many, or all, of the next document's first ones."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprint_edits(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES, **shape) -> DataFrame:
    """One row per input row: ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Each text and its edited text (see :func:`edited_text`) are fingerprinted; ``near_edited`` and ``near_next`` estimate
    how alike the text's shingles are to the edited text's and to the next document's. A null text is empty; empty
    texts have an empty fingerprint, alike to each other (1) and to nothing else (0). The last document is followed
    by the first, a single one by itself. Other columns are ignored; an empty table gives an empty result.
    """
    kind = documents.select(quoted(doc_id)).schema[0].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    hashers: dict[str, Minhash] = {}

    def work(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
        hasher = hashers.get("own") or hashers.setdefault("own", Minhash(**shape))
        prints = [hasher.fingerprint(t.encode()) for t in texts]
        edits = [edited_text(t, f) for t, f in zip(texts, following, strict=True)]
        edited = [hasher.fingerprint(t.encode()) for t in edits]
        after = [*prints[1:], hasher.fingerprint(following[-1].encode())] if texts else []
        return pa.RecordBatch.from_arrays([
            ids, pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
            pa.array(prints, pa.string()), pa.array(edited, pa.string()),
            pa.array([hasher.likeness(a, b) for a, b in zip(prints, edited, strict=True)], pa.float64()),
            pa.array([hasher.likeness(a, b) for a, b in zip(prints, after, strict=True)], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return by_neighbours(documents, work, schema, doc_id, text, range_bytes)
