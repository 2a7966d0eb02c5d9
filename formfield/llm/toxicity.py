"""Toxicity by weak supervision: a label model over many voters, then a linear classifier on its posteriors."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formfield.llm.common import held_out, quoted

#: Labelled documents that voters are found on and the models are fitted on, chosen by a hash of their ids.
FIT_DOCUMENTS = 6_000
FOLDS, HELD_OUT = 4, 2
#: Lexicon voters that are kept, and in how many toxic documents of the sample, at least and as a share, a term must stand.
VOTERS, SUPPORT, SHARE = 96, 5, 0.015
#: Least log odds ratio of a term's document frequencies in toxic and other documents.
ODDS = 2.5
#: Sizes of word beginnings that may become terms, and of the hashed feature space.
BEGINNINGS, FEATURES = (3, 4, 5, 6, 7), 1 << 15

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word and its true beginnings, which end in ``*``."""
    plain = word.decode(errors="replace")
    return [word, *(plain[:n].encode() + b"*" for n in BEGINNINGS if len(plain) > n)]


@dataclass
class Voters:
    """Lexicon voters, one per term, and pattern voters over a document's hits and its writing.

    A vote is 1 (toxic), -1 (not) or 0 (none).
    """

    lexicon: list[bytes]
    at: dict[bytes, int] = field(init=False)
    patterns: int = 7

    def __post_init__(self):
        self.at = {term: n for n, term in enumerate(self.lexicon)}

    def hits(self, words: list[bytes]) -> Counter:
        at, found = self.at, Counter()
        for word, n in Counter(words).items():
            for term in terms_of(word):
                if (k := at.get(term)) is not None:
                    found[k] += n
        return found

    def votes(self, text: str, words: list[bytes], hits: Counter) -> np.ndarray:
        out = np.zeros(len(self.lexicon) + self.patterns, dtype=np.int8)
        for k in hits:
            out[k] = 1
        places, n, size = sum(hits.values()), len(words), max(1, len(text))
        raised = sum(map(text.count, "!?"))
        out[len(self.lexicon):] = (
            1 if len(hits) >= 2 else 0,
            1 if places >= 3 else 0,
            1 if n and places / n >= 0.01 else 0,
            -1 if not hits else 0,
            -1 if len(hits) == 1 and n > 400 else 0,
            -1 if n < 3 and not hits else 0,
            1 if hits and raised / size > 0.02 else 0,
        )
        return out


def find_terms(samples: list[tuple[list[bytes], int]]) -> list[bytes]:
    """Terms that stand much more often in toxic documents, most frequent first.

    A beginning gives way to a longer one that keeps most of its toxic documents, as the longer one is surer; a term that
    begins with one already chosen adds nothing and is left out.
    """
    found: Counter = Counter()
    clean: Counter = Counter()
    total = Counter(label for _, label in samples)
    known: dict[bytes, list[bytes]] = {}
    for words, label in samples:
        terms = set()
        for w in set(words):
            if len(w) > 2:
                if w not in known:
                    known[w] = terms_of(w)
                terms.update(known[w])
        (found if label else clean).update(terms)
    enough = max(SUPPORT, SHARE * total[1])
    plain = {t: t.rstrip(b"*").decode(errors="replace") for t, n in found.items() if n >= enough}
    kept: dict[str, int] = defaultdict(int)
    for t, word in plain.items():
        for n in BEGINNINGS:
            if n < len(word):
                kept[word[:n]] = max(kept[word[:n]], found[t])
    scored = []
    for t, word in plain.items():
        n = found[t]
        odds = log((n + 0.5) / (total[1] + 1)) - log((clean[t] + 0.5) / (total[0] + 1))
        if odds >= ODDS and not (t.endswith(b"*") and kept[word] >= 0.8 * n):
            scored.append((-n * odds, t))
    chosen: set[bytes] = set()
    for _, t in sorted(scored):
        if not any(n < len(plain[t]) and plain[t][:n].encode() + b"*" in chosen for n in BEGINNINGS) and len(chosen) < VOTERS:
            chosen.add(t)
    return sorted(chosen)


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> np.ndarray:
    """Posterior probability of toxic for each row of votes.

    Expectation-maximisation over the true label: each voter has a chance to vote as it does under either label, which
    are its accuracy and coverage. Voters that agree more than the label explains are correlated: the correlation
    of their votes within a label is estimated with the posteriors, and a voter's evidence is divided by
    one plus its correlations with the others, so that ten voters saying the same thing count about once.
    """
    fires = (votes != 0).astype(np.float64)
    toxic = np.clip(0.5 + 0.5 * np.sign(votes).sum(axis=1), 0.02, 0.98) * 1.0
    sign = np.sign(votes).sum(axis=0)
    weight = np.ones(votes.shape[1])
    for step in range(rounds):
        chance = []
        for p in (toxic, 1 - toxic):
            c = (fires.T @ p + 0.5) / (p.sum() + 1)
            chance.append(np.clip(c, 1e-4, 1 - 1e-4))
        # A voter keeps its direction: it may not become evidence for the other label
        up, down = chance
        low = np.where(sign >= 0, np.maximum(up, down), np.minimum(up, down))
        high = np.where(sign >= 0, np.minimum(up, down), np.maximum(up, down))
        on, off = np.log(low / high), np.log((1 - low) / (1 - high))
        # A missing vote says little: lexicon voters are silent on most toxic documents too
        logit = log(prior / (1 - prior)) + (fires * on) @ weight + ((1 - fires) * off) @ weight
        toxic = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if step in (10, 25, 40):
            apart = fires - np.outer(toxic, low) - np.outer(1 - toxic, high)
            spread = np.sqrt((apart**2).mean(axis=0)) + 1e-9
            close = (apart.T @ apart) / len(apart) / np.outer(spread, spread)
            np.fill_diagonal(close, 0)
            weight = 1 / (1 + np.clip(close, 0, 1).sum(axis=1))
    return toxic


def _slots(word: bytes) -> tuple[int, ...]:
    return tuple({xxhash.xxh32_intdigest(t) % FEATURES for t in (word, word[:5] + b"*", word[:4] + b"*")})


def train(documents: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 120, ridge: float = 1e-3):
    """Logistic regression on posterior labels; returns word weights, dense weights and the offset.

    Votes are held less small than hashed words, which are many and mostly noise.
    """
    n = len(documents)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(d[0]) for d in documents])
    col = np.concatenate([d[0] for d in documents]) if n else np.empty(0, dtype=np.int32)
    dense = np.vstack([d[1] for d in documents])
    width = FEATURES + dense.shape[1] + 1
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    w[-1] = log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[col], n) * 0.5 + dense @ w[FEATURES:-1] + w[-1]
        off = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = np.concatenate([np.bincount(col, off[row], FEATURES) * 0.5, dense.T @ off, [off.sum()]]) / n
        slope[:FEATURES] -= ridge * w[:FEATURES]
        slope[FEATURES:-1] -= 0.1 * ridge * w[FEATURES:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w = w + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:FEATURES], w[FEATURES:-1], float(w[-1])


@dataclass
class Model:
    voters: Voters
    word_weights: np.ndarray
    dense_weights: np.ndarray
    offset: float

    def __post_init__(self):
        self.known: dict[bytes, float] = {}

    def features(self, text: str) -> tuple[list[bytes], np.ndarray]:
        words = words_of(text)
        hits = self.voters.hits(words)
        return words, self.voters.votes(text, words, hits).astype(np.float64)

    def score(self, text: str | None) -> float:
        words, dense = self.features(text or "")
        known, total = self.known, self.offset + float(dense @ self.dense_weights)
        if len(known) > 1 << 18:
            known.clear()
        for word in set(words):
            value = known.get(word)
            if value is None:
                value = known[word] = 0.5 * sum(self.word_weights[k] for k in _slots(word))
            total += value
        return 1 / (1 + exp(-max(-30.0, min(30.0, total))))


def fit_model(samples: list[tuple[str, int]]) -> Model:
    """Fits on (text, toxic) pairs: the labels serve to find terms and the share of toxic documents, nothing else."""
    one: dict[bytes, bytes] = {}
    # A word that is met again is the same object, and positions are small arrays: the driver's memory is bounded, but small
    tokens = [([one.setdefault(w, w) for w in words_of(text)], label) for text, label in samples]
    # Copies of a document would make its words look like terms
    voters = Voters(find_terms([tokens[n] for n in {text: n for n, (text, _) in enumerate(samples)}.values()]))
    share = (sum(label for _, label in samples) + 0.5) / (len(samples) + 1)
    if not samples:
        return Model(voters, np.zeros(FEATURES), np.zeros(voters.patterns), -3.0)
    votes = np.vstack([voters.votes(text, words, voters.hits(words)) for (text, _), (words, _) in zip(samples, tokens, strict=True)])
    target = label_model(votes, share)
    slots = {w: _slots(w) for w in one}
    rows = [
        (np.fromiter((k for w in set(words) for k in slots[w]), np.int32), v.astype(np.float32))
        for (words, _), v in zip(tokens, votes, strict=True)
    ]
    return Model(voters, *train(rows, target))


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    fit_documents: int = FIT_DOCUMENTS, folds: int = FOLDS, fold: int = HELD_OUT,
) -> Model:
    """Fits the model on at most ``fit_documents`` labelled documents whose fold is learnt.

    They are the ones whose ids hash lowest, so the choice follows neither order nor partitions. Null labels and ids
    are left out; a repeated id contributes one row per distinct label and text.
    """
    known = labels.select(quoted(doc_id).alias("doc_id"), quoted(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_documents)
    texts = documents.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text")).where("text is not null")
    # At most fit_documents ids, so the broadcast is bounded
    found = texts.join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "text", "label")
    return fit_model([(r["text"], r["label"]) for r in found.limit(fit_documents).collect()])


def score_column(model: Model, text: str = "text") -> Column:
    """Probability that a text is toxic; null and blank texts get the score of a text without words."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.score(t) for p in range(0, len(texts), 512) for t in texts.slice(p, 512).to_pylist()]
            yield pa.array(found, pa.float64())

    return score(quoted(text).cast("string"))


def score_documents(
    documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3,
    folds: int = FOLDS, fold: int = HELD_OUT,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row, without an exchange.

    Null and blank texts have a defined score, repeated rows score alike, and other columns are ignored.
    """
    scored = documents.select(
        quoted(doc_id).alias("doc_id"), held_out(doc_id, folds, fold).alias("held_out"),
        score_column(model, text).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
