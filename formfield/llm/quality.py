"""Document quality from lines labelled by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formfield.llm.common import held_out, quoted, rows, utf8

#: Labelled documents the model is fitted on, chosen by a hash of their ids.
FIT_DOCUMENTS = 4_000
#: Bytes of their whole texts together; the documents beyond it in that order are left out of the sample.
FIT_BYTES = 64 << 20
#: Lines of a stretch; fitting steps through the stretches of all documents side by side.
STRETCH = 400
#: Fold of crc32(doc_id) whose labels are never learnt.
FOLDS, HELD_OUT = 5, 0

_LOWER, _UPPER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((97, 122), (65, 90), (48, 57)))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-")
OWN = 12


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each non-blank line (rows) and the lines' lengths in bytes."""
    found, sizes, seen = [], [], {}
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, count = len(line), len(words)
        letters = n - len(line.translate(None, _LOWER))
        upper = n - len(line.translate(None, _UPPER))
        digits = n - len(line.translate(None, _DIGIT))
        signs = n - len(line.translate(None, _SIGNS))
        bars = line.count(b"|")
        twice = sum(map(eq, words, words[1:]))
        again = seen.get(line, 0)
        seen[line] = again + 1
        found.append((
            1.0, upper / n, upper / (upper + letters + 1), digits / n, signs / n, min(1.0, signs / count),
            min(1.0, bars / count), twice / count, 1 - len(set(words)) / count if count > 20 else 0.0,
            float(again > 0), min(n / count, 30) / 10, float(line.rstrip()[-1:] in b".!?\"'"),
        ))
        sizes.append(n)
    return np.array(found, dtype=np.float64).reshape(-1, OWN), np.array(sizes, dtype=np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Each line's features, its previous line's and its next line's; zeros where there is none."""
    none = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])]) if len(own) else np.zeros((0, 3 * own.shape[1]))


@dataclass
class Model:
    """``node``: weights of label good for a line; ``edge[a, b]``: weight of label b after a; the rest turns the
    share of good text into a probability."""

    centre: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    empty: float = 0.5

    def line_scores(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        own, sizes = line_features(text)
        return np.clip((with_neighbours(own) - self.centre) @ self.node, -25, 25), sizes

    def good_lines(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Marginal probability that each line is good, by forward-backward, and the lines' lengths."""
        scores, sizes = self.line_scores(text)
        (m00, m01), (m10, m11) = np.exp(self.edge).tolist()
        odds = np.exp(scores).tolist()
        ahead, p = [], None
        for o in odds:
            good, bad = (o, 1.0) if p is None else (o * ((1 - p) * m01 + p * m11), (1 - p) * m00 + p * m10)
            p = good / (good + bad)
            ahead.append(p)
        out, b = [0.0] * len(odds), 0.5
        for t in range(len(odds) - 1, -1, -1):
            f = ahead[t]
            out[t] = f * b / (f * b + (1 - f) * (1 - b))
            good, bad = odds[t] * b, 1 - b
            up, down = m10 * bad + m11 * good, m00 * bad + m01 * good
            b = up / (up + down)
        return np.array(out), sizes

    def share(self, text: bytes) -> float:
        """Length-weighted mean of the lines' marginals."""
        good, sizes = self.good_lines(text)
        return float(good @ sizes / sizes.sum()) if len(good) else -1.0

    def score(self, text: bytes | None) -> float:
        share = self.share(text or b"")
        return self.empty if share < 0 else 1 / (1 + exp(-(self.slope * share + self.offset)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Newton's method; the first column stands for the offset and is not held small."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fit_chain(x: list[np.ndarray], y: list[np.ndarray], node: np.ndarray, rounds: int = 200, ridge: float = 1e-3):
    """Maximises the conditional likelihood of the line labels; all sequences are stepped through together."""
    order = sorted(range(len(x)), key=lambda k: -len(x[k]))
    x, y = [x[k] for k in order], [y[k] for k in order]
    n = np.array([len(v) for v in x])
    longest, total = int(n[0]), int(n.sum())
    alive = [int((n > t).sum()) for t in range(longest)]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = [starts[:alive[t]] + t for t in range(longest)]
    flat, gold = np.vstack(x), np.concatenate(y)
    inner = np.ones(total, dtype=bool)
    inner[starts] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    edge = np.zeros((2, 2))
    params = np.concatenate([node, edge.ravel()])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        node, m = params[:-4], np.exp(params[-4:].reshape(2, 2))
        odds = np.exp(np.clip(flat @ node, -25, 25))
        ahead, back = np.empty(total), np.full(total, 0.5)
        for t in range(longest):
            o = odds[at[t]]
            if t:
                p = ahead[at[t] - 1]
                o = o * ((1 - p) * m[0, 1] + p * m[1, 1]) / ((1 - p) * m[0, 0] + p * m[1, 0])
            ahead[at[t]] = o / (1 + o)
        pair = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            k = at[t]
            good, bad, p = odds[k] * back[k], 1 - back[k], ahead[k - 1]
            cells = np.array([[(1 - p) * m[0, 0] * bad, (1 - p) * m[0, 1] * good], [p * m[1, 0] * bad, p * m[1, 1] * good]])
            pair += (cells / cells.sum(axis=(0, 1))).sum(axis=2)
            up, down = m[1, 0] * bad + m[1, 1] * good, m[0, 0] * bad + m[0, 1] * good
            back[k - 1] = up / (up + down)
        good = ahead * back / (ahead * back + (1 - ahead) * (1 - back))
        slope = np.concatenate([flat.T @ (gold - good), (seen - pair).ravel()]) / total - ridge * params
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        params = params + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def _stretches(sequences: list[np.ndarray]) -> list[np.ndarray]:
    return [v[k:k + STRETCH] for v in sequences for k in range(0, len(v), STRETCH)]


def fit_model(samples: list[tuple[bytes, int]]) -> Model:
    """Fits on (text, quality) pairs.

    A line first takes its document's label. Lines of bad documents that a plain line classifier finds good are then
    relabelled, so that the chain learns where bad stretches begin and end. Every line is learnt from; the chain of a
    document of more than STRETCH lines is cut there, which leaves out one transition in STRETCH and no neighbour features.
    """
    width = 3 * OWN
    if len({label for _, label in samples}) < 2:
        sure = 4.0 if samples and samples[0][1] else -4.0 if samples else 0.0
        return Model(np.zeros(width), np.zeros(width), np.zeros((2, 2)), 0.0, sure, 1 / (1 + exp(-sure)))
    x, y, kept = [], [], []
    for text, label in samples:
        own = with_neighbours(line_features(text)[0])
        if len(own):
            x.append(own)
            y.append(np.full(len(own), label))
            kept.append((text, label))
    base = np.mean([label for _, label in samples])
    if len({label for _, label in kept}) < 2:
        return Model(np.zeros(width), np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(base / (1 - base))), float(base))
    flat = np.vstack(x)
    plain = _logistic(flat, np.concatenate(y), 1.0)
    for k, lines in enumerate(x):
        if not y[k][0]:
            doubt = lines @ plain
            y[k] = ((doubt > 0) & (doubt > doubt.min())).astype(int)
    node, edge = _fit_chain(_stretches(x), _stretches(y), plain)
    model = Model(np.zeros(width), node, edge)
    shares = np.array([[1.0, model.share(text)] for text, _ in kept])
    labels = np.array([label for _, label in kept])
    model.offset, model.slope = _logistic(shares, labels, 1e-2).tolist()
    empty = [label for text, label in samples if not text.split()]
    model.empty = (sum(empty) + base) / (len(empty) + 1)
    return model


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    fit_documents: int = FIT_DOCUMENTS, folds: int = FOLDS, fold: int = HELD_OUT, fit_bytes: int = FIT_BYTES,
) -> Model:
    """Fits the model on at most ``fit_documents`` labelled documents whose fold is learnt, with whole texts.

    They are the ones whose ids hash lowest, so the choice follows neither order nor partitions, and of them those whose
    texts together stay within ``fit_bytes``; a text that is longer alone is never learnt. Null labels and ids are left
    out; a repeated id contributes one row per distinct label and text.
    """
    known = labels.select(quoted(doc_id).alias("doc_id"), quoted(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_documents)
    texts = documents.select(quoted(doc_id).alias("doc_id"), utf8(text).alias("text")).where("text is not null")
    # At most fit_documents ids, so the broadcast is bounded
    found = texts.where(F.octet_length("text") <= fit_bytes).join(F.broadcast(chosen), "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("text"), F.col("label")]
    # The window is over fit_documents rows at most
    found = found.orderBy(*order).limit(fit_documents).withColumn("so_far", F.sum(F.octet_length("text")).over(Window.orderBy(*order)))
    return fit_model([(bytes(r["text"]), r["label"]) for r in found.where(F.col("so_far") <= fit_bytes).orderBy("so_far", *order).collect()])


def score_column(model: Model, text: str = "text") -> Column:
    """The score of a text column, from 0 to 1; a null or blank text scores as such texts in the sample did."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (model.score(t) for p in range(0, len(texts), 512) for t in texts.slice(p, 512).to_pylist())
            yield pa.array(list(found), pa.float64())

    return score(utf8(text))


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
