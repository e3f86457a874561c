"""Quality scores by Bradley-Terry ranking.

Each document has a feature vector; a linear score w.x is learned from preference pairs (a
good and a bad document) by the logistic loss of w.(x_good - x_bad). The threshold is the
quantile of the fitting rows' scores at the share of bad labels; the result is
sigmoid(score - threshold), so 0.5 is that quantile.

Defined results: null and empty texts have a zero vector and a score as any text; label rows
without id or label are left out; a document with several labels counts once for each; with
one class only, or none, every score is 1 (all good, or nothing known) or 0; texts of any
length are read whole; repeated rows are scored alike, each for itself; ties in the fitting
scores are ordered as the sample is, and the threshold lies half-way between its neighbours; an
empty table gives an empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, table

#: Bound on the fitting sample: so many labelled rows of each class, those with the smallest hashes; and so many preference pairs.
FIT_ROWS, PAIRS = 4_000, 16_000

#: Byte classes: lower, upper, digit, space, line end, stop, comma, exclamation, quote, bar, symbol, beyond ASCII, control.
CLASSES = 13
_CLASS = np.full(256, 12, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"()[]{}-", b"|", b"*#$%&@^~+=<>/\\_`")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[128:] = 11
EXTRA = 10
WIDTH = CLASSES * CLASSES + EXTRA
_SLICE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte-class pairs, and measures of length and repetition."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    for at in range(0, len(kinds) - 1, _SLICE):
        part = kinds[at : at + _SLICE + 1]
        pairs += np.bincount(part[:-1] * np.uint8(CLASSES) + part[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(kinds) - 1))
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n, k = len(words), CLASSES * CLASSES
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        distinct = len(set(words))
        out[k : k + 8] = np.log1p(len(data)), np.log1p(n), np.log1p(distinct), distinct / n, lengths.mean() / 10, lengths.std() / 10, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines))
        out[k + 8] = np.log1p(n / max(1, len(lines)))
        out[k + 9] = 1.0
    return out


def fit_split(ident: Column, folds: int, held: int) -> tuple[Column, Column]:
    """(row may be learned from, row is held out), by the CRC-32 of the id as text; a null id counts as empty text."""
    fold = F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds
    return fold != held, fold == held


def fit_sample(labels: DataFrame, ident: str, label: str, folds: int, held: int, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of at most so many rows of each class, chosen by hash among all that may be learned from; and the classes' full sizes."""
    known = labels.filter(F.col(ident).isNotNull() & F.col(label).isin(0, 1)).filter(fit_split(F.col(ident), folds, held)[0]).select(F.col(ident).alias("fit_id"), F.col(label).cast("int").alias("fit_label"))
    sizes = {r["fit_label"]: r["count"] for r in known.groupBy("fit_label").count().collect()}
    order = [F.xxhash64(F.lit(11), "fit_id"), F.col("fit_id")]
    parts = [known.filter(F.col("fit_label") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    return parts[0].unionAll(parts[1]), sizes


@dataclass
class BradleyTerry:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def learn(x: np.ndarray, y: np.ndarray, bad_share: float | None = None, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> BradleyTerry:
    """Newton's method on the pairs' logistic loss. bad_share: of label 0 in the whole population, if the sample has other shares."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), 1e3 if len(bad) else -1e3)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    n = min(pairs, 50 * max(len(good), len(bad)))
    d = z[good[rng.permutation(n) % len(good)]] - z[bad[rng.permutation(n) % len(bad)]]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / n + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    share = np.mean(y == 0) if bad_share is None else bad_share
    mass = np.where(y == 0, share / len(bad), (1 - share) / len(good))  # the sample's rows stand for the population
    order = np.argsort(raw, kind="stable")
    reached = np.searchsorted(np.cumsum(mass[order]), share)
    low, high = raw[order[min(reached, len(raw) - 1)]], raw[order[min(reached + 1, len(raw) - 1)]]
    return BradleyTerry(w, mean, scale, float(low + high) / 2)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, ident: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> BradleyTerry:
    sample, sizes = fit_sample(labels, ident, label, folds, held, rows)

    def vectors(batches):
        for batch in batches:
            x = [features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(0).cast(pa.int32()), "x": pa.array(x, pa.list_(pa.float64()))})

    # The sample has a proven bound, 2 * rows ids.
    found = docs.select(quoted(ident).alias("own_id"), quoted(text).alias("own_text")).join(F.broadcast(sample), F.col("own_id") == F.col("fit_id")).select("fit_label", "own_text").mapInArrow(vectors, "y int, x array<double>").toArrow()
    y = found.column("y").to_numpy()
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, WIDTH)
    order = np.lexsort([*x.T[:: max(1, WIDTH // 16)], y])  # rows come in any order; the fit shall not depend on it
    return learn(x[order], y[order], sizes.get(0, 0) / max(1, sum(sizes.values())))


def score_quality(docs: DataFrame, model: BradleyTerry, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def scores(batches):
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512).to_pylist()
                s = model.score(np.array([features(t) for t in part]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(s)], names=["id", "score"])

    return docs.select(quoted(ident).cast("long"), quoted(text)).mapInArrow(scores, "id long, score double")


def op1_bradley_terry(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), "quality", 3, 1)
    held = fit_split(F.col("id"), 3, 1)[1]
    return score_quality(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
