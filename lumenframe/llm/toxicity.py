"""Toxicity by two class-conditional Kneser-Ney bigram models.

A toxic and an ordinary model are counted from labelled rows. Each interpolates, with modified
Kneser-Ney discounts (three for each level, from counts of counts):

    bigrams of the class -> bigrams of both classes -> continuation counts of the class
    -> word counts of the whole corpus, which both share

Rare expressions weigh alike in both: a count of the class stays only if its log-likelihood
ratio against what lies below it reaches a threshold (relative-entropy pruning, as usual for
backoff models); pruned counts give their whole mass to the level below. Bigrams of both classes
that occur once are pruned too. The threshold is chosen by the loss of held-out thirds.

A text's evidence is the difference of the length-normalised log-likelihoods, over the whole
text and over its most toxic expression; a logistic curve, fitted on evidence from models that
haven't counted the text, maps both to a probability.

Bigrams are counted once for each distinct word before them, so that copies and repeated
passages aren't evidence.

Defined results: null and empty texts have no evidence, and so the curve's value at none; texts
of any length are read whole; repeated rows are scored alike, each for itself; equal scores are
equal decisions; label rows without id or label are left out; a document with several labels
counts for each; without labelled rows of both classes the score is 0 (nothing known to be
toxic) or 1 (all labelled rows are toxic); an empty table gives an empty table; other columns
don't matter, and stay as they are where rows are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored, table
from .packed import distinct, distinct_counts
from .quality import fit_sample, fit_split

#: Bounds on the fitting sample: so many labelled rows of each class, those with the smallest hashes, and so many bytes of their texts; longer rows than a sixteenth of that aren't fitted to.
FIT_ROWS, FIT_BYTES = 2_400, 32 << 20
#: Words of the shortest expression that can make a text toxic.
PASSAGE = 2
#: Least log-likelihood ratios of a kept count to choose from, and parts that are held out in turn.
RATIOS, PARTS = (12.0, 20.0, 40.0), 3
#: Ids of words outside the vocabulary and of a text's start.
UNKNOWN, START = 0, 1
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000

_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, cut at all ASCII characters that aren't letters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


@dataclass
class CorpusCounts:
    """Word counts over all documents: of the vocabulary's words, all tokens, distinct words, and words met once and twice."""

    of: np.ndarray
    tokens: int
    words: int
    once: int
    twice: int


@dataclass
class KneserNeyPair:
    """Log ratios toxic / ordinary: of a word by continuation, of a context's backoff weight, and of the bigrams that were seen."""

    vocabulary: list[bytes]
    word: np.ndarray
    context: np.ndarray
    bigrams: np.ndarray
    bigram: np.ndarray
    #: Logistic curve: bias, weight of the whole text, weight of the worst passage.
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)
    ids: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"ids": {}}

    def word_ids(self, text: str | None) -> np.ndarray:
        if not self.ids:
            self.ids.update({w: k + 2 for k, w in enumerate(self.vocabulary)})
        get, words = self.ids.get, words_of(text)
        return np.fromiter((get(w, UNKNOWN) for w in words), np.int64, len(words))

    def evidence_of(self, w: np.ndarray) -> tuple[float, float]:
        if not len(w):
            return 0.0, 0.0
        w = w.astype(np.int64, copy=False)
        v = np.empty_like(w)
        v[0], v[1:] = START, w[:-1]
        d = self.context[v] + self.word[w]
        if len(self.bigrams):
            keys = v * len(self.word) + w
            at = np.minimum(np.searchsorted(self.bigrams, keys), len(self.bigrams) - 1)
            seen = self.bigrams[at] == keys
            d[seen] = self.bigram[at[seen]]
        total = np.concatenate(([0.0], np.cumsum(d)))
        n = min(len(w), PASSAGE)
        return total[-1] / len(w), float((total[n:] - total[:-n]).max()) / PASSAGE

    def evidence(self, text: str | None) -> tuple[float, float]:
        return self.evidence_of(self.word_ids(text))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        b, whole, worst = self.curve
        return 1 / (1 + np.exp(-np.clip(b + evidence[:, 0] * whole + evidence[:, 1] * worst, -500, 500)))

    def narrowed(self) -> KneserNeyPair:
        """The same ratios with only the words that some kept count needs; all others are alike."""
        size = len(self.word)
        needed = np.zeros(size, bool)
        needed[self.word != self.word[UNKNOWN]] = True
        needed[self.context != self.context[UNKNOWN]] = True
        needed[self.bigrams // size] = True
        needed[self.bigrams % size] = True
        needed[[UNKNOWN, START]] = True
        new = np.cumsum(needed) - 1
        keys = new[self.bigrams // size] * int(needed.sum()) + new[self.bigrams % size]
        return KneserNeyPair([w for w, k in zip(self.vocabulary, needed[2:]) if k], self.word[needed], self.context[needed], keys, self.bigram, self.curve)


def vocabulary_of(texts: Iterable[str | None]) -> list[bytes]:
    return sorted({w for t in texts for w in words_of(t)})


def class_counts(texts: Iterable[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigram keys, ascending, and in how many distinct contexts of one word each occurs. So copies of a text count once."""
    keys = [np.zeros(0, np.int64)]
    for w in texts:
        if len(w):
            before = np.concatenate(([START, START], w))
            keys.append((before[:-2] * size + before[1:-1]) * size + w)
        if len(keys) > 512:
            keys = [distinct(np.concatenate(keys))]
    return distinct_counts(distinct(np.concatenate(keys)) % (size * size))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Of counts of 0, 1, 2 and of 3 or more: modified Kneser-Ney's, by how many counts are 1, 2, 3 and 4. Thin counts get 1/2, 1 and 3/2."""
    n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    if not all(n):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))])


def backoff(corpus: CorpusCounts) -> np.ndarray:
    """The shared distribution: discounted corpus counts, and the discounts' mass spread evenly over all words and one unseen."""
    if not corpus.tokens:
        return np.full(len(corpus.of), 1 / len(corpus.of))
    d = corpus.once / (corpus.once + 2 * corpus.twice) if corpus.once and corpus.twice else 0.5
    return np.maximum(corpus.of - d, 0) / corpus.tokens + d * corpus.words / corpus.tokens / (corpus.words + 1)


def kept_part(counts: np.ndarray, total: np.ndarray | float, below: np.ndarray, ratio: float) -> np.ndarray:
    """What the discounts leave of the counts; nothing of those whose log-likelihood ratio against ``below`` is too small."""
    left = counts - discounts(counts[counts > 0])[np.minimum(counts, 3)]
    own = np.maximum(left, 1e-300) / np.maximum(total, 1)
    return np.where((left > 0) & (counts * np.log(own / below) >= ratio), left, 0.0)


def learn_pair(vocabulary: list[bytes], seen: Sequence[tuple[np.ndarray, np.ndarray]], corpus: CorpusCounts, ratio: float) -> KneserNeyPair:
    """seen: class_counts() of the toxic and of the ordinary texts."""
    size = len(vocabulary) + 2
    shared, logs = backoff(corpus), []
    union = distinct(np.concatenate((seen[0][0], seen[1][0])))
    v, w = union // size, union % size
    own = np.zeros((2, len(union)), np.int32)
    for k, (keys, n) in enumerate(seen):
        own[k, np.searchsorted(union, keys)] = n
    pooled = own.sum(0, dtype=np.int32)
    pooled_left = np.where(pooled > 1, pooled - discounts(pooled)[np.minimum(pooled, 3)], 0.0)
    pooled_mass = np.bincount(v, pooled, size)
    pooled_weight = 1 - np.bincount(v, pooled_left, size) / np.maximum(pooled_mass, 1)
    told = pooled_left > 0  # bigrams with a count that stays on some level
    for counts in own:
        types = np.bincount(w[counts > 0], minlength=size)  # continuation: distinct words before
        total = max(1.0, types.sum())
        left = kept_part(types, total, shared, ratio)
        word = left / total + (1 - left.sum() / total) * shared
        below = pooled_left / np.maximum(pooled_mass[v], 1) + pooled_weight[v] * word[w]
        mass = np.bincount(v, counts, size)
        left = kept_part(counts, mass[v], below, ratio)
        told |= left > 0
        weight = 1 - np.bincount(v, left, size) / np.maximum(mass, 1)
        logs.append((np.log(word), np.log(weight), np.log(left / np.maximum(mass[v], 1) + weight[v] * below)))
    word, context, bigram = (a - b for a, b in zip(*logs))
    # A word's ratio is that of words outside the vocabulary if no class keeps its count; they differ by rounding only.
    word = np.where(np.abs(word - word[UNKNOWN]) < 1e-12, word[UNKNOWN], word)
    return KneserNeyPair(vocabulary, word, context, union[told], bigram[told])


def fit_curve(evidence: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton's method, lightly ridged."""
    scale = evidence.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([np.ones(len(y)), evidence / scale])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weights * (p - y)) + 0.05 * b
        hessian = (x * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(b[0]), float(b[1] / scale[0]), float(b[2] / scale[1])


def corpus_counts(docs: DataFrame, text: str, vocabulary: list[bytes]) -> CorpusCounts:
    """The table of all words of all documents with their counts is made and stored in Spark; the driver gets its totals and the rows of the vocabulary, which the fitting sample bounds."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words_of(t))
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    words = stored(docs.select(quoted(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens, distinct, once, twice = words.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    wanted = docs.sparkSession.createDataFrame(pa.table({"wanted": pa.array(vocabulary, pa.binary()), "id": pa.array(range(2, len(vocabulary) + 2), pa.int64())}))
    found = words.join(F.broadcast(wanted), F.col("word") == F.col("wanted")).select("id", "n").toArrow()
    of = np.zeros(len(vocabulary) + 2)
    of[found.column("id").to_numpy()] = found.column("n").to_numpy()
    of[UNKNOWN] = (tokens or 0) - of.sum()
    return CorpusCounts(of, tokens or 0, distinct, once, twice)


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, ident: str, text: str, rows: int, size: int) -> tuple[np.ndarray, list[str | None], dict[int, int]]:
    """Labels and texts of the fitting sample, in a defined order, and the classes' full sizes."""
    sample, sizes = fit_sample(labels, ident, label, folds, held, rows)
    own = docs.select(quoted(ident).alias("own_id"), quoted(text).alias("own_text")).join(F.broadcast(sample), F.col("own_id") == F.col("fit_id"))
    own = own.withColumn("size", F.coalesce(F.octet_length("own_text"), F.lit(0)) + 64).filter(F.col("size") <= size // 16)
    upto = Window.partitionBy("fit_label").orderBy(F.xxhash64(F.lit(11), "own_id"), "own_id", "own_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = own.withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= size // 2).select("own_id", "fit_label", "own_text").toArrow()
    found = found.sort_by([("own_id", "ascending"), ("fit_label", "ascending"), ("own_text", "ascending")])
    return found.column("fit_label").to_numpy(), found.column("own_text").to_pylist(), sizes


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, ident: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> KneserNeyPair:
    y, texts, sizes = fit_rows(docs, labels, label, folds, held, ident, text, rows, size)
    empty = KneserNeyPair([], np.zeros(2), np.zeros(2), np.zeros(0, np.int64), np.zeros(0))
    if len({*y.tolist()}) < 2:
        if len(y) and y.min() == 1:
            empty.curve = (50.0, 0.0, 0.0)
        return empty
    vocabulary = vocabulary_of(texts)
    width = len(vocabulary) + 2
    blank = KneserNeyPair(vocabulary, np.zeros(width), np.zeros(width), np.zeros(0, np.int64), np.zeros(0))
    corpus, ids = corpus_counts(docs, text, vocabulary), [blank.word_ids(t).astype(np.int32) for t in texts]
    del texts, blank
    # Copies of a text share its part, so that no text is held out from a model that has counted it.
    part = np.array([zlib.crc32(w.astype(np.int64).tobytes()) for w in ids]) % PARTS
    weights = np.array([sizes[k] / (y == k).sum() for k in (0, 1)])[y] * len(y) / sum(sizes.values())  # the sample's rows stand for all

    def counted(use: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [class_counts((ids[k] for k in np.flatnonzero(use & (y == c))), width) for c in (1, 0)]

    evidence = np.zeros((len(RATIOS), len(y), 2))
    for p in range(PARTS):
        seen = counted(part != p)
        for tried, ratio in zip(evidence, RATIOS):
            model = learn_pair(vocabulary, seen, corpus, ratio)
            for k in np.flatnonzero(part == p):
                tried[k] = model.evidence_of(ids[k])
    best, chosen, curve = np.inf, RATIOS[0], empty.curve
    for tried, ratio in zip(evidence, RATIOS):
        fitted = KneserNeyPair([], *[np.zeros(0)] * 4, fit_curve(tried, y, weights))
        p = np.clip(fitted.score(tried), 1e-6, 1 - 1e-6)
        loss = -(weights * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
        if loss < best:
            best, chosen, curve = loss, ratio, fitted.curve
    model = learn_pair(vocabulary, counted(np.ones(len(y), bool)), corpus, chosen).narrowed()
    model.curve = curve
    return model


def score_toxicity(docs: DataFrame, model: KneserNeyPair, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    def scores(batches):
        for batch in batches:
            e = np.array([shared.value.evidence(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(e))], names=["id", "score"])

    return docs.select(quoted(ident).cast("long"), quoted(text)).mapInArrow(scores, "id long, score double")


def drop_toxic(docs: DataFrame, model: KneserNeyPair, threshold: float, text: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            e = np.array([shared.value.evidence(t) for t in batch.column(at).to_pylist()]).reshape(-1, 2)
            yield batch.filter(pa.array(shared.value.score(e) < threshold))

    return docs.mapInArrow(keep, docs.schema)


#: Production threshold of the query and of the pipeline.
THRESHOLD = 0.3


def op3_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2)
    held = fit_split(F.col("id"), 4, 2)[1]
    return score_toxicity(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
