"""Quality and toxicity: fits, held-out accuracy, defined results."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import quality as Q
from lumenframe.llm import toxicity as X

from .conftest import prose


def accuracy(spark, rows, label):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = rows.join(labels, "doc_id").filter("held_out").toPandas()
    return (m["predicted"] == m[label]).mean(), m[m[label] == 1]["predicted"].mean(), m[m["predicted"] == 1][label].mean()


def test_op1_held_out_accuracy(spark):
    rows = Q.op1_bradley_terry(spark, "/root/testdata/sf0.1").cache()
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and rows.count() == 10_000
    assert rows.filter("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(spark, rows, "quality")[0] > 0.97
    assert rows.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)).count() == 0


def test_op3_held_out_accuracy(spark):
    rows = X.op3_kneser_ney(spark, "/root/testdata/sf0.1").cache()
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and rows.count() == 10_000
    assert rows.filter("score < 0 or score > 1 or score is null").count() == 0
    right, recall, precision = accuracy(spark, rows, "toxic")
    assert right > 0.95 and recall > 0.75 and precision > 0.85


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, Q.WIDTH))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int)
    model = Q.learn(x, y)
    s = model.score(x)
    assert (s[y == 1].min() > s[y == 0].max() - 0.2) and ((s >= 0.5) == (y == 1)).mean() > 0.97
    assert model.weights[0] > model.weights[1] > abs(model.weights[5])


def plain_features(text):
    """The vector from its description, with lists and dictionaries."""
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "'\"()[]{}-", "|", "*#$%&@^~+=<>/\\_`"]
    data = (text or "").encode()
    out = [0.0] * (13 * 13 + 10)
    if not data:
        return out
    kind = [11 if b > 127 else next((k for k, g in enumerate(groups) if chr(b) in g), 12) for b in data]
    for a, b in zip(kind, kind[1:]):
        out[13 * a + b] += 1
    out = [math.sqrt(x / max(1, len(data) - 1)) for x in out]
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    if words:
        n, sizes = len(words), [len(w) for w in words]
        mean = sum(sizes) / n
        out[169:] = [math.log1p(len(data)), math.log1p(n), math.log1p(len(set(words))), len(set(words)) / n, mean / 10, math.sqrt(sum((x - mean) ** 2 for x in sizes) / n) / 10, math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), 1.0]
    return out


def test_features_and_scores_are_those_of_a_plain_version(spark, nasty):
    texts = [None, "", "a", "A. b!\n\nA. b!\x00\x7f", "é😀 x|y", "  \n", prose(4, 300), *(r["text"] for r in nasty.collect())]
    for t in texts:
        assert Q.features(t) == pytest.approx(plain_features(t), abs=1e-12)
    r = random.Random(2)
    model = Q.BradleyTerry(*[np.array([r.gauss(0, 1) for _ in range(Q.WIDTH)]) for _ in range(2)], np.array([1 + r.random() for _ in range(Q.WIDTH)]), 0.7)
    found = {(x["id"], round(x["score"], 9)) for x in Q.score_quality(nasty, model).collect()}
    for x in nasty.collect():
        raw = sum((v - m) / s * w for v, m, s, w in zip(plain_features(x["text"]), model.mean, model.scale, model.weights)) - 0.7
        assert any(i == x["doc_id"] and abs(s - 1 / (1 + math.exp(-raw))) < 1e-6 for i, s in found)


def test_bradley_terry_minimises_the_pairs_loss():
    """The gradient of the logistic loss of all drawn pairs, computed pair by pair, vanishes at the learned weights."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, Q.WIDTH)) * (np.arange(Q.WIDTH) < 4)
    y = (x[:, 0] + rng.standard_normal(60) > 0).astype(int)
    model = Q.learn(x, y, pairs=500, seed=5)
    z = (x - model.mean) / model.scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(5)
    pairs = list(zip(good[draw.permutation(500) % len(good)], bad[draw.permutation(500) % len(bad)]))
    for k in range(4):
        slope = sum(-(z[g][k] - z[b][k]) / (1 + math.exp(float((z[g] - z[b]) @ model.weights))) for g, b in pairs) / len(pairs) + 1e-3 * model.weights[k]
        assert abs(slope) < 1e-6


def test_features_take_any_text():
    for text in (None, "", " ", "a", "é😀", "x" * 3_000_000, prose(1, 50_000)):
        v = Q.features(text)
        assert v.shape == (Q.WIDTH,) and np.isfinite(v).all()
    assert not Q.features(None).any() and not Q.features("").any()


def corpus_of(texts, words):
    n = collections.Counter(w for t in texts for w in X.words_of(t))
    of = np.array([0.0, 0.0, *(n[w] for w in words)])
    of[X.UNKNOWN] = sum(n.values()) - of.sum()
    return X.CorpusCounts(of, sum(n.values()), len(n), sum(k == 1 for k in n.values()), sum(k == 2 for k in n.values()))


def pair_of(toxic, plain, ratio, more=()):
    words = X.vocabulary_of([*toxic, *plain])
    blank = X.KneserNeyPair(words, *[np.zeros(len(words) + 2)] * 2, np.zeros(0, np.int64), np.zeros(0))
    seen = [X.class_counts([blank.word_ids(t) for t in part], len(words) + 2) for part in (toxic, plain)]
    return X.learn_pair(words, seen, corpus_of([*toxic, *plain, *more], words), ratio)


def plain_discount(values):
    n = collections.Counter(values)
    if not all(n[k] for k in (1, 2, 3, 4)):
        return lambda c: [0, 0.5, 1.0, 1.5][min(c, 3)]
    y = n[1] / (n[1] + 2 * n[2])
    return lambda c: min(max(min(c, 3) - (min(c, 3) + 1) * y * n[min(c, 3) + 1] / n[min(c, 3)], 0.05), min(c, 3) - 0.05)


class PlainKneserNey:
    """Probabilities of one class straight from the definition, with dictionaries."""

    def __init__(self, texts, others, corpus, ratio):
        def bigrams(ts):
            seen = {(["<", "<", *X.words_of(t)][k], ["<", "<", *X.words_of(t)][k + 1], w) for t in ts for k, w in enumerate(X.words_of(t))}
            return collections.Counter((v, w) for _, v, w in seen)

        def mass(counts):
            out = collections.Counter()
            for (v, _), c in counts.items():
                out[v] += c
            return out

        n = collections.Counter(w for t in corpus for w in X.words_of(t))
        once, twice = (sum(k == m for k in n.values()) for m in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        self.known = {w for t in [*texts, *others] for w in X.words_of(t)}
        unknown = sum(k for w, k in n.items() if w not in self.known)
        self.shared = lambda w: max((n[w] if w in self.known else unknown) - d, 0) / sum(n.values()) + d * len(n) / sum(n.values()) / (len(n) + 1)
        own, theirs = bigrams(texts), bigrams(others)
        pooled = own + theirs
        types = collections.Counter(w for _, w in own)
        cut = plain_discount(types.values())
        total = sum(types.values())
        self.types = {w: t - cut(t) for w, t in types.items() if t * math.log((t - cut(t)) / total / self.shared(w)) >= ratio}
        self.total = total
        cut = plain_discount(pooled.values())
        self.pooled, self.pooled_mass = {k: c - cut(c) for k, c in pooled.items() if c > 1}, mass(pooled)
        own_cut, self.mass = plain_discount(own.values()), mass(own)
        self.own = {}
        for (v, w), c in own.items():
            if c * math.log((c - own_cut(c)) / self.mass[v] / self.below(v, w)) >= ratio:
                self.own[v, w] = c - own_cut(c)

    def word(self, w):
        return self.types.get(w, 0) / self.total + (1 - sum(self.types.values()) / self.total) * self.shared(w)

    def below(self, v, w):
        m = self.pooled_mass[v]
        if not m:
            return self.word(w)
        return self.pooled.get((v, w), 0) / m + (1 - sum(c for (a, _), c in self.pooled.items() if a == v) / m) * self.word(w)

    def __call__(self, v, w):
        m = self.mass[v]
        if not m:
            return self.below(v, w)
        return self.own.get((v, w), 0) / m + (1 - sum(c for (a, _), c in self.own.items() if a == v) / m) * self.below(v, w)


def test_kneser_ney_is_that_of_a_plain_version():
    r = random.Random(4)
    toxic = [" ".join(r.choice("abcdefghij") + r.choice(["", "", "x"]) for _ in range(30)) + " vile scum" * (k % 2) for k in range(12)]
    plain = [" ".join(r.choice("abcdefghij") + r.choice(["", "", "y"]) for _ in range(30)) for k in range(20)]
    more = ["only here", "a b vile", "c only"]
    for ratio in (0.5, 3.0, 12.0):
        model = pair_of(toxic, plain, ratio, more)
        bad, good = PlainKneserNey(toxic, plain, [*toxic, *plain, *more], ratio), PlainKneserNey(plain, toxic, [*toxic, *plain, *more], ratio)
        for small in (model, model.narrowed()):
            for text in (toxic[1], plain[3], "vile scum a b unheard of c", "zzz", "a", "e f g vile"):
                words = X.words_of(text)
                d = [math.log(bad(v, w) / good(v, w)) for v, w in zip(["<", *words], words)]
                whole, worst = small.evidence(text)
                assert whole == pytest.approx(sum(d) / len(d), abs=1e-9)
                n = min(2, len(d))
                assert worst == pytest.approx(max(sum(d[k : k + n]) for k in range(len(d) - n + 1)) / 2, abs=1e-9)


def test_kneser_ney_probabilities_sum_to_one():
    """Over the known words and what is left for unknown ones, in every context."""
    r = random.Random(9)
    toxic, plain = ([" ".join(r.choice("abcdefgh") for _ in range(25)) for _ in range(9)] for _ in range(2))
    for ratio in (0.5, 5.0):
        model = PlainKneserNey(toxic, plain, [*toxic, *plain], ratio)
        for v in ("<", b"a", b"e", b"never"):
            assert sum(model(v, w) for w in model.known) + (1 - sum(map(model.shared, model.known))) * 1.0 == pytest.approx(1, abs=0.05)
    d = X.discounts(np.array([1.0] * 40 + [2.0] * 15 + [3.0] * 7 + [4.0] * 4 + [9.0]))
    assert 0 < d[1] < 1 and 0 < d[2] < 2 and 0 < d[3] < 3


def test_toxic_expressions_weigh_and_rare_words_do_not():
    toxic = [prose(k, 30) + f" vile{'' if k % 2 else ' scum'} thing " + prose(k + 1, 20) for k in range(60)]
    plain = [prose(1_000 + k, 55) for k in range(60)]
    model = pair_of(toxic, plain, 12.0).narrowed()
    bad, good, rare = (model.evidence(t)[1] for t in (prose(7, 40) + " vile thing", prose(7, 40), prose(7, 40) + " unheard of"))
    assert bad > good + 0.5 and abs(rare - good) < 0.5
    assert model.evidence(None) == model.evidence("") == (0.0, 0.0) and np.isfinite(model.evidence("vile " * 200_000)).all()


def test_copies_count_once():
    words = X.vocabulary_of([prose(3, 40)])
    blank = X.KneserNeyPair(words, *[np.zeros(200)] * 2, np.zeros(0, np.int64), np.zeros(0))
    ids = blank.word_ids(prose(3, 40))
    assert all((a == b).all() for a, b in zip(X.class_counts([ids], 200), X.class_counts([ids] * 30, 200)))


def test_corpus_counts_are_those_of_all_documents(spark, nasty, no_documents):
    texts = [r["text"] for r in nasty.collect()]
    words = [b"alpha", b"none", b"one", b"same"]
    found, expected = X.corpus_counts(nasty, "text", words), corpus_of(texts, words)
    assert (found.of == expected.of).all() and (found.tokens, found.words, found.once, found.twice) == (expected.tokens, expected.words, expected.once, expected.twice)
    assert X.corpus_counts(no_documents, "text", words).tokens == 0


def test_the_fitting_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "word " * (40 if k % 10 else 5_000)) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, label int")
    y, texts, _ = X.fit_rows(docs, labels, "label", 4, 2, "doc_id", "text", 1_000, 16_000)
    assert {0, 1} == set(y.tolist()) and sum(map(len, texts)) <= 16_000 and max(map(len, texts)) == 200 and len(texts) > 20


@pytest.mark.parametrize("fit,score", [(Q.fit_quality, Q.score_quality), (X.fit_toxicity, X.score_toxicity)])
def test_defined_results(spark, clashing, no_documents, fit, score):
    none = spark.createDataFrame([], "doc_id long, label int")
    some = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (8, 0), (11, 1), (None, 1), (9, None), (0, 1), (777, 0), (10, 0), (6, 1), (-5, 0)], "doc_id long, label int")
    one = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, label int")
    for labels in (none, some, one):
        model = fit(clashing, labels, "label", 3, 1)
        rows = score(clashing, model).collect()
        assert len(rows) == clashing.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert score(no_documents, fit(no_documents, labels, "label", 3, 1)).count() == 0


def test_drop_toxic_keeps_columns(spark, clashing):
    model = X.KneserNeyPair([], np.zeros(2), np.zeros(2), np.zeros(0, np.int64), np.zeros(0))
    kept = X.drop_toxic(clashing, model, 0.3)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    model.curve = (50.0, 0.0, 0.0)
    assert X.drop_toxic(clashing, model, 0.3).count() == 0
