"""Toxicity by multiple-instance learning: only documents are labelled, sentences are judged.

A sentence's chance to offend is a logistic function of the weights of its distinct words and their beginnings; a document's is the noisy-or of its
distinct sentences', 1 - prod(1 - p). Weights and bias are trained from document labels alone, by gradient descent through the noisy-or until the loss settles, on a
bounded sample of labelled rows, whole texts of them. Features that occur evenly in documents of both labels are left out beforehand (a log-likelihood ratio below ``telling``).
Afterwards the sentences with a chance of at least one half are the offending ones.

However many harmless sentences a text has, they don't add up: equal sentences count once, and of the sentences whose chance is below ``FLOOR`` only the likeliest counts. Training
ends with this same noisy-or, after a start with all sentences. So another sentence never lowers a score. Where a text is toxic without a sentence that offends by itself, its likeliest sentence is named.

Defined results: null and empty texts have no sentences, so their score is 0 and no sentence offends. Without labelled rows, or
with labels of one kind only, the model is that share of labels: its score, for any text with words, is that of its prior. Rows of
equal id are scored each on their own. A label that is null is no label. Only the named columns are read; an input column called ``toxicity`` is replaced by the result.
A score of exactly ``limit`` counts as toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that count as features; every word with a telling feature is found by its first few letters.
STEMS = (3, 4, 5, 6)
#: Sentences of a lower chance don't add up. Chosen by cross-validation on learning rows.
FLOOR = 0.2
RESULT = "score double, predicted int, sentences int, offending array<int>"


@dataclass(frozen=True)
class Model:
    """One weight for each telling feature, and the bias."""

    weights: dict[str, float]
    bias: float


def sentences(text: str | None) -> list[str]:
    """Stretches between sentence ends that hold a word, trimmed, in order."""
    return [s.strip() for s in SENTENCE_END.split((text or "").lower()) if WORD.search(s)]


def features(word: str) -> tuple[str, ...]:
    """A word itself and, marked, its beginnings."""
    return word, *("^" + word[:n] for n in STEMS if len(word) > n)


def telling_features(texts: list[str], y: np.ndarray, telling: float, least: int) -> list[str]:
    """Features of at least ``least`` documents whose counts in documents of either label are too uneven for chance, in order of the alphabet."""
    held = [Counter(), Counter()]
    for text, label in zip(texts, y, strict=True):
        held[int(label)].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    ones, all_ = float(y.sum()), float(len(y))
    part = lambda seen, expected: 2 * seen * math.log(seen / expected) if seen else 0.0

    def ratio(a: int, b: int) -> float:
        share = (a + b) / all_
        return part(a, share * ones) + part(b, share * (all_ - ones)) + part(ones - a, (1 - share) * ones) + part(all_ - ones - b, (1 - share) * (all_ - ones))

    return sorted(f for f in set(held[0]) | set(held[1]) if held[0][f] + held[1][f] >= least and ratio(held[1][f], held[0][f]) >= telling)


@dataclass(frozen=True)
class Bags:
    """Documents as bags of distinct sentences: entry i says that sentence ``sentence[i]`` has ``feature[i]``; ``doc`` has the document of each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    docs: int

    def chances(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = bias + np.bincount(self.sentence, weights[self.feature], len(self.doc))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def counting(self, p: np.ndarray, floor: float) -> np.ndarray:
        """Which sentences the noisy-or counts: those whose chance reaches the floor, and each document's likeliest (the first of equal ones)."""
        order = np.lexsort((-p, self.doc))
        count = p >= floor
        count[order[np.flatnonzero(np.diff(self.doc[order], prepend=-1))]] = True
        return count


def bags(texts: list[str], number: dict[str, int]) -> Bags:
    feature, sentence, doc = [], [], []
    for d, text in enumerate(texts):
        for s in dict.fromkeys(sentences(text)):
            found = {number[f] for w in set(WORD.findall(s)) for f in features(w) if f in number}
            feature += found
            sentence += [len(doc)] * len(found)
            doc.append(d)
    return Bags(*(np.array(x, np.int64) for x in (feature, sentence, doc)), len(texts))


def loss_and_slopes(b: Bags, y: np.ndarray, weights: np.ndarray, bias: float, decay: float, heavier: float, floor: float = 0.0) -> tuple[float, np.ndarray, float]:
    """The noisy-or's log loss, toxic documents counting ``heavier`` times, with a penalty on the weights; its slopes by weight and by bias."""
    p = b.chances(weights, bias)
    p = np.where(b.counting(p, floor), p, 0.0) if floor else p
    none = np.exp(np.clip(np.bincount(b.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), b.docs), -60, 0))
    some = np.maximum(1 - none, 1e-9)
    loss = -(heavier * y * np.log(some) + (1 - y) * np.log(none)).sum() + decay * b.docs * (weights**2).sum() / 2
    step = p * ((1 - y) - heavier * y * none / some)[b.doc]
    return float(loss), np.bincount(b.feature, step[b.sentence], len(weights)) + decay * b.docs * weights, float(step.sum())


def train(texts: list[str], labels: list[int], telling: float = 8.0, least: int = 3, rounds: int = 1000, rate: float = 0.5, decay: float = 5e-5, settled: float = 1e-3) -> Model:
    """Full-batch AdaGrad, until 30 rounds lower the loss by less than the share ``settled``: with all sentences first, then with those that count."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, -20.0 if not len(y) or not y.max() else 20.0)
    names = telling_features(texts, y, telling, least)
    b = bags(texts, {f: i for i, f in enumerate(names)})
    share = y.mean()
    bias = -math.log(1 / (1 - (1 - share) ** (len(y) / max(1, len(b.doc)))) - 1)  # so that the noisy-or of a mean document is the share
    weights = np.zeros(len(names))
    for floor in (0.0, FLOOR):
        seen, seen_bias, losses = np.full(len(names), 1e-8), 1e-8, []
        for _ in range(rounds):
            loss, slope, slope_bias = loss_and_slopes(b, y, weights, bias, decay, max(1.0, (1 / share - 1) ** 0.5), floor)
            losses.append(loss)
            if len(losses) > 50 and losses[-31] - loss < settled * abs(loss):
                break
            seen, seen_bias = seen + slope**2, seen_bias + slope_bias**2
            weights = weights - rate * slope / np.sqrt(seen)
            bias -= rate * slope_bias / seen_bias**0.5
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, float(bias))


def pick(labels: DataFrame, label: str, order: Column, sample_rows: int = 6000) -> DataFrame:
    """At most ``sample_rows`` rows of ``labels``, half of each label where there are as many, the first by ``order``."""
    halves = [labels.where(F.col(label).cast("int") == y).orderBy(order).limit(sample_rows // 2) for y in (0, 1)]
    return halves[0].unionAll(halves[1])


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", order_by: Column | None = None, sample_rows: int = 6000, **settings) -> Model:
    """Train on at most ``sample_rows`` rows, half of each label where there are as many, the first by ``order_by`` (a hash of the text unless given). So the driver
    holds as many texts, whole ones."""
    order = F.xxhash64(F.col(text)) if order_by is None else order_by
    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), order.alias("o")).where(F.col("t").isNotNull())
    picked = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("o", "t").limit(sample_rows // 2).collect()]
    return train([r["t"] for r in picked], [r["y"] for r in picked], **settings)


class Scorer:
    """Sentence and document scores. Most words have no telling feature, which their first letters show."""

    def __init__(self, model: Model) -> None:
        self.model, self.neutral = model, 1 / (1 + math.exp(-model.bias))
        self.words = {f for f in model.weights if f[0] != "^"}
        self.fronts = {f[1 : 1 + STEMS[0]] for f in model.weights if f[0] == "^"}

    def chance(self, words: set[str]) -> float:
        found = {f for w in words for f in features(w)}
        z = self.model.bias + sum(self.model.weights.get(f, 0.0) for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __call__(self, text: str | None, limit: float) -> tuple[float, int, int, list[int]]:
        found = sentences(text)
        if not found:
            return 0.0, int(limit <= 0), 0, []
        n, known = STEMS[0], self.fronts
        hot = {w for w in set(WORD.findall(text.lower())) if w[:n] in known or w in self.words}
        chances = {}
        if hot:
            for s in set(found):
                own = hot.intersection(WORD.findall(s))
                chances[s] = self.chance(own) if own else self.neutral
        else:
            chances[found[0]] = self.neutral
        clean, below, offending = 1.0, 0.0, []
        for p in sorted(chances.values()):  # in order, so that the same sentences have the same score
            if p < FLOOR:
                below = p
            else:
                clean *= 1 - p
        if hot or self.neutral >= 0.5:
            offending = [k for k, s in enumerate(found) if chances.get(s, self.neutral) >= 0.5]
        score = min(1.0, max(0.0, 1 - clean * (1 - below)))
        if score >= limit and not offending:
            offending = [max(range(len(found)), key=lambda k: chances.get(found[k], self.neutral))]
        return score, int(score >= limit), len(found), offending


def score(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` with one struct column ``toxicity``: score, predicted, how many sentences, and the offending ones by number."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Scorer(Model(*shared.value))
        for texts in batches:
            yield pd.DataFrame([judge(t, limit) for t in texts], columns=["score", "predicted", "sentences", "offending"])

    return docs.withColumn("toxicity", scored(F.col(text)))
