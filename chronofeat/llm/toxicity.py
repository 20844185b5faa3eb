"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of the words it contains (letters only, case folded, each once) and of
their first four and five letters, which inflected forms share; the document's is their noisy-or, 1 - prod(1 - p). Only documents have labels:
the weights are fitted by maximum likelihood of the bags, so they have to find
the sentences that explain a label, and scoring names those sentences.

Fitted on at most ``per_class`` labelled documents of each class, on features
that at least ``min_docs`` of the toxic ones contain. Every text is scored whole.

Null and empty texts have no sentence that offends: their score is the model's
probability of a sentence without words. Without labels of both classes every
score is that of an untrained model. Repeated rows are scored alike. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts, remainder

PER_CLASS = 1500
MIN_DOCS = 4
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str):
    """(start, end) of the sentences of a text."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def _parts(word: str) -> tuple[str, ...]:
    """The features of a word: itself and its first four and five letters, marked as stems."""
    return (word, word[:5] + "-", word[:4] + "-") if len(word) > 5 else \
        (word, word[:4] + "-") if len(word) > 4 else (word,)


class _WordWeights(dict):
    """Weight of each word met, the sum over its features; forgets all when too many."""

    def __init__(self, weights: dict, entries: int = 300_000):
        super().__init__()
        self.weights, self.entries = weights, entries

    def __missing__(self, word):
        if len(self) >= self.entries:
            self.clear()
        self[word] = got = sum(self.weights.get(f, 0.0) for f in _parts(word))
        return got


class Model:
    """Feature weights (never negative: words can only accuse) and bias of the sentence classifier."""

    def __init__(self, sample: list[tuple[str, int]], min_docs: int = MIN_DOCS,
                 sparsity: float = 0.0001, steps: int = 300):
        self.bias, self.weights = -6.0, {}
        labels = np.array([y for _, y in sample], np.float64)
        if len(set(labels.tolist())) < 2:
            return
        bags = [[set(_WORD.findall(s)) for s in _SENTENCE.findall(t.lower())] or [set()]
                for t, _ in sample]
        spread = Counter(f for bag, y in zip(bags, labels) if y
                         for f in {f for w in set().union(*bag) for f in _parts(w)})
        index = {f: i for i, f in enumerate(sorted(f for f, n in spread.items() if n >= min_docs))}
        known = {w: [index[f] for f in _parts(w) if f in index]
                 for w in set().union(*(s for bag in bags for s in bag))}
        feats, rows, owner = [], [], []
        for d, bag in enumerate(bags):
            for s in bag:
                for w in s:
                    feats += known[w]
                    rows += [len(owner)] * len(known[w])
                owner.append(d)
        feats, rows, owner = (np.array(x, np.int64) for x in (feats, rows, owner))
        weigh = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
        theta, bias = np.zeros(len(index)), self.bias
        m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
        for t in range(1, steps + 1):
            z = bias + np.bincount(rows, theta[feats], minlength=len(owner))
            p = 1.0 / (1.0 + np.exp(-z.clip(-30, 30)))
            clean = np.bincount(owner, -np.logaddexp(0, z), minlength=len(labels))  # log(1 - P)
            pull = np.where(labels > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)
            g = (weigh * pull)[owner] * p
            grad = np.r_[np.bincount(feats, g[rows], minlength=len(index)) + sparsity, g.sum()]
            grad[:-1][(theta == 0) & (grad[:-1] > 0)] = 0.0
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-10)
            theta, bias = np.maximum(0.0, theta - step[:-1]), bias - step[-1]
        theta[theta <= 0.05] = 0.0
        self.bias = float(bias) + self._shift(bias + np.bincount(
            rows, theta[feats], minlength=len(owner)), owner, labels, weigh)
        self.weights = {f: float(theta[i]) for f, i in index.items() if theta[i]}

    @staticmethod
    def _shift(z, owner, labels, weigh) -> float:
        """Middle of the bias shifts at which the threshold errs least on the sample's bags."""
        shifts, errors = np.linspace(-2.0, 4.0, 61), []
        for shift in shifts:
            clean = np.bincount(owner, -np.logaddexp(0, z + shift), minlength=len(labels))
            errors.append((weigh * ((-np.expm1(clean) >= THRESHOLD) != labels)).sum())
        best = np.flatnonzero(np.array(errors) <= min(errors) + 1e-9)
        return float(shifts[best[len(best) // 2]])

    def word_weights(self) -> _WordWeights:
        return _WordWeights(self.weights)

    def sentence_scores(self, text: str, word_weights: _WordWeights) -> list[float]:
        get, out = word_weights.__getitem__, []
        quiet = 1.0 / (1.0 + math.exp(-self.bias))
        for s in _SENTENCE.findall(text.lower()):
            z = sum(map(get, set(_WORD.findall(s))))
            out.append(1.0 / (1.0 + math.exp(-min(30.0, self.bias + z))) if z else quiet)
        return out or [quiet]


def noisy_or(probs: list[float]) -> float:
    return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for p in probs))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          per_class: int = PER_CLASS, min_docs: int = MIN_DOCS,
          offending: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: (key, score, offending).

    ``offending`` lists the sentences whose own probability is at least that
    threshold, as (start, end) in characters and their probability.
    """
    model = Model(labelled_texts(docs, labels, "toxic", per_class, key, text), min_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        m = shared.value
        word_weights = m.word_weights()
        for b in batches:
            total, found = [], []
            for t in b.column("t"):
                t = t.as_py()
                probs = m.sentence_scores(t, word_weights)
                total.append(noisy_or(probs))
                found.append([])
                if t and max(probs) >= offending:
                    found[-1] = [{"start": a, "end": e, "score": p}
                                 for (a, e), p in zip(sentences(t), probs) if p >= offending]
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), pa.array(total, pa.float64()), pa.array(found, kind)],
                names=["k", "score", "offending"])

    schema = rows.select("k", F.lit(0.0).alias("score"), F.lit(None).cast(
        "array<struct<start:int,end:int,score:double>>").alias("offending")).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    return remainder(F.col(key), 3) == 1
