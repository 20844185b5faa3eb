"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its lower-cased words and its runs of three lower-cased bytes,
both hashed, and its style: the pairs of adjacent character classes it contains
(lower and upper case letters, digits, white space, each punctuation mark, other
letters) and terms that count repetition (words equal to one of the words just
before, words and lines seen before). The labelled sample's log term rates,
weighted by inverse document frequency, normalised by kind of term (style weighs
as much as words and runs together) and joined, are reduced to ``rank`` dimensions
by a singular value decomposition. The labelled vectors (at most 2 *
``per_class``, the only thing broadcast) are compared with every document in
blocks of exact cosine products; the ``neighbours`` nearest vote with their
similarity as weight.

Only texts enter a score, and only labelled rows outside the held-out fold teach.
Null and empty texts, and texts without a neighbour of positive similarity, get
the share of label 1 among the labelled rows outside that fold (0.5 without any).
Ties: of equally near vectors the first of the sorted sample count. Repeated rows
are scored alike. Very long texts are scored whole, in stretches. An empty table
gives no rows. Other columns are ignored by ``score`` and kept by ``keep_good``,
whatever their names.
"""

from __future__ import annotations

import operator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts, remainder

PER_CLASS = 1500
RANK = 48
NEIGHBOURS = 15
BLOCK = 512
_PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Class of each byte: 0 space, 1 line end, 2 digit, 3 lower, 4 upper, 5 other letter, then marks."""
    out = np.zeros(256, np.int64)
    out[10], out[13] = 1, 1
    out[48:58], out[97:123], out[65:91], out[128:] = 2, 3, 4, 5
    marks = [b for b in range(33, 127) if not out[b]]
    out[marks] = np.arange(6, 6 + len(marks))
    return out


CLASS = _classes()
N_CLASS = int(CLASS.max()) + 1
STYLE = N_CLASS * N_CLASS + 6
HASHED = 2048
#: Kinds of terms, words, runs of bytes and style: their columns and weights.
KINDS = ((slice(0, HASHED), 0.5), (slice(HASHED, 2 * HASHED), 0.5),
         (slice(2 * HASHED, 2 * HASHED + STYLE), 1.0))
TERMS = 2 * HASHED + STYLE


def term_counts(text: bytes) -> np.ndarray:
    """Counts of the terms of one UTF-8 text."""
    out = np.zeros(TERMS, np.float32)
    by_word, by_run, style = (out[k] for k, _ in KINDS)
    low = text.lower()
    raw, small = np.frombuffer(text, np.uint8), np.frombuffer(low, np.uint8)
    for at in range(0, len(raw) - 1, _PIECE):
        c = CLASS[raw[at:at + _PIECE + 1]]
        style[:N_CLASS * N_CLASS] += np.bincount(c[:-1] * N_CLASS + c[1:],
                                                 minlength=N_CLASS * N_CLASS)
        x = small[at:at + _PIECE + 2].astype(np.uint32)
        run = (x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(0x9E3779B1) >> np.uint32(16)
        by_run += np.bincount(run % HASHED, minlength=HASHED)
    words = text.split()
    known = np.fromiter((crc32(w) for w in low.split()), np.int64, len(words))
    by_word += np.bincount(known % HASHED, minlength=HASHED)
    for i, back in enumerate((1, 2, 3)):
        style[N_CLASS * N_CLASS + i] = sum(map(operator.eq, words, words[back:]))
    style[-3] = len(words) - len(set(words))
    lines = text.splitlines()
    style[-2] = len(lines) - len(set(lines))
    style[-1] = len(words)
    return out


class Space:
    """The latent space of a labelled sample and its vectors."""

    def __init__(self, sample: list[tuple[bytes, int]], rank: int = RANK):
        counts = np.array([term_counts(t) for t, _ in sample], np.float32).reshape(-1, TERMS)
        self.labels = np.array([y for _, y in sample], np.float32)
        seen = (counts > 0).sum(axis=0)
        self.idf = (np.log((1 + len(sample)) / (1 + seen)) + 1.0).astype(np.float32)
        x = self._weigh(counts)
        self.basis = _leading(x, rank)
        self.known = self._unit(x @ self.basis)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        """Log rates per thousand words times idf, each kind of terms of its weight's length."""
        out = np.log1p(counts * (1000.0 / np.maximum(1.0, counts[:, -1:]))) * self.idf
        for k, weight in KINDS:
            out[:, k] = self._unit(out[:, k]) * np.float32(weight)
        return self._unit(out)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))

    def scores(self, counts: np.ndarray, neighbours: int, default: float) -> np.ndarray:
        """Similarity-weighted vote of the nearest labelled vectors for a block of documents."""
        if not len(self.labels):
            return np.full(len(counts), default)
        cosine = self._unit(self._weigh(counts) @ self.basis) @ self.known.T
        k = min(neighbours, cosine.shape[1])
        near = _nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-6, vote, default).clip(0.0, 1.0)


def _leading(x: np.ndarray, rank: int, more: int = 16, passes: int = 4) -> np.ndarray:
    """The leading right singular vectors of ``x``, by a randomised range finder."""
    rank = min(rank, *x.shape)
    draws = np.random.default_rng(1).standard_normal((x.shape[1], rank + more))
    q = x @ draws.astype(np.float32)
    for _ in range(passes):
        q = x @ (x.T @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row; of equal values the first columns."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    for i in np.flatnonzero((cosine >= least).sum(axis=1) > k):
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    return near


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        per_class: int = PER_CLASS, rank: int = RANK) -> Space:
    sample = labelled_texts(docs, labels, "quality", per_class, key, text)
    return Space([(t.encode("utf-8", "surrogatepass"), y) for t, y in sample], rank)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          per_class: int = PER_CLASS, rank: int = RANK, neighbours: int = NEIGHBOURS,
          keep: list[str] | None = None) -> DataFrame:
    """(key, score) of each row; with ``keep`` those columns of the rows of score 0.5 or more."""
    space = fit(docs, labels, key, text, per_class, rank)
    known = labels.where(F.col("quality").isin(0, 1) & F.col(f"`{key}`").isNotNull()
                         & (remainder(F.col(f"`{key}`"), 3) != 1)).agg(F.avg("quality")).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast((space, 0.5 if known is None else float(known)))
    cols, made = ([key], "score") if keep is None else (keep, None)
    # the kept columns travel under plain numbers, so no name can clash
    names = docs.columns
    numbered = docs.toDF(*[f"n{i}" for i in range(len(names))])
    rows = numbered.select(
        *[F.col(f"n{names.index(c)}").alias(f"c{i}") for i, c in enumerate(cols)],
        F.coalesce(F.col(f"n{names.index(text)}"), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        model, default = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for at in range(0, b.num_rows, BLOCK):
                texts = [x.as_py() for x in b.column("t")[at:at + BLOCK]]
                got = model.scores(np.array([term_counts(x) for x in texts]), neighbours, default)
                out[at:at + BLOCK] = [s if x.strip() else default for s, x in zip(got, texts)]
            yield pa.RecordBatch.from_arrays([*[b.column(f"c{i}") for i in range(len(cols))],
                                              pa.array(out)],
                                             names=[*[f"c{i}" for i in range(len(cols))], "s"])

    schema = rows.drop("t").withColumn("s", F.lit(0.0)).schema
    done = rows.mapInArrow(run, schema)
    if keep is not None:
        return done.where("s >= 0.5").drop("s").toDF(*cols)
    return done.toDF(key, made)


def held_out(key: str = "doc_id"):
    return remainder(F.col(key), 3) == 1


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              **options) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, with all their columns."""
    return score(docs, labels, key, text, keep=docs.columns, **options)
