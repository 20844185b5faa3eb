"""Learned category embeddings from co-occurrence counts.

Every category column gets vectors of its own width (``encode.embedding_width``
of its cardinality unless widths are given): the leading singular vectors of its
positive pointwise mutual information with the labels of the other columns,

    x(value, other) = max(0, ln(n(value, other) * n / (n(value) * n(other)))),

counted over the rows in which both columns are not NULL. One pass counts all
pairs of columns. The factorisation is a randomised subspace iteration on the
table of positive cells, all columns at once: a product is one join and one
aggregation of cells, vectors stay tables, and only a rank x rank matrix per
column (rank at most 60) comes to the driver. The starting signs are hashes, so
reruns agree but for the vectors' signs (and turns among equal singular values).
A column whose rank is at most its width plus ``oversample`` is factorised
exactly.

NULL and unseen labels, and labels without a positive cell, have zero vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .encode import cardinality, embedding_width

#: Vectors are broadcast up to this counted number (at 60 doubles each some 50 MB).
BROADCAST_VECTORS = 100_000
#: One 64-bit hash holds a cell's starting signs.
MAX_RANK = 60
_VALUE = ["column", "value"]
_OTHER = ["column", "context", "other"]


def cooccurrence(df: DataFrame, cols, contexts=None) -> DataFrame:
    """(column, value, context, other, n) for every column and other context column.

    A pair of columns is counted once and mirrored; counts are combined before
    the shuffle, so distinct pairs of labels cross the network.
    """
    cols, contexts = list(cols), list(contexts if contexts is not None else cols)
    every = list(dict.fromkeys(cols + contexts))
    wanted = {(a, b) for a in cols for b in contexts if a != b}
    pairs = [(a, b) for a, b in combinations(every, 2) if {(a, b), (b, a)} & wanted]
    if not pairs:
        raise ValueError("an embedding needs a second column to occur with")
    text = {c: F.col(f"`{c}`").cast("string") for c in every}
    cells = F.array(*[F.struct(F.lit(a).alias("column"), text[a].alias("value"),
                               F.lit(b).alias("context"), text[b].alias("other"))
                      for a, b in pairs])
    counts = reliable_checkpoint(
        df.select(F.inline(cells)).where("value is not null and other is not null")
        .groupBy("column", "value", "context", "other").agg(F.count(F.lit(1)).alias("n")))
    mirrored = counts.select(F.col("context").alias("column"), F.col("other").alias("value"),
                             F.col("column").alias("context"), F.col("value").alias("other"), "n")
    out = counts.unionByName(mirrored)
    return out.where(F.col("column").isin(cols) & F.col("context").isin(contexts))


def positive_information(counts: DataFrame) -> DataFrame:
    """(column, value, context, other, x): the cells whose mutual information is positive."""
    n = F.sum("n")
    of_value = counts.groupBy("column", "value", "context").agg(n.alias("n_value"))
    of_other = counts.groupBy(*_OTHER).agg(n.alias("n_other"))
    of_all = counts.groupBy("column", "context").agg(n.alias("n_all"))
    cells = (counts.join(of_value, ["column", "value", "context"]).join(of_other, _OTHER)
             .join(F.broadcast(of_all), ["column", "context"]))  # a row per pair of columns
    x = F.log(F.col("n").cast("double") * F.col("n_all")
              / (F.col("n_value").cast("double") * F.col("n_other")))
    return cells.select(*_VALUE, "context", "other", x.alias("x")).where("x > 0")


def _product(cells: DataFrame, vectors: DataFrame, on, by, rank: int) -> DataFrame:
    """(by, v): the sum of x * v over each row (or column) of the cells."""
    sums = [F.sum(F.col("x") * F.col("v")[d]).alias(f"s{d}") for d in range(rank)]
    return reliable_checkpoint(
        cells.join(_small(vectors), on).groupBy(*by).agg(*sums)
        .select(*by, F.array(*[f"s{d}" for d in range(rank)]).alias("v")))


def _small(vectors: DataFrame) -> DataFrame:
    return F.broadcast(vectors) if vectors.count() <= BROADCAST_VECTORS else vectors


def _gram(vectors: DataFrame, rank: int) -> dict[str, np.ndarray]:
    """V'V per column: a partial matrix per task, added up in Spark, rank * rank numbers each."""
    def run(parts):
        sums = {}
        for part in parts:
            for column, rows in part.groupby("column"):
                m = np.stack(rows["v"].to_numpy())
                sums[column] = sums.get(column, 0.0) + m.T @ m
        for column, g in sums.items():
            yield pd.DataFrame({"column": column, "d": np.arange(g.size), "g": g.ravel()})

    out = {}
    for r in (vectors.select("column", "v").mapInPandas(run, "column string, d int, g double")
              .groupBy("column", "d").agg(F.sum("g").alias("g")).collect()):
        out.setdefault(r["column"], np.zeros(rank * rank))[r["d"]] = r["g"]
    return {column: g.reshape(rank, rank) for column, g in out.items()}


def _spectrum(g: np.ndarray):
    """Eigenvalues from the largest down, rounding residue as zero, and their vectors."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    return np.where(values > 1e-12 * max(values[0], 0.0), values, 0.0), vectors


def _power(values: np.ndarray, p: float) -> np.ndarray:
    return np.where(values > 0, np.where(values > 0, values, 1.0) ** p, 0.0)


def _turned(vectors: DataFrame, turns: dict[str, np.ndarray]) -> DataFrame:
    """Every vector times its column's matrix."""
    def run(parts):
        for part in parts:
            part["v"] = [v @ turns[c] for c, v in zip(part["column"], part["v"])]
            yield part

    return vectors.mapInPandas(run, vectors.schema)


def _orthonormal(vectors: DataFrame, rank: int) -> DataFrame:
    turns = {}
    for column, g in _gram(vectors, rank).items():
        values, w = _spectrum(g)
        turns[column] = w * _power(values, -0.5)
    return reliable_checkpoint(_turned(vectors, turns))


@dataclass
class CategoryEmbedding:
    """Vectors of labels and of their contexts, widths and singular values by column."""

    left: DataFrame     # (column, value, v), v of the column's width
    right: DataFrame    # (column, context, other, v)
    widths: dict
    singular: dict      # the leading singular values, from the largest down

    def transform(self, df: DataFrame, suffix: str = "_emb") -> DataFrame:
        """``df`` plus an array<double> column per embedded column, one equi-join each."""
        out = df
        for c, width in self.widths.items():
            side = self.left.where(F.col("column") == c).select(
                F.col("value").alias(f"__value_{c}"), F.col("v").alias(c + suffix))
            out = out.join(_small(side), F.col(f"`{c}`").cast("string")
                           == F.col(f"`__value_{c}`"), "left").drop(f"__value_{c}")
            zero = F.array_repeat(F.lit(0.0), width)
            out = out.withColumn(c + suffix, F.coalesce(F.col(f"`{c}{suffix}`"), zero))
        return out

    def features(self, df: DataFrame, continuous=(), out: str = "features") -> DataFrame:
        """``df`` plus one array: all embeddings in order, then the continuous columns."""
        parts = [F.col(f"`{c}__vector`") for c in self.widths]
        if continuous:
            parts.append(F.array(*[F.col(f"`{c}`").cast("double") for c in continuous]))
        done = self.transform(df, "__vector").withColumn(out, F.concat(*parts))
        return done.drop(*[c + "__vector" for c in self.widths])

    def reconstruct(self, cells: DataFrame) -> DataFrame:
        """``cells`` (column, value, context, other) plus ``x``: the product of their vectors."""
        dot = F.aggregate(F.zip_with("v", "__w", lambda a, b: a * b), F.lit(0.0),
                          lambda s, a: s + a)
        return (cells.select(*_VALUE, "context", "other").join(_small(self.left), _VALUE)
                .join(_small(self.right.withColumnRenamed("v", "__w")), _OTHER)
                .select(*_VALUE, "context", "other", dot.alias("x")))


def fit_category_embedding(df: DataFrame, cols, contexts=None, widths: dict | None = None,
                           power: int = 2, oversample: int = 8, share: float = 0.5,
                           seed: int = 7) -> CategoryEmbedding:
    """Embed every column of ``cols`` by what it occurs with in ``contexts`` (default: ``cols``).

    Labels get ``U * S**share`` and contexts ``V * S**(1 - share)``, so their
    products give the cells back, exactly where the width covers the rank.
    ``power`` steps sharpen the subspace; the vectors' signs are arbitrary.
    """
    if widths is None:
        table = embedding_width(cardinality(df, cols))  # a row per column
        widths = {r["column"]: r["width"] for r in table.collect()}
    widths = {c: widths.get(c, 1) for c in cols}
    rank = max(widths.values()) + oversample
    if rank > MAX_RANK:
        raise ValueError(f"width plus oversample is {rank}, at most {MAX_RANK}")
    cells = reliable_checkpoint(positive_information(cooccurrence(df, cols, contexts)))
    hashed = F.xxhash64("context", "other", F.lit(seed))
    signs = F.array(*[(F.shiftright(hashed, d).bitwiseAND(F.lit(1)) * 2 - 1).cast("double")
                      for d in range(rank)])
    start = reliable_checkpoint(cells.select(*_OTHER).distinct().select(*_OTHER, signs.alias("v")))
    left = _orthonormal(_product(cells, start, _OTHER, _VALUE, rank), rank)
    for _ in range(power):
        right = _orthonormal(_product(cells, left, _VALUE, _OTHER, rank), rank)
        left = _orthonormal(_product(cells, right, _OTHER, _VALUE, rank), rank)
    right = _product(cells, left, _VALUE, _OTHER, rank)
    turn_left, turn_right, singular = {}, {}, {}
    for column, g in _gram(right, rank).items():
        values, w = _spectrum(g)
        width = widths[column]
        turn_left[column] = (w * _power(values, share / 2))[:, :width]
        turn_right[column] = (w * _power(values, -share / 2))[:, :width]
        singular[column] = np.sqrt(values[:width]).tolist()
    return CategoryEmbedding(reliable_checkpoint(_turned(left, turn_left)),
                             reliable_checkpoint(_turned(right, turn_right)), widths,
                             {c: singular.get(c, [0.0] * w) for c, w in widths.items()})
