"""Label distribution and balanced class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

BROADCAST_CLASSES = 10_000


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n): rows per label value."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str, by: str | None = None,
                  count_col: str | None = None) -> DataFrame:
    """(label, n, weight) with ``weight = total / (classes * n)`` ("balanced").

    ``df`` holds rows, or already-aggregated counts in ``count_col``. The
    grouped table has one row per class (per ``by`` group), so the window for
    the grand total runs over a handful of rows. NULL labels are ignored.
    """
    keys = [by, label] if by else [label]
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(n.cast("long").alias("n"))
    w = Window.partitionBy(*([by] if by else []))
    total = F.sum("n").over(w)
    classes = F.count(F.lit(1)).over(w)
    return counts.withColumn("weight", total.cast("double") / (classes * F.col("n")).cast("double"))


def with_weight(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """``df`` plus the weight of its label (NULL without one), by an equi-join.

    The weight table has one row per class; it is broadcast if its counted size
    is at most ``BROADCAST_CLASSES``, and joined by a shuffle beyond that.
    """
    table = reliable_checkpoint(weights.select(F.col(label).alias("_label"),
                                               F.col("weight").cast("double").alias(out)))
    side = F.broadcast(table) if table.count() <= BROADCAST_CLASSES else table
    return df.drop(out).join(side, F.col(label) == F.col("_label"), "left").select(
        *[c for c in df.columns if c != out], out)
