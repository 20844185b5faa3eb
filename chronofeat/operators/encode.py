"""Categorical indexing, cardinality and embedding widths.

Index order is frequency descending, ties by the label's string form
ascending, starting at 0 as a double; integer categories are indexed by their
string form. One pass counts every (column, value) pair for all columns; the
index stays a DataFrame (column, value, n, index) built with an ordered scan and
applied with one equi-join per column, so no label passes through the driver and
columns may have any number of them. :class:`CategoryIndex` holds a fitted index
and saves and loads it as Parquet. :func:`fit_string_indexer` is the stock
estimator, for comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .scan import ordered_scan

#: A column's labels are broadcast up to this counted number; beyond, its join shuffles.
BROADCAST_LABELS = 200_000


def melt_values(df: DataFrame, cols) -> DataFrame:
    """(column, value) rows, one per input cell; values as strings."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column, value, n): counts per distinct value of every column, one pass.

    Partial aggregation runs before the shuffle, so only distinct
    (column, value) pairs per input partition cross the network.
    """
    return melt_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def cardinality(df: DataFrame, cols, count_null: bool = True, approx: bool = False) -> DataFrame:
    """(column, cardinality) for every column; NULL counts as a value when ``count_null``.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``) with no
    shuffle of values at all.
    """
    if approx:
        aggs = []
        for c in cols:
            card = F.approx_count_distinct(c)
            if count_null:
                card = card + F.max(F.col(c).isNull().cast("int"))
            aggs.append(F.struct(F.lit(c).alias("column"), card.cast("long").alias("cardinality")))
        return df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))
    counts = value_counts(df, cols)
    if not count_null:
        counts = counts.where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))


def embedding_width(card: DataFrame, cap: int = 50, card_col: str = "cardinality",
                    out: str = "width") -> DataFrame:
    """``min(cap, (cardinality + 2) // 2)`` per row of a cardinality table."""
    return card.withColumn(out, F.least(F.lit(cap), F.floor((F.col(card_col) + 2) / 2)).cast("int"))


def index_from_counts(counts: DataFrame, scan_buckets: int | None = None) -> DataFrame:
    """(column, value, n, index) from (column, value, n); NULL values have no index."""
    order = [F.col("column"), -F.col("n"), F.col("value")]
    scanned = ordered_scan(counts.where(F.col("value").isNotNull()), order,
                           sums={"_before": F.lit(1)}, buckets=scan_buckets)
    firsts = scanned.groupBy("column").agg(F.min("_before").alias("_first"))
    # one row per input column: a proven broadcast bound
    return (scanned.join(F.broadcast(firsts), "column")
            .select("column", "value", "n",
                    (F.col("_before") - F.col("_first")).cast("double").alias("index")))


def index_table(df: DataFrame, cols, scan_buckets: int | None = None) -> DataFrame:
    """(column, value, n, index) with the StringIndexer order; restarts at 0 for every column."""
    return index_from_counts(reliable_checkpoint(value_counts(df, cols)), scan_buckets)


@dataclass
class CategoryIndex:
    """A fitted index: its table, the indexed columns and their label counts."""

    table: DataFrame          # (column, value, n, index), materialised
    cols: list
    sizes: dict               # labels per column
    suffix: str = "_cat"
    handle_invalid: str = "error"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus an index column per category, one equi-join each.

        NULL or unseen labels: ``error`` raises in the row, ``keep`` maps them
        to the column's label count, ``skip`` drops the row.
        """
        out = df
        for c in self.cols:
            value, index = f"_v_{c}", c + self.suffix
            side = self.table.where(F.col("column") == c).select(
                F.col("value").alias(value), F.col("index").alias(index))
            if self.sizes.get(c, 0) <= BROADCAST_LABELS:
                side = F.broadcast(side)
            out = out.join(side, F.col(c).cast("string") == F.col(value), "left").drop(value)
            if self.handle_invalid == "keep":
                out = out.withColumn(index, F.coalesce(index, F.lit(float(self.sizes.get(c, 0)))))
            elif self.handle_invalid == "error":
                wrong = F.raise_error(F.lit(f"NULL or unseen label in column {c}"))
                out = out.withColumn(index, F.when(F.col(index).isNull(), wrong)
                                     .otherwise(F.col(index)))
        if self.handle_invalid == "skip":
            out = out.na.drop(subset=[c + self.suffix for c in self.cols])
        return out

    def save(self, path: str) -> str:
        self.table.write.mode("overwrite").parquet(path)
        return path


def load_category_index(spark: SparkSession, path: str, cols, suffix: str = "_cat",
                        handle_invalid: str = "error") -> CategoryIndex:
    """An index saved by :meth:`CategoryIndex.save`."""
    return _held(spark.read.parquet(path), cols, suffix, handle_invalid)


def _held(table, cols, suffix, handle_invalid) -> CategoryIndex:
    # one row per column: bounded, safe to bring to the driver
    sizes = {r["column"]: r["k"] for r in
             table.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    return CategoryIndex(table, list(cols), sizes, suffix, handle_invalid)


def fit_category_index(df: DataFrame, cols, suffix: str = "_cat", handle_invalid: str = "error",
                       scan_buckets: int | None = None) -> CategoryIndex:
    """Fit the index of every column in one pass over ``df``."""
    return index_and_cardinality(df, cols, suffix, handle_invalid, scan_buckets)[0]


def index_and_cardinality(df: DataFrame, cols, suffix: str = "_cat",
                          handle_invalid: str = "error", scan_buckets: int | None = None):
    """``(index, cardinality)`` from the same single pass of value counts.

    ``cardinality`` (column, cardinality) counts NULL as a value, like
    :func:`cardinality`; it is a lazy view of the count table.
    """
    counts = reliable_checkpoint(value_counts(df, cols))
    table = reliable_checkpoint(index_from_counts(counts, scan_buckets))
    card = counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))
    return _held(table, cols, suffix, handle_invalid), card


def fit_string_indexer(df: DataFrame, cols, suffix: str = "_cat",
                       handle_invalid: str = "error") -> StringIndexerModel:
    """The stock ``StringIndexer`` fit (same result; its final merge runs in one task)."""
    indexer = StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols],
                            handleInvalid=handle_invalid, stringOrderType="frequencyDesc")
    return indexer.fit(df)
