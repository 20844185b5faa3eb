"""Row filters, projections and casts of the preparation stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import entity_key


def filter_threshold(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Keep ``col >= threshold``: NULL is dropped, NaN is kept (NaN sorts above all numbers).

    A plain comparison with a literal, so it reaches the Parquet scan as a
    pushed filter.
    """
    return df.where(F.col(col) >= F.lit(threshold))


def with_entity_key(df: DataFrame, parts, out: str, sep: str = " ") -> DataFrame:
    """Add ``out`` = parts joined by ``sep`` (NULL if any part is NULL)."""
    return df.withColumn(out, entity_key(*parts, sep=sep))


def project(df: DataFrame, cols) -> DataFrame:
    """Keep exactly ``cols`` in that order (column pruning reaches the scan)."""
    return df.select(*cols)


def drop_required_nulls(df: DataFrame, subset) -> DataFrame:
    """Drop rows where any ``subset`` column is NULL (or NaN for floating columns)."""
    return df.na.drop(subset=list(subset))


def cast_columns(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Cast named columns in place, e.g. ``{"label": "long", "x_cat": "long"}``."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})
