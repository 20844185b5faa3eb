"""Column expressions (all built-in, JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def entity_key(*parts, sep: str = " ") -> Column:
    """Join key parts with ``sep``; NULL if any part is NULL (``concat``, not ``concat_ws``)."""
    items = []
    for i, p in enumerate(parts):
        if i:
            items.append(F.lit(sep))
        items.append(_c(p))
    return F.concat(*items)


def argmax_class(scores) -> Column:
    """0-based index of the largest element of an array (first one on ties)."""
    arr = _c(scores)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def probability_pair(p1) -> Column:
    """``[1 - p1, p1]``: two-class probability vector from a positive-class score."""
    p = _c(p1).cast("double")
    return F.array(F.lit(1.0) - p, p)


def pack_categories(cols) -> Column:
    """Stack category index columns into one ``array<bigint>`` (one row = one sample)."""
    return F.array(*[_c(c).cast("long") for c in cols])


def vector_to_float64(col) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(_c(col), "float64")


def clip(col, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(col).cast("double"), F.lit(lo)), F.lit(hi))
