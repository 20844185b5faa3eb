"""Ordered scan: exclusive running sums / maxima and ``lag`` over a total order.

The reference computes sequence features with windows that have an empty
``partitionBy()``; Spark runs those in a single task. Here the global order is
only ever needed over *small derived tables* (one row per entity block, per
distinct timestamp, per score), and this module scans such a table:

* if its row count is at most ``single_task_rows`` the scan is one plain
  window (the bound is checked by counting, not assumed);
* otherwise the table is range-partitioned on the order keys, checkpointed so
  bucket ids are fixed, each bucket is scanned by a window partitioned by
  bucket, and bucket totals (at most ``buckets`` rows, so a proven broadcast
  size) are prefixed and joined back.

Rows must be unique under ``order_by``; "exclusive" then means "over all rows
strictly before this one".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

DEFAULT_SINGLE_TASK_ROWS = 2_000_000
DEFAULT_ROWS_PER_BUCKET = 1_000_000


def _as_cols(order_by) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def ordered_scan(df: DataFrame, order_by, sums: dict[str, Column] | None = None,
                 maxes: dict[str, Column] | None = None,
                 lags: dict[str, Column] | None = None,
                 buckets: int | None = None,
                 single_task_rows: int = DEFAULT_SINGLE_TASK_ROWS,
                 rows_per_bucket: int = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Add exclusive prefix columns to ``df`` in the order ``order_by``.

    ``sums``  {out: expr} -> sum of expr over earlier rows (0 when none).
    ``maxes`` {out: expr} -> max of expr over earlier rows (NULL when none).
    ``lags``  {out: expr} -> expr of the previous row (NULL for the first).
    ``buckets`` forces the bucketed form with that many range buckets; ``1``
    forces the single window; ``None`` decides from a row count.
    """
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    order = _as_cols(order_by)
    if buckets is None:
        n = df.count()
        buckets = 1 if n <= single_task_rows else math.ceil(n / rows_per_bucket)
    if buckets <= 1:
        return _single_window(df, order, sums, maxes, lags)
    return _bucketed(df, order, sums, maxes, lags, buckets)


def _single_window(df, order, sums, maxes, lags):
    w = Window.orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(e).over(before), F.lit(0)).alias(k) for k, e in sums.items()]
    cols += [F.max(e).over(before).alias(k) for k, e in maxes.items()]
    cols += [F.lag(e).over(w).alias(k) for k, e in lags.items()]
    return df.select("*", *cols)


def _bucketed(df, order, sums, maxes, lags, buckets):
    # Range buckets follow the global order: bucket i holds the i-th key range
    # and equal keys never straddle two buckets. Checkpointing pins the ids.
    ranged = reliable_checkpoint(
        df.repartitionByRange(buckets, *order).withColumn("_sb", F.spark_partition_id()))
    w = Window.partitionBy("_sb").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*",
        F.row_number().over(w).alias("_srn"),
        *[F.coalesce(F.sum(e).over(before), F.lit(0)).alias(f"_si_{k}") for k, e in sums.items()],
        *[F.max(e).over(before).alias(f"_mi_{k}") for k, e in maxes.items()],
        *[F.lag(e).over(w).alias(f"_li_{k}") for k, e in lags.items()],
    )
    totals = ranged.groupBy("_sb").agg(
        F.count(F.lit(1)).alias("_sn"),
        *[F.coalesce(F.sum(e), F.lit(0)).alias(f"_st_{k}") for k, e in sums.items()],
        *[F.max(e).alias(f"_mt_{k}") for k, e in maxes.items()],
        # last row of the bucket, by the same order as the scan
        *[F.max_by(e, F.struct(*order)).alias(f"_lt_{k}") for k, e in lags.items()],
    )
    wb = Window.orderBy("_sb")
    wbb = wb.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_sb",
        *[F.coalesce(F.sum(f"_st_{k}").over(wbb), F.lit(0)).alias(f"_so_{k}") for k in sums],
        *[F.max(f"_mt_{k}").over(wbb).alias(f"_mo_{k}") for k in maxes],
        *[F.lag(f"_lt_{k}").over(wb).alias(f"_lo_{k}") for k in lags],
    )
    # ``offsets`` has at most ``buckets`` rows: a proven broadcast bound.
    out = local.join(F.broadcast(offsets), "_sb", "left")
    cols = [(F.coalesce(F.col(f"_so_{k}"), F.lit(0)) + F.col(f"_si_{k}")).alias(k) for k in sums]
    cols += [F.greatest(F.col(f"_mo_{k}"), F.col(f"_mi_{k}")).alias(k) for k in maxes]
    cols += [F.when(F.col("_srn") == 1, F.col(f"_lo_{k}")).otherwise(F.col(f"_li_{k}")).alias(k)
             for k in lags]
    return out.select(*df.columns, *cols)
