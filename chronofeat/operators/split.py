"""Time-ordered train / validation / test split without a global sort of rows.

Reference semantics: ``pr = percent_rank() over (order by ts)`` on all rows;
train ``pr <= .8``, validation ``.8 < pr < .9``, test ``pr >= .9``. Rows with
equal ``ts`` share ``pr`` and therefore a split; NULL ``ts`` sorts first.

Because ``pr`` only depends on how many rows have a smaller ``ts``, the split
is decided by two *cut values*: ``hi`` = largest ``ts`` with ``pr <= .8`` and
``lo`` = smallest ``ts`` with ``pr >= .9``. For integers, dates and timestamps
two passes over the time column find them: a mergeable quantile sketch brackets
both, then values inside a bracket are counted one by one and all others per
gap between the brackets, which gives exact ranks whatever the sketch's error.
A cut outside its bracket would show in the counts; exact order statistics
(:mod:`chronofeat.operators.select`) answer then. Other types use a per-value
count table scanned in order. Cuts travel as integer keys, so no time zone can
move them. Each row is then labelled with plain comparisons against two
literals, which Parquet can use for row-group pruning:

    ts IS NULL OR ts <= hi -> train;  ts >= lo -> test;  otherwise -> val

(either cut may be NULL; the CASE order makes that exact, see tests).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint, reuse
from . import select
from .scan import ordered_scan

TRAIN, VAL, TEST = "train", "val", "test"

#: The sketch's rank error is at most rows / ACCURACY; each bracket holds four times that.
ACCURACY = 10_000
_KEY_MIN, _KEY_MAX = -2**63, 2**63 - 1


def cut_literal(cut, dtype: T.DataType) -> Column:
    """A cut (an integer key where the type has one) as a literal of exactly ``dtype``."""
    if select.supports(dtype):
        return select.value_literal(cut, dtype)
    return F.lit(cut).cast(dtype)


def time_percent_rank(df: DataFrame, ts: str, out: str = "pr",
                      scan_buckets: int | None = None, persist: bool = False) -> DataFrame:
    """``percent_rank() over (order by ts)`` as a column, without a global window.

    ``(rows before) / max(n - 1, 1)``; equals Spark's ``percent_rank`` (0.0 for
    a single row). Per-value counts are scanned in order and joined back on
    ``ts`` (NULL-safe); Spark broadcasts that table only when its measured
    size is under the broadcast threshold. ``persist=True`` keeps ``df``
    between its two passes (worth it only when ``df`` is costly to recompute).
    """
    df = reuse(df) if persist else df
    counts = reliable_checkpoint(
        df.groupBy(F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_c")))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    scanned = ordered_scan(counts, [F.col("_t")], sums={"_before": F.col("_c")},
                           buckets=scan_buckets)
    ranks = scanned.select(
        F.col("_t"), (F.col("_before").cast("double") / F.lit(float(max(n - 1, 1)))).alias(out))
    return df.join(ranks, F.col(ts).eqNullSafe(F.col("_t")), "left").drop("_t")


def _last_position_at_most(n: int, bound: float):
    """Largest p in [0, n) with p / max(n-1, 1) <= bound (double division)."""
    denom = float(max(n - 1, 1))
    p = min(n - 1, int(math.floor(bound * denom)))
    while p + 1 <= n - 1 and (p + 1) / denom <= bound:
        p += 1
    while p >= 0 and p / denom > bound:
        p -= 1
    return p if p >= 0 else None


def _first_position_at_least(n: int, bound: float):
    """Smallest q in [0, n) with q / max(n-1, 1) >= bound (double division)."""
    denom = float(max(n - 1, 1))
    q = max(0, int(math.ceil(bound * denom)))
    while q - 1 >= 0 and (q - 1) / denom >= bound:
        q -= 1
    while q <= n - 1 and q / denom < bound:
        q += 1
    return q if q <= n - 1 else None


def _cuts_by_rank(df, ts, bounds, width):
    """Cut keys from exact order statistics; the rows are read once, for their keys."""
    train_upto, test_from = bounds
    keys = df.select(select.order_key(F.col(ts), df.schema[ts].dataType).alias("_k"))
    keys = keys.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = keys.agg(F.count(F.lit(1)).alias("n"), F.count("_k").alias("nn"),
                       F.min("_k").alias("a"), F.max("_k").alias("b")).first()
        n, nn, nulls = row["n"], row["nn"], row["n"] - row["nn"]
        p = _last_position_at_most(n, train_upto)    # position of the last train row
        q = _first_position_at_least(n, test_from)   # first position allowed in test
        ranks = []
        if p is not None and p >= nulls:
            ranks.append(p - nulls)                  # non-NULL rank of the value at p
        if q is not None and nn > 0 and q > nulls:
            ranks.append(q - nulls - 1)              # lo is the next value after this one
        found = select.order_statistics(keys, "_k", ranks, (nn, row["a"], row["b"]), width)
        hi = found[p - nulls] if p is not None and p >= nulls else None
        if q is None or nn == 0:
            lo = None
        elif q <= nulls:
            lo = row["a"]                            # every non-NULL value qualifies
        else:
            lo = select.next_key(keys, "_k", found[q - nulls - 1])
        return hi, lo, n
    finally:
        keys.unpersist()


def _brackets(keys, bounds, accuracy):
    """Row count and disjoint ascending key ranges around the cuts, from one pass with a sketch."""
    shares = [min(1.0, max(0.0, b + side * 2.0 / accuracy)) for b in bounds for side in (-1, 1)]
    # NULL sorts first, so it takes the smallest key here; the counts tell it apart
    n, ends = keys.agg(F.count(F.lit(1)), F.percentile_approx(
        F.coalesce("_k", F.lit(_KEY_MIN)), shares, accuracy)).first()
    if ends is None:
        return n, []
    pad = [(abs(e) >> 52) + 1 for e in ends]  # the sketch rounds keys to doubles
    ranges = sorted((max(_KEY_MIN, ends[i] - pad[i]), min(_KEY_MAX, ends[i + 1] + pad[i + 1]))
                    for i in (0, 2))
    if ranges[1][0] <= ranges[0][1]:
        return n, [(ranges[0][0], max(ranges[0][1], ranges[1][1]))]
    return n, ranges


def _bracketed_counts(keys, ranges):
    """(_t, _c, _e): a row per key inside a range (_e), one per gap with its smallest key, one for
    NULL; partial counts, so a task emits no more."""
    zone, inside = F.lit(0), F.lit(False)
    for lo, hi in ranges:
        zone = zone + (F.col("_k") >= F.lit(lo)).cast("int") + (F.col("_k") > F.lit(hi)).cast("int")
        inside = inside | F.col("_k").between(F.lit(lo), F.lit(hi))
    counts = (keys.groupBy(zone.alias("_z"), F.when(inside, F.col("_k")).alias("_v"))
              .agg(F.min("_k").alias("_t"), F.count(F.lit(1)).alias("_c")))
    return counts.select("_t", "_c", (F.col("_v").isNotNull() | F.col("_t").isNull()).alias("_e"))


def _cuts_by_sketch(df, ts, bounds, accuracy, scan_buckets):
    """Cut keys from a sketch and one exact count, or None if a cut left its bracket."""
    keys = df.select(select.order_key(F.col(ts), df.schema[ts].dataType).alias("_k"))
    n, ranges = _brackets(keys, bounds, accuracy)
    counts = _bracketed_counts(keys, ranges).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scanned = ordered_scan(counts, [F.col("_t")], sums={"_before": F.col("_c")},
                               lags={"_prev": F.col("_e")}, buckets=scan_buckets)
        pr = F.col("_before").cast("double") / F.lit(float(max(n - 1, 1)))
        at = F.struct(F.col("_t").alias("t"), F.col("_e").alias("e"),
                      F.coalesce("_prev", F.lit(True)).alias("p"))
        hi, lo, end = scanned.where(F.col("_t").isNotNull()).agg(
            F.max(F.when(pr <= F.lit(bounds[0]), at)), F.min(F.when(pr >= F.lit(bounds[1]), at)),
            F.max(at)).first()
    finally:
        counts.unpersist()
    # a gap's later keys are not known: it can be no last key, and the key after it no first one
    if (hi and not hi["e"]) or (lo and not lo["p"]) or (end and not lo and not end["e"]):
        return None
    return hi and hi["t"], lo and lo["t"], n


def _cuts_by_counts(df, ts, bounds, scan_buckets):
    """Cuts from a per-value count table scanned in order, for any orderable type."""
    train_upto, test_from = bounds
    dtype = df.schema[ts].dataType
    value = select.order_key(F.col(ts), dtype) if select.supports(dtype) else F.col(ts)
    counts = reliable_checkpoint(df.groupBy(value.alias("_t")).agg(F.count(F.lit(1)).alias("_c")))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    scanned = ordered_scan(counts, [F.col("_t")], sums={"_before": F.col("_c")},
                           buckets=scan_buckets)
    pr = F.col("_before").cast("double") / F.lit(float(max(n - 1, 1)))
    row = scanned.agg(
        F.max(F.when(pr <= F.lit(train_upto), F.col("_t"))).alias("hi"),
        F.min(F.when(pr >= F.lit(test_from), F.col("_t"))).alias("lo"),
    ).first()
    return row["hi"], row["lo"], n


def time_cuts(df: DataFrame, ts: str, bounds=(0.8, 0.9), scan_buckets: int | None = None,
              method: str | None = None, width: int = select.DEFAULT_WIDTH,
              accuracy: int = ACCURACY) -> tuple[object, object, int]:
    """Return ``(hi, lo, n)``: the two cuts (see :func:`cut_literal`) and the row count.

    ``method`` follows from the type of ``ts`` alone: ``sketch`` where it has an
    integer key, ``counts`` otherwise. All are exact; naming one is for tests.
    ``rank`` needs no sketch and reads the keys once a level of ``width`` buckets;
    it also answers if a cut is not in its bracket.
    """
    method = method or ("sketch" if select.supports(df.schema[ts].dataType) else "counts")
    if method == "sketch":
        found = _cuts_by_sketch(df, ts, bounds, accuracy, scan_buckets)
        if found is not None:
            return found
        method = "rank"
    if method == "rank":
        return _cuts_by_rank(df, ts, bounds, width)
    if method == "counts":
        return _cuts_by_counts(df, ts, bounds, scan_buckets)
    raise ValueError(f"unknown method {method!r}")


def split_label_counts(df: DataFrame, ts: str, label: str, bounds=(0.8, 0.9),
                       scan_buckets: int | None = None) -> DataFrame:
    """(split, label, n): rows are labelled first, so only split x label counts shuffle."""
    hi, lo, _ = time_cuts(df, ts, bounds, scan_buckets)
    return label_counts_for_cuts(df, ts, label, hi, lo)


def label_counts_for_cuts(df: DataFrame, ts: str, label: str, hi, lo) -> DataFrame:
    """(split, label, n) for known cuts, in one pass over ``df``."""
    labelled = split_column(df.select(ts, label), ts, hi, lo)
    return labelled.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))


def split_column(df: DataFrame, ts: str, hi, lo, out: str = "split") -> DataFrame:
    """Label rows with the ordered CASE over the two cut literals."""
    dtype = df.schema[ts].dataType
    t = F.col(ts)
    train = t.isNull()
    if hi is not None:
        train = train | (t <= cut_literal(hi, dtype))
    label = F.when(train, F.lit(TRAIN))
    if lo is not None:
        label = label.when(t >= cut_literal(lo, dtype), F.lit(TEST))
    return df.withColumn(out, label.otherwise(F.lit(VAL)))


def time_split(df: DataFrame, ts: str, bounds=(0.8, 0.9), out: str = "split",
               scan_buckets: int | None = None, persist: bool = False,
               **cut_options) -> DataFrame:
    """``df`` plus a ``split`` column: train / val / test by time position.

    Two passes over ``df``: the cut pass reads only ``ts`` (column pruning),
    the labelling is a projection fused into whatever consumes it.
    ``persist=True`` keeps ``df`` between the passes, for inputs that are
    costly to recompute (see :func:`chronofeat.session.reuse`).
    """
    df = reuse(df) if persist else df
    hi, lo, _ = time_cuts(df, ts, bounds, scan_buckets, **cut_options)
    return split_column(df, ts, hi, lo, out)


def split_predicates(df: DataFrame, ts: str, hi, lo) -> tuple[Column, Column, Column]:
    """Plain range predicates (train, val, test) that Parquet can push down.

    ``lo > hi`` whenever both exist (pr is monotone in ts and .9 > .8), so
    test is ``ts >= lo`` and val is the open range between the cuts. A
    missing cut is resolved here, on the driver, so no predicate compares
    with NULL (which would silently drop validation rows).
    """
    dtype = df.schema[ts].dataType
    t = F.col(ts)
    h = cut_literal(hi, dtype) if hi is not None else None
    lo_lit = cut_literal(lo, dtype) if lo is not None else None
    train = t.isNull() | (t <= h) if h is not None else t.isNull()
    test = t >= lo_lit if lo_lit is not None else F.lit(False)
    val = t > h if h is not None else t.isNotNull()
    if lo_lit is not None:
        val = val & (t < lo_lit)
    return train, val, test


def split_frames(df: DataFrame, ts: str, bounds=(0.8, 0.9), scan_buckets: int | None = None,
                 persist: bool = False):
    """Three DataFrames (train, val, test), each a pushed-down range filter."""
    df = reuse(df) if persist else df
    hi, lo, _ = time_cuts(df, ts, bounds, scan_buckets)
    return tuple(df.where(p) for p in split_predicates(df, ts, hi, lo))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split, one job instead of one count per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
