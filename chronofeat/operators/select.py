"""Exact order statistics of a column without shuffling its values.

``order_statistics(keys, ranks)`` returns the values at given 0-based positions
of the ascending order of a column of integer keys. It narrows one key range per
rank, all ranks in the same pass: rows in a range are counted in ``width``
buckets of equal key width (each task emits at most ``width`` partial counts a
rank, so only bucket counts cross the network) and the bucket that holds the
rank is the next range, until buckets are single keys. Each level divides the
span by ``width``: dates need one level, microseconds over decades four. All
arithmetic is on integers, and the path is the same for every input size.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_WIDTH = 16384
_EPOCH = _dt.datetime(1970, 1, 1)
_EPOCH_UTC = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def supports(dtype: T.DataType) -> bool:
    """Types with an exact, time-zone-free monotone map to a 64-bit integer."""
    return isinstance(dtype, _INTEGRAL + (T.DateType, T.TimestampType, T.TimestampNTZType))


def order_key(col: Column, dtype: T.DataType) -> Column:
    """Monotone ``bigint`` key of ``col`` (micros for timestamps, days for dates)."""
    if isinstance(dtype, _INTEGRAL):
        return col.cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.TimestampNTZType):
        # wall-clock fields of an NTZ value do not depend on the session zone
        seconds = F.date_part(F.lit("SECOND"), col)  # decimal with microseconds
        return (F.unix_date(col.cast("date")).cast("long") * 86_400_000_000
                + F.hour(col).cast("long") * 3_600_000_000
                + F.minute(col).cast("long") * 60_000_000
                + (seconds * 1_000_000).cast("long"))
    raise TypeError(f"no integer order key for {dtype.simpleString()}")


def key_to_value(key: int, dtype: T.DataType):
    """Inverse of :func:`order_key` for a Python value."""
    if isinstance(dtype, _INTEGRAL):
        return int(key)
    if isinstance(dtype, T.DateType):
        return _dt.date(1970, 1, 1) + _dt.timedelta(days=int(key))
    if isinstance(dtype, T.TimestampType):
        return _EPOCH_UTC + _dt.timedelta(microseconds=int(key))
    if isinstance(dtype, T.TimestampNTZType):
        return _EPOCH + _dt.timedelta(microseconds=int(key))
    raise TypeError(dtype.simpleString())


def value_literal(key: int, dtype: T.DataType) -> Column:
    """The value with that key, as a literal of exactly ``dtype`` in any time zone."""
    value = key_to_value(key, dtype)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    if isinstance(dtype, T.TimestampType):
        # an instant: pass micros, not a naive wall clock
        return F.timestamp_micros(F.lit(int(key)))
    return F.lit(value).cast(dtype)


def _bucket(key: str, lo: int, step: int, wide: bool) -> Column:
    """``(key - lo) div step`` for keys at or above ``lo``; exact for any 64-bit span."""
    if wide:  # the difference can leave 64 bits
        return F.expr(f"cast((cast({key} as decimal(20,0)) - cast('{lo}' as decimal(20,0)))"
                      f" div cast('{step}' as decimal(20,0)) as bigint)")
    return F.expr(f"({key} - cast('{lo}' as bigint)) div cast('{step}' as bigint)")


def order_statistics(keys: DataFrame, key: str, ranks, stats,
                     width: int = DEFAULT_WIDTH) -> dict[int, int]:
    """{rank: key} for 0-based ranks among the non-NULL values of ``key``.

    ``stats`` = (count, min, max) of the column. Worth persisting ``keys``: each
    level reads it once.
    """
    n, kmin, kmax = stats
    for r in ranks:
        if not 0 <= r < n:
            raise ValueError(f"rank {r} outside [0, {n})")
    ranges = {r: (kmin, kmax, 0) for r in set(ranks)}  # rank -> key range, rows below it
    while open_ := {r: x for r, x in ranges.items() if x[0] < x[1]}:
        k, parts, steps = F.col(key), [], {}
        for r, (lo, hi, _) in open_.items():
            steps[r] = step = -(-(hi - lo + 1) // width)
            parts.append(F.when((k >= lo) & (k <= hi), F.struct(
                F.lit(r).cast("long").alias("r"), _bucket(key, lo, step, hi - lo >= 1 << 63).alias("q"))))
        counted = (keys.select(F.explode(F.array_compact(F.array(*parts))).alias("b"))
                   .groupBy("b.r", "b.q").agg(F.count(F.lit(1)).alias("c")))
        found = {}
        for row in counted.collect():  # at most width rows a rank
            found.setdefault(row["r"], []).append((row["q"], row["c"]))
        for r, (lo, hi, below) in open_.items():
            for q, c in sorted(found.get(r, ())):
                if below + c > r:
                    first = lo + q * steps[r]
                    ranges[r] = (first, min(hi, first + steps[r] - 1), below)
                    break
                below += c
            else:
                raise RuntimeError(f"no bucket holds rank {r}: the input changed between passes")
    return {r: x[0] for r, x in ranges.items()}


def next_key(keys: DataFrame, key: str, after: int):
    """Smallest value of ``key`` above ``after`` (None if none)."""
    return keys.where(F.col(key) > after).agg(F.min(key)).first()[0]
