"""Row numbers, epochs and batches for readers of training data.

A row's number comes from a sort by ranges or from its place in an exported file;
either way a partition (or file) adds the rows of those before it, so no window
spans the table. An epoch reads the rows in the order of a keyed permutation of
their numbers: place = P(position), computed per row, so epochs differ without a
shuffle of rows, any reader can resume at (epoch, place), and reruns agree.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .scan import ordered_scan

ROUNDS = 6
#: A prime above the square root of any row count; products of two residues fit a long.
PRIME = (1 << 31) - 1
#: At most so many files have their offsets broadcast; beyond it the join shuffles.
BROADCAST_FILES = 200_000


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def number_rows(df: DataFrame, order, out: str = "position",
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in the total order of the columns ``order``.

    One exchange by ranges; the sorted rows are written to the checkpoint folder,
    which pins them. ``order`` should end in a unique column: rows that tie in all
    of it are numbered in any order and share a range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    local, part, first = (_free(df, x) for x in ("_local", "_part", "_first"))
    rows = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    rows = reliable_checkpoint(rows.withColumn(local, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(local, 33))  # the id is partition << 33 | row
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = ordered_scan(sizes, [F.col(part)], sums={first: F.col("n")}).select(part, first)
    return rows.join(F.broadcast(offsets), part).withColumn(  # at most one row a partition
        out, F.col(first) + F.col(local).bitwiseAND(F.lit((1 << 33) - 1))).drop(local, part, first)


def number_file_rows(spark: SparkSession, path: str, out: str = "position",
                     broadcast_files: int = BROADCAST_FILES) -> DataFrame:
    """The rows of a Parquet export, numbered by file and place in the file; nothing is shuffled."""
    rows = spark.read.parquet(path)
    file, place, first = (_free(rows, x) for x in ("_file", "_place", "_first"))
    named = rows.withColumn(file, F.col("_metadata.file_path")).withColumn(
        place, F.col("_metadata.row_index"))
    sizes = reliable_checkpoint(rows.select(F.col("_metadata.file_path").alias(file))
                                .groupBy(file).agg(F.count(F.lit(1)).alias("n")))
    offsets = ordered_scan(sizes, [F.col(file)], sums={first: F.col("n")}).select(file, first)
    offsets = F.broadcast(offsets) if sizes.count() <= broadcast_files else offsets
    return named.join(offsets, file).withColumn(out, F.col(first) + F.col(place)).drop(
        file, place, first)


class EpochOrder:
    """A keyed permutation of 0 .. n - 1.

    x is written as (l, r) with x = l * b + r on a grid of a x b >= n cells; rounds
    add in turn a keyed function of r to l (modulo a) and of l to r (modulo b),
    which can be undone, so cells are permuted. A number that leaves 0 .. n - 1 is
    permuted again until it is back. Only the a * b - n < sqrt(n) + 1 cells outside can
    cause that, so the number of repetitions is found by following them.
    """

    def __init__(self, n: int, epoch: int, seed: int = 0):
        self.n = max(1, n)
        self.a = math.isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        draw = random.Random(f"{seed}/{epoch}")
        self.keys = [(draw.randrange(PRIME), draw.randrange(PRIME)) for _ in range(ROUNDS)]
        beyond = np.arange(self.n, self.a * self.b)
        self.walks, out = 1, np.setdiff1d(beyond, self._once(beyond))  # entered from inside
        while len(out):
            out = self._once(out)
            out = out[out >= self.n]
            self.walks += 1

    def _once(self, x):
        left, right = x // self.b, x % self.b
        for i, (j, k) in enumerate(self.keys):
            v = left if i % 2 else right
            f = (v + j) % PRIME * ((v + k) % PRIME) % PRIME
            if i % 2:
                right = (right + f) % self.b
            else:
                left = (left + f) % self.a
        return left * self.b + right

    def place(self, position):
        """Places of an array of positions."""
        x = self._once(np.asarray(position, np.int64))
        while (x >= self.n).any():
            x = np.where(x >= self.n, self._once(x), x)
        return x

    def column(self, position: Column) -> Column:
        """The place of a position, as one expression that refers to it once.

        Rounds are steps of an ``aggregate``: as columns of their own they would be
        substituted into each other when a filter on the place is pushed down.
        """
        a, b, n, p = (F.lit(v).cast("long") for v in (self.a, self.b, self.n, PRIME))
        keys = F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.lit(k).cast("long").alias("k"),
                                  F.lit(i % 2 == 1).alias("right"))
                         for i, (j, k) in enumerate(self.keys)])

        def state(left, right):
            return F.struct(left.alias("l"), right.alias("r"))

        def turn(s, q):
            def f(v):
                return F.pmod(F.pmod(v + q["j"], p) * F.pmod(v + q["k"], p), p)
            return F.when(q["right"], state(s["l"], F.pmod(s["r"] + f(s["l"]), b))).otherwise(
                state(F.pmod(s["l"] + f(s["r"]), a), s["r"]))

        def once(x):
            return F.aggregate(keys, state(F.call_function("div", x, b), F.pmod(x, b)), turn,
                               lambda s: s["l"] * b + s["r"])

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(self.walks)), position.cast("long"),
            lambda x, walk: F.when((walk > 1) & (x < n), x).otherwise(once(x)))

    def with_place(self, df: DataFrame, position: str, out: str = "place") -> DataFrame:
        """``df`` with the column ``out``."""
        return df.withColumn(out, self.column(F.col(position)))


def epoch_batches(df: DataFrame, position: str, n: int, batch_size: int, epoch: int,
                  seed: int = 0, shard: int | None = None, num_shards: int = 1,
                  start: int = 0) -> DataFrame:
    """The rows of one epoch with ``epoch``, ``place`` and ``batch``.

    ``position`` holds 0 .. n - 1 (:func:`number_rows`). Batches are runs of
    ``batch_size`` places, so all but the last are full. Reader ``shard`` of ``num_shards``
    gets every ``num_shards``-th batch; ``start`` resumes at a place.
    """
    out = EpochOrder(n, epoch, seed).with_place(df, position, "place")
    out = out.withColumn("epoch", F.lit(epoch)).withColumn(
        "batch", F.call_function("div", F.col("place"), F.lit(batch_size).cast("long")))
    if start:
        out = out.where(F.col("place") >= start)
    if shard is not None:
        out = out.where(F.pmod(F.col("batch"), F.lit(num_shards)) == shard)
    return out
