"""Vector compression into codes (product quantisation) with memoised grid cells.

A component x becomes the integer floor(scale * x); a vector is cut into
``parts`` equal parts, each with a codebook of at most ``entries`` entries that
starts as that part of the vectors with the smallest ids. A round assigns every
part to its nearest entry (squared Euclidean distance, ties to the lower index)
and moves each entry to the floor of its parts' mean; unused entries stay.

Nearest entries come from a memo: a part falls into a coarse grid cell, found by
the hash of the cell's coordinates (checked against the coordinates). A new cell
keeps the entries that are not dominated over its box: those whose smallest
distance to the box is at most the least of the entries' largest distances. Only
these are evaluated, in integers, so results equal a search of the whole
codebook. The memo of a task is bounded and can be rebuilt at any time.

A round broadcasts the codebooks (parts x entries vectors) and shuffles one row
of sums per task, part and used entry. Errors are summed over equal labels;
labels with more rows than an average partition (fewer than there are
partitions) get their sums by broadcast, the others by a join.

Nulls and oddities: vectors that are null or empty, hold null or non-finite
components or ones beyond ``LIMIT`` after scaling (squares must fit a long), or
whose length differs from the first usable vector's or is no multiple of
``parts`` give no row. Null ids sort last; rows that repeat an id are ordered by
vector and kept each. Equal entries: the lower index wins. Null labels are one
label. An empty table gives no rows. Other columns are ignored and names cannot
clash, as all columns are renamed on the way in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Largest size of a scaled component.
LIMIT = 1 << 24
CELL_WIDTH = 32
MEMO_CELLS = 1 << 16
_BLOCK = 1 << 22


class Cells:
    """Nearest entries of one codebook through memoised grid cells."""

    def __init__(self, entries: np.ndarray, width: int = CELL_WIDTH, limit: int = MEMO_CELLS):
        self.entries, self.width, self.limit = entries, width, limit
        odd = np.arange(1, 2 * entries.shape[1], 2, dtype=np.uint64)
        self.factors = odd * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        self.known = {}  # cell coordinates as bytes: candidates

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries not dominated over the boxes of ``cells``, lowest index first."""
        low = cells[:, None, :] * self.width
        high = low + (self.width - 1)
        e = self.entries[None, :, :]
        near = np.maximum(np.maximum(low - e, e - high), 0)
        far = np.maximum(np.abs(low - e), np.abs(high - e))
        keep = (near * near).sum(2) <= (far * far).sum(2).min(axis=1, keepdims=True)
        return [np.flatnonzero(k) for k in keep]

    def _lookup(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [c.tobytes() for c in cells]
        fresh = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.known, fresh = {}, list(range(len(keys)))
        step = max(1, _BLOCK // self.entries.size)
        for at in range(0, len(fresh), step):
            some = fresh[at:at + step]
            for i, found in zip(some, self._candidates(cells[some])):
                self.known[keys[i]] = found
        return [self.known[k] for k in keys]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of ``x``."""
        step = max(1, _BLOCK // self.entries.size)
        if len(x) > step:
            done = [self.nearest(x[at:at + step]) for at in range(0, len(x), step)]
            return tuple(np.concatenate(d) for d in zip(*done))
        cells = x // self.width
        hashed = (cells.astype(np.uint64) * self.factors).sum(axis=1, dtype=np.uint64)
        hashed ^= hashed >> np.uint64(29)
        _, first, cell = np.unique(hashed, return_index=True, return_inverse=True)
        lists = self._lookup(cells[first])
        astray = (cells != cells[first][cell]).any(axis=1)  # another cell with the same hash
        if astray.any():
            lists.append(np.arange(len(self.entries)))
            cell = np.where(astray, len(lists) - 1, cell)
        sizes = np.array([len(c) for c in lists])
        flat, at = np.concatenate(lists), np.cumsum(sizes) - sizes
        n = sizes[cell]
        starts = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = flat[np.repeat(at[cell] - starts, n) + np.arange(len(row))]
        gap = x[row] - self.entries[entry]
        best = np.minimum.reduceat((gap * gap).sum(axis=1) * len(self.entries) + entry, starts)
        return best % len(self.entries), best // len(self.entries)


def _matrix(column, scale: float) -> np.ndarray:
    """Scaled integers of an Arrow column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           label: str = "label", parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """(id, label, v): the vectors that can be compressed, stored."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fits = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LIMIT))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"),
                          v.alias("v")).where(v.isNotNull()).where(fits)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    return stored(rows.where(F.size("v") == (first[0] if first else 0)), "vector-codes")


def _sums(shared, scale: float, width: int):
    """Per task: (part, entry, n, sums) of the assigned parts."""
    def run(batches):
        books = shared.value
        n_parts, n_entries, dim = books.shape
        cells = [Cells(b, width) for b in books]
        n = np.zeros((n_parts, n_entries), np.int64)
        sums = np.zeros((n_parts, n_entries, dim), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), scale).reshape(b.num_rows, n_parts, dim)
            for p in range(n_parts):
                code, _ = cells[p].nearest(x[:, p])
                n[p] += np.bincount(code, minlength=n_entries)
                np.add.at(sums[p], code, x[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])
    return run


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
        scale: float = SCALE, width: int = CELL_WIDTH) -> np.ndarray:
    """Codebooks (part, entry, component) as integers, from the rows of ``usable``."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.floor(np.array([r.v for r in first]) * scale).astype(np.int64)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    dim = books.shape[2]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        found = rows.select("v").mapInArrow(_sums(shared, scale, width),
                                            "part int, entry int, n long, sums array<long>")
        means = found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
        books = books.copy()
        for r in means.collect():  # at most parts * entries rows
            books[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all entries' decimal components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(rows: DataFrame, books: np.ndarray, scale: float = SCALE,
           width: int = CELL_WIDTH) -> DataFrame:
    """(id, label, code, error) of each row: two hex digits per part, squared distances summed."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    n_parts, _, dim = books.shape

    def run(batches):
        cells = [Cells(b, width) for b in shared.value]
        hexes = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), scale).reshape(b.num_rows, n_parts, dim)
            codes, error = np.empty((b.num_rows, n_parts), np.int64), np.zeros(b.num_rows, np.int64)
            for p in range(n_parts):
                codes[:, p], gap = cells[p].nearest(x[:, p])
                error += gap
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"),
                 pa.array(["".join(c) for c in hexes[codes]], pa.string()), pa.array(error)],
                names=["id", "label", "code", "error"])

    schema = rows.drop("v").withColumn("code", F.lit("")).withColumn(
        "error", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """``codes`` with the approximate vector (array of doubles) of each ``code``."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in b])
                        for b in books])
    place = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(
        F.get(entries, p), F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10)
        .cast("int")))
    return codes.withColumn("vector", F.flatten(place))


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` (stored) with ``label_error``, the errors summed over equal labels."""
    n = partitions(codes.sparkSession)
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"),
                                             F.count(F.lit(1)).alias("n")), "vector-labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") * n > total).select(F.col("label").alias("l"), "label_error")
    rest = sums.where(F.col("n") * n <= total).select(F.col("label").alias("l"),
                                                      F.col("label_error").alias("other"))
    return (codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
            .join(rest, F.col("label_error").isNull() & F.col("label").eqNullSafe(F.col("l")),
                  "left")
            .select("id", "label", "code", "error",
                    F.coalesce("label_error", "other").alias("label_error")))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
             label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: float = SCALE, width: int = CELL_WIDTH):
    """(codes, codebooks): rows (id, label, code, error, label_error), and the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    rows = usable(vectors, key, vector, label, parts, scale)
    books = fit(rows, parts, entries, rounds, scale, width)
    codes = stored(assign(rows, books, scale, width), "vector-codes")
    return label_errors(codes), books
