"""Bounded samples of labelled rows for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key


def remainder(key: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo n (null id: of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def _near_smallest(rows: DataFrame, cls: str, hashed: str, per_class: int) -> DataFrame:
    """Rows whose hash is so small that some 3 * ``per_class`` of their class are expected.

    Counting the classes first keeps what follows bounded however many rows,
    tasks or classes there are: one narrow aggregate, one row per class
    broadcast, and a few thousand rows left.
    """
    share = rows.groupBy(cls).agg(
        (F.lit(3.0 * per_class) / F.count(F.lit(1))).alias("__share"))
    near = F.col(hashed).cast("double") / F.lit(2.0 ** 63) <= 2.0 * F.col("__share") - 1.0
    return rows.join(F.broadcast(share), cls).where(near).drop("__share")


def _first(rows: DataFrame, cls: str, hashed: str, per_class: int) -> DataFrame:
    order = Window.partitionBy(cls).orderBy(hashed)
    return (_near_smallest(rows, cls, hashed, per_class).dropDuplicates([cls, hashed])
            .withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_class))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                   key: str = "doc_id", text: str = "text", folds: int = 3,
                   held_out: int = 1) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each label 0 and 1, outside the held-out fold.

    The rows with the smallest id hashes are taken, so reruns agree. Rows whose
    label or text is null teach nothing.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"),
                          F.xxhash64(F.col(key)).alias("h"))
    known = known.where(F.col("y").isin(0, 1) & F.col("k").isNotNull()
                        & (remainder(F.col("k"), folds) != held_out))
    picked = _first(known, "y", "h", per_class).select("k", "y")  # 2 * per_class rows
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    taken = rows.join(F.broadcast(picked), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    return sorted((r.t, r.y) for r in taken.select("t", "y").collect())


def texts_by_class(docs: DataFrame, label: Column, per_class: int, wanted: Column,
                   key: str = "doc_id", text: str = "text") -> list[tuple[str, str]]:
    """At most ``per_class`` (text, class) rows of each class among the ``wanted`` rows."""
    rows = docs.select(label.alias("c"), F.col(text).alias("t"), wanted.alias("w"),
                       text_key(F.col(key), F.col(text))[1].alias("h"))
    rows = rows.where(F.col("w") & F.col("c").isNotNull() & F.col("t").isNotNull())
    return sorted((r.t, r.c) for r in _first(rows, "c", "h", per_class).select("t", "c").collect())
