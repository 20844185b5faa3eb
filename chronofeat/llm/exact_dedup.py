"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. Every text becomes a digest: SHA-256 of the text with A-Z lower-cased.
2. A Misra-Gries summary finds frequent digests: each task keeps a frequent-items
   sketch of ``tracked`` counters, the sketches are merged in ``merge_groups``
   groups, and the groups' counters are added.
3. The candidates (at most ``tracked``, the bound of every broadcast here) are
   verified by an exact count, which also names the row that stays.
4. Verified winners are broadcast: rows of frequent digests are decided where
   they lie. All other digests have few rows each and take an ordinary shuffle.

The sketch only chooses the way a digest takes, never the result.

Nulls: a null text counts as empty; a null id sorts below every id. Of repeated
rows (same id and text) exactly one stays. Extra columns are left alone by
``drop_exact_duplicates`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRACKED = 1024
MERGE_GROUPS = 64


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the text after lower-casing A-Z only (null: empty text).

    ``lower`` equals that rule on pure ASCII and is much cheaper than
    ``translate``, which the other texts take.
    """
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.length(t) == F.octet_length(t)
    return F.sha2(F.when(ascii_only, F.lower(t)).otherwise(
        F.translate(t, UPPER, UPPER.lower())), 256)


def frequent_digests(rows: DataFrame, digest: str, tracked: int = TRACKED,
                     merge_groups: int = MERGE_GROUPS) -> DataFrame:
    """At most ``tracked`` candidate digests from Misra-Gries summaries of all rows.

    Summaries of groups of tasks are merged by adding their counters; a digest
    that is frequent overall is frequent in some group.
    """
    groups = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(merge_groups)).alias("g")).agg(
        F.expr(f"approx_top_k({digest}, {tracked}, {tracked})").alias("top"))
    found = groups.select(F.explode("top").alias("t")).select(
        F.col("t.item").alias(digest), F.col("t.count").alias("n"))
    return (found.groupBy(digest).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), digest)
            .limit(tracked).select(digest))


def _winners(rows: DataFrame, digest: str, order: list[str], tracked: int) -> DataFrame:
    """Exact size and staying row of each frequent digest (at most ``tracked`` rows)."""
    found = F.broadcast(frequent_digests(rows.select(digest), digest, tracked))
    return (rows.join(found, digest)
            .groupBy(digest).agg(F.count(F.lit(1)).alias("heavy_n"),
                                 F.max(F.struct(*order)).alias("heavy_win"))
            .where("heavy_n > 1"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: (key, keep_id, group_size, kept, text_sha256).

    The row with the largest ``key`` of each group of equal texts stays. An
    empty table gives no rows.
    """
    rows = stored(docs.select(F.col(f"`{key}`").alias("id"), text_digest(F.col(f"`{text}`")).alias("digest"))
                  .withColumn("row", F.monotonically_increasing_id()), "exact-dedup")
    winners = stored(_winners(rows, "digest", ["id", "row"], tracked), "exact-dedup")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("heavy_n is not null")
    w = Window.partitionBy("digest")
    light = (marked.where("heavy_n is null").drop("heavy_n", "heavy_win")
             .withColumn("heavy_n", F.count(F.lit(1)).over(w))
             .withColumn("heavy_win", F.max(F.struct("id", "row")).over(w)))
    return heavy.unionByName(light).select(
        F.col("id").alias(key), F.col("heavy_win.id").alias("keep_id"),
        F.col("heavy_n").cast("long").alias("group_size"),
        (F.col("row") == F.col("heavy_win.row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                          tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Frequent groups lose their copies before the shuffle; in the shuffle of the
    rest each task forwards at most one row per digest (group limit).
    """
    wide, names = numbered(docs)
    id_, text_ = (F.col(f"c{names.index(c)}") for c in (key, text))
    digest = text_digest(text_)
    rows = stored(wide.select(id_.alias("id"), digest.alias("digest")), "exact-dedup")
    winners = stored(_winners(rows, "digest", ["id"], tracked), "exact-dedup")
    left = (wide.withColumn("digest", digest).join(F.broadcast(winners), "digest", "left")
            .where(F.col("heavy_n").isNull() | F.col("heavy_win.id").eqNullSafe(id_)))
    w = Window.partitionBy("digest").orderBy(id_.desc_nulls_last())
    return (left.withColumn("rank", F.row_number().over(w)).where("rank = 1")
            .select(*wide.columns).toDF(*names))
