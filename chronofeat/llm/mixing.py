"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of
its documents (at most ``max_copies``). The whole part is given to every
document; the fraction is rounded jointly: documents are paired, and mass
(probability x size) moves between the two at random until one of them is
settled at 0 or 1, so the source's expected words never change. Leaves of at
most about ``leaf_rows`` documents are settled independently (a hot source has
many leaves), each leaving one unsettled document; these residuals are combined
``fan_in`` at a time in a reduction tree, one small shuffle per level, until one
per source is left and drawn. A source's taken words therefore miss its target
by less than one document.

Everything random comes from hashes of ids, leaves from hashes too, so reruns
agree however the input is partitioned.

Nulls: a null text has size 0 and takes nothing; a null source is a source of
its own, last in order; a null id is an id. Repeated rows are separate
documents. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ordered_scan
from .common import partitions, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
LEAF_ROWS = 1024
FAN_IN = 32
_M = (1 << 64) - 1


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) from two 64-bit hashes (splitmix64 finaliser)."""
    z = ((a ^ (b * 0x9E3779B97F4A7C15)) + 0x9E3779B97F4A7C15) & _M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
    return ((z ^ (z >> 31)) >> 11) / float(1 << 53)


def settle(sizes, probs, marks):
    """Pivotal rounding of one node: settled picks (0.0 / 1.0), and at most one open fraction.

    ``marks`` are the 64-bit hashes that stand for the documents. Larger
    documents go first, so what stays open is small.
    """
    out = list(probs)
    order = sorted(range(len(out)), key=lambda i: (-sizes[i], marks[i]))
    open_i = None
    for i in order:
        if not 0.0 < out[i] < 1.0:
            continue
        if open_i is None:
            open_i = i
            continue
        j = open_i
        si, sj = sizes[i], sizes[j]
        up_i = min(si * (1 - out[i]), sj * out[j])
        up_j = min(sj * (1 - out[j]), si * out[i])
        if _uniform(marks[i], marks[j]) * (up_i + up_j) < up_j:
            move = up_i
        else:
            move = -up_j
        out[i] += move / si
        out[j] -= move / sj
        for k in (i, j):
            if out[k] < 1e-9:
                out[k] = 0.0
            elif out[k] > 1 - 1e-9:
                out[k] = 1.0
        open_i = i if 0 < out[i] < 1 else j if 0 < out[j] < 1 else None
    return out


def _settle_node(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf["prob"] = settle(pdf["size"].tolist(), pdf["prob"].tolist(),
                         [int(m) & _M for m in pdf["mark"]])
    return pdf


def source_targets(sizes: DataFrame, share: float = 1.5, weights=WEIGHTS,
                   max_copies: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size).

    The total is ``share`` of all sizes, split by the repeating ``weights`` in
    code point order of the sources; what exceeds ``max_copies`` times a
    source's size is reshared. In order of cap over weight the capped sources
    come first, so running sums give the fixed point without iterating.
    """
    src = stored(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("size").alias("source_size")), "mix-sources")
    ranked = ordered_scan(src, [F.col("source").asc_nulls_last()], sums={"place": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    ranked = (ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(max_copies))
              .withColumn("ratio", F.col("cap") / F.col("w")))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    all_w = ranked.agg(F.sum("w")).first()[0] or 0.0
    budget = share * total
    before = ordered_scan(ranked, ["ratio", "place"],
                          sums={"cap_before": F.col("cap"), "w_before": F.col("w")})
    rest = F.lit(float(budget)) - F.col("cap_before")
    marked = stored(before.withColumn(
        "capped", rest >= F.col("ratio") * (F.lit(float(all_w)) - F.col("w_before"))), "mix-targets")
    capped, free_w = marked.agg(
        F.sum(F.when(F.col("capped"), F.col("cap"))),
        F.sum(F.when(~F.col("capped"), F.col("w")))).first()
    level = (budget - (capped or 0.0)) / free_w if free_w else 0.0
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.lit(float(level)) * F.col("w")))
    return marked.select("source", "n", "source_size", target.alias("target"))


def _told_apart(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Rows (id, source, size) with ``repeat``: 0, 1, ... over rows that agree in all three.

    Such rows are interchangeable, so they are counted and made again from the
    count, in blocks; however many there are, they spread over tasks and leaves.
    """
    groups = stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")),
                    "mix-groups")
    few = groups.where(F.col("n") <= block).withColumn("first", F.lit(0).cast("long"))
    many = groups.where(F.col("n") > block).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    many = many.repartition(partitions(rows.sparkSession), "id", "source", "size", "first")
    last = F.least(F.col("first") + block, F.col("n")) - 1
    return few.unionByName(many).select(
        "id", "source", "size", F.explode(F.sequence("first", last)).alias("repeat"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        share: float = 1.5, weights=WEIGHTS, max_copies: float = 2.0, seed: int = 7,
        leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: (key, size, source_size, target, taken, copies)."""
    rows = stored(_told_apart(docs.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"))), "mix-sizes")
    goals = stored(source_targets(rows, share, weights, max_copies), "mix-goals")
    most = goals.agg(F.max("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1.0, most / leaf_rows))))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mark = F.xxhash64(F.lit(seed), "id", "size", "repeat")
    leaves = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(
        F.col("n") / F.lit(float(leaf_rows)))))).cast("long")
    planned = (rows.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
               .select("id", F.col("r.source").alias("source"), "size", "source_size", "target",
                       copies.alias("want"), mark.alias("mark"),
                       F.pmod(mark, leaves).alias("node"))
               .withColumn("whole", F.floor(F.col("want") + F.lit(1e-9)).cast("long"))
               .withColumn("prob", F.when(F.col("size") > 0, F.greatest(
                   F.lit(0.0), F.col("want") - F.col("whole"))).otherwise(F.lit(0.0))))
    planned = planned.withColumn("prob", F.when(F.col("prob") < 1e-9, 0.0).otherwise(F.col("prob")))
    is_open = (F.col("prob") > 0) & (F.col("prob") < 1)
    settled, work = planned.where(~is_open), planned.where(is_open)
    while True:
        done = stored(work.groupBy("source", "node").applyInPandas(_settle_node, planned.schema),
                      "mix-level")
        if levels <= 0:
            drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "mark"), F.lit(1 << 30)) / F.lit(1 << 30)
            settled = settled.unionByName(done.withColumn(
                "prob", F.when(is_open, (drawn < F.col("prob")).cast("double"))
                .otherwise(F.col("prob"))))
            break
        settled = settled.unionByName(done.where(~is_open))
        shift = int(math.log2(fan_in))
        work = done.where(is_open).withColumn("node", F.expr(f"shiftright(node, {shift})"))
        levels -= shift
    n = F.col("whole") + F.col("prob").cast("long")
    return settled.select(F.col("id").alias(key), "size", "source_size", "target",
                          (n * F.col("size")).alias("taken"), n.alias("copies"))
