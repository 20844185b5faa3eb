"""Episodes of data that arrives in batches: old rows are never read again.

:func:`append_episodes` takes a batch and one state row per entity and returns
the batch with (``case_no``, ``time``), the next state and the rows that came too
late. Both columns are numbers within an entity, so later batches leave them as
they are; :func:`global_episodes` turns them into the ``case_id`` and ``time`` of
:func:`chronofeat.operators.episodes.assign_episodes` over all rows so far, from
the state alone.

A state row (entity, ts, label, case_no, time) describes the last row of its
entity in the order of ``assign_episodes``. It enters the batch as one head row
before the entity's new rows (a new entity gets one with a NULL label, which never
breaks), so episodes, breaks and ties come from the one operator, which spreads a
hot entity over many ranges.

Defined cases: a row whose time is not after its entity's state (an equal time
would change the peer group of rows already returned; a NULL time sorts first) is
*late* and returned untouched; NULL entities are one entity; an empty batch leaves
the state as it is; extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint
from .episodes import assign_episodes
from .scan import ordered_scan

STATE = ("entity", "ts", "label", "case_no", "time")


def empty_state(spark: SparkSession, rows: DataFrame, entity: str, ts: str, label: str) -> DataFrame:
    """The state before the first batch, with the types of ``rows``."""
    types = [rows.schema[c].dataType for c in (entity, ts, label)] + [T.LongType()] * 2
    return spark.createDataFrame([], T.StructType(
        [T.StructField(n, t) for n, t in zip(STATE, types)]))


def append_episodes(batch: DataFrame, state: DataFrame, entity: str, ts: str, label: str,
                    tiebreak: str, ranges: int | None = None):
    """``(rows, state, late)``: the batch with ``case_no`` and ``time``, the next state, late rows.

    All three are checkpointed or read from checkpoints, so they outlive the batch's input.
    """
    names = batch.columns
    keyed = batch.select(
        F.col(_q(entity)).alias("e"), F.col(_q(ts)).alias("t"), F.col(_q(label)).alias("y"),
        F.col(_q(tiebreak)).alias("b"), F.struct(*[F.col(_q(c)).alias(f"c{i}")
                                                   for i, c in enumerate(names)]).alias("row"))
    known = state.select(F.col("entity").alias("se"), F.col("ts").alias("st"),
                         F.col("label").alias("sy"), F.col("case_no").alias("sc"),
                         F.col("time").alias("sm"))
    # per entity, not per row: what the batch holds of it, and its state
    seen = keyed.groupBy("e").agg(F.min("t").alias("first"),
                                  F.max(F.col("t").isNull()).alias("nulls"))
    met = reliable_checkpoint(
        seen.join(known, F.col("e").eqNullSafe(F.col("se")), "left"))
    is_late = (F.col("sc").isNotNull()
               & F.coalesce(F.col("t") <= F.col("st"), F.col("t").isNull()))
    behind = met.where(F.col("sc").isNotNull() & (
        F.col("nulls") | F.coalesce(F.col("first") <= F.col("st"), F.lit(False))))
    # only entities with late rows are joined to rows: usually none, broadcast at run time
    marked = keyed.join(behind.select(F.col("e").alias("se"), "st", "sc"),
                        F.col("e").eqNullSafe(F.col("se")), "left").withColumn("late", is_late)
    late = reliable_checkpoint(marked.where("late").select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)]))

    def placed(df, row):
        return df.select("e", F.struct(F.lit(row).alias("r"), F.col("t")).alias("at"), "y", "b",
                         "row", "sc", "sm")

    nothing = {c: F.lit(None).cast(keyed.schema[c].dataType) for c in ("b", "row")}
    heads = met.select("e", F.col("st").alias("t"), F.col("sy").alias("y"),
                       F.coalesce("sc", F.lit(0)).alias("sc"),
                       F.coalesce("sm", F.lit(-1)).alias("sm")).withColumns(nothing)
    fresh = (marked.where(~F.col("late")).drop("se", "st", "sc", "late")
             .withColumns({"sc": F.lit(None).cast("long"), "sm": F.lit(None).cast("long")}))
    both = assign_episodes(placed(heads, 0).unionByName(placed(fresh, 1)), "e", "at", "y", "b",
                           ("running_breaks", "time"), ranges)
    both = reliable_checkpoint(both)
    base = both.where("at.r = 0").select(F.col("e").alias("he"), F.col("running_breaks").alias("hr"),
                                         F.col("time").alias("hm"), F.col("sc").alias("hc"),
                                         F.col("sm").alias("hs"))
    own = F.col("running_breaks") - F.col("hr")  # breaks of the entity in this batch
    rows = reliable_checkpoint(
        both.where("at.r = 1").join(base, F.col("e").eqNullSafe(F.col("he"))).select(
            "e", F.col("at.t").alias("t"), "y", "b", "row", (F.col("hc") + own).alias("case_no"),
            F.when(own == 0, F.col("hs") + F.col("time") - F.col("hm")).otherwise(F.col("time"))
            .alias("time")))
    last = (rows.groupBy("e").agg(F.max_by(F.struct("t", "y", "case_no", "time"),
                                           F.struct("t", "b")).alias("l"))
            .select(F.col("e").alias("entity"), F.col("l.t").alias("ts"), F.col("l.y").alias("label"),
                    F.col("l.case_no").alias("case_no"), F.col("l.time").alias("time")))
    same = F.col("n.entity").eqNullSafe(F.col("o.entity"))
    kept = state.alias("o").join(last.alias("n"), same, "left_anti")
    return (rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)],
                        "case_no", "time"),
            reliable_checkpoint(kept.unionByName(last)), late)


def episode_offsets(state: DataFrame) -> DataFrame:
    """(entity, first_case, time_add): what turns numbers within an entity into global ones.

    ``time_add`` counts rows of the episode that a NULL entity leaves open for the
    next one; it belongs to ``case_no`` 0 alone.
    """
    order = [F.col("entity").asc_nulls_first()]
    prev = ordered_scan(state, order, lags={"prev": F.struct("entity", "label", "time")})
    head = (F.when(F.col("prev").isNull(), 0)
            .when(~(F.col("entity") == F.col("prev.entity")), 1)
            .when(F.col("prev.label") == 1, 1).otherwise(0)).cast("long")
    scanned = ordered_scan(prev.withColumn("head", head), order,
                           sums={"before": F.col("head") + F.col("case_no")})
    return scanned.select(
        "entity", (F.col("before") + F.col("head") + 1).alias("first_case"),
        F.when(F.col("prev").isNotNull() & (F.col("head") == 0), F.col("prev.time") + 1)
        .otherwise(0).alias("time_add"))


def global_episodes(rows: DataFrame, state: DataFrame, entity: str) -> DataFrame:
    """Rows of :func:`append_episodes` with ``case_id`` and the global ``time``.

    One join with a row per entity; ``state`` is the one after the last batch.
    """
    names = [c for c in rows.columns if c not in ("case_no", "time")]
    numbered = rows.select(F.col(_q(entity)).alias("e"), "case_no", "time", F.struct(
        *[F.col(_q(c)).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    joined = numbered.join(episode_offsets(state), F.col("e").eqNullSafe(F.col("entity")))
    return joined.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)],
        (F.col("first_case") + F.col("case_no")).alias("case_id"),
        (F.col("time") + F.when(F.col("case_no") == 0, F.col("time_add")).otherwise(0)).alias("time"))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
