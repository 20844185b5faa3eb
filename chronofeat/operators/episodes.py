"""Episodes inside per-entity time sequences (break flags, ``case_id``, ``time``).

Semantics (global order: entity asc nulls first, time asc nulls first, then a
tiebreak used by ``lag`` only):

* a row *breaks* (starts a new episode) when
  ``NOT (entity = lag(entity)) OR lag(label, 1, 0) = 1`` is TRUE - three-valued,
  so a NULL entity on either side never breaks by itself and a NULL previous
  label never breaks;
* ``case_id`` = 1 + breaks over all rows up to the end of the row's
  (entity, time) peer group (RANGE frame: tied rows share it);
* ``time`` = rows of the same ``case_id`` up to the end of the peer group - 1.

No window ever spans the table, and there is one path for every input:

1. rows are range-partitioned on (entity, time, tiebreak), so a hot entity, rows
   without a time and rows tied in time spread over as many ranges as they need;
2. inside a range, windows give what its own rows know: lag, breaks, running
   counts to the end of the peer group, the last episode start. The result is
   checkpointed, which pins the ranges;
3. one row per range goes to the driver (``ranges`` of them, a parameter, whatever
   the input): a peer group or an episode may continue over many ranges, and a
   walk over the ranges settles where they start and end;
4. that table is broadcast back (again ``ranges`` rows) and a projection turns
   local values into global ones.

Rows are shuffled twice (to ranges, and into their windows) and never joined
with rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

OUTPUTS = ("brk", "prev_entity", "prev_label", "running_breaks", "case_id", "time")


def assign_episodes(df: DataFrame, entity: str, ts: str, label: str, tiebreak: str,
                    outputs=("case_id", "time"), ranges: int | None = None) -> DataFrame:
    """``df`` plus the episode columns named in ``outputs`` (see OUTPUTS).

    ``tiebreak`` orders tied rows for ``lag``; it should be unique. ``ranges``
    defaults to ``spark.sql.shuffle.partitions``.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = reliable_checkpoint(_local(df, entity, ts, label, tiebreak, ranges))
    edges = _edges(local, entity, ts, label, tiebreak)
    rows = local.join(F.broadcast(_settled(edges)), "_range")  # at most ``ranges`` rows
    head = F.col("_row") == 1
    first, last = F.col("_rank") == 1, F.col("_to") == F.col("_n")
    run = F.when(first, F.col("b_first_run")).when(last, F.col("b_last_run")).otherwise(
        F.col("b_run") + F.col("_run"))
    to = F.when(first, F.col("b_first_to")).when(last, F.col("b_last_to")).otherwise(
        F.col("b_pos") + F.col("_to"))
    start = F.when(first, F.col("b_first_start")).when(last, F.col("b_last_start")).otherwise(
        F.coalesce(F.col("b_pos") + F.col("_start"), F.col("b_first_start")))
    made = {
        "brk": F.when(head, F.col("b_break")).otherwise(F.col("_brk")).cast("int"),
        "prev_entity": F.when(head, F.col("b_prev_entity")).otherwise(F.col("_prev_entity")),
        "prev_label": F.when(head, F.col("b_prev_label")).otherwise(F.col("_prev_label")),
        "running_breaks": run.cast("long"),
        "case_id": (run + 1).cast("long"),
        "time": (to - start).cast("long"),
    }
    return rows.select(*df.columns, *[made[o].alias(o) for o in outputs])


def time_polynomial(df: DataFrame, time_col: str = "time", degrees=(2, 3)) -> DataFrame:
    """``time2``, ``time3`` ... as doubles (``pow`` of the step counter)."""
    return df.withColumns({f"{time_col}{d}": F.pow(F.col(time_col), F.lit(d)) for d in degrees})


def _local(df, entity, ts, label, tiebreak, ranges):
    """What the rows of each range know by themselves; positions and runs count from its start."""
    keys = [F.col(entity).asc_nulls_first(), F.col(ts).asc_nulls_first()]
    order = [*keys, F.col(tiebreak).asc_nulls_first()]
    split = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    in_range = Window.partitionBy("_range")
    by_row, by_peer = in_range.orderBy(*order), in_range.orderBy(*keys)  # the latter: RANGE frames
    rows = split.select(
        "*", F.row_number().over(by_row).alias("_row"),
        F.lag(entity).over(by_row).alias("_prev_entity"),
        F.lag(label).over(by_row).alias("_prev_label"))
    rows = rows.withColumn("_brk", F.when((F.col("_row") > 1) & (
        ~(F.col(entity) == F.col("_prev_entity")) | (F.col("_prev_label") == 1)), 1).otherwise(0))
    rows = rows.select(
        "*", F.rank().over(by_peer).alias("_rank"), F.sum("_brk").over(by_peer).alias("_run"),
        F.count(F.lit(1)).over(by_peer).alias("_to"),
        F.sum("_brk").over(Window.partitionBy("_range", entity, ts)).alias("_in_peer"))
    # the first peer group's own start is not known here
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(in_range))
    return rows.withColumn("_start", F.max(F.when(
        (F.col("_in_peer") > 0) & (F.col("_rank") > 1), F.col("_rank"))).over(by_peer))


def _edges(local, entity, ts, label, tiebreak):
    """One row per range: its counts, its first and last peer group, and the row before it."""
    at = F.struct("_rank", "_row")
    inner = (F.col("_start") == F.col("_rank")) & (F.col("_to") < F.col("_n"))
    edges = local.groupBy("_range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_brk").alias("breaks"),
        F.max(F.when(F.col("_rank") == 1, F.col("_run"))).alias("first_run"),
        F.max(F.when(F.col("_rank") == 1, F.col("_to"))).alias("first_to"),
        F.max("_rank").alias("last_rank"), F.max_by("_in_peer", at).alias("last_breaks"),
        F.max(F.when(inner, F.col("_rank"))).alias("inner_start"),
        *[F.min_by(c, at).alias(n) for c, n in ((entity, "e0"), (ts, "t0"))],
        *[F.max_by(c, at).alias(n) for c, n in ((entity, "e1"), (ts, "t1"), (label, "y1"))])
    before = Window.orderBy("_range")  # over one row per range
    prev = F.struct("e1", "t1", "y1")
    edges = edges.withColumn("before", F.lag(prev).over(before))
    same = (F.col("before").isNotNull() & F.col("before.e1").eqNullSafe(F.col("e0"))
            & F.col("before.t1").eqNullSafe(F.col("t0")))
    broke = F.when(~(F.col("e0") == F.col("before.e1")) | (F.col("before.y1") == 1), 1).otherwise(0)
    return edges.select(
        "_range", "n", "breaks", "first_run", "first_to", "last_rank", "last_breaks", "inner_start",
        same.alias("continues"),
        F.when(F.col("before").isNull(), 0).otherwise(broke).alias("break"),
        F.col("before.e1").alias("b_prev_entity"),
        # lag(label, 1, 0): the default belongs to the first row of all
        F.when(F.col("before").isNull(), 0).otherwise(F.col("before.y1")).alias("b_prev_label"))


def _settled(edges: DataFrame) -> DataFrame:
    """The ranges' rows with global values: where peer groups end and episodes start.

    The walk sees integers only, one small row per range.
    """
    edges = reliable_checkpoint(edges)
    rows = sorted((r.asDict() for r in edges.drop("b_prev_entity", "b_prev_label").collect()),
                  key=lambda r: r["_range"])
    pos = run = 0
    for r in rows:
        run += r["break"]
        r |= {"b_pos": pos, "b_run": run, "b_break": r["break"]}
        pos, run = pos + r["n"], run + r["breaks"]
    after = None
    for r in reversed(rows):  # peer groups end in the last range they reach
        end = (r["b_run"] + r["breaks"], r["b_pos"] + r["n"])
        if after is not None and after["continues"]:
            end = (after["b_first_run"], after["b_first_to"])
        r["b_last_run"], r["b_last_to"] = end
        if r["last_rank"] > 1:
            end = (r["b_run"] + r["first_run"], r["b_pos"] + r["first_to"])
        r["b_first_run"], r["b_first_to"] = end
        after = r
    before = None
    for r in rows:  # an episode starts where the running count changes
        if before is None:
            start = 1
        elif r["continues"] or r["b_first_run"] == before["b_last_run"]:
            start = before["b_last_start"]
        else:
            start = r["b_pos"] + 1
        r["b_first_start"] = start
        if r["last_rank"] > 1:
            if r["b_last_run"] != r["b_run"] + r["breaks"] - r["last_breaks"]:
                start = r["b_pos"] + r["last_rank"]
            elif r["inner_start"] is not None:
                start = r["b_pos"] + r["inner_start"]
        r["b_last_start"] = start
        before = r
    names = ("b_pos", "b_run", "b_break", "b_first_run", "b_first_to", "b_first_start",
             "b_last_run", "b_last_to", "b_last_start")
    walked = edges.sparkSession.createDataFrame(
        [(r["_range"], *[r[n] for n in names]) for r in rows],
        "_range int, " + ", ".join(f"{n} long" for n in names))
    return walked.join(edges.select("_range", "b_prev_entity", "b_prev_label"), "_range")
