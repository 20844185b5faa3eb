"""Textbook forms with windows over the whole table, for parity tests and the bench.

One task holds every row, so the library itself does not use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plain_episodes(df: DataFrame, entity: str, ts: str, label: str, tiebreak: str,
                   outputs=("case_id", "time")) -> DataFrame:
    """The episode columns straight from their definition."""
    keys = [F.col(entity).asc_nulls_first(), F.col(ts).asc_nulls_first()]
    rows, peers = Window.orderBy(*keys, F.col(tiebreak).asc_nulls_first()), Window.orderBy(*keys)
    out = df.withColumns({"_e": F.lag(entity).over(rows), "_y": F.lag(label, 1, 0).over(rows)})
    out = out.withColumn("_b", F.expr(f"int(coalesce(not(`{entity}` = _e) or _y = 1, false))"))
    out = out.withColumn("_r", F.sum("_b").over(peers))
    steps = F.count(F.lit(1)).over(Window.partitionBy("_r").orderBy(*keys)) - 1
    made = {"brk": F.col("_b"), "prev_entity": F.col("_e"), "prev_label": F.col("_y"),
            "running_breaks": F.col("_r"), "case_id": F.col("_r") + 1, "time": steps}
    return out.select(*df.columns, *[made[o].alias(o) for o in outputs])


def plain_time_split(df: DataFrame, ts: str, bounds=(0.8, 0.9), out: str = "split") -> DataFrame:
    """Rows labelled by a global ``percent_rank``."""
    place = F.percent_rank().over(Window.orderBy(F.col(ts).asc_nulls_first()))
    named = F.when(F.col("_p") > bounds[0], F.when(F.col("_p") < bounds[1], "val").otherwise(
        "test")).otherwise("train")
    return df.withColumn("_p", place).withColumn(out, named).drop("_p")
