"""Table scans and the two fixture views used by the queries and tests.

The reference reads one pre-joined catalog view (``select * from <view>``).
Here any Parquet table directory can be read and registered under a name;
``sales_view`` and ``events_view`` build the stand-in inputs described in
FIXTURES.md from the driver's tables. Joins are left to Catalyst / AQE: the
dimension sides become broadcasts only when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``, otherwise they stay sort-merge joins.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_STRING_CATEGORIES = ["l_linestatus", "o_orderstatus", "o_orderpriority",
                           "c_mktsegment", "p_brand", "p_type"]
SALES_INT_CATEGORIES = ["month", "quarter", "dom", "dow", "c_nationkey", "p_size"]
SALES_CATEGORIES = SALES_STRING_CATEGORIES + SALES_INT_CATEGORIES
SALES_CONTINUOUS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "o_totalprice", "c_acctbal", "p_retailprice"]
SALES_LABEL = "label"
SALES_TIME = "o_orderdate"


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def scan_view(spark: SparkSession, name: str) -> DataFrame:
    """All columns of a named view or table (``select * from name``)."""
    return spark.table(name)


def sales_view(spark: SparkSession, data_dir: str) -> DataFrame:
    """lineitem x orders x customer x part, one row per lineitem row."""
    li = read_table(spark, data_dir, "lineitem")
    od = read_table(spark, data_dir, "orders")
    cu = read_table(spark, data_dir, "customer")
    pa = read_table(spark, data_dir, "part")
    # customers meet the fewer orders first, so line items cross two exchanges and not three
    ordered = od.join(cu, od.o_custkey == cu.c_custkey)
    joined = (li.join(ordered, li.l_orderkey == F.col("o_orderkey"))
              .join(pa, li.l_partkey == pa.p_partkey))
    d = F.col("o_orderdate")
    return joined.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate",
        "c_mktsegment", "c_nationkey", "c_acctbal",
        "p_brand", "p_type", "p_size", "p_retailprice",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.month(d).alias("month"), F.quarter(d).alias("quarter"),
        F.dayofmonth(d).alias("dom"), F.dayofweek(d).alias("dow"),
    )


def _hour_ntz(ts):
    """Truncate to the hour without passing through the session time zone."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def events_view(spark: SparkSession, data_dir: str) -> DataFrame:
    """events with NULL-injected entities and hour-truncated (tied) times."""
    ev = read_table(spark, data_dir, "events")
    return ev.select(
        "event_id",
        F.when(F.col("user_id") > 2, F.col("user_id").cast("string")).alias("entity"),
        "ts",
        _hour_ntz(F.col("ts")).alias("ts_hour"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        "value",
        "event_type",
    )
