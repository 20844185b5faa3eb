"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the cluster's shared folder and read back.

    Cuts the lineage: later passes read these files, so a lost executor costs
    a re-read and non-deterministic columns (row ids) keep their values.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (null: 0) as a long, on the JVM."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_key(key: Column, text: Column) -> list[Column]:
    """Two columns that identify a document: its id, and a hash of its id and text.

    Rows that agree in both are repeats of one row; every operator treats them alike.
    """
    return [key.alias("doc_key"), F.xxhash64(key, F.coalesce(text, F.lit(""))).alias("doc_hash")]


def row_name(key: Column, text: Column) -> Column:
    """A 128-bit name (hex MD5) of a document's id and text; rows that share it are repeats."""
    return F.md5(F.concat_ws("\0", F.when(key.isNull(), "0").otherwise("1"),
                             F.coalesce(key.cast("string"), F.lit("")),
                             F.coalesce(text, F.lit(""))).cast("binary"))


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ..., so scratch columns of other names cannot clash; its names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
