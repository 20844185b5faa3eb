"""Session helpers: defaults for a local test session and a reliable checkpoint.

On a cluster the session is created by the platform; nothing here overrides
what the cluster already configured. ``spark.checkpoint.dir`` in particular
is read from the session and only set when it is missing (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A ``local[cores]`` session with AQE on, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronofeat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names.

    Library code only ever uses a folder it is given; a session without one is
    an error here (tests, the bench and the driver contract set one first, see
    ``use_local_checkpoint_dir``).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def use_local_checkpoint_dir(spark: SparkSession) -> None:
    """Give a local-master session without ``spark.checkpoint.dir`` a fresh folder.

    Called by entry points only (tests, bench, driver contract). One process
    holds driver and executors there, so a local folder is shared by
    construction; any other master must name its own folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronofeat-ckpt-"))


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (for exports, models)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "chronofeat", *parts, uuid.uuid4().hex)


def reuse(df: DataFrame) -> DataFrame:
    """Keep ``df`` (memory, spilling to disk) for several passes; the caller unpersists it.

    Worth it where a pass would repeat a join or a window; a plain scan is better
    read again, column by column. Lost blocks are recomputed from lineage.
    """
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return df
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back.

    For several passes over a costly join that read some of the columns each: as
    Parquet the rows are compact, and a pass reads its own columns only.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where a later step must see exactly the same rows/partition ids as an
    earlier one (range buckets), and where recomputing a long lineage after an
    executor loss would be expensive. Never a local checkpoint: those vanish
    with the executor that held them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
