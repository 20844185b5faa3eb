"""Parquet export, shards for parallel readers, preview and artifact listing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files of this size suit scans of a large table.
TARGET_BYTES = 128 * 1024 * 1024

#: At most about so many bytes of rows are sorted by one task, whatever they take as Parquet.
SORT_BYTES = 512 * 1024 * 1024

#: Unions of more frames than this take long to plan.
MERGED_AT_ONCE = 64

#: Fixed value: the small row group that gives many readers a group each.
ROW_GROUP_BYTES = 1024 * 1024


def write_shards(df: DataFrame, path: str, num_files: int | None = None,
                 block_size: int | None = None, partition_by=None,
                 max_records_per_file: int | None = None, mode: str = "overwrite") -> str:
    """Write ``df`` as Parquet; ``block_size`` (bytes) sets the row groups' size.

    Spark's default size suits scans; :data:`ROW_GROUP_BYTES` gives each of many
    readers of a small output some groups.

    ``num_files=None`` (default) writes one file per task with no shuffle -
    the right choice at scale, where there are already far more tasks than
    readers; ``max_records_per_file`` then bounds file size. ``num_files=n``
    reproduces the reference's round-robin ``repartition(n)`` layout (a full
    shuffle; use it for small outputs that must have an exact file count).
    ``partition_by`` writes several outputs (e.g. all three splits) in one job.
    """
    out = df.repartition(num_files) if num_files else df
    w = out.write.mode(mode)
    if block_size:
        w = w.option("parquet.block.size", block_size)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def bytes_per_row(df: DataFrame, scratch: str, rows: int, sample_rows: int = 50_000) -> float:
    """Parquet bytes a row of ``df`` takes, measured on at most about ``sample_rows`` rows.

    The sample is written as one file under ``scratch``; it plans a layout and
    never decides which rows are written.
    """
    if rows == 0:
        return 0.0
    share = min(1.0, sample_rows / rows)
    some = df if share == 1.0 else df.sample(share, seed=7)
    some.repartition(1).write.mode("overwrite").parquet(scratch)
    written = df.sparkSession.read.parquet(scratch).count()
    if written == 0:
        return 0.0
    files = artifacts(df.sparkSession, scratch).where(F.col("path").endswith(".parquet"))
    return files.agg(F.sum("length")).first()[0] / written


def _row_bytes(df: DataFrame, rows: int, sample_rows: int = 50_000) -> float:
    """Bytes a row of ``df`` takes in a sort at most, by its JSON form, on at most about
    ``sample_rows`` rows; like :func:`bytes_per_row` it only plans."""
    some = df.sample(min(1.0, sample_rows / rows), seed=7) if rows > sample_rows else df
    text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return 40 + 8 * len(df.columns) + (some.agg(F.avg(text)).first()[0] or 0.0)


def _merge_files(df: DataFrame, path: str, sorted_path: str, target_bytes: int, by: list,
                 block_size: int | None, rows: int, mode: str) -> int:
    """Write the sorted files under ``sorted_path`` again as files near ``target_bytes``;
    returns the planned files.

    Files of a folder follow each other in the order of their names; neighbours that
    make up two files are read by one frame of two tasks, and no task sorts.
    """
    spark = df.sparkSession
    schema = T.StructType([f for f in df.schema.fields if f.name not in by])
    folders: dict[str, list] = {}
    for r in artifacts(spark, sorted_path).where(F.col("path").endswith(".parquet")).collect():
        folders.setdefault(r["path"].rpartition("/")[0], []).append((r["path"], r["length"]))
    size = sum(n for files in folders.values() for _, n in files) / rows
    most, planned = math.ceil(3 * target_bytes / size), 0  # folders compress unlike each other
    if by:
        write_shards(df.where(F.lit(False)), path, partition_by=by, mode=mode)
        mode = "append"
    for folder, files in sorted(folders.items()):
        # .../sorted/a=1/b=2 -> a=1/b=2
        to = "/".join([path, *folder.split("/")[-len(by):]]) if by else path
        total = sum(n for _, n in files)
        wanted = max(1, round(total / target_bytes))
        planned += wanted
        pairs: list[list[str]] = [[] for _ in range((wanted + 1) // 2)]
        before = 0
        for name, n in sorted(files):
            pairs[min(len(pairs) - 1, int((before + n / 2) / total * wanted) // 2)].append(name)
            before += n
        # a pair is two tasks: a union of frames of one task each would be one task
        frames = [spark.read.schema(schema).parquet(*p).coalesce(
            1 if wanted % 2 and i == len(pairs) - 1 else 2) for i, p in enumerate(pairs) if p]
        for i in range(0, len(frames), MERGED_AT_ONCE):
            out = frames[i]
            for f in frames[i + 1:i + MERGED_AT_ONCE]:
                out = out.union(f)
            write_shards(out, to, None, block_size, None, most, mode)
            mode = "append"
    return planned


def write_sized(df: DataFrame, path: str, scratch: str, target_bytes: int = TARGET_BYTES,
                partition_by=(), cluster_by=(), block_size: int | None = None,
                mode: str = "overwrite", sort_bytes: int = SORT_BYTES) -> int:
    """Write ``df`` as Parquet files near ``target_bytes``, clustered; returns the planned files.

    Rows are counted, a row's size is measured (:func:`bytes_per_row`), and one
    range exchange on (``partition_by``, ``cluster_by``, a hash of the row) deals
    them evenly, so a value that very many rows share spreads over files. Files
    and row groups hold narrow ranges of ``cluster_by`` and a filter on it skips
    the others. Only equal rows cannot be told apart by ranges; a limit of rows
    per file, one and a half times the plan, cuts them (and any error of the
    sampled bounds). Each value of ``partition_by`` may add one smaller file.

    Rows that compress well take far more memory in a sort than in a file. If a
    file's rows take more than ``sort_bytes``, narrower ranges are sorted and written
    under ``scratch`` first, and neighbouring ones merged into files without a sort.

    ``df`` is read four times (count, two samples, bounds and write): give a stored
    or cheap one, whose rows do not change between the passes.
    """
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    cluster = [cluster_by] if isinstance(cluster_by, str) else list(cluster_by)
    rows = df.count()
    size = bytes_per_row(df, f"{scratch}/sample", rows)
    files = max(1, math.ceil(rows * size / target_bytes))
    keys = [F.col(f"`{c}`") for c in by + cluster]
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields
              if "map<" not in f.dataType.simpleString()]
    ranges = files
    if keys and mode != "ignore":  # which is one write or none
        ranges = max(files, math.ceil(rows * _row_bytes(df, rows) / sort_bytes))
    out = df.repartitionByRange(ranges, *keys, F.xxhash64(*hashed)) if ranges > 1 else \
        df.repartition(1)
    if keys:
        out = out.sortWithinPartitions(*keys)
    if ranges > files:
        write_shards(out, f"{scratch}/sorted", partition_by=by)
        return _merge_files(df, path, f"{scratch}/sorted", target_bytes, by, block_size, rows, mode)
    most = math.ceil(1.5 * target_bytes / size) if size else None
    write_shards(out, path, None, block_size, by, most, mode)
    return files


def shard_column(df: DataFrame, key: str | None, num_shards: int, out: str = "shard",
                 method: str = "hash") -> DataFrame:
    """A stable shard number in ``[0, num_shards)`` for every row.

    ``hash`` = ``pmod(xxhash64(key), n)`` spreads any key evenly; ``mod`` =
    ``pmod(key, n)`` for integer keys (reproducible outside Spark);
    ``key=None`` uses the scan partition the row came from.
    """
    n = F.lit(num_shards)
    if key is None:
        expr = F.pmod(F.spark_partition_id(), n)
    elif method == "hash":
        expr = F.pmod(F.xxhash64(F.col(key)), n)
    elif method == "mod":
        expr = F.pmod(F.col(key).cast("long"), n)
    else:
        raise ValueError(f"unknown shard method {method!r}")
    return df.withColumn(out, expr.cast("int"))


def shard_files(spark: SparkSession, path: str, num_shards: int) -> list[list[str]]:
    """Data files of each reader: dealt out in turn from the largest down, so shards are even.

    One listing (a row per file) serves all shards, and whenever there are as
    many files as readers no reader is left without one.
    """
    files = sorted((-r["length"], r["path"]) for r in artifacts(spark, path).collect()
                   if r["path"].endswith(".parquet"))
    return [[f for _, f in files[i::num_shards]] for i in range(num_shards)]


def read_shards(spark: SparkSession, path: str, num_shards: int) -> list[DataFrame]:
    """The rows of every reader: whole files, disjoint, exhaustive, from one listing.

    Reading a shard opens its own files only; one without a file is an empty
    frame with the dataset's schema.
    """
    base = spark.read.parquet(path)
    return [spark.read.schema(base.schema).option("basePath", path).parquet(*files)
            if files else base.limit(0) for files in shard_files(spark, path, num_shards)]


def read_shard(spark: SparkSession, path: str, shard: int, num_shards: int) -> DataFrame:
    """Rows of reader ``shard`` out of ``num_shards``."""
    return read_shards(spark, path, num_shards)[shard]


def shard_counts(df: DataFrame, shard: str = "shard") -> DataFrame:
    return df.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, order_by, n: int = 4) -> DataFrame:
    """First ``n`` rows in a stated order (top-k per partition, then a merge)."""
    return df.orderBy(*order_by).limit(n)


def partition_count(df: DataFrame) -> int:
    """Number of partitions of the physical plan (a layout check)."""
    return df.rdd.getNumPartitions()


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of every file under ``path``."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "modificationTime", "length"))
