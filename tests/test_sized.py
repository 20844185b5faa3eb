import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronofeat.sources import parquet


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows share one time; values do not compress."""
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)))
        .cast("int").alias("t.x"),
        F.sha2(F.col("id").cast("string"), 256).alias("value"),
        F.when(F.col("id") % 10 < 8, "train").otherwise("val").alias("split"),
        F.create_map(F.lit("k"), F.col("id")).alias("m")).checkpoint()


def files_of(spark, path):
    return parquet.artifacts(spark, path).where(F.col("path").endswith(".parquet")).collect()


def test_sizes_clusters_and_rows(spark, rows, tmp_path):
    path, target = str(tmp_path / "out"), 400_000
    planned = parquet.write_sized(rows, path, str(tmp_path / "s"), target, "split", "t.x",
                                  block_size=100_000)
    files = files_of(spark, path)
    assert planned <= len(files) <= planned + 2
    near = [f for f in files if target / 2 <= f["length"] <= target * 2]
    assert len(near) >= len(files) - 2  # a remainder for each split
    assert all(f["length"] <= target * 2 for f in files)
    back = spark.read.parquet(path)
    flat = [F.col("`t.x`"), "value", "split", F.col("m")["k"]]
    assert back.select(*flat).exceptAll(rows.select(*flat)).count() == 0
    assert back.count() == rows.count()
    groups = hit = 0
    for f in files:
        meta = pq.ParquetFile(f["path"].removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            col = next(meta.row_group(g).column(i) for i in range(meta.num_columns)
                       if meta.row_group(g).column(i).path_in_schema == "t.x")
            groups += 1
            hit += col.statistics.min <= 100 <= col.statistics.max
    assert groups > 10 and hit <= 4  # one or two groups a split hold time 100


def test_equal_rows_are_cut_by_rows_per_file(spark, tmp_path):
    same = spark.range(40_000).select(F.lit(1).alias("t"), F.lit("x").alias("v"))
    noisy = spark.range(20_000).select(F.lit(2).alias("t"), F.sha2(F.col("id").cast("string"), 256)
                                       .alias("v"))
    path = str(tmp_path / "out")
    parquet.write_sized(same.union(noisy), path, str(tmp_path / "s"), 200_000, cluster_by="t")
    assert spark.read.parquet(path).groupBy("t").count().orderBy("t").collect() == [
        (1, 40_000), (2, 20_000)]
    most = max(pq.ParquetFile(f["path"].removeprefix("file:")).metadata.num_rows
               for f in files_of(spark, path))
    assert most < 40_000


def test_empty_table_and_one_file(spark, rows, tmp_path):
    empty = str(tmp_path / "empty")
    assert parquet.write_sized(rows.where("false"), empty, str(tmp_path / "s"),
                               cluster_by="t.x") == 1
    assert spark.read.schema(rows.schema).parquet(empty).count() == 0
    one = str(tmp_path / "one")
    assert parquet.write_sized(rows, one, str(tmp_path / "s2")) == 1
    assert len(files_of(spark, one)) == 1


def test_rows_that_compress_are_sorted_in_small_tasks_and_merged(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("t"), F.pmod("id", F.lit(4)).alias("v"),
        F.lit("a long text that is the same in every row").alias("same"),
        F.when(F.col("id") % 10 < 8, "tr ain").when(F.col("id") % 10 < 9, "val").alias("split"))
    path, scratch, target = str(tmp_path / "out"), str(tmp_path / "s"), 40_000
    for mode in ("overwrite", "overwrite", "append"):
        planned = parquet.write_sized(rows, path, scratch, target, "split", "t", mode=mode,
                                      sort_bytes=500_000)
        if mode == "append":
            break
        assert spark.read.parquet(path).exceptAll(rows.select("t", "v", "same", "split")).count() == 0
        assert spark.read.parquet(path).count() == 200_000
        files = files_of(spark, path)
        big = [f for f in files if "tr%20ain" in f["path"] or "tr ain" in f["path"]]
        assert len(big) >= 3 and abs(len(files) - planned) <= 1
        assert all(target / 3 <= f["length"] <= target * 2 for f in big)
    assert spark.read.parquet(path).count() == 400_000
    parts = files_of(spark, scratch + "/sorted")
    assert len(parts) > 2 * planned  # no task sorted more than its share
    assert max(pq.ParquetFile(f["path"].removeprefix("file:")).metadata.num_rows
               for f in parts) < 30_000
    spans = []
    for f in big:
        t = spark.read.parquet(f["path"]).agg(F.min("t"), F.max("t")).first()
        spans.append(t[1] - t[0])
    assert max(spans) < 5000 * 3 / len(big)  # two files of neighbours at most
    alone = str(tmp_path / "alone")
    parquet.write_sized(rows, alone, scratch, target, cluster_by="t", sort_bytes=500_000)
    assert spark.read.parquet(alone).exceptAll(rows).count() == 0
    assert spark.read.parquet(alone).count() == 200_000
