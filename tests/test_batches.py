"""Row numbers, epochs and batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofeat.operators import batches, metrics
from chronofeat.session import shared_path


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 30, 31, 1000, 12_345])
def test_places_are_a_permutation(n):
    seen = [batches.EpochOrder(n, epoch, 5).place(np.arange(n)) for epoch in (0, 1)]
    for places in seen:
        assert sorted(places.tolist()) == list(range(n))
    if n > 10:
        assert (seen[0] != seen[1]).any()
        assert (seen[0] == batches.EpochOrder(n, 0, 5).place(np.arange(n))).all()
        assert (seen[0] != batches.EpochOrder(n, 0, 6).place(np.arange(n))).any()


def test_a_permutation_mixes_near_rows():
    n = 100_000
    places = batches.EpochOrder(n, 0, 1).place(np.arange(n))
    assert np.abs(np.corrcoef(places[:-1], places[1:])[0, 1]) < 0.02
    assert np.abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.02
    first = np.sort(np.flatnonzero(places < 1000))  # a batch holds rows from everywhere
    assert np.diff(first).max() < 2000


@pytest.mark.parametrize("n", [1, 2, 97, 4001])
def test_columns_equal_the_array_form(spark, n):
    df = spark.range(n).withColumnRenamed("id", "_x").withColumn("_left", F.lit("kept"))
    order = batches.EpochOrder(n, 3, 9)
    rows = order.with_place(df, "_x").collect()
    assert [r.place for r in sorted(rows, key=lambda r: r._x)] == order.place(np.arange(n)).tolist()
    assert {r._left for r in rows} == {"kept"} and rows[0].asDict().keys() == {"_x", "_left", "place"}


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), "id", F.lit(1).alias("_part"))
    rows = batches.number_rows(df.repartition(5), [F.col("g").desc(), "id"], partitions=13).collect()
    want = sorted(rows, key=lambda r: (-r.g, r.id))
    assert [r.position for r in want] == list(range(5000))
    assert batches.number_rows(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("limit", [100, 0])
def test_file_rows_are_numbered_without_gaps(spark, limit):
    path = shared_path(spark, "numbered")
    spark.range(3000).withColumn("_file", F.lit("x")).repartition(7).write.parquet(path)
    rows = batches.number_file_rows(spark, path, broadcast_files=limit)
    got = rows.collect()
    assert sorted(r.position for r in got) == list(range(3000))
    assert sorted(r.id for r in got) == list(range(3000)) and {r._file for r in got} == {"x"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.collect()))


def test_epochs_shards_and_resuming(spark):
    n, size, readers = 1003, 100, 3
    df = spark.range(n).withColumnRenamed("id", "position")

    def read(epoch, **more):
        return {r.position: (r.place, r.batch) for r in batches.epoch_batches(
            df, "position", n, size, epoch, seed=2, **more).collect()}
    whole = [read(0), read(1)]
    assert all(sorted(p for p, _ in w.values()) == list(range(n)) for w in whole)
    assert whole[0] != whole[1] and whole[0] == read(0)
    parts = [read(0, shard=s, num_shards=readers) for s in range(readers)]
    assert sum(map(len, parts)) == n and {k for p in parts for k in p} == set(range(n))
    for s, part in enumerate(parts):
        assert all(b % readers == s for _, b in part.values())
    counts = np.bincount([b for _, b in whole[0].values()])
    assert counts.tolist() == [100] * 10 + [3]
    rest = read(0, start=450)
    assert rest == {k: v for k, v in whole[0].items() if v[0] >= 450}


def test_batch_losses(spark):
    rows = [(i // 10, i % 2, 0.1 + 0.8 * ((i * 37) % 100) / 100, 1.0 + i % 3) for i in range(95)]
    df = spark.createDataFrame(rows + [(3, None, 0.5, 1.0), (4, 1, None, 1.0)],
                               "b int, y int, p double, w double")
    per = {r.batch: r for r in metrics.batch_log_loss(df, "y", "p", "b", "w").collect()}
    loss = {b: [(w, -np.log(p if y else 1 - p)) for c, y, p, w in rows if c == b] for b in range(10)}
    for b, terms in loss.items():
        assert per[b].log_loss == pytest.approx(sum(w * x for w, x in terms) / sum(w for w, _ in terms))
        assert per[b].n == len(terms)
    total = metrics.mean_batch_log_loss(df, "y", "p", "b", "w").first()
    assert total.mean_batch_loss == pytest.approx(np.mean([r.log_loss for r in per.values()]))
    assert total.global_loss == pytest.approx(
        metrics.weighted_log_loss(df, "y", "p", "w").first().log_loss)
    assert (total.batches, total.n) == (10, 95)
    empty = metrics.mean_batch_log_loss(df.limit(0), "y", "p", "b").first()
    assert empty.batches == 0 and empty.mean_batch_loss is None
