"""Episodes batch by batch equal the run over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from chronofeat.operators import appended
from chronofeat.operators.episodes import assign_episodes
from conftest import same_rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, e string, t long, y int, `a.b` string")


def _random_rows(seed, n=240):
    rng = random.Random(seed)
    hot = [None, "a", "a", "a", "b", "c", "d", "e"]
    return [(i, rng.choice(hot[:2 + seed * 2]), rng.choice([None, *range(20)]) if i % 9 else None,
             rng.choice([0, 0, 1, None]), f"x{i}") for i in range(n)]


def _by_batches(spark, df, cuts):
    """All batches appended in turn: rows with global columns."""
    state = appended.empty_state(spark, df, "e", "t", "y")
    bounds = list(zip([None, *cuts], [*cuts, None]))
    parts, late = [], 0
    for lo, hi in bounds:
        batch = df.where((F.lit(lo is None) & F.col("t").isNull())
                         | ((F.lit(lo is None) | (F.col("t") >= F.lit(lo)))
                            & (F.lit(hi is None) | (F.col("t") < F.lit(hi)))))
        rows, state, behind = appended.append_episodes(batch, state, "e", "t", "y", "id", ranges=5)
        parts.append(rows)
        late += behind.count()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return appended.global_episodes(every, state, "e"), late


@pytest.mark.parametrize("seed,cuts", [(1, [4]), (2, [6, 13]), (3, [1, 2, 19])])
def test_batches_equal_the_full_run(spark, seed, cuts):
    df = _frame(spark, _random_rows(seed)).repartition(3)
    got, late = _by_batches(spark, df, cuts)
    assert late == 0
    full = assign_episodes(df.withColumnRenamed("a.b", "x"), "e", "t", "y", "id")
    assert same_rows(got.withColumnRenamed("a.b", "x"), full)


def test_late_rows_come_back_and_change_nothing(spark):
    first = _frame(spark, [(1, "a", 5, 0, "p"), (2, "a", 7, 1, "q"), (3, None, None, 0, "r")])
    state = appended.empty_state(spark, first, "e", "t", "y")
    _, state, _ = appended.append_episodes(first, state, "e", "t", "y", "id")
    batch = _frame(spark, [(4, "a", 7, 0, "tie"), (5, "a", 6, 0, "old"), (6, "a", None, 0, "null"),
                           (7, "a", 8, 0, "new"), (8, None, None, 0, "null"), (9, "b", None, 0, "n")])
    rows, after, late = appended.append_episodes(batch, state, "e", "t", "y", "id")
    assert sorted(r.id for r in late.collect()) == [4, 5, 6, 8]
    assert late.columns == batch.columns
    assert sorted((r.id, r.case_no, r.time) for r in rows.collect()) == [(7, 1, 0), (9, 0, 0)]
    assert {(r.entity, r.ts, r.label, r.case_no, r.time) for r in after.collect()} == {
        ("a", 8, 0, 1, 0), ("b", None, 0, 0, 0), (None, None, 0, 0, 0)}


def test_an_empty_batch_keeps_the_state(spark):
    df = _frame(spark, [(1, "a", 5, 0, "p")])
    state = appended.empty_state(spark, df, "e", "t", "y")
    _, state, _ = appended.append_episodes(df, state, "e", "t", "y", "id")
    rows, after, late = appended.append_episodes(df.limit(0), state, "e", "t", "y", "id")
    assert rows.count() == 0 and late.count() == 0 and same_rows(after, state)
