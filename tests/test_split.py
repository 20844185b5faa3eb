"""Time split: cut-value form equals percent_rank, edge cases, expected counts."""

import pytest
from pyspark.sql import functions as F

from chronofeat.operators import split
from chronofeat.operators.scan import ordered_scan
from chronofeat.sources.views import sales_view
from tools.plain_forms import plain_time_split
from conftest import SF001, SF01, same_rows


def _ts_frame(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, t int")


EDGE_CASES = {
    "empty": [],
    "one": [5],
    "two": [1, 2],
    "all_tied": [7] * 10,
    "top_three_tied": list(range(17)) + [99, 99, 99],
    "half_null": [None] * 10 + list(range(10)),
    "mostly_null": [None] * 19 + [3],
    "all_null": [None] * 5,
    "distinct": list(range(1000)),
}


@pytest.mark.parametrize("name", sorted(EDGE_CASES))
@pytest.mark.parametrize("buckets", [None, 3])
def test_cut_split_equals_percent_rank(spark, name, buckets):
    df = _ts_frame(spark, EDGE_CASES[name])
    lit = plain_time_split(df, "t")
    cut = split.time_split(df, "t", scan_buckets=buckets)
    assert same_rows(lit, cut)


def test_val_rows_kept_when_no_row_reaches_test_bound(spark):
    df = _ts_frame(spark, list(range(17)) + [99, 99, 99])
    counts = {r.split: r.n for r in split.split_counts(split.time_split(df, "t")).collect()}
    # pr = i/19: 0..15 train; 16 (.842) and the tied 99s (.895) val; nothing reaches .9
    assert counts == {"train": 16, "val": 4}


def test_percent_rank_column(spark):
    df = _ts_frame(spark, [3, 1, 1, None, 7])
    got = sorted((r.id, r.pr) for r in split.time_percent_rank(df, "t").collect())
    assert got == [(0, 0.75), (1, 0.25), (2, 0.25), (3, 0.0), (4, 1.0)]


@pytest.mark.parametrize("sf,expected", [
    (SF001, {("train", 0): 3240, ("train", 1): 1560, ("val", 0): 422, ("val", 1): 184,
             ("test", 0): 370, ("test", 1): 224}),
    (SF01, {("train", 0): 32007, ("train", 1): 15999, ("val", 0): 3984, ("val", 1): 2030,
            ("test", 0): 3963, ("test", 1): 2017}),
])
def test_sales_split_counts_match_fixtures(spark, sf, expected):
    s = split.time_split(sales_view(spark, sf), "o_orderdate")
    got = {(r.split, r.label): r.n for r in
           s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == expected


def test_split_filter_pushed_to_parquet(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    train, val, test = split.split_frames(ev, "ts")
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
    assert train.count() + val.count() + test.count() == ev.count()


@pytest.mark.parametrize("buckets", [1, 4])
def test_ordered_scan_sums_max_lag(spark, buckets):
    df = spark.range(0, 50).withColumn("v", (F.col("id") % 7).cast("long"))
    out = ordered_scan(df, [F.col("id")], sums={"s": F.col("v")}, maxes={"m": F.col("v")},
                       lags={"p": F.col("v")}, buckets=buckets)
    rows = sorted(out.collect(), key=lambda r: r.id)
    run, mx, prev = 0, None, None
    for r in rows:
        assert (r.s, r.m, r.p) == (run, mx, prev)
        run += r.v
        mx = r.v if mx is None else max(mx, r.v)
        prev = r.v


@pytest.mark.parametrize("name", sorted(EDGE_CASES))
def test_split_frames_equal_literal(spark, name):
    df = _ts_frame(spark, EDGE_CASES[name])
    lit = plain_time_split(df, "t")
    frames = split.split_frames(df, "t")
    for label, frame in zip(("train", "val", "test"), frames):
        assert same_rows(frame, lit.where(F.col("split") == label).drop("split"))


@pytest.mark.parametrize("name", sorted(EDGE_CASES))
def test_rank_cuts_equal_count_cuts(spark, name):
    df = _ts_frame(spark, EDGE_CASES[name])
    expect = split.time_cuts(df, "t", method="counts")
    assert split.time_cuts(df, "t", method="rank", width=4) == expect
    assert split.time_cuts(df, "t") == expect


@pytest.mark.parametrize("sf,col,table", [
    (SF01, "o_orderdate", "orders"), (SF01, "ts", "events"), (SF01, "l_shipdate", "lineitem"),
])
def test_rank_cuts_on_tables(spark, sf, col, table):
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    expect = split.time_cuts(df, col, method="counts")
    assert split.time_cuts(df, col, width=16) == expect == split.time_cuts(df, col)


@pytest.mark.parametrize("accuracy", [3, 20, 10_000])
@pytest.mark.parametrize("name", sorted(EDGE_CASES))
def test_sketch_cuts_equal_count_cuts(spark, name, accuracy):
    """Also where the sketch is so coarse that its brackets cover everything or miss."""
    df = _ts_frame(spark, EDGE_CASES[name])
    expect = split.time_cuts(df, "t", method="counts")
    assert split.time_cuts(df, "t", method="sketch", accuracy=accuracy) == expect


@pytest.mark.parametrize("shift", [-400, -30, 0, 30, 400])
def test_a_cut_outside_its_bracket_is_still_exact(spark, monkeypatch, shift):
    df = _ts_frame(spark, [None] * 5 + [i // 2 for i in range(1000)])
    expect = split.time_cuts(df, "t", method="counts")
    monkeypatch.setattr(split, "_brackets", lambda *a: (1005, [(390 + shift, 410 + shift),
                                                               (440 + shift, 460 + shift)]))
    assert split.time_cuts(df, "t") == expect


def test_sketch_counts_few_rows_outside_brackets(spark, monkeypatch):
    """Two million times: counted singly only inside the brackets, and no other method asked."""
    df = spark.range(2_000_000).selectExpr("timestamp_micros(id * 7919 % 2000003 * 1000000) as t")
    sizes = []
    scan = split.ordered_scan
    monkeypatch.setattr(split, "ordered_scan",
                        lambda d, *a, **k: sizes.append(d.count()) or scan(d, *a, **k))
    monkeypatch.setattr(split, "_cuts_by_rank", None)
    found = split.time_cuts(df, "t")
    assert sizes[0] < 2_000_000 * 10 / split.ACCURACY
    monkeypatch.undo()
    assert found == split.time_cuts(df, "t", method="rank")


def test_rank_cuts_with_nulls_and_dates(spark):
    import datetime as dt
    rows = [(i, None if i % 4 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=i // 3))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, d date")
    assert split.time_cuts(df, "d", width=3) == split.time_cuts(df, "d", method="counts")


def test_wide_integer_keys(spark):
    """Nanoseconds over years, and keys at both ends of 64 bits."""
    nano = spark.range(4000).selectExpr(
        "1600000000000000000 + id * 23651999999983 + pmod(hash(id), 1000) as t")
    ends = spark.createDataFrame([(x,) for x in (-2**63, -2**63 + 1, -5, 0, 7, 2**62, 2**63 - 2,
                                                 2**63 - 1, 2**63 - 1, None)], "t long")
    for df in (nano, ends):
        for width in (7, 16384):
            assert split.time_cuts(df, "t", width=width) == split.time_cuts(df, "t",
                                                                           method="counts")
        assert same_rows(plain_time_split(df, "t"), split.time_split(df, "t"))


def test_cuts_inside_a_repeated_hour(spark, monkeypatch):
    """A driver zone with a DST change must not move TIMESTAMP cuts by an hour."""
    import time
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        df = spark.range(100).selectExpr(
            "timestamp_micros(1730606400000000 + id * 600000000) as t")  # 2024-11-03 04:00Z on
        assert same_rows(plain_time_split(df, "t"), split.time_split(df, "t"))
        counts = {r.split: r.n for r in split.split_counts(split.time_split(df, "t")).collect()}
        assert counts == {"train": 80, "val": 10, "test": 10}
    finally:
        monkeypatch.undo()
        time.tzset()


def test_strings_and_doubles_split_by_counts(spark):
    df = spark.range(200).selectExpr("cast(id % 61 as double) / 7 as d", "concat('k', id % 50) as s")
    for col in ("d", "s"):
        assert same_rows(plain_time_split(df, col), split.time_split(df, col))


def test_label_counts_do_not_shuffle_by_time(spark):
    df = spark.range(1000).selectExpr("id as t", "cast(id % 2 as int) as y")
    plan = split.split_label_counts(df, "t", "y")._jdf.queryExecution().executedPlan().toString()
    hashed = [x for x in plan.split("\n") if "hashpartitioning" in x]
    assert hashed and not any("hashpartitioning(t" in x for x in hashed)


def test_nothing_stays_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    split.time_split(_ts_frame(spark, list(range(50))), "t").count()
    split.time_percent_rank(_ts_frame(spark, list(range(50))), "t").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("name", ["scaled_features", "scaled_features_f32", "time_split"])
def test_the_sales_view_is_joined_once(spark, monkeypatch, name):
    from chronofeat import queries
    joined, store = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, to: joined.append(to) or store(df, to))
    out = queries.QUERIES[name](spark, SF001)
    assert joined == ["sales"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
