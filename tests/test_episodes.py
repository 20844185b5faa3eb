"""Episode assignment: edge rules, and literal vs distributed parity."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofeat.operators.episodes import OUTPUTS, assign_episodes, time_polynomial
from chronofeat.sources.views import events_view
from tools.plain_forms import plain_episodes
from conftest import SF01, same_rows

TIE_ROWS = [
    (None, "2024-01-01", 0, 5), (None, "2024-01-02", 1, 6),
    ("A", "2024-01-01", 0, 1), ("A", "2024-01-02", 1, 2), ("A", "2024-01-03", 0, 3),
    ("A", "2024-01-03", 1, 4), ("A", "2024-01-04", 0, 7),
    ("B", "2024-01-01", 0, 8), ("B", "2024-01-02", None, 9), ("B", "2024-01-03", 0, 10),
]
# (id, case_id, time) in (k, t, id) order - FIXTURES.md
TIE_EXPECTED = [(5, 1, 0), (6, 1, 1), (1, 2, 0), (2, 2, 1), (3, 3, 1), (4, 3, 1),
                (7, 4, 0), (8, 5, 0), (9, 5, 1), (10, 5, 2)]


def _tie(spark, rows=TIE_ROWS):
    return spark.createDataFrame(rows, "k string, t string, y int, id int")


def _plain(df, *names, outputs=("case_id", "time")):
    return plain_episodes(df, *names, outputs=outputs)


FORMS = [_plain] + [lambda df, *names, outputs=("case_id", "time"), k=k: assign_episodes(
    df, *names, outputs=outputs, ranges=k) for k in (None, 1, 2, 4, 30)]


@pytest.mark.parametrize("form", FORMS)
def test_tie_rows(spark, form):
    out = form(_tie(spark), "k", "t", "y", "id")
    got = [(r.id, r.case_id, r.time) for r in out.orderBy(
        F.col("k").asc_nulls_first(), "t", "id").collect()]
    assert got == TIE_EXPECTED


def test_null_block_without_final_one_continues(spark):
    # last NULL-entity label 0: entity A's first row does not start an episode
    rows = [(None, "2024-01-01", 1, 1), (None, "2024-01-02", 0, 2),
            ("A", "2024-01-01", 0, 3), ("A", "2024-01-02", 0, 4)]
    for form in FORMS:
        got = {r.id: (r.case_id, r.time) for r in form(_tie(spark, rows), "k", "t", "y", "id").collect()}
        assert got == {1: (1, 0), 2: (2, 0), 3: (2, 1), 4: (2, 2)}


def test_first_row_and_null_label(spark):
    rows = [("A", "2024-01-01", None, 1), ("A", "2024-01-02", 1, 2), ("A", "2024-01-03", 0, 3)]
    for form in FORMS:
        out = form(_tie(spark, rows), "k", "t", "y", "id", outputs=("brk", "prev_label", "case_id"))
        got = {r.id: (r.brk, r.prev_label, r.case_id) for r in out.collect()}
        # first row: lag default 0; NULL previous label never breaks
        assert got == {1: (0, 0, 1), 2: (0, None, 1), 3: (1, 1, 2)}


@pytest.mark.parametrize("ranges", [None, 3, 97])
def test_ranges_match_plain_form_on_events(spark, ranges):
    ev = events_view(spark, SF01)
    names = ("entity", "ts_hour", "label", "event_id", OUTPUTS)
    assert same_rows(plain_episodes(ev, *names), assign_episodes(ev, *names, ranges=ranges))


def _one_hot_entity():
    base = dt.datetime(2024, 1, 1)
    rows = [("hot", (base + dt.timedelta(hours=i // 3)).isoformat(), int(i % 7 == 0), i)
            for i in range(300)]
    return rows + [("cold", base.isoformat(), 1, 1000), (None, base.isoformat(), 1, 1001)]


HOT_CASES = {
    "one entity": _one_hot_entity(),
    "no times": [("hot", None, int(i % 5 == 0), i) for i in range(200)],
    "one tie": [("a", "1", 1, 900), ("b", "2", 0, 901)] + [
        ("hot", "2024", int(i % 50 == 0), i) for i in range(200)] + [("z", "1", 0, 902)],
    "a tie inside an entity": [("hot", str(1 if 20 < i < 180 else i), int(i % 40 == 0), i)
                               for i in range(200)],
    "no entity": [(None, str(i % 9), None if i % 4 else 1, i) for i in range(120)],
}


@pytest.mark.parametrize("case", sorted(HOT_CASES))
def test_hot_groups_spread_over_ranges(spark, case):
    df = _tie(spark, HOT_CASES[case]).repartition(3)
    plain = plain_episodes(df, "k", "t", "y", "id", OUTPUTS)
    for ranges in (2, 7, 40):
        assert same_rows(plain, assign_episodes(df, "k", "t", "y", "id", OUTPUTS, ranges=ranges))
    used = df.repartitionByRange(7, "k", "t", "id").groupBy(F.spark_partition_id()).count()
    assert used.agg(F.max("count")).first()[0] < df.count() / 3


def test_empty_input(spark):
    out = assign_episodes(_tie(spark, []), "k", "t", "y", "id", OUTPUTS)
    assert out.count() == 0 and out.columns[-6:] == list(OUTPUTS)


def test_time_polynomial(spark):
    df = spark.createDataFrame([(0,), (2,), (3,)], "time long")
    got = sorted((r.time, r.time2, r.time3) for r in time_polynomial(df).collect())
    assert got == [(0, 0.0, 0.0), (2, 4.0, 8.0), (3, 9.0, 27.0)]


def _single_partition_inputs(df):
    """Input column lists of every single-partition exchange in the formatted plan."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    blocks = buf.getvalue().split("\n\n")
    return [b for b in blocks if "Exchange" in b.split("\n")[0] and "SinglePartition" in b]


def test_no_row_level_single_partition_exchange(spark):
    ev = events_view(spark, SF01)
    ours = assign_episodes(ev, "entity", "ts_hour", "label", "event_id", ranges=4)
    assert all("event_id" not in b for b in _single_partition_inputs(ours))
    plain = plain_episodes(ev, "entity", "ts_hour", "label", "event_id")
    assert any("event_id" in b for b in _single_partition_inputs(plain))
