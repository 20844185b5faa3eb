"""Property tests: random small inputs, the library against the plain forms."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronofeat.operators import split
from chronofeat.operators.episodes import OUTPUTS, assign_episodes
from tools.plain_forms import plain_episodes, plain_time_split
from conftest import same_rows

SETTINGS = settings(max_examples=10, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_strategy = st.lists(
    st.tuples(st.sampled_from([None, "a", "b", "c"]),        # entity, NULL included
              st.integers(min_value=0, max_value=6),          # time: few values -> ties
              st.sampled_from([None, 0, 1])),                 # label, NULL included
    min_size=1, max_size=40)


@SETTINGS
@given(rows=rows_strategy, ranges=st.integers(min_value=1, max_value=9))
def test_episodes_over_ranges_equal_plain_form(spark, rows, ranges):
    data = [(e, t, y, i) for i, (e, t, y) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t int, y int, id int")
    plain = plain_episodes(df, "k", "t", "y", "id", OUTPUTS)
    assert same_rows(plain, assign_episodes(df, "k", "t", "y", "id", OUTPUTS, ranges=ranges))


@SETTINGS
@given(times=st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=30)),
                      min_size=0, max_size=60))
def test_split_methods_agree(spark, times):
    base = dt.datetime(2024, 1, 1)
    data = [(i, None if t is None else base + dt.timedelta(minutes=t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "id int, t timestamp_ntz")
    lit = plain_time_split(df, "t")
    assert same_rows(lit, split.time_split(df, "t", method="counts"))
    assert same_rows(lit, split.time_split(df, "t", method="rank", width=3))
