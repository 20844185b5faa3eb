"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as entry_mod
from chronofeat.queries import QUERIES


def test_entry_runs_with_stable_schema(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["split", "label", "n", "weight"]
    rows = df.collect()
    assert {r.split for r in rows} == {"train", "val", "test"}
    assert entry_mod.entry(spark).schema == df.schema


def test_every_oracle_has_a_query():
    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(qs)
    rows_only = {q for q in set(qs) - set(sql) if q in QUERIES}
    assert rows_only == set()
