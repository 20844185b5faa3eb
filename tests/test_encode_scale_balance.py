"""Indexing, cardinality, widths, scaling and class weights: closed forms and edges."""

import math

import pytest
from pyspark.sql import functions as F

from chronofeat.operators import balance, clean, encode, scale

CAT_ROWS = [("b", 3), ("a", 3), ("c", 1), ("c", 1), (None, 2)]


def _cats(spark):
    return spark.createDataFrame(CAT_ROWS, "c string, n int")


def _labels(table, col):
    rows = table.where(F.col("column") == col).orderBy("index").collect()
    assert [r["index"] for r in rows] == [float(i) for i in range(len(rows))]
    return [r["value"] for r in rows]


def test_index_order_frequency_then_label(spark):
    df = _cats(spark).where(F.col("c").isNotNull())
    table = encode.fit_category_index(df, ["c", "n"]).table
    assert _labels(table, "c") == ["c", "a", "b"]
    assert _labels(table, "n") == ["1", "3"]  # ints indexed as strings


def test_index_null_raises_keep_and_skip(spark):
    df = _cats(spark)
    with pytest.raises(Exception, match="unseen label"):
        encode.fit_category_index(df, ["c"]).transform(df).collect()
    keep = encode.fit_category_index(df, ["c"], handle_invalid="keep").transform(df)
    assert sorted(r.c_cat for r in keep.collect()) == [0.0, 0.0, 1.0, 2.0, 3.0]
    skip = encode.fit_category_index(df, ["c"], handle_invalid="skip").transform(df)
    assert skip.count() == 4


@pytest.mark.parametrize("buckets", [None, 3])
def test_index_equals_string_indexer_and_survives_saving(spark, buckets):
    from chronofeat.session import shared_path
    df = spark.createDataFrame([(str(i % 13), i % 5) for i in range(200)], "a string, b int")
    model = encode.fit_category_index(df, ["a", "b"], scan_buckets=buckets)
    stock = encode.fit_string_indexer(df, ["a", "b"])
    assert [_labels(model.table, c) for c in ("a", "b")] == [list(x) for x in stock.labelsArray]
    again = encode.load_category_index(spark, model.save(shared_path(spark, "index")), ["a", "b"])
    direct = stock.transform(df)
    for out in (model.transform(df), again.transform(df)):
        assert out.exceptAll(direct.select(*out.columns)).count() == 0


def test_many_labels_need_no_driver(spark, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_LABELS", 1000)  # the join shuffles beyond it
    df = spark.range(1_200_000).select(F.concat(F.lit("k"), "id").alias("k"))
    model = encode.fit_category_index(df, ["k"])
    out = model.transform(df)
    assert model.sizes == {"k": 1_200_000}
    assert out.select(F.count_distinct("k_cat")).first()[0] == 1_200_000


def test_cardinality_counts_null(spark):
    card = {r.column: r.cardinality for r in encode.cardinality(_cats(spark), ["c", "n"]).collect()}
    assert card == {"c": 4, "n": 3}
    no_null = encode.cardinality(_cats(spark), ["c"], count_null=False).first().cardinality
    assert no_null == 3
    approx = {r.column: r.cardinality
              for r in encode.cardinality(_cats(spark), ["c", "n"], approx=True).collect()}
    assert approx == {"c": 4, "n": 3}


def test_embedding_width_rule(spark):
    df = spark.createDataFrame([(c,) for c in (1, 2, 3, 97, 98, 200)], "cardinality long")
    got = [r.width for r in encode.embedding_width(df).orderBy("cardinality").collect()]
    assert got == [min(50, (c + 2) // 2) for c in (1, 2, 3, 97, 98, 200)]


def test_scaler_sample_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    model = scale.fit_scaler(df, ["a", "b"], "s")
    out = scale.apply_scaler(model, df, ["a", "b"], "s", as_array="float64", drop_input=False)
    mean, sd = 7 / 3, math.sqrt(((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 2)
    for r in out.collect():
        assert abs(r.s[0] - (r.a - mean) / sd) < 1e-12
        assert r.s[1] == 0.0
    assert abs(sd - 1.5275252316519468) < 1e-12


def test_assembler_raises_on_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception):
        scale.assemble(df, ["a", "b"]).collect()


def test_threshold_keeps_nan_drops_null(spark):
    df = spark.createDataFrame([(None,), (-15.0,), (-16.0,), (float("nan"),)], "x double")
    got = [r.x for r in clean.filter_threshold(df, "x", -15).collect()]
    assert len(got) == 2 and -15.0 in got and any(math.isnan(x) for x in got)


def test_na_drop_drops_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "x double, k string")
    assert clean.drop_required_nulls(df, ["x", "k"]).count() == 1


def test_entity_key_null_propagates(spark):
    df = spark.createDataFrame([("T1", "AA"), (None, "AA"), ("T2", None)], "t string, c string")
    got = [r.k for r in clean.with_entity_key(df, ["t", "c"], "k").collect()]
    assert got == ["T1 AA", None, None]


def test_class_weights_balanced_invariant(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2 + [(None,)], "y int")
    w = {r.y: (r.n, r.weight) for r in balance.class_weights(df, "y").collect()}
    assert w == {0: (8, 10 / 16), 1: (2, 10 / 4)}
    assert sum(n * wt for n, wt in w.values()) == pytest.approx(10)
    weighted = balance.with_weight(df, "y", balance.class_weights(df, "y"))
    assert weighted.where(F.col("y") == 1).first().weight == 2.5


def test_reference_weights_recomputed(spark):
    # the reference hard-codes these two counts and rounded weights
    df = spark.createDataFrame([(0, 20080658), (1, 4473741)], "y int, n long")
    total = 20080658 + 4473741
    w = df.withColumn("w", F.lit(float(total)) / (2 * F.col("n"))).orderBy("y").collect()
    assert round(w[0].w, 8) == 0.61139428 and round(w[1].w, 8) == 2.74428035


def test_one_pass_fit_equals_stock_string_indexer(spark):
    from chronofeat.sources.views import SALES_CATEGORIES, sales_view
    from conftest import SF01
    sales = sales_view(spark, SF01)
    ours = encode.fit_category_index(sales, SALES_CATEGORIES)
    stock = encode.fit_string_indexer(sales, SALES_CATEGORIES)
    assert [_labels(ours.table, c) for c in SALES_CATEGORIES] == [list(x) for x in stock.labelsArray]


@pytest.mark.parametrize("as_array", ["float32", "float64"])
def test_column_scaling_equals_ml_transform(spark, as_array):
    from chronofeat.sources.views import SALES_CONTINUOUS, sales_view
    from conftest import SF01
    from pyspark.ml.functions import vector_to_array
    sales = sales_view(spark, SF01)
    model = scale.fit_scaler(sales, SALES_CONTINUOUS, "s")
    ours = scale.apply_scaler(model, sales, SALES_CONTINUOUS, "s", as_array=as_array)
    ml = model.transform(sales).withColumn("s", vector_to_array("s", as_array)).drop(
        "_features", *SALES_CONTINUOUS)
    assert ours.select("s").exceptAll(ml.select("s")).count() == 0  # bit-identical


def test_column_scaling_raises_on_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    model = scale.fit_scaler(df, ["a", "b"], "s")
    bad = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception):
        scale.apply_scaler(model, bad, ["a", "b"], "s").collect()
