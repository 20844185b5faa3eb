"""Export, shards, preview, training on a planted signal, reload and search."""

import os

import pytest
from pyspark.sql import functions as F

from chronofeat.plans import learn
from chronofeat.plans import prepare as prep
from chronofeat.session import shared_path
from chronofeat.sources import parquet
from chronofeat.sources.views import (SALES_CONTINUOUS, SALES_INT_CATEGORIES,
                                      SALES_STRING_CATEGORIES, sales_view)
from conftest import SF001


def _spec():
    return prep.PrepSpec(label="label", time="o_orderdate",
                         string_categories=SALES_STRING_CATEGORIES,
                         int_categories=SALES_INT_CATEGORIES,
                         continuous=SALES_CONTINUOUS, required=["label"])


@pytest.fixture(scope="module")
def prepared(spark):
    return prep.prepare(sales_view(spark, SF001), _spec())


def test_prepared_layout(prepared):
    cols = prepared.frame.columns
    assert cols[0] == "label" and "scaledFeatures" in cols and "split" in cols
    assert len([c for c in cols if c.endswith("_cat")]) == 12
    dtype = prepared.frame.schema["scaledFeatures"].dataType.simpleString()
    assert dtype == "array<float>"


def test_export_roundtrip_and_row_groups(spark, prepared):
    path = prep.export(prepared, shared_path(spark, "test-export"), num_files=10)
    back = spark.read.parquet(path)
    assert back.count() == prepared.frame.count()
    assert back.exceptAll(prepared.frame.select(*back.columns)).count() == 0
    train_files = [f for f in os.listdir(os.path.join(path.replace("file:", ""), "split=train"))
                   if f.endswith(".parquet")]
    assert 1 <= len(train_files) <= 10


def test_three_folder_export(spark, prepared):
    path = prep.export(prepared, shared_path(spark, "test-export3"), num_files=2, one_job=False)
    total = sum(spark.read.parquet(f"{path}/{s}").count() for s in ("train", "val", "test"))
    assert total == prepared.frame.count()


def test_shards_disjoint_and_exhaustive(spark, prepared):
    path = parquet.write_shards(prepared.split("train"), shared_path(spark, "test-shards"), 10)
    whole = spark.read.parquet(path)
    parts = [parquet.read_shard(spark, path, r, 3) for r in range(3)]
    assert sum(p.count() for p in parts) == whole.count()
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert union.exceptAll(whole).count() == 0 and whole.exceptAll(union).count() == 0


def test_no_reader_is_left_without_a_file(spark, prepared):
    for n in range(3):
        path = parquet.write_shards(prepared.split("train"), shared_path(spark, "even"), 10)
        files = parquet.shard_files(spark, path, 10)
        assert [len(f) for f in files] == [1] * 10
        assert len({x for f in parquet.shard_files(spark, path, 4) for x in f}) == 10


def test_history_and_versions(spark, prepared):
    cats = [c + "_cat" for c in prepared.spec.categories]
    model = learn.train_weighted(prepared.split("train"), cats, "scaledFeatures", "label", max_iter=3)
    loss = [r.loss for r in learn.history(spark, model).orderBy("iteration").collect()]
    assert len(loss) >= 2 and loss[-1] < loss[0]
    base = shared_path(spark, "versions")
    for v in (3, 12):
        learn.save(model, base, version=v)
    assert learn.versions(spark, base) == [3, 12]
    assert learn.load(base, version=12).stages[-1].coefficients == model.stages[-1].coefficients


def test_full_preparation_with_episodes_and_limit(spark):
    from chronofeat.sources.views import events_view
    spec = prep.PrepSpec(label="label", time="ts_hour", string_categories=["event_type"],
                         int_categories=[], continuous=["value"], required=["label", "key"],
                         entity_parts=["entity", "event_type"], entity="key",
                         threshold_col="value", threshold=5, episodes=True, tiebreak="event_id",
                         fit_index_on="train")
    events = events_view(spark, SF001)
    p = prep.prepare(events, spec)
    rows = events.where("value >= 5 and entity is not null and label is not null")
    assert p.frame.count() == rows.count()
    assert {"case_id", "time", "time2", "time3", "event_type_cat"} <= set(p.frame.columns)
    spec.limit = 50
    assert prep.clean_frame(events, spec).count() <= 50


def test_shard_column_hash_and_mod(spark):
    df = spark.range(100)
    h = parquet.shard_column(df, "id", 4)
    assert {r.shard for r in h.collect()} <= {0, 1, 2, 3}
    m = parquet.shard_column(df, "id", 4, method="mod")
    assert parquet.shard_counts(m).where(F.col("n") != 25).count() == 0


def test_preview_and_partition_count(spark):
    df = spark.range(100).repartition(5)
    assert parquet.partition_count(df) == 5
    assert [r.id for r in parquet.preview(df, [F.col("id").desc()], 4).collect()] == [99, 98, 97, 96]


def test_training_beats_prior_on_planted_signal(spark):
    rows = spark.range(4000).select(
        (F.rand(1) * 1.0).alias("a"), (F.rand(2) * 1.0).alias("b"),
        (F.col("id") % 3).cast("double").alias("c_cat"))
    rows = rows.withColumn("label", ((F.col("a") + 0.3 * F.col("b")) > 0.9).cast("int"))
    rows = rows.withColumn("feats", F.array(F.col("a").cast("float"), F.col("b").cast("float")))
    model = learn.train_weighted(rows, ["c_cat"], "feats", "label", max_iter=50)
    scored = learn.score(model, rows, "feats")
    acc = scored.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    prior = rows.select(F.avg("label")).first()[0]
    assert acc > max(prior, 1 - prior) + 0.05


def test_save_load_same_scores(spark, prepared):
    cats = [c + "_cat" for c in prepared.spec.categories]
    model = learn.train_weighted(prepared.split("train"), cats, "scaledFeatures", "label",
                                 max_iter=3)
    path = learn.save(model, shared_path(spark, "test-model"))
    again = learn.load(path)
    a = learn.score(model, prepared.split("test"), "scaledFeatures").select("prediction", "p1")
    b = learn.score(again, prepared.split("test"), "scaledFeatures").select("prediction", "p1")
    assert a.exceptAll(b).count() == 0
    listing = parquet.artifacts(spark, path)
    assert listing.count() > 0 and listing.where(F.col("length") < 0).count() == 0


def test_param_search_one_best(spark, prepared):
    cats = [c + "_cat" for c in prepared.spec.categories]
    res = learn.param_search(prepared.split("train"), prepared.split("val"), cats,
                             "scaledFeatures", "label", n_draws=2, max_iter=2)
    rows = res.collect()
    assert len(rows) == 2 and sum(r.best for r in rows) >= 1
    for r in rows:
        assert 4.5e-5 <= r.reg_param <= 1.9e-2


def test_summaries_match_direct_counts(spark, prepared):
    raw = prep.clean_frame(sales_view(spark, SF001), _spec())
    out = prep.summaries(prepared, raw)
    counts = {(r.split, r.label): r.n for r in out["split_label_counts"].collect()}
    direct = {(r.split, r.label): r["count"] for r in
              prepared.frame.groupBy("split", "label").count().collect()}
    assert counts == direct
    from chronofeat.operators import encode
    got = {r.column: (r.cardinality, r.width) for r in out["cardinality"].collect()}
    direct = {r.column: r.cardinality for r in encode.cardinality(raw, prepared.spec.categories).collect()}
    assert {c: v[0] for c, v in got.items()} == direct
    assert all(w == min(50, (k + 2) // 2) for k, w in got.values())
    w = {r.label: r.weight for r in out["class_weights"].collect()}
    n0, n1 = counts[("train", 0)], counts[("train", 1)]
    assert w[0] == pytest.approx((n0 + n1) / (2 * n0)) and w[1] == pytest.approx((n0 + n1) / (2 * n1))


def test_artifacts_of_the_export_and_of_the_saved_model_are_listed(spark):
    from chronofeat.queries import QUERIES
    got = {r.folder: r.has_files for r in QUERIES["artifact_listing"](spark, SF001).collect()}
    assert got == dict.fromkeys(
        ["split=train", "split=val", "split=test", "metadata", "stages/0_OneHotEncoder",
         "stages/1_VectorAssembler", "stages/2_LogisticRegression"], True)
