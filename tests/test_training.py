"""Histories, halving and complete versions."""

import pytest
from pyspark.sql import functions as F

from chronofeat.operators import metrics
from chronofeat.plans import learn, prepare as prep
from chronofeat.session import shared_path


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 5).cast("double").alias("c_cat"), F.array(
            ((F.col("id") * 7919 % 1000) / 500.0 - 1.0).cast("float")).alias("x"),
        ((F.col("id") * 7919 % 1000 > 600) | (F.col("id") % 5 == 1)).cast("int").alias("y"),
        F.col("id"))
    return rows.where("id < 2400").drop("id"), rows.where("id >= 2400").drop("id")


def loss_of(model, val, weights, cont="x"):
    scored = learn.score(model, val, cont).join(weights, "y")
    return (metrics.weighted_log_loss(scored, "y", "p1", "weight").first().log_loss,
            metrics.accuracy(scored, "y", "prediction").first().accuracy)


@pytest.mark.parametrize("model", ["logistic", "gbt"])
def test_the_last_row_is_the_final_model(spark, parts, model):
    train, val = parts
    got = learn.validation_history(train, val, ["c_cat"], "x", "y", model, max_iter=4).orderBy(
        "iteration").collect()
    assert [r.iteration for r in got] == [1, 2, 3, 4]
    final = learn.train_weighted(train, ["c_cat"], "x", "y", model, max_iter=4)
    weights = learn.class_weights(train, "y").select("y", "weight")
    loss, accuracy = loss_of(final, val, weights)
    assert got[-1].val_loss == pytest.approx(loss, rel=1e-6)
    assert got[-1].val_accuracy == pytest.approx(accuracy, abs=1e-9)
    assert got[-1].val_loss < got[0].val_loss
    with pytest.raises(ValueError):
        learn.validation_history(train, val, ["c_cat"], "x", "y", "other")


def test_halving_finds_the_full_search_s_winner(parts):
    train, val = parts
    regs = [1.0, 0.3, 1e-1, 1e-2, 1e-4]
    rows = learn.halving_search(train, val, ["c_cat"], "x", "y", regs).collect()
    full = learn.param_search(train, val, ["c_cat"], "x", "y", reg_params=regs).collect()
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].reg_param == min(full, key=lambda r: r.val_log_loss).reg_param
    by_rung = {}
    for r in rows:
        by_rung.setdefault(r.rung, []).append(r)
    assert [len(by_rung[k]) for k in sorted(by_rung)] == [5, 3, 2]
    for k, rs in by_rung.items():
        worst_kept = max(r.val_log_loss for r in rs if r.kept)
        assert all(r.val_log_loss >= worst_kept for r in rs if not r.kept)
    assert [by_rung[k][0].share for k in sorted(by_rung)] == [0.25, 0.5, 1.0]
    last = {r.reg_param: r.val_log_loss for r in by_rung[2]}
    assert all(last[r.reg_param] == pytest.approx(r.val_log_loss) for r in full
               if r.reg_param in last)


def test_samples_of_halving_are_nested(parts):
    train, val = parts
    with learn._feature_frames(train, val, ["c_cat"], "x", "y") as (tr, _):
        n = [tr.where(F.col("_u") < s).count() for s in (0.25, 0.5, 1.0)]
    assert 450 < n[0] < 750 and 1000 < n[1] < 1400 and n[2] == 2400


def test_only_complete_versions_are_loaded(spark, parts):
    train, val = parts
    path = shared_path(spark, "versions")
    assert learn.versions(spark, path) == []
    with pytest.raises(ValueError):
        learn.load_latest(spark, path)
    model = learn.train_weighted(train, ["c_cat"], "x", "y")
    learn.save(model, path, 1)
    learn.save(model, path, 2)
    model.stages[0].write().save(f"{path}/version=000003/stages/0_x")  # ended half-way
    assert learn.versions(spark, path) == [1, 2]
    version, again = learn.load_latest(spark, path)
    assert version == 2 and learn.score(again, val, "x").count() == val.count()
    learn.save(model, path, 3)  # the save is repeated
    assert learn.versions(spark, path) == [1, 2, 3]
    with pytest.raises(ValueError):
        learn.save(model, path, 3)


def test_three_classes_and_empty_and_many(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 1), (0, 2), (None, 1)], "t int, p int")
    report = {r["class"]: r for r in metrics.report(df, "t", "p").collect()}
    assert metrics.weighted_f1(df, "t", "p").first()[0] == pytest.approx(report["weighted avg"].f1)
    assert {(r.truth, r.pred): r.n for r in metrics.confusion_counts(df, "t", "p").collect()} == {
        (0, 0): 1, (1, 1): 1, (2, 2): 1, (2, 1): 1, (0, 2): 1}
    none = metrics.report(df.limit(0), "t", "p").collect()
    assert [(r["class"], r.f1, r.support) for r in none] == [
        ("accuracy", 0.0, 0), ("macro avg", 0.0, 0), ("weighted avg", 0.0, 0)]
    many = spark.range(2000).selectExpr("id as t", "id as p")
    with pytest.raises(ValueError, match="confusion_counts"):
        metrics.report(many, "t", "p")
    assert metrics.confusion_counts(many, "t", "p").count() == 2000


def test_a_limited_input_is_the_same_in_every_pass(spark):
    rows = spark.range(1000).select("id", F.rand().alias("value")).repartition(8)
    spec = prep.PrepSpec(label="label", time="t", string_categories=[], int_categories=[],
                         continuous=["value"], limit=50)
    frame = prep.clean_frame(rows, spec)
    assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, frame.collect()))
    assert frame.count() == 50


def test_iterations_after_convergence_need_no_fit(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 5).cast("double").alias("c_cat"),
                                    (F.col("id") * 7919 % 1000 > 600).cast("int").alias("y"))
    fitted, fit_all = [], learn._fit_all

    def counted(train, label, settings, *rest):
        fitted.extend(s["maxIter"] for s in settings)
        return fit_all(train, label, settings, *rest)
    monkeypatch.setattr(learn, "_fit_all", counted)
    got = learn.validation_history(rows, rows, ["c_cat"], None, "y", max_iter=30, tol=1e-9).orderBy(
        "iteration").collect()
    assert [r.iteration for r in got] == list(range(1, 31))
    assert len(fitted) < 30 and fitted[0] == 30 and len(set(fitted)) == len(fitted)
    weights = learn.class_weights(rows, "y").select("y", "weight")
    for i in (1, 2, len(fitted), 29, 30):
        model = learn.train_weighted(rows, ["c_cat"], None, "y", max_iter=i, tol=1e-9)
        loss, accuracy = loss_of(model, rows, weights, None)
        assert got[i - 1].val_loss == pytest.approx(loss, rel=1e-9)
        assert got[i - 1].val_accuracy == pytest.approx(accuracy)


def test_the_scaler_is_fitted_without_index_joins(spark, monkeypatch):
    rows = spark.range(100).select((F.col("id") % 3).cast("string").alias("c"),
                                   F.col("id").cast("double").alias("x"),
                                   F.col("id").cast("int").alias("t"), F.lit(1).alias("label"))
    plans, fit = [], prep.scale.fit_scaler

    def seen(train, *rest):
        plans.append(train.select("x")._jdf.queryExecution().optimizedPlan().toString())
        return fit(train, *rest)
    monkeypatch.setattr(prep.scale, "fit_scaler", seen)
    spec = prep.PrepSpec(label="label", time="t", string_categories=["c"], int_categories=[],
                         continuous=["x"])
    out = prep.prepare(rows, spec)
    assert out.frame.count() == 100 and "Join" not in plans[0]
