"""Metrics against closed forms from the 2x2 table and brute force."""

import math

import pytest
from pyspark.sql import functions as F

from chronofeat.operators import metrics

# truth, pred, p1
ROWS = [(1, 1, 0.9), (1, 0, 0.4), (1, 1, 0.7), (0, 0, 0.2), (0, 1, 0.6),
        (0, 0, 0.4), (0, 0, 0.1), (1, 1, 0.6), (None, 1, 0.5)]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, "y int, p int, s double")


def _table():
    rows = [(t, p) for t, p, _ in ROWS if t is not None]
    tp = sum(1 for t, p in rows if t == 1 and p == 1)
    tn = sum(1 for t, p in rows if t == 0 and p == 0)
    fp = sum(1 for t, p in rows if t == 0 and p == 1)
    fn = sum(1 for t, p in rows if t == 1 and p == 0)
    return tp, tn, fp, fn


def test_confusion(df):
    tp, tn, fp, fn = _table()
    got = {r.truth: (r.pred_0, r.pred_1) for r in metrics.confusion(df, "y", "p").collect()}
    assert got == {0: (tn, fp), 1: (fn, tp)}
    swapped = {r.truth: (r.pred_0, r.pred_1) for r in metrics.confusion(df, "p", "y").collect()}
    assert swapped == {0: (tn, fn), 1: (fp, tp)}  # transposed


def test_report_and_f1(df):
    tp, tn, fp, fn = _table()
    p1, r1 = tp / (tp + fp), tp / (tp + fn)
    p0, r0 = tn / (tn + fn), tn / (tn + fp)
    f1_1, f1_0 = 2 * p1 * r1 / (p1 + r1), 2 * p0 * r0 / (p0 + r0)
    rep = {r["class"]: r for r in metrics.report(df, "y", "p").collect()}
    assert rep["1"].precision == pytest.approx(p1) and rep["1"].recall == pytest.approx(r1)
    assert rep["0"].f1 == pytest.approx(f1_0) and rep["0"].support == tn + fp
    n = tp + tn + fp + fn
    assert rep["accuracy"].f1 == pytest.approx((tp + tn) / n) and rep["accuracy"].precision is None
    assert rep["macro avg"].f1 == pytest.approx((f1_0 + f1_1) / 2)
    wf1 = ((tn + fp) * f1_0 + (tp + fn) * f1_1) / n
    assert rep["weighted avg"].f1 == pytest.approx(wf1)
    assert metrics.weighted_f1(df, "y", "p").first().weighted_f1 == pytest.approx(wf1)


def test_auc_hard_both_orders(df):
    tp, tn, fp, fn = _table()
    assert metrics.auc_hard(df, "y", "p").first().auc == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    # the reference's swapped call: (precision + NPV) / 2
    assert metrics.auc_hard(df, "p", "y").first().auc == pytest.approx((tp / (tp + fp) + tn / (tn + fn)) / 2)


@pytest.mark.parametrize("buckets", [1, 2])
def test_auc_score_brute_force(df, buckets):
    rows = [(t, s) for t, _, s in ROWS if t is not None]
    pos = [s for t, s in rows if t == 1]
    neg = [s for t, s in rows if t == 0]
    pairs = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    got = metrics.auc_score(df, "y", "s", scan_buckets=buckets).first().auc
    assert got == pytest.approx(pairs / (len(pos) * len(neg)))


def test_weighted_log_loss(df, spark):
    w = df.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(0.5))
    rows = [(t, s) for t, _, s in ROWS if t is not None]
    num = sum((2.0 if t else 0.5) * -math.log(s if t else 1 - s) for t, s in rows)
    den = sum(2.0 if t else 0.5 for t, _ in rows)
    assert metrics.weighted_log_loss(w, "y", "s", "w").first().log_loss == pytest.approx(num / den)


def test_log_loss_matches_spark_evaluator(df):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.linalg import Vectors, VectorUDT
    d = df.where(F.col("y").isNotNull()).withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(0.5))
    to_vec = F.udf(lambda s: Vectors.dense([1 - s, s]), VectorUDT())
    scored = d.select(F.col("y").cast("double").alias("label"), F.col("p").cast("double").alias(
        "prediction"), to_vec("s").alias("probability"), "w", "s")
    ev = MulticlassClassificationEvaluator(metricName="logLoss", weightCol="w")
    ours = metrics.weighted_log_loss(scored, "label", "s", "w").first().log_loss
    assert ours == pytest.approx(ev.evaluate(scored), abs=1e-12)


def test_accuracy_and_shard_mean(df):
    tp, tn, fp, fn = _table()
    assert metrics.accuracy(df, "y", "p").first().accuracy == pytest.approx((tp + tn) / 8)
    sh = df.withColumn("shard", F.when(F.col("s") > 0.5, 1).otherwise(0))
    rows = [(t, p, s) for t, p, s in ROWS if t is not None]
    accs = []
    for k in (0, 1):
        part = [(t, p) for t, p, s in rows if (s > 0.5) == bool(k)]
        accs.append(sum(t == p for t, p in part) / len(part))
    got = metrics.shard_mean_accuracy(sh, "y", "p", "shard").first()
    assert got.mean_accuracy == pytest.approx(sum(accs) / 2) and got.shards == 2


def test_confusion_is_complete(spark):
    """Three labels, a class without rows, and values that are no class."""
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (2, 0), (7, 0), (2, 9), (None, 1)],
                               "y int, p int")
    got = {r.truth: (r.pred_0, r.pred_1, r.pred_2, r.pred_other)
           for r in metrics.confusion(df, "y", "p", (0, 1, 2)).collect()}
    assert got == {0: (1, 0, 1, 0), 1: (0, 0, 0, 0), 2: (1, 0, 1, 1), None: (1, 0, 0, 0)}
    own = metrics.confusion(df, "y", "p")
    assert own.columns == ["truth", "pred_0", "pred_2", "pred_7", "pred_9", "pred_other"]
    assert own.agg(F.sum(sum(F.col(c) for c in own.columns[1:]))).first()[0] == 6


def test_report_averages_over_the_classes_of_the_data(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 2)], "y int, p int")
    rep = {r["class"]: r for r in metrics.report(df, "y", "p").collect()}
    assert set(rep) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert rep["weighted avg"].support == sum(rep[c].support for c in "012") == 5
    assert rep["weighted avg"].recall == pytest.approx(0.8) == rep["accuracy"].f1


def test_auc_from_counts_beyond_64_bits(spark):
    n = 4_000_000_000
    per = spark.createDataFrame([(0.1, n, 3 * n), (0.5, n, n), (0.9, 2 * n, 0)],
                                "_s double, _p long, _q long")
    # of 4n positives x 4n negatives: n*1.5n + n*3.5n + 2n*4n
    assert metrics.auc_from_counts(per).first().auc == pytest.approx(13 / 16)
