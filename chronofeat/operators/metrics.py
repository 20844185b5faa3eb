"""Classification metrics as DataFrame aggregates.

Every function takes the truth and prediction column names explicitly
(``truth``, ``pred``), so the conventional orientation is the default and the
reference's swapped call ``metric(preds, labels)`` is obtained by swapping the
two arguments. Each result is a small DataFrame; no rows go to the driver.
Rows with a NULL truth or prediction are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import ordered_scan


def _valid(df, *cols):
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.where(cond)


#: More classes than this make no matrix; :func:`confusion_counts` has no limit.
MAX_CLASSES = 1000


def class_values(df: DataFrame, truth: str, pred: str, most: int = MAX_CLASSES) -> list:
    """The distinct classes among truths and predictions, in order (a matrix side, not rows).

    More than ``most`` raise a ValueError; no more than that many reach the driver.
    """
    d = _valid(df, truth, pred)
    both = d.select(F.col(truth).alias("c")).unionByName(d.select(F.col(pred).alias("c")))
    found = both.distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} classes in {truth!r} and {pred!r}; "
                         "list the classes, or use confusion_counts")
    return sorted(r["c"] for r in found)


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n): the confusion matrix in long form, for any number of classes."""
    return _valid(df, truth, pred).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, pred: str, classes=None) -> DataFrame:
    """(truth, pred_<c> ..., pred_other): one row per class, one count column per prediction.

    ``classes`` are those found in the data by default. Classes without rows
    have a row of zeros; rows whose truth is no listed class are counted in a
    row with truth NULL, predictions that are none in ``pred_other``.
    """
    classes = list(class_values(df, truth, pred) if classes is None else classes)
    d = _valid(df, truth, pred)
    kind = df.schema[truth].dataType
    shown = F.when(F.col(truth).isin(classes), F.col(truth)) if classes else F.lit(None)
    counts = d.select(shown.cast(kind).alias("truth"), *[
        (F.col(pred) == c).cast("long").alias(f"pred_{c}") for c in classes],
        (~F.col(pred).isin(classes) if classes else F.lit(True)).cast("long").alias("pred_other"))
    names = counts.columns[1:]
    listed = df.sparkSession.range(1).select(F.explode(F.array(
        *[F.lit(c).cast(kind) for c in classes])).alias("truth")) if classes else counts.select("truth").limit(0)
    zeros = listed.select("truth", *[F.lit(0).cast("long").alias(n) for n in names])
    return counts.unionByName(zeros).groupBy("truth").agg(*[F.sum(n).alias(n) for n in names])


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(accuracy, n)."""
    d = _valid(df, truth, pred)
    return d.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n"))


def shard_mean_accuracy(df: DataFrame, truth: str, pred: str, shard: str) -> DataFrame:
    """Mean over shards of per-shard accuracy (each worker's value counts once)."""
    d = _valid(df, truth, pred)
    per = d.groupBy(shard).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("_a"))
    return per.agg(F.avg("_a").alias("mean_accuracy"), F.count(F.lit(1)).alias("shards"))


def _class_counts(df, truth, pred, classes):
    d = _valid(df, truth, pred)
    aggs = [F.count(F.lit(1)).alias("total")]
    for c in classes:
        t, p = F.col(truth) == c, F.col(pred) == c
        aggs += [F.sum((t & p).cast("long")).alias(f"tp_{c}"),
                 F.sum(t.cast("long")).alias(f"sup_{c}"),
                 F.sum(p.cast("long")).alias(f"prd_{c}")]
    return d.agg(*aggs)


def _ratio(a, b):
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _per_class(classes):
    """precision / recall / f1 / support columns of each class, from _class_counts."""
    out = {}
    for c in classes:
        p = _ratio(F.col(f"tp_{c}"), F.col(f"prd_{c}"))
        r = _ratio(F.col(f"tp_{c}"), F.col(f"sup_{c}"))
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        out[c] = (p, r, f1, F.col(f"sup_{c}"))
    return out


def report(df: DataFrame, truth: str, pred: str, classes=None) -> DataFrame:
    """Per-class precision, recall, f1, support plus accuracy, macro and weighted averages.

    Columns: ``class`` (string), ``precision``, ``recall``, ``f1``, ``support``.
    The accuracy row carries the accuracy in ``f1`` and NULL precision/recall;
    it is over all rows. The averages are over the listed classes (by default
    those of the data) and their support. An empty frame has the three last rows, zero.
    """
    classes = list(class_values(df, truth, pred) if classes is None else classes)
    counts = _class_counts(df, truth, pred, classes)
    pc = _per_class(classes)
    k = float(max(1, len(classes)))
    total, listed = F.col("total"), sum((F.col(f"sup_{c}") for c in classes), F.lit(0))
    acc = _ratio(sum((F.col(f"tp_{c}") for c in classes), F.lit(0)), total)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("long").alias("support"))

    rows = [row(str(c), *pc[c]) for c in classes]
    rows.append(row("accuracy", F.lit(None), F.lit(None), acc, total))
    macro = [sum((pc[c][i] for c in classes), F.lit(0.0)) / k for i in range(3)]
    rows.append(row("macro avg", *macro, listed))
    weighted = [_ratio(sum((pc[c][i] * pc[c][3] for c in classes), F.lit(0.0)), listed)
                for i in range(3)]
    rows.append(row("weighted avg", *weighted, listed))
    return counts.select(F.inline(F.array(*rows)))


def weighted_f1(df: DataFrame, truth: str, pred: str, classes=None) -> DataFrame:
    """Class F1 averaged with weights = support of ``truth`` (sklearn ``average='weighted'``).

    ``classes`` are those of the data by default; the average is over their support.
    """
    classes = list(class_values(df, truth, pred) if classes is None else classes)
    pc = _per_class(classes)
    listed = sum((pc[c][3] for c in classes), F.lit(0))
    val = _ratio(sum((pc[c][2] * pc[c][3] for c in classes), F.lit(0.0)), listed)
    return _class_counts(df, truth, pred, classes).select(val.alias("weighted_f1"))


def auc_hard(df: DataFrame, truth: str, pred: str, positive=1, negative=0) -> DataFrame:
    """ROC AUC of hard 0/1 predictions: (TPR + TNR) / 2."""
    counts = _class_counts(df, truth, pred, (negative, positive))
    tpr = _ratio(F.col(f"tp_{positive}"), F.col(f"sup_{positive}"))
    tnr = _ratio(F.col(f"tp_{negative}"), F.col(f"sup_{negative}"))
    return counts.select(((tpr + tnr) / 2).alias("auc"))


def auc_score(df: DataFrame, truth: str, score: str, positive=1,
              scan_buckets: int | None = None) -> DataFrame:
    """ROC AUC of a continuous score (Mann-Whitney with ties counted half).

    Per distinct score: positives and negatives; an ordered scan gives the
    negatives below each score; the AUC is one more aggregate.
    """
    d = _valid(df, truth, score)
    is_pos = (F.col(truth) == positive).cast("long")
    per = d.groupBy(F.col(score).alias("_s")).agg(
        F.sum(is_pos).alias("_p"), F.sum(1 - is_pos).alias("_q"))
    return auc_from_counts(per, scan_buckets)


def auc_from_counts(per: DataFrame, scan_buckets: int | None = None) -> DataFrame:
    """ROC AUC from rows (_s score, _p positives, _q negatives), one per distinct score."""
    scanned = ordered_scan(per, [F.col("_s")], sums={"_qb": F.col("_q")}, buckets=scan_buckets)
    num = F.sum(F.col("_p") * (F.col("_qb") + 0.5 * F.col("_q")))
    den = F.sum("_p").cast("double") * F.sum("_q").cast("double")
    return scanned.agg(F.when(den > 0, num / den).alias("auc"))


def _log_loss_terms(truth: str, p1: str, weight: str | None, eps: float):
    p = F.least(F.greatest(F.col(p1).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    p_true = F.when(F.col(truth) == 1, p).otherwise(1.0 - p)
    return F.col(weight).cast("double") if weight else F.lit(1.0), F.log(p_true)


def batch_log_loss(df: DataFrame, truth: str, p1: str, batch: str, weight: str | None = None,
                   eps: float = 1e-15) -> DataFrame:
    """(batch, log_loss, n, weight): the weighted log loss of every batch, one row a batch."""
    w, ln = _log_loss_terms(truth, p1, weight, eps)
    return _valid(df, truth, p1).groupBy(F.col(batch).alias("batch")).agg(
        (-F.sum(w * ln) / F.sum(w)).alias("log_loss"), F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("weight"))


def mean_batch_log_loss(df: DataFrame, truth: str, p1: str, batch: str, weight: str | None = None,
                        eps: float = 1e-15) -> DataFrame:
    """(mean_batch_loss, global_loss, batches, n): every batch counted once, and all rows at once."""
    per = batch_log_loss(df, truth, p1, batch, weight, eps)
    return per.agg(F.avg("log_loss").alias("mean_batch_loss"),
                   (F.sum(F.col("log_loss") * F.col("weight")) / F.sum("weight"))
                   .alias("global_loss"),
                   F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n"))


def weighted_log_loss(df: DataFrame, truth: str, p1: str, weight: str | None = None,
                      eps: float = 1e-15) -> DataFrame:
    """``-sum(w * ln p_truth) / sum(w)`` for a binary truth and P(class 1) in ``p1``.

    Probabilities are clipped to [eps, 1 - eps] as Spark's log-loss evaluator
    does. ``weight=None`` gives every row weight 1.
    """
    w, ln = _log_loss_terms(truth, p1, weight, eps)
    return _valid(df, truth, p1).agg((-F.sum(w * ln) / F.sum(w)).alias("log_loss"),
                                     F.count(F.lit(1)).alias("n"))
