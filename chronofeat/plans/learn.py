"""Weighted training, scoring, model save/load and a parameter search.

The reference trains an embedding network on 10 worker processes that each
read one shard of the exported Parquet. Here the same task - a class-weighted
binary classifier over categorical indices plus scaled continuous features -
is a Spark ML pipeline: an embedding over one-hot input is a learned linear
map, so ``OneHotEncoder`` + ``LogisticRegression(weightCol)`` is the default
model and ``GBTClassifier(weightCol)`` is the non-linear option. The
estimators aggregate gradients / statistics across all partitions of the
training data (every partition is a shard), so no process launch, ring
all-reduce or per-worker data loader is needed.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.balance import class_weights, with_weight
from ..sources.parquet import artifacts


def _features_stages(cat_cols, cont_col):
    onehot = [c + "_oh" for c in cat_cols]
    stages = [OneHotEncoder(inputCols=list(cat_cols), outputCols=onehot,
                            handleInvalid="keep", dropLast=True)] if onehot else []
    stages.append(VectorAssembler(inputCols=onehot + ([cont_col] if cont_col else []),
                                  outputCol="_x", handleInvalid="error"))
    return stages


def as_vector(df: DataFrame, col: str | None) -> DataFrame:
    """Exported ``array<float>`` features back to an ML vector (no-op for vectors or no column)."""
    if col is None:
        return df
    dtype = df.schema[col].dataType.typeName()
    return df.withColumn(col, array_to_vector(F.col(col))) if dtype == "array" else df


def build_estimator(cat_cols, cont_col: str, label: str, weight: str = "weight",
                    model: str = "logistic", max_iter: int = 7, reg_param: float = 0.0,
                    seed: int = 7, tol: float = 1e-6) -> Pipeline:
    if model == "logistic":
        clf = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight,
                                 maxIter=max_iter, regParam=reg_param, family="binomial", tol=tol)
    elif model == "gbt":
        clf = GBTClassifier(featuresCol="_x", labelCol=label, weightCol=weight,
                            maxIter=max_iter, seed=seed)
    else:
        raise ValueError(f"unknown model {model!r}")
    return Pipeline(stages=_features_stages(cat_cols, cont_col) + [clf])


def train_weighted(train: DataFrame, cat_cols, cont_col: str, label: str,
                   model: str = "logistic", max_iter: int = 7, reg_param: float = 0.0,
                   weights: DataFrame | None = None, tol: float = 1e-6) -> PipelineModel:
    """Fit a class-weighted classifier; weights default to "balanced" on ``train``.

    ``cont_col=None`` trains on the categories alone; no ``cat_cols`` on ``cont_col`` alone,
    as with learned embeddings (:meth:`..operators.embed.CategoryEmbedding.features`).
    """
    train = as_vector(train, cont_col).withColumn(label, F.col(label).cast("double"))
    if weights is None:
        weights = class_weights(train, label)
    train = with_weight(train, label, weights)
    return build_estimator(cat_cols, cont_col, label, "weight", model, max_iter,
                           reg_param, tol=tol).fit(train)


def score(model: PipelineModel, df: DataFrame, cont_col: str) -> DataFrame:
    """Add ``prediction`` (double) and ``p1`` = P(class 1); drops the work vectors."""
    out = model.transform(as_vector(df, cont_col))
    out = out.withColumn("p1", vector_to_array(F.col("probability"))[1])
    drop = [c for c in out.columns if c.endswith("_oh")] + ["_x", "rawPrediction", "probability"]
    return out.drop(*drop)


def history(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(iteration, loss) of a fitted logistic model's training, one row per iteration."""
    losses = [float(x) for x in model.stages[-1].summary.objectiveHistory]
    return spark.createDataFrame(list(enumerate(losses)), "iteration int, loss double")


def _version_path(path: str, version: int) -> str:
    return f"{path}/version={version:06d}"


def save(model: PipelineModel, path: str, version: int | None = None) -> str:
    """Save a model, as version ``version`` of ``path`` if given; returns the folder.

    A version counts once its mark under ``path/complete`` is written, after all
    of the model; a save that ended half-way leaves none and can be repeated. A
    complete version is never overwritten.
    """
    if version is None:
        model.write().overwrite().save(path)
        return path
    spark = SparkSession.active()
    if version in versions(spark, path):
        raise ValueError(f"version {version} of {path} is complete")
    to = _version_path(path, version)
    model.write().overwrite().save(to)
    spark.range(1).select(F.lit(version).alias("version"), F.lit(to).alias("path")).coalesce(
        1).write.mode("overwrite").json(f"{path}/complete/version={version:06d}")
    return to


def load(path: str, version: int | None = None) -> PipelineModel:
    """Load a model, or version ``version`` of those saved under ``path``."""
    return PipelineModel.load(path if version is None else _version_path(path, version))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions saved under ``path``, oldest first."""
    try:
        found = artifacts(spark, f"{path}/complete").select(F.regexp_extract(
            "path", r"/version=(\d+)/part-[^/]*\.json$", 1).alias("v")).where("v <> ''")
        return sorted(int(r["v"]) for r in found.distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def load_latest(spark: SparkSession, path: str) -> tuple[int, PipelineModel]:
    """(version, model) of the newest complete version under ``path``."""
    found = versions(spark, path)
    if not found:
        raise ValueError(f"no complete version under {path}")
    return found[-1], load(path, found[-1])


def log_uniform_draws(low_exp: float, high_exp: float, n: int, seed: int) -> list[float]:
    """``n`` seeded draws of ``exp(U(low_exp, high_exp))``."""
    rng = random.Random(seed)
    return [math.exp(rng.uniform(low_exp, high_exp)) for _ in range(n)]


@contextmanager
def _feature_frames(train: DataFrame, val: DataFrame, cat_cols, cont_col, label: str):
    """(label, weight, _x, _u) of train and val, kept for the time of the block.

    The feature stages are fitted once on train; weights are train's. ``_u`` in
    [0, 1) is a hash of the row, for nested samples.
    """
    def typed(df):
        return as_vector(df, cont_col).withColumn(label, F.col(label).cast("double"))

    train, val = typed(train), typed(val)
    weights = class_weights(train, label)
    features = Pipeline(stages=_features_stages(cat_cols, cont_col)).fit(train)

    def kept(df):
        rows = features.transform(with_weight(df, label, weights))
        used = [label, *cat_cols] + ([cont_col] if cont_col else [])
        u = F.pmod(F.xxhash64(*used), F.lit(1 << 40)) / F.lit(float(1 << 40))
        return rows.select(label, "weight", "_x", u.alias("_u")).persist(
            StorageLevel.MEMORY_AND_DISK)

    tr, va = kept(train), kept(val)
    try:
        yield tr, va
    finally:
        tr.unpersist()
        va.unpersist()


def _fit_all(train: DataFrame, label: str, settings: list[dict], parallelism: int,
             first: int = 0) -> list:
    """One logistic model for each of ``settings``, some at a time; outputs are numbered from
    ``first``."""
    def fit(i):
        return LogisticRegression(
            featuresCol="_x", labelCol=label, weightCol="weight", family="binomial",
            predictionCol=f"_pred{first + i}", rawPredictionCol=f"_raw{first + i}",
            probabilityCol=f"_prob{first + i}", **settings[i]).fit(train)
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(fit, range(len(settings))))


def _losses(rows: DataFrame, label: str, scores: list) -> list[tuple[float, float]]:
    """(weighted log loss, accuracy) of each column of P(class 1), from one pass over ``rows``."""
    w, aggs = F.col("weight"), []
    for i, p1 in enumerate(scores):
        p = F.least(F.greatest(p1, F.lit(1e-15)), F.lit(1.0 - 1e-15))
        right = F.when(F.col(label) == 1, p).otherwise(1.0 - p)
        hit = (F.when(p1 > 0.5, 1.0).otherwise(0.0) == F.col(label)).cast("double")
        aggs += [(-F.sum(w * F.log(right)) / F.sum(w)).alias(f"l{i}"), F.avg(hit).alias(f"a{i}")]
    got = rows.where(F.col(label).isNotNull()).agg(*aggs).first()
    return [(got[f"l{i}"], got[f"a{i}"]) for i in range(len(scores))]


def _logistic_losses(val: DataFrame, label: str, models: list) -> list[tuple[float, float]]:
    scored = val
    for m in models:
        scored = m.transform(scored)
    return _losses(scored, label, [vector_to_array(F.col(f"_prob{i}"))[1]
                                   for i in range(len(models))])


def validation_history(train: DataFrame, val: DataFrame, cat_cols, cont_col, label: str,
                       model: str = "logistic", max_iter: int = 7, reg_param: float = 0.0,
                       seed: int = 7, tol: float = 1e-6, parallelism: int = 4) -> DataFrame:
    """(iteration, val_loss, val_accuracy) after each of ``max_iter`` iterations.

    The models of all iterations are scored in one pass over ``val``. A logistic
    fit has no state to go on from, but is deterministic: its i-th iterate is the
    fit of i iterations, on features made once. The fit of all iterations comes first:
    one that has converged earlier stays where it is, so the iterations from there
    on need no fit of their own. Boosted trees are fitted once; iteration i sums the
    first i.
    """
    with _feature_frames(train, val, cat_cols, cont_col, label) as (tr, va):
        if model == "logistic":
            def fits(iterations, first):
                return _fit_all(tr, label, [{"maxIter": i, "regParam": reg_param, "tol": tol}
                                            for i in iterations], parallelism, first)
            models = fits([max_iter], 0)
            end = max(1, models[0].summary.totalIterations)
            models += fits(range(1, end), 1)
            losses = _logistic_losses(va, label, models)
            found = losses[1:] + losses[:1] * (max_iter - end + 1)
        elif model == "gbt":
            fitted = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="weight",
                                   maxIter=max_iter, seed=seed).fit(tr)
            scored, margin, scores = va, F.lit(0.0), []
            for i, (tree, w) in enumerate(zip(fitted.trees, fitted.treeWeights)):
                scored = tree.setPredictionCol(f"_tree{i}").setFeaturesCol("_x").transform(scored)
                margin = margin + F.lit(float(w)) * F.col(f"_tree{i}")
                scores.append(1.0 / (1.0 + F.exp(-2.0 * margin)))
            found = _losses(scored, label, scores)
        else:
            raise ValueError(f"unknown model {model!r}")
    rows = [(i + 1, float(x), float(a)) for i, (x, a) in enumerate(found)]
    return train.sparkSession.createDataFrame(
        rows, "iteration int, val_loss double, val_accuracy double")


def halving_search(train: DataFrame, val: DataFrame, cat_cols, cont_col, label: str, reg_params,
                   keep: float = 0.5, max_iter: int = 7, tol: float = 1e-6,
                   parallelism: int = 4) -> DataFrame:
    """Successive halving: (rung, share, reg_param, val_log_loss, kept, best).

    A rung fits its candidates on a sample of train and keeps the ``keep`` best of
    them (the first of equal losses); each rung's sample is 1 / ``keep`` times as
    large as the one before and holds it (rows by hash), the last is all of train.
    The losses of a rung come from one pass over the whole of ``val``.
    """
    alive, rungs = list(range(len(reg_params))), 1
    while math.ceil(len(reg_params) * keep ** rungs) > 1:
        rungs += 1
    out = []
    with _feature_frames(train, val, cat_cols, cont_col, label) as (tr, va):
        for rung in range(rungs):
            share = keep ** (rungs - 1 - rung)
            sample = tr if share >= 1 else tr.where(F.col("_u") < share)
            models = _fit_all(sample, label, [
                {"regParam": float(reg_params[i]), "maxIter": max_iter, "tol": tol}
                for i in alive], parallelism)
            losses = [x for x, _ in _logistic_losses(va, label, models)]
            order = sorted(range(len(alive)), key=lambda i: (losses[i], alive[i]))
            last = rung == rungs - 1
            stay = set(order[:1 if last else math.ceil(len(alive) * keep)])
            out += [(rung, share, float(reg_params[i]), losses[k], k in stay, last and k in stay)
                    for k, i in enumerate(alive)]
            alive = [i for k, i in enumerate(alive) if k in stay]
    return train.sparkSession.createDataFrame(
        out, "rung int, share double, reg_param double, val_log_loss double, kept boolean, "
             "best boolean")


def param_search(train: DataFrame, val: DataFrame, cat_cols, cont_col: str, label: str,
                 reg_params=None, n_draws: int = 3, seed: int = 11, max_iter: int = 7,
                 low_exp: float = -10.0, high_exp: float = -4.0,
                 parallelism: int = 4, tol: float = 1e-6) -> DataFrame:
    """Fit one model per ``regParam`` and return (reg_param, val_log_loss, best).

    Candidates come from a seeded log-uniform draw on exp(-10)..exp(-4). The
    feature stages are fitted once and both feature frames kept for the time of
    the search; ``parallelism`` classifiers are fitted at a time, and one pass
    over the *time-ordered* validation split yields every candidate's
    class-weighted log loss. The lowest loss is best (the first of equal ones).
    """
    if reg_params is None:
        reg_params = log_uniform_draws(low_exp, high_exp, n_draws, seed)
    with _feature_frames(train, val, cat_cols, cont_col, label) as (tr, va):
        models = _fit_all(tr, label, [{"regParam": float(r), "maxIter": max_iter, "tol": tol}
                                      for r in reg_params], parallelism)
        losses = [x for x, _ in _logistic_losses(va, label, models)]
    best = min(range(len(losses)), key=lambda i: (losses[i], i))
    rows = [(float(r), x, i == best) for i, (r, x) in enumerate(zip(reg_params, losses))]
    return train.sparkSession.createDataFrame(
        rows, "reg_param double, val_log_loss double, best boolean")
