"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's tables through the two fixture views

Oracle house rules: NULLS FIRST written out in every ordered window; ``||``
for NULL-propagating concatenation; integer sums cast to BIGINT; doubles
that come from different summation orders are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import (appended, balance, batches, clean, embed, encode, episodes, metrics, scale,
                        split)
from .plans import learn, prepare as prep
from .session import reliable_checkpoint, shared_path, stored
from .sources import parquet, views

# ---------------------------------------------------------------------------
# shared pieces

CONT = views.SALES_CONTINUOUS
CATS = views.SALES_CATEGORIES
#: Embedded columns and their numbers of labels.
EMBEDDED = {"o_orderpriority": 5, "c_mktsegment": 5, "p_brand": 25, "p_size": 50}
MODEL_COLS = ["label"] + CONT + ["o_orderdate"] + CATS


def _score_p1():
    """Fixed probability of class 1: value / 500 clipped to [0.01, 0.99]."""
    return scalar.clip(F.col("value") / F.lit(500.0), 0.01, 0.99)


def _pred():
    """Fixed hard prediction: value > 50."""
    return (F.col("value") > 50).cast("int")


def _sales(spark, d):
    return views.sales_view(spark, d)


def _events(spark, d):
    return views.events_view(spark, d)


def _episodes(spark, d, outputs):
    return episodes.assign_episodes(_events(spark, d), "entity", "ts_hour", "label",
                                    "event_id", outputs=outputs)


def _stored_sales(spark, d, cols):
    """Columns of the sales view, joined once for all passes of a split or preparation."""
    return stored(_sales(spark, d).select(*cols), "sales")


def _split_sales(spark, d, cols):
    return split.time_split(_stored_sales(spark, d, ["o_orderdate", *cols]), "o_orderdate")


def _scored_events(spark, d):
    return _events(spark, d).select("event_id", "label", "value", _score_p1().alias("p1"),
                                    _pred().alias("pred"))


def _sales_spec():
    return prep.PrepSpec(label="label", time="o_orderdate",
                         string_categories=views.SALES_STRING_CATEGORIES,
                         int_categories=views.SALES_INT_CATEGORIES,
                         continuous=CONT, required=["label"])


def _prepared(spark, d):
    return prep.prepare(_stored_sales(spark, d, MODEL_COLS), _sales_spec())


def _r(col, digits):
    return F.round(F.col(col), digits).alias(col)


# ---------------------------------------------------------------------------
# A: sources / sinks


def q_scan_view(spark, d):
    views.register_view(_sales(spark, d), "sales_view")
    return views.scan_view(spark, "sales_view")


def q_export_roundtrip(spark, d):
    """Every exported column read back: index columns as written, features rounded."""
    prepared = _prepared(spark, d)
    path = prep.export(prepared, shared_path(spark, "export"))
    back = spark.read.parquet(path)
    return back.select("label", "split", *_cat_idx(), *[
        F.round(F.col("scaledFeatures")[i].cast("double"), 3).alias(f"s_{c}")
        for i, c in enumerate(CONT)])


def q_shard_counts(spark, d):
    """(shards, empty_shards, total_rows, overlapping_rows) of the train export in 4 readers."""
    prepared = _prepared(spark, d)
    path = parquet.write_shards(prepared.split("train"), shared_path(spark, "shards"), 10)
    parts = [p.select(F.lit(r).alias("shard"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.row_index").alias("row"))
             for r, p in enumerate(parquet.read_shards(spark, path, 4))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    per_row = rows.groupBy("file", "row").agg(F.count(F.lit(1)).alias("readers"),
                                              F.min("shard").alias("shard"))
    return per_row.agg(
        F.lit(len(parts)).alias("shards"),
        (F.lit(len(parts)) - F.count_distinct("shard")).alias("empty_shards"),
        F.sum("readers").alias("total_rows"),
        F.sum((F.col("readers") > 1).cast("long")).alias("overlapping_rows"))


def q_preview_topk(spark, d):
    ev = _events(spark, d)
    return parquet.preview(ev.select("event_id", "entity", "ts_hour", "label"),
                           [F.col("entity").asc_nulls_first(), F.col("ts_hour").asc_nulls_first(),
                            F.col("event_id")], 4)


def q_sort_entity_time(spark, d):
    ev = _events(spark, d)
    return ev.select("event_id", "entity", "ts_hour").orderBy(
        F.col("entity").asc_nulls_first(), F.col("ts_hour").asc_nulls_first(), "event_id")


# ---------------------------------------------------------------------------
# B: projections / filters


def q_filter_threshold(spark, d):
    return clean.filter_threshold(_events(spark, d), "value", 5)


def q_entity_key(spark, d):
    ev = clean.with_entity_key(_events(spark, d), ["entity", "event_type"], "entity_key")
    return ev.select("event_id", "entity_key")


def q_project_model_cols(spark, d):
    return clean.project(_sales(spark, d), MODEL_COLS)


def q_drop_required_nulls(spark, d):
    ev = clean.with_entity_key(_events(spark, d), ["entity", "event_type"], "entity_key")
    return clean.drop_required_nulls(ev, ["label", "entity_key"]).select(
        "event_id", "entity_key", "label")


def q_cast_indices(spark, d):
    model = encode.fit_category_index(_sales(spark, d), ["p_brand", "p_size"])
    out = model.transform(_sales(spark, d))
    return clean.cast_columns(out.select("label", "p_brand_cat", "p_size_cat"),
                              {"label": "long", "p_brand_cat": "long", "p_size_cat": "long"})


# ---------------------------------------------------------------------------
# C: sequence windows


def q_break_flags(spark, d):
    return _episodes(spark, d, ("brk",)).select("event_id", "brk")


def q_lag_entity(spark, d):
    return _episodes(spark, d, ("prev_entity",)).select("event_id", "prev_entity")


def q_lag_default(spark, d):
    return _episodes(spark, d, ("prev_label",)).select("event_id", "prev_label")


def q_running_breaks(spark, d):
    return _episodes(spark, d, ("running_breaks",)).select("event_id", "running_breaks")


def q_case_time(spark, d):
    return _episodes(spark, d, ("time",)).select("event_id", "time")


def q_episodes(spark, d):
    return _episodes(spark, d, ("case_id", "time")).select(
        "event_id", "entity", "ts_hour", "label", "case_id", "time")


def q_episodes_split_blocks(spark, d):
    """Episodes over many more ranges than entities: peer groups and episodes cross them."""
    out = episodes.assign_episodes(_events(spark, d), "entity", "ts_hour", "label", "event_id",
                                   outputs=("case_id", "time"), ranges=150)
    return out.select("event_id", "entity", "ts_hour", "label", "case_id", "time")


def q_episodes_appended(spark, d):
    """Episodes of three batches in time order, each from its own rows and the state before it."""
    events = _events(spark, d).select("event_id", "entity", "ts_hour", "label")
    state, parts = appended.empty_state(spark, events, "entity", "ts_hour", "label"), []
    for batch in split.split_frames(events, "ts_hour", (0.4, 0.7)):
        rows, state, _ = appended.append_episodes(batch, state, "entity", "ts_hour", "label",
                                                  "event_id")
        parts.append(rows)
    return appended.global_episodes(parts[0].unionByName(parts[1]).unionByName(parts[2]), state,
                                    "entity")


def q_time_polynomial(spark, d):
    ep = episodes.time_polynomial(_episodes(spark, d, ("time",)))
    return ep.select("event_id", "time", "time2", "time3")


def q_time_percent_rank(spark, d):
    pr = split.time_percent_rank(_sales(spark, d), "o_orderdate")
    return pr.select("o_orderdate", "pr")


# ---------------------------------------------------------------------------
# I1 / D1 / D2 / D5: split and balance


def q_time_split(spark, d):
    return _split_sales(spark, d, ["label"]).select("o_orderdate", "label", "split")


def _split_label_counts(spark, d):
    """(split, label, n) from one pass over the sales view."""
    return split.split_label_counts(_stored_sales(spark, d, ["o_orderdate", "label"]),
                                    "o_orderdate", "label")


def q_time_split_refined(spark, d):
    """Split from order statistics with narrow ranges, several levels deep."""
    out = split.time_split(_stored_sales(spark, d, ["o_orderdate", "label"]), "o_orderdate",
                           method="rank", width=16)
    return out.select("o_orderdate", "label", "split")


def q_split_counts(spark, d):
    return _split_label_counts(spark, d).groupBy("split").agg(F.sum("n").cast("long").alias("n"))


def q_label_distribution(spark, d):
    train = _split_label_counts(spark, d).where(F.col("split") == "train")
    return train.select("label", F.col("n").cast("long").alias("n"))


def q_class_weights(spark, d):
    train = _split_label_counts(spark, d).where(F.col("split") == "train")
    return balance.class_weights(train, "label", count_col="n")


def q_class_weights_by_split(spark, d):
    return balance.class_weights(_split_label_counts(spark, d), "label", by="split",
                                 count_col="n")


# ---------------------------------------------------------------------------
# D3 / D4 / F: encoding and scaling


def q_categorical_cardinality(spark, d):
    return encode.cardinality(_sales(spark, d), CATS)


def q_embedding_width(spark, d):
    return encode.embedding_width(encode.cardinality(_sales(spark, d), CATS))


def q_category_index(spark, d):
    sales = _sales(spark, d)
    out = encode.fit_category_index(sales, CATS).transform(sales)
    return out.select(*[c + "_cat" for c in CATS])


def q_category_index_table(spark, d):
    sales = _sales(spark, d)
    return encode.index_table(sales, CATS).select("column", "value", "n", "index")


def q_category_index_joined(spark, d):
    """Index built in range buckets, saved, loaded and applied."""
    sales = _sales(spark, d)
    path = encode.fit_category_index(sales, CATS, scan_buckets=3).save(shared_path(spark, "index"))
    out = encode.load_category_index(spark, path, CATS).transform(sales)
    return out.select(*[c + "_cat" for c in CATS])


def q_pack_categories(spark, d):
    sales = _sales(spark, d)
    out = encode.fit_category_index(sales, CATS).transform(sales)
    return out.select(scalar.pack_categories([c + "_cat" for c in CATS]).alias("x_cat"))


def q_assembled_array(spark, d):
    out = scale.assemble(_sales(spark, d), CONT, "features")
    return out.select(scalar.vector_to_float64("features").alias("features"))


def q_scaled_features(spark, d):
    s = _split_sales(spark, d, CONT)
    model = scale.fit_scaler(s.where(F.col("split") == "train"), CONT, "scaled")
    out = scale.apply_scaler(model, s, CONT, "scaled", as_array="float64")
    return out.select("split", *[F.round(F.col("scaled")[i], 4).alias(f"s_{c}")
                                 for i, c in enumerate(CONT)])


def q_scaled_features_f32(spark, d):
    """Export form: scaled vector as ``array<float>`` (compared after widening, rounded)."""
    s = _split_sales(spark, d, CONT)
    model = scale.fit_scaler(s.where(F.col("split") == "train"), CONT, "scaled")
    out = scale.apply_scaler(model, s, CONT, "scaled", as_array="float32")
    return out.select("split", *[F.round(F.col("scaled")[i].cast("double"), 4).alias(f"s_{c}")
                                 for i, c in enumerate(CONT)])


# ---------------------------------------------------------------------------
# G: scalar functions


def q_argmax_class(spark, d):
    ev = _scored_events(spark, d)
    return ev.select("event_id",
                     scalar.argmax_class(scalar.probability_pair("p1")).alias("pred_class"))


# ---------------------------------------------------------------------------
# D6 - D12: metrics on a fixed prediction


def q_weighted_log_loss(spark, d):
    ev = _scored_events(spark, d).where(F.col("label").isNotNull())
    w = balance.with_weight(ev, "label", balance.class_weights(ev, "label"))
    return metrics.weighted_log_loss(w, "label", "p1", "weight").select(_r("log_loss", 8), "n")


def q_accuracy(spark, d):
    return metrics.accuracy(_scored_events(spark, d), "label", "pred").select(
        _r("accuracy", 10), "n")


def q_shard_mean_accuracy(spark, d):
    ev = parquet.shard_column(_scored_events(spark, d), "event_id", 10, method="mod")
    return metrics.shard_mean_accuracy(ev, "label", "pred", "shard").select(
        _r("mean_accuracy", 10), "shards")


def q_confusion_matrix(spark, d):
    return metrics.confusion(_scored_events(spark, d), "label", "pred")


def q_classification_report(spark, d):
    rep = metrics.report(_scored_events(spark, d), "label", "pred")
    return rep.select("class", _r("precision", 8), _r("recall", 8), _r("f1", 8), "support")


def q_roc_auc(spark, d):
    ev = _scored_events(spark, d)
    hard = metrics.auc_hard(ev, "label", "pred").select(F.lit("hard").alias("kind"), _r("auc", 10))
    soft = metrics.auc_score(ev, "label", "p1").select(F.lit("score").alias("kind"), _r("auc", 10))
    return hard.unionByName(soft)


def q_weighted_f1(spark, d):
    return metrics.weighted_f1(_scored_events(spark, d), "label", "pred").select(
        _r("weighted_f1", 10))


# ---------------------------------------------------------------------------
# H / A4 - A6: training, scoring, reload, search


def _cat_idx():
    return [c + "_cat" for c in CATS]


def _brand_export(spark, d):
    """The prepared table exported and read back, as training reads it."""
    path = prep.export(_prepared(spark, d), shared_path(spark, "export"))
    return spark.read.parquet(path)


def _brand_model(rows):
    """A model of one one-hot category, to convergence: its scores have a closed form."""
    return learn.train_weighted(rows.where(F.col("split") == "train"), ["p_brand_cat"], None,
                                "label", max_iter=200, tol=1e-12)


def _brand_scores(spark, d, part):
    rows = _brand_export(spark, d)
    model = _brand_model(rows)
    return model, learn.score(model, rows.where(F.col("split") == part), None)


def q_train_scores(spark, d):
    return _brand_scores(spark, d, "val")[1].select(
        "label", "p_brand_cat", F.col("prediction").cast("int").alias("prediction"), _r("p1", 4))


def q_score_rows(spark, d):
    return _brand_scores(spark, d, "test")[1].select(
        "label", "p_brand_cat", F.col("prediction").cast("int").alias("prediction"), _r("p1", 4))


def q_model_reload_scores(spark, d):
    """(rows, same): test rows, and those that the saved and loaded model scores alike."""
    rows = _brand_export(spark, d)
    test = rows.where(F.col("split") == "test")
    model = learn.train_weighted(rows.where(F.col("split") == "train"), _cat_idx(),
                                 "scaledFeatures", "label")
    path = shared_path(spark, "models")
    learn.save(model, path, version=1)
    reloaded = learn.load(path, version=learn.versions(spark, path)[-1])
    first = learn.score(model, test, "scaledFeatures").withColumnsRenamed(
        {"prediction": "prediction_1", "p1": "p1_1"})
    both = learn.score(reloaded, first, "scaledFeatures")
    same = (F.col("prediction") == F.col("prediction_1")) & (F.col("p1") == F.col("p1_1"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum(same.cast("long")).alias("same"))


def q_artifact_listing(spark, d):
    """(folder, has_files): the folders that hold files, of an export (by split) and of the model
    trained on it and saved (its metadata and stages, without their random suffix)."""
    path = prep.export(_prepared(spark, d), shared_path(spark, "export"))
    train = spark.read.parquet(path).where(F.col("split") == "train")
    model = learn.save(learn.train_weighted(train, _cat_idx(), "scaledFeatures", "label"),
                       shared_path(spark, "models"))
    parts = [(path, r"/(split=[^/]*)/[^/]*\.parquet$"),
             (model, r"/(metadata|stages/\d+_[A-Za-z]+)[^/]*/")]
    found = [parquet.artifacts(spark, p).where(F.col("length") > 0).select(
        F.regexp_extract("path", folder, 1).alias("folder")) for p, folder in parts]
    return found[0].union(found[1]).groupBy("folder").agg(
        (F.count(F.lit(1)) > 0).alias("has_files"))


def q_param_search(spark, d):
    """(candidates, reg_param, val_log_loss) of the candidate without regularisation, among
    seeded draws: a model of one category to convergence, whose loss has a closed form."""
    rows = _brand_export(spark, d)
    draws = learn.log_uniform_draws(-10.0, -4.0, 3, 11)
    found = learn.param_search(rows.where("split = 'train'"), rows.where("split = 'val'"),
                               ["p_brand_cat"], None, "label", reg_params=[*draws, 0.0],
                               max_iter=200, tol=1e-12)
    return found.groupBy().agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max(F.when(F.col("reg_param") == 0, F.col("reg_param"))).alias("reg_param"),
        F.round(F.max(F.when(F.col("reg_param") == 0, F.col("val_log_loss"))), 6)
        .alias("val_log_loss"))


def q_halving_search(spark, d):
    """(rungs, fits, val_log_loss of the winner) of a halving between no regularisation, whose
    loss has a closed form, and ones so strong that every probability is a half."""
    rows = _brand_export(spark, d)
    found = learn.halving_search(rows.where("split = 'train'"), rows.where("split = 'val'"),
                                 ["p_brand_cat"], None, "label", [0.0, 1e7, 1e8, 1e9],
                                 max_iter=200, tol=1e-12)
    return found.agg((F.max("rung") + 1).alias("rungs"), F.count(F.lit(1)).alias("fits"),
                     F.round(F.max(F.when(F.col("best"), F.col("val_log_loss"))), 6)
                     .alias("val_log_loss"))


def q_validation_history(spark, d):
    """(val_loss, val_accuracy) after the last iteration of a model with a closed form."""
    rows = _brand_export(spark, d)
    found = learn.validation_history(rows.where("split = 'train'"), rows.where("split = 'val'"),
                                     ["p_brand_cat"], None, "label", max_iter=12, tol=1e-12)
    last = found.orderBy(F.desc("iteration")).limit(1)
    return last.select(_r("val_loss", 6), _r("val_accuracy", 6))


def q_prepare_events(spark, d):
    """The whole preparation of the events: threshold, entity key, episodes, null drop, split,
    index and scaling, one row per kept event."""
    spec = prep.PrepSpec(label="label", time="ts_hour", string_categories=["event_type"],
                         int_categories=[], continuous=["value"],
                         entity_parts=["entity", "event_type"], entity="entity_key",
                         threshold_col="value", threshold=5, required=["label", "entity_key"],
                         episodes=True, tiebreak="event_id")
    rows = prep.prepare(_events(spark, d), spec).frame
    return rows.withColumn("scaled", F.round(F.col("scaledFeatures")[0].cast("double"), 3)).drop(
        "scaledFeatures")


BATCH_ROWS = 1000
EPOCH_SEED = 3


def _numbered_events(spark, d):
    rows = batches.number_rows(_scored_events(spark, d), ["event_id"])
    return rows, rows.count()


def q_epoch_batches(spark, d):
    """Per epoch and batch: rows, and sums that tell which rows they are."""
    rows, n = _numbered_events(spark, d)
    both = [batches.epoch_batches(rows, "position", n, BATCH_ROWS, epoch, EPOCH_SEED)
            for epoch in (0, 1)]
    return both[0].unionByName(both[1]).groupBy("epoch", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("events"),
        F.sum(F.col("event_id") * F.col("place")).alias("places"))


def q_batch_log_loss(spark, d):
    """Log loss of every batch of rows in order, and (batch -1) the mean of these and the global."""
    rows, _ = _numbered_events(spark, d)
    rows = rows.withColumn("batch", F.call_function(
        "div", F.col("position"), F.lit(BATCH_ROWS).cast("long")))
    per = metrics.batch_log_loss(rows, "label", "p1", "batch").select(
        "batch", _r("log_loss", 8), "n", F.lit(None).cast("double").alias("mean_batch_loss"))
    total = metrics.mean_batch_log_loss(rows, "label", "p1", "batch").select(
        F.lit(-1).cast("long").alias("batch"), F.round("global_loss", 8).alias("log_loss"), "n",
        _r("mean_batch_loss", 8))
    return per.unionByName(total)


def q_evaluate_model(spark, d):
    """Export, train, save, load and score the test split; its metrics as (metric, value)."""
    rows = _brand_export(spark, d)
    path = learn.save(_brand_model(rows), shared_path(spark, "models"))
    test = learn.score(learn.load(path), rows.where(F.col("split") == "test"), None)
    test = test.withColumn("pred", F.col("prediction").cast("int"))
    test = balance.with_weight(test, "label", balance.class_weights(
        rows.where(F.col("split") == "train"), "label"))
    test = reliable_checkpoint(test.select("label", "pred", F.round("p1", 6).alias("p1"), "weight"))
    parts = [
        metrics.weighted_log_loss(test, "label", "p1", "weight").select(
            F.lit("log_loss").alias("metric"), F.col("log_loss").alias("value")),
        metrics.accuracy(test, "label", "pred").select(F.lit("accuracy"), "accuracy"),
        metrics.weighted_f1(test, "label", "pred").select(F.lit("weighted_f1"), "weighted_f1"),
        metrics.auc_hard(test, "label", "pred").select(F.lit("auc_hard"), "auc"),
        metrics.auc_score(test, "label", "p1").select(F.lit("auc_score"), "auc"),
        metrics.confusion(test, "label", "pred", (0, 1)).select(
            F.concat(F.lit("true_"), F.col("truth")), F.col("pred_1").cast("double")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("metric", _r("value", 4))


def q_sized_export(spark, d):
    """Rows of every split read back from files of the production size, clustered by time."""
    path, scratch = shared_path(spark, "sized"), shared_path(spark, "sized-sample")
    rows = _split_sales(spark, d, ["l_quantity", "p_brand", "label"])
    parquet.write_sized(rows, path, scratch, partition_by="split", cluster_by="o_orderdate")
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").alias("first_date"),
        F.max("o_orderdate").cast("date").alias("last_date"),
        F.sum("label").alias("n_label"), F.countDistinct("p_brand").alias("n_brands"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"))


def q_category_embedding(spark, d):
    """Cells given back by embeddings as wide as a column has labels, on the training rows."""
    train = _split_sales(spark, d, EMBEDDED).where(F.col("split") == "train")
    model = embed.fit_category_embedding(train, EMBEDDED, widths=EMBEDDED)
    cells = embed.positive_information(embed.cooccurrence(train, EMBEDDED))
    return model.reconstruct(cells).select("column", "value", "context", "other", _r("x", 6))


# ---------------------------------------------------------------------------
# registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_view": q_scan_view,
    "export_roundtrip": q_export_roundtrip,
    "shard_counts": q_shard_counts,
    "preview_topk": q_preview_topk,
    "sort_entity_time": q_sort_entity_time,
    "filter_threshold": q_filter_threshold,
    "entity_key": q_entity_key,
    "project_model_cols": q_project_model_cols,
    "drop_required_nulls": q_drop_required_nulls,
    "cast_indices": q_cast_indices,
    "break_flags": q_break_flags,
    "lag_entity": q_lag_entity,
    "lag_default": q_lag_default,
    "running_breaks": q_running_breaks,
    "case_time": q_case_time,
    "episodes": q_episodes,
    "episodes_split_blocks": q_episodes_split_blocks,
    "episodes_appended": q_episodes_appended,
    "time_polynomial": q_time_polynomial,
    "time_percent_rank": q_time_percent_rank,
    "time_split": q_time_split,
    "time_split_refined": q_time_split_refined,
    "split_counts": q_split_counts,
    "label_distribution": q_label_distribution,
    "class_weights": q_class_weights,
    "class_weights_by_split": q_class_weights_by_split,
    "categorical_cardinality": q_categorical_cardinality,
    "embedding_width": q_embedding_width,
    "category_index": q_category_index,
    "category_index_table": q_category_index_table,
    "category_index_joined": q_category_index_joined,
    "pack_categories": q_pack_categories,
    "assembled_array": q_assembled_array,
    "scaled_features": q_scaled_features,
    "scaled_features_f32": q_scaled_features_f32,
    "argmax_class": q_argmax_class,
    "weighted_log_loss": q_weighted_log_loss,
    "accuracy": q_accuracy,
    "shard_mean_accuracy": q_shard_mean_accuracy,
    "confusion_matrix": q_confusion_matrix,
    "classification_report": q_classification_report,
    "roc_auc": q_roc_auc,
    "weighted_f1": q_weighted_f1,
    "train_scores": q_train_scores,
    "score_rows": q_score_rows,
    "model_reload_scores": q_model_reload_scores,
    "artifact_listing": q_artifact_listing,
    "param_search": q_param_search,
    "halving_search": q_halving_search,
    "validation_history": q_validation_history,
    "prepare_events": q_prepare_events,
    "category_embedding": q_category_embedding,
    "sized_export": q_sized_export,
    "epoch_batches": q_epoch_batches,
    "batch_log_loss": q_batch_log_loss,
    "evaluate_model": q_evaluate_model,
}
