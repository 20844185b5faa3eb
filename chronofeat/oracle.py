"""DuckDB SQL equivalents of the registered queries (see :mod:`chronofeat.queries`).

The base tables are registered as views by the checker; the fixture views are
rebuilt here as CTEs with the same definitions as ``sources/views.py``.
"""

from __future__ import annotations

from .operators.batches import PRIME, EpochOrder
from .sources.views import SALES_CATEGORIES, SALES_CONTINUOUS

SALES = """sales_view AS (
  SELECT l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
         o.o_orderstatus, o.o_orderpriority, o.o_totalprice, o.o_orderdate,
         c.c_mktsegment, c.c_nationkey, c.c_acctbal,
         p.p_brand, p.p_type, p.p_size, p.p_retailprice,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS label,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         CAST(quarter(o.o_orderdate) AS INTEGER) AS quarter,
         CAST(day(o.o_orderdate) AS INTEGER) AS dom,
         CAST(dayofweek(o.o_orderdate) + 1 AS INTEGER) AS dow
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

EVENTS = """events_view AS (
  SELECT event_id,
         CASE WHEN user_id > 2 THEN CAST(user_id AS VARCHAR) END AS entity,
         ts, date_trunc('hour', ts) AS ts_hour,
         CAST(event_type = 'error' AS INTEGER) AS label, value, event_type
  FROM events)"""

SPLIT = """sales_split AS (
  SELECT *, CASE WHEN pr <= 0.8 THEN 'train' WHEN pr < 0.9 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, percent_rank() OVER (ORDER BY o_orderdate NULLS FIRST) AS pr FROM sales_view))"""

ORDER = "entity NULLS FIRST, ts_hour NULLS FIRST"
LAGS = f"""lagged AS (
  SELECT *, lag(entity) OVER w AS prev_entity, lag(label, 1, 0) OVER w AS prev_label
  FROM events_view WINDOW w AS (ORDER BY {ORDER}, event_id)),
flags AS (
  SELECT *, CAST(CASE WHEN NOT (entity = prev_entity) OR prev_label = 1 THEN 1 ELSE 0 END
                 AS INTEGER) AS brk
  FROM lagged),
cases AS (
  SELECT *, CAST(SUM(brk) OVER (ORDER BY {ORDER}) AS BIGINT) AS running_breaks,
         CAST(SUM(brk) OVER (ORDER BY {ORDER}) + 1 AS BIGINT) AS case_id
  FROM flags),
timed AS (
  SELECT *, CAST(COUNT(*) OVER (PARTITION BY case_id ORDER BY {ORDER}) - 1 AS BIGINT) AS time
  FROM cases)"""

SCORED = """scored AS (
  SELECT event_id, label, value,
         LEAST(GREATEST(value / 500.0, 0.01), 0.99) AS p1,
         CAST(value > 50 AS INTEGER) AS pred
  FROM events_view)"""

CONT = SALES_CONTINUOUS
CATS = SALES_CATEGORIES
MODEL_COLS = ["label"] + CONT + ["o_orderdate"] + CATS


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _rank_ctes() -> str:
    """One (value -> index) table per category: count desc, label string asc."""
    parts = []
    for c in CATS:
        parts.append(f"""r_{c} AS (
  SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, v) - 1 AS DOUBLE) AS idx
  FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM sales_view
        WHERE {c} IS NOT NULL GROUP BY 1))""")
    return ",\n".join(parts)


def _indexed_select(exprs: str) -> str:
    joins = "\n".join(f"JOIN r_{c} ON CAST(s.{c} AS VARCHAR) = r_{c}.v" for c in CATS)
    return f"SELECT {exprs} FROM sales_view s\n{joins}"


def _cardinality_union() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST(COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL "
        f"THEN 1 ELSE 0 END) AS BIGINT) AS cardinality FROM sales_view" for c in CATS)


def _class_counts() -> str:
    return """cc AS (
  SELECT COUNT(*) AS total,
         SUM(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tp_0,
         SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS sup_0,
         SUM(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS prd_0,
         SUM(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp_1,
         SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS sup_1,
         SUM(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS prd_1
  FROM scored WHERE label IS NOT NULL AND pred IS NOT NULL),
pc AS (
  SELECT *,
    CASE WHEN prd_0 > 0 THEN tp_0 / prd_0 ELSE 0.0 END AS p_0,
    CASE WHEN sup_0 > 0 THEN tp_0 / sup_0 ELSE 0.0 END AS r_0,
    CASE WHEN prd_1 > 0 THEN tp_1 / prd_1 ELSE 0.0 END AS p_1,
    CASE WHEN sup_1 > 0 THEN tp_1 / sup_1 ELSE 0.0 END AS r_1
  FROM cc),
f AS (
  SELECT *,
    CASE WHEN p_0 + r_0 > 0 THEN 2 * p_0 * r_0 / (p_0 + r_0) ELSE 0.0 END AS f_0,
    CASE WHEN p_1 + r_1 > 0 THEN 2 * p_1 * r_1 / (p_1 + r_1) ELSE 0.0 END AS f_1
  FROM pc)"""


#: Probability of class 1 per brand: the closed form of a class-weighted logistic fit on one
#: one-hot category.
BRAND = """tw AS (
  SELECT SUM(n) OVER () / (2.0 * n) AS weight, label FROM (
    SELECT label, COUNT(*) AS n FROM sales_split WHERE split = 'train' GROUP BY label)),
brand AS (
  SELECT p_brand, SUM(CASE WHEN label = 1 THEN weight ELSE 0 END) / SUM(weight) AS p1
  FROM sales_split JOIN tw USING (label) WHERE split = 'train' GROUP BY p_brand)"""

BRAND_ROWS = """SELECT s.label, r_p_brand.idx AS p_brand_cat,
  CAST(CASE WHEN b.p1 > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction, ROUND(b.p1, 4) AS p1
FROM sales_split s JOIN brand b USING (p_brand) JOIN r_p_brand ON s.p_brand = r_p_brand.v
WHERE s.split = """

EVALUATED = """scored AS (
  SELECT s.label, CAST(CASE WHEN b.p1 > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS pred,
         ROUND(b.p1, 6) AS p1, tw.weight
  FROM sales_split s JOIN brand b USING (p_brand) JOIN tw ON tw.label = s.label
  WHERE s.split = 'test')"""

VALIDATED = EVALUATED.replace("'test'", "'val'").replace("ROUND(b.p1, 6)", "b.p1")
VAL_LOSS = ("ROUND(-SUM(weight * LN(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END)) / SUM(weight), 6)")

KEY_ORDER = "entity_key NULLS FIRST, ts_hour NULLS FIRST"
PREPARED_EVENTS = f"""kept AS (
  SELECT *, entity || ' ' || event_type AS entity_key FROM events_view WHERE value >= 5),
lagged AS (
  SELECT *, lag(entity_key) OVER w AS prev_key, lag(label, 1, 0) OVER w AS prev_label
  FROM kept WINDOW w AS (ORDER BY {KEY_ORDER}, event_id)),
flags AS (
  SELECT *, CASE WHEN NOT (entity_key = prev_key) OR prev_label = 1 THEN 1 ELSE 0 END AS brk
  FROM lagged),
cases AS (
  SELECT *, CAST(SUM(brk) OVER (ORDER BY {KEY_ORDER}) + 1 AS BIGINT) AS case_id FROM flags),
timed AS (
  SELECT *, CAST(COUNT(*) OVER (PARTITION BY case_id ORDER BY {KEY_ORDER}) - 1 AS BIGINT) AS time
  FROM cases),
split_events AS (
  SELECT *, CASE WHEN pr <= 0.8 THEN 'train' WHEN pr < 0.9 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, percent_rank() OVER (ORDER BY ts_hour NULLS FIRST) AS pr FROM timed
        WHERE label IS NOT NULL AND entity_key IS NOT NULL)),
idx AS (
  SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, event_type) - 1 AS DOUBLE) AS idx
  FROM (SELECT event_type, COUNT(*) AS n FROM split_events GROUP BY 1)),
st AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS d FROM split_events WHERE split = 'train')"""

BATCH_ROWS, EPOCH_SEED = 1000, 3
NUMBERED = """numbered AS (
  SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS x, COUNT(*) OVER () AS n
  FROM events_view),
grid AS (
  SELECT *, CAST((n + a - 1) // a AS BIGINT) AS b FROM (
    SELECT *, CAST(CEIL(SQRT(n)) AS BIGINT) AS a FROM numbered))"""


def _placed(epoch: int, walks: int = 4) -> str:
    """(event_id, place) of an epoch: the rounds of the permutation as nested selects."""
    keys, rows = EpochOrder(1, epoch, EPOCH_SEED).keys, "SELECT event_id, n, a, b, x FROM grid"
    for walk in range(walks):
        rows = f"SELECT *, x // b AS l, x % b AS r FROM ({rows})"
        for i, (j, k) in enumerate(keys):
            v = "l" if i % 2 else "r"
            f = f"(({v} + {j}) % {PRIME}) * (({v} + {k}) % {PRIME}) % {PRIME}"
            new = f"l, (r + {f}) % b AS r" if i % 2 else f"(l + {f}) % a AS l, r"
            rows = f"SELECT event_id, n, a, b, x, {new} FROM ({rows})"
        new = "l * b + r" if walk == 0 else "CASE WHEN x < n THEN x ELSE l * b + r END"
        rows = f"SELECT event_id, n, a, b, {new} AS x FROM ({rows})"
    return f"SELECT event_id, x AS place FROM ({rows})"


SCORE_RANKS = """per AS (
  SELECT p1 AS s, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY p1),
sc AS (
  SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                     AND 1 PRECEDING), 0) AS nb FROM per)"""


def _embedding_cells() -> str:
    """Positive mutual information of the labels of every two embedded columns, in SQL."""
    cols = ["o_orderpriority", "c_mktsegment", "p_brand", "p_size"]
    counts = " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", CAST({a} AS VARCHAR) AS value, '{b}' AS context,
        CAST({b} AS VARCHAR) AS other, COUNT(*) AS n
        FROM sales_split WHERE split = 'train' AND {a} IS NOT NULL AND {b} IS NOT NULL
        GROUP BY {a}, {b}""" for a in cols for b in cols if a != b)
    return _with(SALES, SPLIT, f"""cells AS ({counts}), informed AS (
  SELECT "column", value, context, other, ln(CAST(n AS DOUBLE)
         * SUM(n) OVER (PARTITION BY "column", context)
         / (CAST(SUM(n) OVER (PARTITION BY "column", value, context) AS DOUBLE)
            * SUM(n) OVER (PARTITION BY "column", context, other))) AS x FROM cells)""") + """
SELECT "column", value, context, other, ROUND(x, 6) AS x FROM informed WHERE x > 0"""


def oracle_sql() -> dict[str, str]:
    s, e = SALES, EVENTS
    cat_idx = ", ".join(f"r_{c}.idx AS {c}_cat" for c in CATS)
    pack = ", ".join(f"CAST(r_{c}.idx AS BIGINT)" for c in CATS)
    train_stats = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS d_{c}" for c in CONT)
    scaled = ", ".join(
        f"ROUND(CASE WHEN d_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / d_{c} END, 4) AS s_{c}"
        for c in CONT)
    feats = ", ".join(f"CAST({c} AS DOUBLE)" for c in CONT)
    scaled32 = ", ".join(
        f"ROUND(CAST(CAST(CASE WHEN d_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / d_{c} END AS FLOAT) "
        f"AS DOUBLE), 4) AS s_{c}" for c in CONT)
    export32 = scaled32.replace(", 4) AS", ", 3) AS")
    sql = {
        "scan_view": _with(s) + "SELECT * FROM sales_view",
        "export_roundtrip": _with(s, SPLIT, _rank_ctes(), f"""st AS (
  SELECT {train_stats} FROM sales_split WHERE split = 'train')""") +
            f"SELECT s.label, s.split, {cat_idx}, {export32} FROM sales_split s, st\n" +
            _indexed_select("").split("sales_view s\n", 1)[1] +
            "\nWHERE s.label IS NOT NULL",
        "shard_counts": _with(s, SPLIT) +
            "SELECT 4 AS shards, 0 AS empty_shards, COUNT(*) AS total_rows, 0 AS overlapping_rows "
            "FROM sales_split WHERE split = 'train' AND label IS NOT NULL",
        "train_scores": _with(s, SPLIT, _rank_ctes(), BRAND) + BRAND_ROWS + "'val'",
        "score_rows": _with(s, SPLIT, _rank_ctes(), BRAND) + BRAND_ROWS + "'test'",
        "model_reload_scores": _with(s, SPLIT) +
            "SELECT COUNT(*) AS rows, COUNT(*) AS same FROM sales_split "
            "WHERE split = 'test' AND label IS NOT NULL",
        "artifact_listing": _with(s, SPLIT) +
            "SELECT DISTINCT 'split=' || split AS folder, TRUE AS has_files FROM sales_split "
            "WHERE label IS NOT NULL UNION ALL "
            "SELECT folder, TRUE AS has_files FROM (VALUES ('metadata'), "
            "('stages/0_OneHotEncoder'), ('stages/1_VectorAssembler'), "
            "('stages/2_LogisticRegression')) t(folder)",
        "param_search": _with(s, SPLIT, BRAND, VALIDATED) +
            f"SELECT 4 AS candidates, CAST(0.0 AS DOUBLE) AS reg_param, {VAL_LOSS} "
            "AS val_log_loss FROM scored",
        "halving_search": _with(s, SPLIT, BRAND, VALIDATED) +
            f"SELECT 2 AS rungs, 6 AS fits, LEAST({VAL_LOSS}, ROUND(LN(2), 6)) AS val_log_loss "
            "FROM scored",
        "validation_history": _with(s, SPLIT, BRAND, VALIDATED) +
            f"SELECT {VAL_LOSS} AS val_loss, ROUND(AVG(CAST(label = pred AS DOUBLE)), 6) "
            "AS val_accuracy FROM scored",
        "prepare_events": _with(e, PREPARED_EVENTS) + """
SELECT s.label, i.idx AS event_type_cat, s.case_id, s.time, POW(s.time, 2) AS time2,
       POW(s.time, 3) AS time3, ROUND(CAST(CAST((s.value - st.m) / st.d AS FLOAT) AS DOUBLE), 3) AS scaled, s.split
FROM split_events s JOIN idx i USING (event_type), st""",
        "epoch_batches": _with(e, NUMBERED) + "\nUNION ALL\n".join(
            f"SELECT {epoch} AS epoch, place // {BATCH_ROWS} AS batch, COUNT(*) AS n, "
            f"CAST(SUM(event_id) AS BIGINT) AS events, CAST(SUM(event_id * place) AS BIGINT) AS "
            f"places FROM ({_placed(epoch)}) GROUP BY 1, 2" for epoch in (0, 1)),
        "batch_log_loss": _with(e, SCORED, f"""b AS (
  SELECT *, (ROW_NUMBER() OVER (ORDER BY event_id) - 1) // {BATCH_ROWS} AS batch FROM scored),
per AS (
  SELECT batch, -AVG(LN(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END)) AS loss, COUNT(*) AS n
  FROM b WHERE label IS NOT NULL AND p1 IS NOT NULL GROUP BY batch)""") + """
SELECT batch, ROUND(loss, 8) AS log_loss, n, CAST(NULL AS DOUBLE) AS mean_batch_loss FROM per
UNION ALL
SELECT -1, ROUND(SUM(loss * n) / SUM(n), 8), CAST(SUM(n) AS BIGINT), ROUND(AVG(loss), 8)
FROM per""",
        "evaluate_model": _with(s, SPLIT, BRAND, EVALUATED, _class_counts(), SCORE_RANKS) + """
SELECT 'log_loss' AS metric, ROUND(-SUM(weight * LN(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END))
                                   / SUM(weight), 4) AS value FROM scored
UNION ALL SELECT 'accuracy', ROUND((tp_0 + tp_1) / total, 4) FROM f
UNION ALL SELECT 'weighted_f1', ROUND((f_0 * sup_0 + f_1 * sup_1) / total, 4) FROM f
UNION ALL SELECT 'auc_hard', ROUND((r_1 + r_0) / 2, 4) FROM f
UNION ALL SELECT 'auc_score', ROUND(CAST(SUM(pos * (nb + 0.5 * neg)) AS DOUBLE)
                                    / CAST(SUM(pos) * SUM(neg) AS DOUBLE), 4) FROM sc
UNION ALL SELECT 'true_0', CAST(prd_1 - tp_1 AS DOUBLE) FROM f
UNION ALL SELECT 'true_1', CAST(tp_1 AS DOUBLE) FROM f""",
        "preview_topk": _with(e) +
            f"SELECT event_id, entity, ts_hour, label FROM events_view "
            f"ORDER BY {ORDER}, event_id LIMIT 4",
        "sort_entity_time": _with(e) +
            f"SELECT event_id, entity, ts_hour FROM events_view ORDER BY {ORDER}, event_id",
        "filter_threshold": _with(e) + "SELECT * FROM events_view WHERE value >= 5",
        "entity_key": _with(e) + "SELECT event_id, entity || ' ' || event_type AS entity_key "
                                 "FROM events_view",
        "project_model_cols": _with(s) + f"SELECT {', '.join(MODEL_COLS)} FROM sales_view",
        "drop_required_nulls": _with(e) +
            "SELECT event_id, entity || ' ' || event_type AS entity_key, label FROM events_view "
            "WHERE label IS NOT NULL AND (entity || ' ' || event_type) IS NOT NULL",
        "cast_indices": _with(s, _rank_ctes()) + _indexed_select(
            "CAST(s.label AS BIGINT) AS label, CAST(r_p_brand.idx AS BIGINT) AS p_brand_cat, "
            "CAST(r_p_size.idx AS BIGINT) AS p_size_cat"),
        "break_flags": _with(e, LAGS) + "SELECT event_id, brk FROM flags",
        "lag_entity": _with(e, LAGS) + "SELECT event_id, prev_entity FROM lagged",
        "lag_default": _with(e, LAGS) + "SELECT event_id, prev_label FROM lagged",
        "running_breaks": _with(e, LAGS) + "SELECT event_id, running_breaks FROM cases",
        "case_time": _with(e, LAGS) + "SELECT event_id, time FROM timed",
        "episodes": _with(e, LAGS) +
            "SELECT event_id, entity, ts_hour, label, case_id, time FROM timed",
        "time_polynomial": _with(e, LAGS) +
            "SELECT event_id, time, POW(time, 2) AS time2, POW(time, 3) AS time3 FROM timed",
        "time_percent_rank": _with(s) +
            "SELECT o_orderdate, percent_rank() OVER (ORDER BY o_orderdate NULLS FIRST) AS pr "
            "FROM sales_view",
        "time_split": _with(s, SPLIT) + "SELECT o_orderdate, label, split FROM sales_split",
        "split_counts": _with(s, SPLIT) + "SELECT split, COUNT(*) AS n FROM sales_split "
                                          "GROUP BY split",
        "label_distribution": _with(s, SPLIT) +
            "SELECT label, COUNT(*) AS n FROM sales_split WHERE split = 'train' GROUP BY label",
        "class_weights": _with(s, SPLIT, """cw AS (
  SELECT label, COUNT(*) AS n FROM sales_split
  WHERE split = 'train' AND label IS NOT NULL GROUP BY label)""") + """SELECT label, n,
  CAST(SUM(n) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () * n AS DOUBLE) AS weight FROM cw""",
        "class_weights_by_split": _with(s, SPLIT, """cw AS (
  SELECT split, label, COUNT(*) AS n FROM sales_split
  WHERE label IS NOT NULL GROUP BY split, label)""") + """SELECT split, label, n,
  CAST(SUM(n) OVER (PARTITION BY split) AS DOUBLE)
    / CAST(COUNT(*) OVER (PARTITION BY split) * n AS DOUBLE) AS weight FROM cw""",
        "categorical_cardinality": _with(s) + _cardinality_union(),
        "category_embedding": _embedding_cells(),
        "sized_export": _with(SALES, SPLIT) + """
SELECT split, COUNT(*) AS n, CAST(MIN(o_orderdate) AS DATE) AS first_date,
       CAST(MAX(o_orderdate) AS DATE) AS last_date, CAST(SUM(label) AS BIGINT) AS n_label,
       COUNT(DISTINCT p_brand) AS n_brands, ROUND(SUM(l_quantity), 2) AS quantity
FROM sales_split GROUP BY split""",
        "embedding_width": _with(s) +
            "SELECT \"column\", cardinality, CAST(LEAST(50, (cardinality + 2) // 2) AS INTEGER) "
            f"AS width FROM ({_cardinality_union()})",
        "category_index": _with(s, _rank_ctes()) + _indexed_select(cat_idx),
        "category_index_table": _with(s) + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS \"column\", v AS value, n, CAST(ROW_NUMBER() OVER "
            f"(ORDER BY n DESC, v) - 1 AS DOUBLE) AS \"index\" FROM (SELECT CAST({c} AS VARCHAR) "
            f"AS v, COUNT(*) AS n FROM sales_view WHERE {c} IS NOT NULL GROUP BY 1)"
            for c in CATS),
        "pack_categories": _with(s, _rank_ctes()) + _indexed_select(f"[{pack}] AS x_cat"),
        "assembled_array": _with(s) + f"SELECT [{feats}] AS features FROM sales_view",
        "scaled_features": _with(s, SPLIT, f"""st AS (
  SELECT {train_stats} FROM sales_split WHERE split = 'train')""") +
            f"SELECT split, {scaled} FROM sales_split, st",
        "argmax_class": _with(e, SCORED) +
            "SELECT event_id, CAST(CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END AS INTEGER) "
            "AS pred_class FROM scored",
        "weighted_log_loss": _with(e, SCORED, """p AS (
  SELECT label, p1 FROM scored WHERE label IS NOT NULL AND p1 IS NOT NULL),
cw AS (SELECT label, COUNT(*) AS n FROM p GROUP BY label),
w AS (SELECT label, CAST(SUM(n) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () * n AS DOUBLE)
      AS weight FROM cw)""") + """SELECT ROUND(-SUM(weight * LN(CASE WHEN label = 1 THEN p1
  ELSE 1 - p1 END)) / SUM(weight), 8) AS log_loss, COUNT(*) AS n FROM p JOIN w USING (label)""",
        "accuracy": _with(e, SCORED) +
            "SELECT ROUND(AVG(CAST(label = pred AS DOUBLE)), 10) AS accuracy, COUNT(*) AS n "
            "FROM scored WHERE label IS NOT NULL AND pred IS NOT NULL",
        "shard_mean_accuracy": _with(e, SCORED) + """SELECT ROUND(AVG(a), 10) AS mean_accuracy,
  COUNT(*) AS shards FROM (SELECT event_id % 10 AS shard, AVG(CAST(label = pred AS DOUBLE)) AS a
  FROM scored WHERE label IS NOT NULL AND pred IS NOT NULL GROUP BY 1)""",
        "confusion_matrix": _with(e, SCORED) + """SELECT label AS truth,
  CAST(SUM(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
  CAST(SUM(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1,
  CAST(SUM(CASE WHEN pred NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS pred_other
FROM scored WHERE label IS NOT NULL AND pred IS NOT NULL AND label IN (0, 1) GROUP BY label""",
        "classification_report": _with(e, SCORED, _class_counts()) + """SELECT * FROM (
  SELECT '0' AS class, ROUND(p_0, 8) AS precision, ROUND(r_0, 8) AS recall, ROUND(f_0, 8) AS f1,
         CAST(sup_0 AS BIGINT) AS support FROM f
  UNION ALL SELECT '1', ROUND(p_1, 8), ROUND(r_1, 8), ROUND(f_1, 8), CAST(sup_1 AS BIGINT) FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL,
         ROUND(CASE WHEN total > 0 THEN (tp_0 + tp_1) / total ELSE 0.0 END, 8),
         CAST(total AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', ROUND((p_0 + p_1) / 2, 8), ROUND((r_0 + r_1) / 2, 8),
         ROUND((f_0 + f_1) / 2, 8), CAST(total AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', ROUND((p_0 * sup_0 + p_1 * sup_1) / total, 8),
         ROUND((r_0 * sup_0 + r_1 * sup_1) / total, 8),
         ROUND((f_0 * sup_0 + f_1 * sup_1) / total, 8), CAST(total AS BIGINT) FROM f)""",
        "roc_auc": _with(e, SCORED, _class_counts(), """per AS (
  SELECT p1 AS s, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
  FROM scored WHERE label IS NOT NULL AND p1 IS NOT NULL GROUP BY p1),
sc AS (
  SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
                                     AND 1 PRECEDING), 0) AS nb FROM per)""") + """
SELECT 'hard' AS kind, ROUND((r_1 + r_0) / 2, 10) AS auc FROM f
UNION ALL
SELECT 'score', ROUND(CAST(SUM(pos * (nb + 0.5 * neg)) AS DOUBLE)
                      / CAST(SUM(pos) * SUM(neg) AS DOUBLE), 10) FROM sc""",
        "weighted_f1": _with(e, SCORED, _class_counts()) +
            "SELECT ROUND((f_0 * sup_0 + f_1 * sup_1) / total, 10) AS weighted_f1 FROM f",
    }
    # the scale-path variants must give exactly the base query's rows
    sql["episodes_split_blocks"] = sql["episodes"]
    sql["episodes_appended"] = sql["episodes"]
    sql["time_split_refined"] = sql["time_split"]
    sql["category_index_joined"] = sql["category_index"]
    sql["scaled_features_f32"] = _with(s, SPLIT, f"""st AS (
  SELECT {train_stats} FROM sales_split WHERE split = 'train')""") + \
        f"SELECT split, {scaled32} FROM sales_split, st"
    return sql
