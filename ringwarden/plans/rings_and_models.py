"""Queries: rings, evaluation metrics, calibration, cost, drift, training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import FEATURES, FLAG_THRESHOLD, TABULAR_FEATURES
from ..functions import scoring
from ..functions.scoring import feature_columns
from ..operators import calibration, drift, graph, learn, metrics, rings
from ..operators import features as feat
from ..session import cut_lineage, store
from ..sources import views
from .inputs import labelled_matrix, matrix, r, rounded, stored_edges, stored_payments
from .registry import query

# --- rings --------------------------------------------------------------------------------


def _clustered(payments):
    return store(rings.ring_payments(payments), "ring-payments")


@query("identifier_components", "ptx comp", """
SELECT transaction_id, coalesce(component, transaction_id) AS component FROM ptx LEFT JOIN comp USING (transaction_id)""")
def identifier_components(spark, folder):
    return graph.identifier_components(views.payments(spark, folder))


@query("shared_identifier_pairs", "anchored", "SELECT kind, value, tx, anchor FROM anchored WHERE tx <> anchor")
def shared_identifier_pairs(spark, folder):
    """Every sharing payment linked to the first of its identifier: linear, not all pairs."""
    return graph.shared_identifier_links(views.payments(spark, folder)).select("kind", "value", "tx", "anchor")


RING_REPORT_SQL = """
SELECT 'RING_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || '_' || predicted_ring_type AS ring_id,
  * EXCLUDE (k) FROM (SELECT *, row_number() OVER (ORDER BY component) AS k FROM report)"""


@query("ring_report", "report", RING_REPORT_SQL)
def ring_report(spark, folder):
    report = rings.ring_report(views.payments(spark, folder), views.risk_scores(spark, folder))
    return report.withColumn("total_exposure", F.col("total_exposure").cast("double"))


@query("ring_entities", "entities", "SELECT component, kind, entity FROM entities")
def ring_entities(spark, folder):
    return rings.ring_entities(rings.ring_payments(views.payments(spark, folder)))


@query("ring_entity_lists", "entities", """
SELECT component, kind, string_agg(entity, ',' ORDER BY entity) AS entities FROM entities GROUP BY 1, 2""")
def ring_entity_lists(spark, folder):
    lists = rings.ring_entity_lists(rings.ring_entities(rings.ring_payments(views.payments(spark, folder))), chunk_size=1000)
    return lists.select("component", "kind", F.array_join("entities", ",").alias("entities"))


@query("ring_sync_score", "ringtime", "SELECT component, round(sync, 6) AS sync FROM ringtime")
def ring_sync_score(spark, folder):
    return rounded(rings.ring_timing(rings.ring_payments(views.payments(spark, folder))).select("component", "sync"), "sync")


@query("ring_concentration", "ringconc", """
SELECT component, round(concentration, 6) AS concentration,
  CASE WHEN concentration >= 0.70 THEN 'CRITICAL' WHEN concentration >= 0.40 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM ringconc""")
def ring_concentration(spark, folder):
    entities = rings.ring_entities(rings.ring_payments(views.payments(spark, folder)))
    return rounded(rings.ring_concentration(entities, views.risk_scores(spark, folder)), "concentration")


@query("risk_score_lookup", "ptx risk_scores", """
SELECT transaction_id, customer_id, coalesce(score, 0.1) AS score FROM ptx LEFT JOIN risk_scores USING (customer_id)""")
def risk_score_lookup(spark, folder):
    members = views.payments(spark, folder).select("transaction_id", "customer_id")
    return rings.risk_score_lookup(members, views.risk_scores(spark, folder), member="customer_id")


@query("ring_cross_merchant", "ringcount", "SELECT component, round(least(1.0, n_merchant / 3.0), 6) AS cross_merchant FROM ringcount")
def ring_cross_merchant(spark, folder):
    counts = rings.entity_counts(rings.ring_entities(rings.ring_payments(views.payments(spark, folder))))
    return counts.select("component", r(rings.cross_merchant(F.col("n_merchant"))).alias("cross_merchant"))


@query("ring_typing", "report", "SELECT predicted_ring_type, risk_level, count(*) AS n FROM report GROUP BY 1, 2")
def ring_typing(spark, folder):
    report = rings.ring_report(views.payments(spark, folder), views.risk_scores(spark, folder))
    return report.groupBy("predicted_ring_type", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("ring_summary", "report", "SELECT count(*) AS total_rings, round(sum(total_exposure), 2) AS total_exposure FROM report")
def ring_summary(spark, folder):
    report = rings.ring_report(views.payments(spark, folder), views.risk_scores(spark, folder))
    return rounded(rings.ring_summary(report), "total_exposure", digits=2)


def _members(clustered):
    return clustered.select("component", "customer_id").distinct()


@query("ring_truth_match", "matches", "SELECT component, ring_id, overlap, round(jaccard, 6) AS jaccard FROM matches")
def ring_truth_match(spark, folder):
    members = store(_members(rings.ring_payments(stored_payments(spark, folder))), "members")
    return rounded(rings.ring_truth_match(members, views.true_ring_members(spark, folder)), "jaccard")


_LOSS = """
SELECT m.component, m.ring_id, coalesce(sum(CAST(p.amount AS DECIMAL(18,2))), 0) AS lost
FROM matches m JOIN ringtime t ON t.component = m.component
LEFT JOIN (SELECT DISTINCT ring_id, customer_id FROM gt_members) g ON g.ring_id = m.ring_id
LEFT JOIN ptx p ON p.customer_id = g.customer_id AND p.timestamp >= t.detected_at GROUP BY 1, 2"""


@query("post_detection_loss", "matches ringtime gt_members ptx", f"SELECT component, ring_id, CAST(lost AS DOUBLE) AS prevented FROM ({_LOSS})")
def post_detection_loss(spark, folder):
    payments, truth = stored_payments(spark, folder), views.true_ring_members(spark, folder)
    clustered = _clustered(payments)
    times = rings.ring_timing(clustered).select("component", "detected_at")
    matches = rings.ring_truth_match(store(_members(clustered), "members"), truth).join(times, "component")
    lost = rings.post_detection_loss(matches, truth, payments)
    return lost.select("component", "ring_id", F.col("prevented").cast("double").alias("prevented"))


RING_EVAL_VIEWS = "matches ringtime gt_members ptx"
RING_EVAL_SQL = f"""
SELECT (SELECT count(DISTINCT ring_id) FROM gt_members) AS total_true_rings, (SELECT count(*) FROM ringtime) AS detected_rings_count,
  count(DISTINCT m.ring_id) AS matched_true_rings,
  round(count(DISTINCT m.ring_id) * 1.0 / (SELECT count(DISTINCT ring_id) FROM gt_members), 4) AS ring_recall,
  round(avg(greatest(0, t.detected_at - s.started)), 1) AS mean_ttfd_seconds,
  (SELECT round(CAST(sum(lost) AS DOUBLE), 2) FROM ({_LOSS})) AS future_loss_prevented
FROM matches m JOIN ringtime t ON t.component = m.component
JOIN (SELECT ring_id, min(start_timestamp) AS started FROM gt_members GROUP BY 1) s ON s.ring_id = m.ring_id"""


@query("ring_eval", RING_EVAL_VIEWS, RING_EVAL_SQL)
def ring_eval(spark, folder):
    payments, truth = stored_payments(spark, folder), views.true_ring_members(spark, folder)
    clustered = _clustered(payments)
    report = cut_lineage(rings.report_from(clustered, store(rings.ring_entities(clustered), "ring-entities"), views.risk_scores(spark, folder)))
    return rounded(rings.ring_eval(report, store(_members(clustered), "members"), truth, payments), "future_loss_prevented", digits=2)


@query("member_jaccard", "entities", """
WITH d AS (SELECT component, list(DISTINCT entity) FILTER (WHERE kind = 'device') AS a, list(DISTINCT entity) FILTER (WHERE kind = 'ip') AS b FROM (
  SELECT component, kind, right(entity, 2) AS entity FROM entities WHERE kind IN ('device', 'ip')) GROUP BY component)
SELECT component, round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM d WHERE a IS NOT NULL AND b IS NOT NULL""")
def member_jaccard(spark, folder):
    """Two short lists per ring: which two-digit endings its devices and its IPs use (at most 100 each)."""
    entities = rings.ring_entities(rings.ring_payments(views.payments(spark, folder)))
    endings = entities.select("component", "kind", F.right("entity", F.lit(2)).alias("e")).distinct()
    sets = endings.where(F.col("kind").isin("device", "ip")).groupBy("component").agg(
        F.collect_set(F.when(F.col("kind") == "device", F.col("e"))).alias("a"),
        F.collect_set(F.when(F.col("kind") == "ip", F.col("e"))).alias("b"),
    )
    both = sets.where((F.size("a") > 0) & (F.size("b") > 0))
    return both.select("component", r(rings.member_jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


# --- ranking and thresholds -----------------------------------------------------------------


def scored_of(spark, folder):
    return views.scored_orders(spark, folder)


@query("average_precision", "ladder", "SELECT round(sum(pos * 1.0 / p * tp / (tp + fp)), 6) AS average_precision FROM ladder")
def average_precision(spark, folder):
    return rounded(metrics.average_precision(scored_of(spark, folder)), "average_precision")


@query("roc_auc", "ladder", "SELECT round(sum(neg * ((tp - pos) + pos / 2.0)) / max(CAST(p AS DOUBLE) * n), 6) AS roc_auc FROM ladder")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(scored_of(spark, folder)), "roc_auc")


@query("recall_at_fpr", "ladder", "SELECT round(coalesce(max(tp * 1.0 / p) FILTER (WHERE fp * 1.0 / n <= 0.01), 0), 6) AS recall_at_fpr FROM ladder")
def recall_at_fpr(spark, folder):
    return rounded(metrics.recall_at_fpr(scored_of(spark, folder), 0.01), "recall_at_fpr")


_TOPK = "SELECT *, row_number() OVER (ORDER BY y_prob DESC, id) AS k, sum(y_true) OVER () AS pos, count(*) OVER () AS n FROM scored"
_PATK = f"""SELECT CAST(kk AS INTEGER) AS k, sum(y_true) * 1.0 / kk AS p, sum(y_true) / (max(pos) + 1e-6) AS rc
FROM ({_TOPK}) CROSS JOIN (SELECT unnest([100, 500, 1000]) AS kk) WHERE k <= kk AND kk <= n GROUP BY kk"""


@query("precision_recall_at_k", "scored", f"SELECT k, round(p, 6) AS precision_at_k, round(rc, 6) AS recall_at_k FROM ({_PATK})")
def precision_recall_at_k(spark, folder):
    return rounded(metrics.precision_recall_at_k(scored_of(spark, folder)), "precision_at_k", "recall_at_k")


def _grid_sql(points):
    values = ", ".join(f"({i}, {p!r})" for i, p in enumerate(points))
    return f"""SELECT CAST(t AS DOUBLE) AS threshold, sum(CASE WHEN y_prob >= t THEN y_true ELSE 0 END) AS tp,
  sum(CASE WHEN y_prob >= t THEN 1 - y_true ELSE 0 END) AS fp, sum(CASE WHEN y_prob < t THEN y_true ELSE 0 END) AS fn,
  sum(CASE WHEN y_prob < t THEN 1 - y_true ELSE 0 END) AS tn
FROM scored CROSS JOIN (VALUES {values}) g(i, t) GROUP BY t"""


_F1 = f"SELECT threshold, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM ({_grid_sql(metrics.F1_GRID)})"


@query("best_f1_threshold", "scored", f"SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM ({_F1}) ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1_threshold(spark, folder):
    return rounded(metrics.best_f1_threshold(scored_of(spark, folder)), "threshold", "f1")


@query("best_f1_threshold_smoothed", "scored", f"""
SELECT round(threshold, 6) AS threshold, round(2 * p * rc / (p + rc + 1e-8), 6) AS f1 FROM (
  SELECT threshold, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS rc FROM ({_grid_sql(metrics.STACK_GRID)}))
ORDER BY 2 * p * rc / (p + rc + 1e-8) DESC, threshold LIMIT 1""")
def best_f1_threshold_smoothed(spark, folder):
    return rounded(metrics.best_f1_threshold(scored_of(spark, folder), metrics.STACK_GRID, smoothed=True), "threshold", "f1")


_CM = """SELECT CAST(count(*) FILTER (WHERE y_prob >= 0.42 AND y_true = 1) AS BIGINT) AS tp, count(*) FILTER (WHERE y_prob >= 0.42 AND y_true = 0) AS fp,
  count(*) FILTER (WHERE y_prob < 0.42 AND y_true = 1) AS fn, count(*) FILTER (WHERE y_prob < 0.42 AND y_true = 0) AS tn FROM scored"""


@query("confusion_matrix", "scored", _CM)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(scored_of(spark, folder))


@query("threshold_metrics", "scored", f"""
SELECT round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_CM})""")
def threshold_metrics(spark, folder):
    return rounded(metrics.threshold_metrics(scored_of(spark, folder)), "precision", "recall", "f1")


@query("evaluate_model", "scored ladder", f"""
WITH best AS (SELECT threshold FROM ({_F1}) ORDER BY f1 DESC, threshold LIMIT 1),
cm AS (SELECT sum(CASE WHEN y_prob >= threshold THEN y_true ELSE 0 END) AS tp, sum(CASE WHEN y_prob >= threshold THEN 1 - y_true ELSE 0 END) AS fp,
  sum(CASE WHEN y_prob < threshold THEN y_true ELSE 0 END) AS fn FROM scored CROSS JOIN best),
at AS MATERIALIZED ({_PATK})
SELECT 'model' AS model, (SELECT round(sum(pos * 1.0 / p * tp / (tp + fp)), 6) FROM ladder) AS pr_auc,
  (SELECT round(sum(neg * ((tp - pos) + pos / 2.0)) / max(CAST(p AS DOUBLE) * n), 6) FROM ladder) AS roc_auc,
  round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall,
  (SELECT round(threshold, 6) FROM best) AS threshold,
  (SELECT round(p, 6) FROM at a WHERE a.k = 100) AS precision_at_100, (SELECT round(rc, 6) FROM at a WHERE a.k = 100) AS recall_at_100,
  (SELECT round(p, 6) FROM at a WHERE a.k = 500) AS precision_at_500, (SELECT round(rc, 6) FROM at a WHERE a.k = 500) AS recall_at_500,
  (SELECT round(p, 6) FROM at a WHERE a.k = 1000) AS precision_at_1000, (SELECT round(rc, 6) FROM at a WHERE a.k = 1000) AS recall_at_1000
FROM cm""".replace("at AS MATERIALIZED", "patk AS MATERIALIZED").replace("FROM at a", "FROM patk a"))
def evaluate_model(spark, folder):
    row = metrics.evaluate_model(scored_of(spark, folder))
    return rounded(row, *[c for c in row.columns if c != "model"])


@query("dollar_capture", "scored", f"""
SELECT round(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE k <= 100 AND y_true = 1) AS DOUBLE), 2) AS captured,
  round(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y_true = 1) AS DOUBLE), 2) AS total,
  round(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE k <= 100 AND y_true = 1) AS DOUBLE) / CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y_true = 1) AS DOUBLE), 6) AS dollar_capture
FROM ({_TOPK})""")
def dollar_capture(spark, folder):
    got = metrics.dollar_capture(scored_of(spark, folder))
    return got.select(r("captured", 2).alias("captured"), r("total", 2).alias("total"), r("dollar_capture").alias("dollar_capture"))


def _segment_metrics(spark, folder):
    """Recall at the flag threshold and precision of the best 100, per order segment."""
    scored = scored_of(spark, folder)
    recall = metrics.segment_comparison(scored, "segment").select("segment", "recall")
    order = Window.partitionBy("segment").orderBy(F.desc("y_prob"), "id")
    top = scored.withColumn("k", F.row_number().over(order)).where("k <= 100")
    at = top.groupBy("segment").agg((F.sum("y_true") / 100.0).alias("precision_at_100"))
    return recall.join(at, "segment").select(F.col("segment").alias("model"), "recall", "precision_at_100")


_SEG = """SELECT segment AS model, sum(CASE WHEN y_prob >= 0.42 THEN y_true ELSE 0 END) * 1.0 / greatest(sum(y_true), 1) AS recall,
  sum(CASE WHEN k <= 100 THEN y_true ELSE 0 END) / 100.0 AS precision_at_100
FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY y_prob DESC, id) AS k FROM scored) GROUP BY segment"""
_COST = f"""SELECT model, round(13 * recall, 1) AS expected_tp, round(13 * (1 - recall), 1) AS expected_fn, CAST(fp AS INTEGER) AS expected_fp,
  round(fp * 350.0 + 13 * (1 - recall) * 42000.0, 2) AS total_expected_cost FROM (
  SELECT *, CASE WHEN precision_at_100 > 0 THEN least(9987, greatest(2, trunc(13 * recall * (1.0 / greatest(precision_at_100, 0.01) - 1.0))))
    WHEN recall = 0 THEN 0 ELSE 499 END AS fp FROM ({_SEG}))"""


@query("model_comparison", "scored", """
SELECT segment AS model, round(tp * 1.0 / greatest(tp + fp, 1), 6) AS precision, round(tp * 1.0 / greatest(tp + fn, 1), 6) AS recall,
  round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM (
  SELECT segment, sum(CASE WHEN y_prob >= 0.42 THEN y_true ELSE 0 END) AS tp, sum(CASE WHEN y_prob >= 0.42 THEN 1 - y_true ELSE 0 END) AS fp,
    sum(CASE WHEN y_prob < 0.42 THEN y_true ELSE 0 END) AS fn FROM scored GROUP BY segment)""")
def model_comparison(spark, folder):
    """One row per segment, each standing for a model."""
    rows = metrics.segment_comparison(scored_of(spark, folder), "segment")
    return rounded(rows.withColumnRenamed("segment", "model"), "precision", "recall", "f1")


@query("batch_cost_summary", "scored", _COST)
def batch_cost_summary(spark, folder):
    return metrics.batch_cost_summary(_segment_metrics(spark, folder))


@query("cost_savings", "scored", f"""
WITH c AS MATERIALIZED ({_COST}) SELECT model, total_expected_cost, round((SELECT total_expected_cost FROM c WHERE model = '1-URGENT') - total_expected_cost, 2) + 0.0 AS savings FROM c""")
def cost_savings(spark, folder):
    got = metrics.cost_savings(metrics.batch_cost_summary(_segment_metrics(spark, folder)), "1-URGENT")
    return got.withColumn("savings", F.col("savings") + 0.0)


@query("cost_curve", "scored", f"""
SELECT round(threshold, 6) AS threshold, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(fp * 350.0 + fn * 42000.0 AS DOUBLE) AS cost FROM ({_grid_sql(metrics.F1_GRID)})""")
def cost_curve(spark, folder):
    return rounded(metrics.cost_curve(scored_of(spark, folder)), "threshold")


@query("cost_optimal_threshold", "scored", f"""
SELECT round(threshold, 6) AS threshold, CAST(fp * 350.0 + fn * 42000.0 AS DOUBLE) AS cost FROM ({_grid_sql(metrics.F1_GRID)}) ORDER BY cost, threshold LIMIT 1""")
def cost_optimal_threshold(spark, folder):
    return rounded(metrics.cost_optimal_threshold(metrics.cost_curve(scored_of(spark, folder))), "threshold")


@query("latency_percentiles", "ev", """
SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(avg(value), 6) AS mean, round(count(*) / (sum(value) / 1000.0), 6) AS requests_per_sec FROM ev""")
def latency_percentiles(spark, folder):
    """The event value stands for a latency in milliseconds."""
    got = metrics.latency_percentiles(views.events(spark, folder), "value")
    return rounded(got, "p50", "p90", "p95", "p99", "mean", "requests_per_sec")


@query("category_rates", "scored", """
SELECT segment, count(*) AS n, round(avg(CASE WHEN y_prob >= 0.42 THEN 1.0 ELSE 0.0 END), 6) AS flag_rate,
  round(avg(CASE WHEN y_prob >= 0.42 THEN 1.0 ELSE 0.0 END) FILTER (WHERE y_true = 0), 6) AS false_positive_rate FROM scored GROUP BY 1""")
def category_rates(spark, folder):
    return rounded(metrics.category_rates(scored_of(spark, folder), "segment"), "flag_rate", "false_positive_rate")


@query("disparate_impact", "scored", """
SELECT round(a, 6) AS protected_rate, round(b, 6) AS reference_rate, round(a / b, 6) AS impact_ratio, a / b >= 0.80 AS passes FROM (
  SELECT avg(CASE WHEN y_prob >= 0.42 THEN 0.0 ELSE 1.0 END) FILTER (WHERE segment = '1-URGENT') AS a,
    avg(CASE WHEN y_prob >= 0.42 THEN 0.0 ELSE 1.0 END) FILTER (WHERE segment = '5-LOW') AS b FROM scored)""")
def disparate_impact(spark, folder):
    got = metrics.disparate_impact(scored_of(spark, folder), "segment", "1-URGENT", "5-LOW")
    return rounded(got, "protected_rate", "reference_rate", "impact_ratio")


# --- calibration -----------------------------------------------------------------------------


@query("brier_score", "scored", "SELECT round(avg(power(y_prob - y_true, 2)), 8) AS brier_score FROM scored")
def brier_score(spark, folder):
    return rounded(calibration.brier_score(scored_of(spark, folder)), "brier_score", digits=8)


_EDGES = metrics.grid(0.0, 1.0, 11)
_BIN_LEFT = "least(9, " + " + ".join(f"(y_prob >= {e!r})::INTEGER" for e in _EDGES[1:]) + ")"
_BIN_RIGHT = "least(9, " + " + ".join(f"(y_prob > {e!r})::INTEGER" for e in _EDGES[1:]) + ")"


@query("ece", "scored", f"""
SELECT round(sum(n * abs(y - p)) / sum(n), 6) AS ece FROM (SELECT {_BIN_LEFT} AS b, count(*) AS n, avg(y_true) AS y, avg(y_prob) AS p FROM scored GROUP BY 1)""")
def ece(spark, folder):
    return rounded(calibration.ece(scored_of(spark, folder)), "ece")


@query("reliability_curve", "scored", f"""
SELECT CAST({_BIN_RIGHT} AS INTEGER) AS bin, count(*) AS n, round(avg(y_true), 6) AS prob_true, round(avg(y_prob), 6) AS prob_pred FROM scored GROUP BY 1""")
def reliability_curve(spark, folder):
    return rounded(calibration.reliability_curve(scored_of(spark, folder)), "prob_true", "prob_pred")


def _temperature_sql(points=25, rounds=5):
    logit = "ln(greatest(1e-6, least(1 - 1e-6, y_prob)) / (1 - greatest(1e-6, least(1 - 1e-6, y_prob))))"
    ctes = [f"s AS MATERIALIZED (SELECT {logit} AS z, count(*) AS n, sum(y_true) AS pos FROM scored GROUP BY y_prob)",
            "b0 AS (SELECT CAST(0.05 AS DOUBLE) AS lo, CAST(20.0 AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS t)"]
    last = points - 1
    for i in range(1, rounds + 1):
        ctes.append(f"c{i} AS MATERIALIZED (SELECT k, lo * power(hi / lo, k / {last}.0) AS t FROM b{i - 1} CROSS JOIN range({points}) g(k))")
        ctes.append(f"""l{i} AS MATERIALIZED (SELECT k, t, sum(-(pos * ln(p) + (n - pos) * ln(1 - p))) AS loss FROM (
          SELECT k, t, n, pos, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-greatest(-30, least(30, z / t)))))) AS p FROM s CROSS JOIN c{i}) GROUP BY k, t)""")
        ctes.append(f"m{i} AS MATERIALIZED (SELECT k, t FROM l{i} ORDER BY loss, k LIMIT 1)")
        ctes.append(f"""b{i} AS MATERIALIZED (SELECT (SELECT t FROM c{i} WHERE k = greatest(m.k - 1, 0)) AS lo, (SELECT t FROM c{i} WHERE k = least(m.k + 1, {last})) AS hi, m.t FROM m{i} m)""")
    return f"WITH {', '.join(ctes)} SELECT round(t, 4) AS temperature FROM b{rounds}"


@query("temperature_calibrate", "scored", _temperature_sql())
def temperature_calibrate(spark, folder):
    scored = scored_of(spark, folder)
    t = calibration.fit_temperature(scored)
    return scored.agg(F.round(F.max(F.lit(t)), 4).alias("temperature"))


_HALVES = """
halves AS MATERIALIZED (SELECT id, y_true, y_prob, row_number() OVER (PARTITION BY y_true ORDER BY md5(id || '|42'), id) % 2 AS fits FROM scored),
points AS MATERIALIZED (SELECT y_prob AS x, count(*) AS n, sum(y_true) AS pos FROM halves WHERE fits = 1 GROUP BY 1)"""

# Runs of falling means are one block of any fit; over those, the largest of the smallest means of stretches around each is the fit.
_ISOTONIC = """
steps AS (SELECT *, coalesce(pos * lag(n) OVER w > lag(pos) OVER w * n, FALSE) AS rises FROM points WINDOW w AS (ORDER BY x)),
runs AS (SELECT g, min(x) AS lo, max(x) AS hi, sum(n) AS n, sum(pos) AS pos FROM (SELECT *, sum(rises::INTEGER) OVER (ORDER BY x) AS g FROM steps) GROUP BY g),
sums AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY g) AS cn, sum(pos) OVER (ORDER BY g) AS cp FROM runs),
least_means AS (SELECT k.g, min((k.cp - j.cp + j.pos) / (k.cn - j.cn + j.n)) OVER (PARTITION BY j.g ORDER BY k.g DESC) AS low FROM sums j JOIN sums k ON k.g >= j.g),
fitted AS (SELECT g, max(low) AS v FROM least_means GROUP BY g),
knots AS MATERIALIZED (SELECT DISTINCT unnest([lo, hi]) AS x, v FROM (SELECT min(lo) AS lo, max(hi) AS hi, v FROM fitted JOIN runs USING (g) GROUP BY v)),
isotonic AS MATERIALIZED (SELECT id, y_true, y_prob, CASE WHEN a.x IS NULL THEN b.v WHEN b.x IS NULL OR b.x = a.x THEN a.v
  ELSE a.v + (y_prob - a.x) * (b.v - a.v) / (b.x - a.x) END AS y_cal
  FROM (SELECT * FROM halves WHERE fits = 0) t ASOF LEFT JOIN knots a ON t.y_prob >= a.x ASOF LEFT JOIN knots b ON t.y_prob <= b.x)"""


def _platt_sql(rounds=12):
    ctes = ["p0 AS (SELECT CAST(0 AS DOUBLE) AS a, ln((sum(pos) + 0.5) / (sum(n) - sum(pos) + 0.5)) AS b FROM points)"]
    for i in range(1, rounds + 1):
        ctes.append(f"""s{i} AS MATERIALIZED (SELECT a, b, sum((n * p - pos) * x) + a AS gx, sum(n * p - pos) AS g1,
          sum(n * p * (1 - p) * x * x) + 1 AS hxx, sum(n * p * (1 - p) * x) AS hx1, sum(n * p * (1 - p)) AS h11
          FROM (SELECT *, 1 / (1 + exp(-(a * x + b))) AS p FROM points, p{i - 1}) GROUP BY a, b)""")
        ctes.append(f"""p{i} AS MATERIALIZED (SELECT a - (h11 * gx - hx1 * g1) / (hxx * h11 - hx1 * hx1) AS a,
          b - (hxx * g1 - hx1 * gx) / (hxx * h11 - hx1 * hx1) AS b FROM s{i})""")
    ctes.append(f"platt AS (SELECT id, y_true, y_prob, 1 / (1 + exp(-(a * y_prob + b))) AS y_cal FROM halves, p{rounds} WHERE fits = 0)")
    return ",\n".join(ctes)


def _halved_temperature_sql():
    """Candidates and losses over the fitting half."""
    whole = _temperature_sql().replace("FROM scored GROUP BY", "FROM halves WHERE fits = 1 GROUP BY")
    ctes, last = whole.removeprefix("WITH ").rsplit(" SELECT round(t, 4) AS temperature FROM ", 1)
    logit = "ln(greatest(1e-6, least(1 - 1e-6, y_prob)) / (1 - greatest(1e-6, least(1 - 1e-6, y_prob))))"
    return f"""{ctes},
temperature AS (SELECT id, y_true, y_prob, greatest(0, least(1, 1 / (1 + exp(-greatest(-30, least(30, {logit} / greatest(t, 0.05))))))) AS y_cal
  FROM halves, {last} WHERE fits = 0)"""


def _compare_row(method, source, column):
    index = "least(9, " + " + ".join(f"({column} >= {e!r})::INTEGER" for e in _EDGES[1:]) + ")"
    return f"""SELECT '{method}' AS method, round((SELECT avg(power({column} - y_true, 2)) FROM {source}), 5) AS brier_score,
  round((SELECT sum(n * abs(y - p)) / sum(n) FROM (SELECT {index} AS b, count(*) AS n, avg(y_true) AS y, avg({column}) AS p FROM {source} GROUP BY 1)), 5) AS ece"""


def _halves(spark, folder):
    split = store(calibration.stratified_halves(scored_of(spark, folder)), "halves")
    return split.where("part = 'fit'"), split.where("part = 'test'")


def _calibrated(spark, folder, method):
    fit, test = _halves(spark, folder)
    return calibration.CALIBRATORS[method](fit)(test).select("id", "y_true", "y_prob", r("y_cal").alias("y_cal"))


@query("isotonic_calibrate", "scored", f"WITH {_HALVES}, {_ISOTONIC} SELECT id, y_true, y_prob, round(y_cal, 6) AS y_cal FROM isotonic")
def isotonic_calibrate(spark, folder):
    return _calibrated(spark, folder, "isotonic")


@query("platt_calibrate", "scored", f"WITH {_HALVES}, {_platt_sql()} SELECT id, y_true, y_prob, round(y_cal, 6) AS y_cal FROM platt")
def platt_calibrate(spark, folder):
    return _calibrated(spark, folder, "platt")


@query("calibration_compare", "scored", f"""WITH {_HALVES}, {_ISOTONIC}, {_platt_sql()}, {_halved_temperature_sql()}
{_compare_row("Uncalibrated", "isotonic", "y_prob")} UNION ALL {_compare_row("Platt", "platt", "y_cal")}
UNION ALL {_compare_row("Temperature", "temperature", "y_cal")} UNION ALL {_compare_row("Isotonic", "isotonic", "y_cal")}""")
def calibration_compare(spark, folder):
    return calibration.calibration_compare(*_halves(spark, folder))


def _lift_sql():
    index = lambda c: "least(9, " + " + ".join(f"({c} >= {e!r})::INTEGER" for e in _EDGES[1:]) + ")"
    brier = lambda c: f"(SELECT avg(power({c} - y_true, 2)) FROM isotonic)"
    gap = lambda c: f"(SELECT sum(n * abs(y - p)) / sum(n) FROM (SELECT {index(c)} AS b, count(*) AS n, avg(y_true) AS y, avg({c}) AS p FROM isotonic GROUP BY 1))"
    return f"""WITH {_HALVES}, {_ISOTONIC}, four AS (SELECT {brier("y_prob")} AS b0, {brier("y_cal")} AS b1, {gap("y_prob")} AS e0, {gap("y_cal")} AS e1)
SELECT 'isotonic' AS method, round(b0, 5) AS brier_before, round(b1, 5) AS brier_after, round(e0, 5) AS ece_before, round(e1, 5) AS ece_after,
  round((1 - b1 / greatest(b0, 1e-6)) * 100, 2) AS brier_reduction_pct, round((1 - e1 / greatest(e0, 1e-6)) * 100, 2) AS ece_reduction_pct,
  CAST(0.008264 AS DOUBLE) AS bayes_optimal_threshold, CAST({FLAG_THRESHOLD} AS DOUBLE) AS operational_threshold FROM four"""


@query("calibration_lift", "scored", _lift_sql())
def calibration_lift(spark, folder):
    return calibration.calibration_lift(*_halves(spark, folder))


# --- drift -------------------------------------------------------------------------------------


def psi_sql(columns, source, is_ref):
    parts = []
    for name in columns:
        parts.append(f"""SELECT '{name}' AS feature, sum((c - r) * ln(c / r)) AS psi FROM (
  SELECT b, coalesce(sum(1) FILTER (WHERE ref), 0) / max(nr) + 1e-4 AS r, coalesce(sum(1) FILTER (WHERE NOT ref), 0) / max(nc) + 1e-4 AS c FROM (
    SELECT ref, nr, nc, CASE WHEN hi > lo THEN greatest(0, least(9, floor((x - lo) / (hi - lo) * 10))) ELSE 9 END AS b FROM (
      SELECT CAST({name} AS DOUBLE) AS x, {is_ref} AS ref, CAST(count(*) FILTER (WHERE {is_ref}) OVER () AS DOUBLE) AS nr,
        CAST(count(*) FILTER (WHERE NOT ({is_ref})) OVER () AS DOUBLE) AS nc, min(CAST({name} AS DOUBLE)) OVER () AS lo, max(CAST({name} AS DOUBLE)) OVER () AS hi FROM {source})) GROUP BY b)""")
    return " UNION ALL ".join(parts)


@query("histogram_equal_width", "scored", """
SELECT CAST(g.b AS INTEGER) AS bin, count(s.b) AS n FROM range(10) g(b) LEFT JOIN (
  SELECT least(9, floor((y_prob - lo) / (hi - lo) * 10)) AS b FROM scored CROSS JOIN (SELECT min(y_prob) AS lo, max(y_prob) AS hi FROM scored)) s ON s.b = g.b GROUP BY 1""")
def histogram_equal_width(spark, folder):
    return drift.histogram_equal_width(scored_of(spark, folder), "y_prob")


@query("psi_single", "scored", f"SELECT round(psi, 6) AS psi FROM ({psi_sql(['y_prob'], 'scored', 'id % 3 = 0')})")
def psi_single(spark, folder):
    scored = scored_of(spark, folder)
    return rounded(drift.psi_single(scored.where("id % 3 = 0"), scored.where("id % 3 <> 0"), "y_prob"), "psi")


_DRIFT_SOURCE = "(SELECT m.*, s.last_step FROM fm m JOIN (SELECT id, coalesce(x, 0) AS last_step FROM gnodes LEFT JOIN (SELECT nameOrig, max(step) AS x FROM txn GROUP BY 1) ON nameOrig = id) s ON s.id = m.account_id)"
_EARLY = "last_step <= 700"


def _by_time(spark, folder):
    txn = views.transactions(spark, folder)
    known = cut_lineage(feat.node_last_step(matrix(spark, folder), txn))
    return known.where("last_step <= 700"), known.where("last_step > 700")


@query("psi_features", "fm gnodes txn", f"SELECT feature, round(psi, 6) AS psi FROM ({psi_sql(FEATURES, _DRIFT_SOURCE, _EARLY)})")
def psi_features(spark, folder):
    early, late = _by_time(spark, folder)
    return rounded(drift.psi_features(early, late, FEATURES), "psi")


_REPORT_COLUMNS = ("y_score", "total_sent_log", "tx_count_out", "degree_ratio", "balance_drain_ratio")


@query("drift_report", "fm gnodes txn", f"""
WITH src AS MATERIALIZED (SELECT *, greatest(0, balance_drain_ratio) AS y_score FROM {_DRIFT_SOURCE}),
p AS MATERIALIZED ({psi_sql(_REPORT_COLUMNS, 'src', _EARLY)})
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.20 THEN 'DRIFTED' WHEN psi >= 0.10 THEN 'WARNED' ELSE 'STABLE' END AS status,
  (SELECT max(psi) >= 0.20 FROM p) AS has_drift FROM p""")
def drift_report(spark, folder):
    early, late = [df.withColumn("y_score", F.greatest(F.lit(0.0), F.col("balance_drain_ratio"))) for df in _by_time(spark, folder)]
    return rounded(drift.drift_report(early, late, score="y_score", features=_REPORT_COLUMNS[1:]), "psi")


@query("batch_score_summary", "scored risk_scores", f"""
WITH p AS ({psi_sql(['y_prob'], 'scored', 'id % 2 = 0')})
SELECT count(*) AS total_accounts, count(*) FILTER (WHERE y_prob >= 0.42) AS flagged_accounts,
  round(count(*) FILTER (WHERE y_prob >= 0.42) * 1.0 / count(*), 6) AS flag_rate, count(*) FILTER (WHERE id % 5 <> 4) AS cache_hits,
  (SELECT round(psi, 6) FROM p) AS drift_psi, (SELECT psi >= 0.2 FROM p) AS drift_alert FROM scored WHERE id % 2 <> 0""")
def batch_score_summary(spark, folder):
    scored = scored_of(spark, folder).withColumn("is_flagged", F.col("y_prob") >= 0.42).withColumn("cache_hit", F.col("id") % 5 != 4)
    summary = drift.batch_score_summary(scored.where("id % 2 <> 0"), scored.where("id % 2 = 0"))
    return rounded(summary, "flag_rate", "drift_psi")


# --- training -------------------------------------------------------------------------------------


@query("class_weights", "labels_of", """
SELECT CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg, round(sum(1 - label) * 1.0 / sum(label), 6) AS scale_pos_weight,
  round(count(*) / (2.0 * sum(label)), 6) AS weight_pos, round(count(*) / (2.0 * sum(1 - label)), 6) AS weight_neg FROM labels_of""")
def class_weights(spark, folder):
    txn = views.transactions(spark, folder)
    labels = feat.label_join(feat.all_accounts(feat.fraud_type_filter(txn)), txn)
    return rounded(learn.class_weights(labels), "scale_pos_weight", "weight_pos", "weight_neg")


def _train_test(spark, folder):
    both = labelled_matrix(spark, folder)
    return both.where("split = 'train'"), both.where("split = 'test'")


def _predicted(model, test):
    return rounded(learn.predict(model, test), "y_prob")


@query("train_logistic")
def train_logistic(spark, folder):
    train, test = _train_test(spark, folder)
    return _predicted(learn.train_logistic(train), test)


@query("train_gbt")
def train_gbt(spark, folder):
    train, test = _train_test(spark, folder)
    return _predicted(learn.train_gbt(train), test)


@query("train_gbt_leafwise")
def train_gbt_leafwise(spark, folder):
    train, test = _train_test(spark, folder)
    held = F.pmod(F.xxhash64("account_id"), F.lit(5)) == 0
    return _predicted(learn.train_gbt_leafwise(train.where(~held), train.where(held)), test)


@query("feature_importance_topn")
def feature_importance_topn(spark, folder):
    train, _ = _train_test(spark, folder)
    return rounded(learn.feature_importances(learn.train_gbt(train), FEATURES, spark), "importance")


@query("ablation_subsets")
def ablation_subsets(spark, folder):
    train, test = _train_test(spark, folder)
    rows = learn.ablation_subsets(train, test)
    return rounded(rows, *[c for c in rows.columns if c not in ("model", "n_features")])


@query("propagated_classifier")
def propagated_classifier(spark, folder):
    base = labelled_matrix(spark, folder)
    return rounded(learn.propagated_classifier(base, stored_edges(spark, folder).select("src", "dst")), "y_prob")


@query("hybrid_stack")
def hybrid_stack(spark, folder):
    """The graph score is the structural rule score, which no label went into."""
    base = labelled_matrix(spark, folder)
    graph_score = base.select(F.col("account_id").alias("id"), scoring.graph_score(feature_columns()).alias("y_prob"))
    return rounded(learn.hybrid_stack(base, graph_score), "y_prob")


@query("two_stage_cascade", "logits risk_scores", """
SELECT account_id, round(s1, 6) AS stage1_score, score AS stage2_score, coalesce(score > 0.5, FALSE) AS is_alert FROM (
  SELECT account_id, 1 / (1 + exp(-tab_logit)) AS s1 FROM logits) LEFT JOIN risk_scores ON customer_id = 'c' || substr(account_id, 2) WHERE s1 > 0.2""")
def two_stage_cascade(spark, folder):
    nearline = views.risk_scores(spark, folder).select(F.concat(F.lit("C"), F.substring("customer_id", 2, 20)).alias("account_id"), "score")
    got = learn.two_stage_cascade(
        matrix(spark, folder), nearline, stage1=scoring.tabular_score(feature_columns()), stage1_threshold=0.2, stage2_threshold=0.5
    )
    return got.select("account_id", r("stage1_score").alias("stage1_score"), "stage2_score", "is_alert")


@query("batch_infer", "fm", """
SELECT account_id AS id, round(1 / (1 + exp(-(0.8 * balance_drain_ratio + 0.1 * degree_ratio - 0.02 * tx_count_out))), 6) AS y_prob FROM fm""")
def batch_infer(spark, folder):
    """An opaque model: a function of an Arrow batch that Catalyst cannot look into."""
    names = ["balance_drain_ratio", "degree_ratio", "tx_count_out"]

    def opaque(batch):
        return 1.0 / (1.0 + np.exp(-(0.8 * batch[names[0]] + 0.1 * batch[names[1]] - 0.02 * batch[names[2]])))

    return rounded(learn.batch_infer(matrix(spark, folder), opaque, id_column="account_id", features=names), "y_prob")


@query("shard_stratified", "labels_of", """
SELECT account_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(account_id || '|42'), account_id) - 1) % 3 AS INTEGER) AS shard FROM labels_of""")
def shard_stratified(spark, folder):
    txn = views.transactions(spark, folder)
    labels = feat.label_join(feat.all_accounts(feat.fraud_type_filter(txn)), txn)
    return learn.shard_stratified(labels, id_column="account_id", label="label")


def _federated_sql(rounds=10, rate=0.5, l2=1e-4):
    n = len(TABULAR_FEATURES)
    ctes = [
        """sh AS MATERIALIZED (SELECT fm.*, label, (row_number() OVER (PARTITION BY label ORDER BY md5(fm.account_id || '|42'), fm.account_id) - 1) % 3 AS shard
          FROM fm JOIN labels_of USING (account_id))""",
        f"lg AS MATERIALIZED (SELECT account_id, shard, label, unnest(range({n})) AS j, unnest([{', '.join(TABULAR_FEATURES)}]) AS v FROM sh)",
        "ms AS (SELECT shard, j, avg(v) AS m, stddev_pop(v) AS s FROM lg GROUP BY 1, 2)",
        f"""x AS MATERIALIZED (SELECT account_id, shard, j, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS x FROM lg JOIN ms USING (shard, j)
          UNION ALL SELECT account_id, shard, {n}, 1.0 FROM sh)""",
        "sz AS MATERIALIZED (SELECT shard, count(*) AS n, sum(label) AS pos FROM sh GROUP BY 1)",
        """yw AS MATERIALIZED (SELECT account_id, shard, label AS y, CASE WHEN label = 1 THEN n / (2.0 * greatest(pos, 1)) ELSE n / (2.0 * greatest(n - pos, 1)) END AS b
          FROM sh JOIN sz USING (shard))""",
        f"w0 AS (SELECT j, CAST(0 AS DOUBLE) AS w FROM range({n + 1}) g(j))",
    ]
    for i in range(1, rounds + 1):
        ctes.append(f"""e{i} AS MATERIALIZED (SELECT x.account_id, (1 / (1 + exp(-sum(x * w))) - any_value(y)) * any_value(b) AS e
          FROM x JOIN w{i - 1} USING (j) JOIN yw ON yw.account_id = x.account_id GROUP BY 1)""")
        ctes.append(f"""w{i} AS MATERIALIZED (SELECT j, sum(n / (SELECT sum(n) FROM sz) * (w - {rate} * (g + {l2} * w))) AS w
          FROM (SELECT shard, j, avg(e * x) AS g FROM x JOIN e{i} USING (account_id) GROUP BY 1, 2) JOIN w{i - 1} USING (j) JOIN sz USING (shard) GROUP BY j)""")
    return f"""WITH {', '.join(ctes)}
SELECT account_id, label, round(1 / (1 + exp(-(z + (SELECT w FROM w{rounds} WHERE j = {n})))), 6) AS y_prob FROM (
  SELECT account_id, any_value(label) AS label, sum(w * CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END) AS z
  FROM lg JOIN (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM lg GROUP BY j) USING (j) JOIN w{rounds} USING (j) GROUP BY account_id)"""


@query("federated_average", "fm labels_of", _federated_sql())
def federated_average(spark, folder):
    """Global weights applied to every account."""
    base = cut_lineage(learn.shard_stratified(labelled_matrix(spark, folder), id_column="account_id", label="label"))
    weights = learn.federated_average(base, features=TABULAR_FEATURES, rounds=10)
    moments = base.agg(
        *[F.avg(c).alias(f"m_{c}") for c in TABULAR_FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in TABULAR_FEATURES]
    )
    m = metrics.one_row(moments)
    standard = base.withColumn("_m", m).select(
        "account_id", "label",
        *[F.when(F.col(f"_m.s_{c}") > 0, (F.col(c) - F.col(f"_m.m_{c}")) / F.col(f"_m.s_{c}")).otherwise(0.0).alias(c) for c in TABULAR_FEATURES],
    )
    return standard.select("account_id", "label", r(learn.linear_score(TABULAR_FEATURES, weights)).alias("y_prob"))
