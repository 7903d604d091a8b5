"""Queries: planted rings and decoys, streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import feature_columns
from ..operators import learn, metrics, plant, rings, snapshots, temporal
from ..session import cut_lineage, scratch_path, store
from ..sources import files, views
from ..streaming import jobs
from .inputs import labelled_matrix, r, rounded, stored_edges
from .registry import query
from .rings_and_models import RING_EVAL_SQL, RING_EVAL_VIEWS, RING_REPORT_SQL, psi_sql

BASE_TS = 1_788_300_000
HASH = "(('0x' || substr(md5({0}), 1, 8))::BIGINT)"


def _anchors(spark, folder):
    """One planted ring per supplier."""
    return views.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("anchor"), F.lit(BASE_TS).cast("bigint").alias("base_ts")
    )


def _ring_sql(shape):
    tx = f"concat_ws('_', 'tx_{shape.name}', s_suppkey, a, n)"

    def pick(prefix, count):
        if not count:
            return "CAST(NULL AS VARCHAR)"
        number = HASH.format(f"'{prefix}:{shape.name}:' || tx")
        return f"'{prefix}_{shape.name}_' || s_suppkey || '_' || ({number} % {count} + 1)"

    merchant_number = HASH.format(f"'merchant:{shape.name}:' || tx")
    time_number = HASH.format("'time:' || tx")
    bank = f"'bank_{shape.name}_' || s_suppkey" if shape.shared_bank else "CAST(NULL AS VARCHAR)"
    promo = f"'promo_{shape.name}_' || s_suppkey" if shape.promo else "CAST(NULL AS VARCHAR)"
    return f"""
SELECT tx AS transaction_id, concat_ws('_', 'cust_{shape.name}', s_suppkey, a) AS customer_id,
  'merch_' || s_suppkey || '_' || ({merchant_number} % {shape.merchants} + 1) AS merchant_id,
  {pick('dev', shape.devices)} AS device_id, {pick('ip', shape.ips)} AS ip_id, {pick('addr', shape.addresses)} AS address_id,
  {promo} AS promo_id, {bank} AS bank_account_id, CAST({shape.amount} AS DOUBLE) AS amount,
  {BASE_TS} + {shape.start} + {time_number} % {shape.spread} AS timestamp,
  CAST({int(shape.rto)} AS INTEGER) AS rto_flag, CAST({int(shape.chargeback)} AS INTEGER) AS chargeback_flag,
  CAST({shape.promo_discount} AS DOUBLE) AS promo_discount_amount, CAST({shape.amount if shape.rto else 0.0} AS DOUBLE) AS refund_amount
FROM (SELECT s_suppkey, a, n, {tx} AS tx FROM supplier CROSS JOIN range(1, {shape.accounts + 1}) x(a) CROSS JOIN range(1, {shape.payments + 1}) y(n))"""


@query("plant_promo_ring", "", _ring_sql(plant.PROMO))
def plant_promo_ring(spark, folder):
    return plant.plant_promo_ring(_anchors(spark, folder))


@query("plant_rto_ring", "", _ring_sql(plant.RTO))
def plant_rto_ring(spark, folder):
    return plant.plant_rto_ring(_anchors(spark, folder))


@query("plant_chargeback_ring", "", _ring_sql(plant.CHARGEBACK))
def plant_chargeback_ring(spark, folder):
    return plant.plant_chargeback_ring(_anchors(spark, folder))


def _victims(spark, folder):
    anchors = _anchors(spark, folder).withColumn("position", F.col("anchor"))
    customers = views.table(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("c"))
    return plant.ato_victims(anchors, customers, customer="c")


@query("plant_ato_ring", "", f"""
WITH v AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS c, (row_number() OVER (ORDER BY lpad(CAST(c_custkey AS VARCHAR), 12, '0')) - 1) // 6 AS pos FROM customer),
t AS (SELECT s_suppkey, c, n, 'tx_ato_' || s_suppkey || '_' || c || '_' || n AS tx FROM supplier JOIN v ON pos = s_suppkey CROSS JOIN range(5) g(n))
SELECT tx AS transaction_id, c AS customer_id, 'merch_' || s_suppkey || '_' || ({HASH.format("'merchant:ato:' || tx")} % 4 + 1) AS merchant_id,
  'dev_ato_' || s_suppkey AS device_id, 'ip_ato_' || s_suppkey AS ip_id, CAST(19500 AS DOUBLE) AS amount, {BASE_TS} + 25000 + n * 60 AS timestamp FROM t""")
def plant_ato_ring(spark, folder):
    rows = plant.plant_ato_ring(_victims(spark, folder))
    return rows.select("transaction_id", "customer_id", "merchant_id", "device_id", "ip_id", "amount", "timestamp")


def _everything_planted(spark, folder):
    anchors = _anchors(spark, folder)
    return [plant.plant_promo_ring(anchors), plant.plant_rto_ring(anchors), plant.plant_chargeback_ring(anchors)]


@query("plant_rows", "ptx", """
SELECT 'base' AS what, count(*) AS n FROM ptx UNION ALL SELECT 'promo', count(*) * 45 FROM supplier
UNION ALL SELECT 'rto', count(*) * 20 FROM supplier UNION ALL SELECT 'chargeback', count(*) * 16 FROM supplier""")
def plant_rows(spark, folder):
    rows = plant.plant_rows(views.payments(spark, folder), _everything_planted(spark, folder))
    kind = F.when(F.col("transaction_id").startswith("tx_"), F.split("transaction_id", "_")[1]).otherwise("base")
    return rows.groupBy(kind.alias("what")).agg(F.count(F.lit(1)).alias("n"))


_PAYMENT_COLUMNS = (
    "transaction_id, customer_id, merchant_id, device_id, ip_id, address_id, promo_id, bank_account_id, amount, timestamp, rto_flag, chargeback_flag"
)


@query("planted_ring_recall", RING_EVAL_VIEWS, RING_EVAL_SQL, {
    "ptx": f"SELECT {_PAYMENT_COLUMNS} FROM ({{original}}) UNION ALL SELECT {_PAYMENT_COLUMNS} FROM ({_ring_sql(plant.PROMO)})",
    "gt_members": f"""SELECT 'ring_promo_' || s_suppkey AS ring_id, concat_ws('_', 'cust_promo', s_suppkey, a) AS customer_id,
      CAST({BASE_TS} + 3600 AS BIGINT) AS start_timestamp FROM supplier CROSS JOIN range(1, 16) x(a)""",
})
def planted_ring_recall(spark, folder):
    """Planted promo rings added to the payments: how many does the detector find?"""
    anchors = _anchors(spark, folder)
    payments = store(plant.plant_rows(views.payments(spark, folder), [plant.plant_promo_ring(anchors)]), "payments")
    clustered = store(rings.ring_payments(payments), "ring-payments")
    report = cut_lineage(rings.report_from(clustered, store(rings.ring_entities(clustered), "ring-entities"), views.risk_scores(spark, folder)))
    members = store(clustered.select("component", "customer_id").distinct(), "members")
    got = rings.ring_eval(report, members, plant.truth_of(anchors, plant.PROMO), payments)
    return rounded(got, "future_loss_prevented", digits=2)


_U = "(({0} + 0.5) / 4294967296.0)"


@query("synthetic_background", "", f"""
SELECT tx AS transaction_id, 'cust_clean_' || c_custkey AS customer_id, 'merch_' || ({HASH.format("'merchant:' || tx")} % 20 + 1) AS merchant_id,
  'dev_clean_' || c_custkey AS device_id, 'asn_isp_' || ({HASH.format("'asn:' || c_custkey")} % 5 + 1) AS asn_id,
  'pin_' || ({HASH.format("'pin:' || c_custkey")} % 50 + 100001) AS pincode_id,
  round(exp(7.0 + 0.8 * sqrt(-2 * ln({_U.format(HASH.format("'u1:' || tx"))})) * cos(6.283185307179586 * {_U.format(HASH.format("'u2:' || tx"))})), 2) AS amount,
  {BASE_TS} + n * 3600 + {HASH.format("'time:' || tx")} % 301 AS timestamp
FROM (SELECT c_custkey, n, 'tx_clean_' || c_custkey || '_' || n AS tx FROM customer CROSS JOIN range(5) g(n))""")
def synthetic_background(spark, folder):
    rows = plant.synthetic_background(views.table(spark, folder, "customer"), customer="c_custkey")
    return rows.select("transaction_id", "customer_id", "merchant_id", "device_id", "asn_id", "pincode_id", "amount", "timestamp")


def _wave_sql():
    parts = []
    for ring, (accounts, prefix, merchant, mcc, amount, method, first, step, tier) in plant.WAVES.items():
        parts.append(f"""SELECT '{ring}' AS ring_type, '{prefix}_' || s_suppkey || '_' || lpad(CAST(i + 1 AS VARCHAR), 3, '0') AS account_id, '{merchant}' AS merchant_name,
  CAST({amount} AS DOUBLE) AS amount_inr, 'dev_shared_cluster_' || s_suppkey AS device_fingerprint, round(CAST({first} AS DOUBLE) + i * {step}, 6) AS risk_score, '{tier}' AS risk_tier
FROM supplier CROSS JOIN range({accounts}) g(i)""")
    return " UNION ALL ".join(parts)


@query("plant_event_wave", "", _wave_sql())
def plant_event_wave(spark, folder):
    waves = [plant.plant_event_wave(_anchors(spark, folder), ring) for ring in plant.WAVES]
    rows = waves[0].union(waves[1]).union(waves[2]).union(waves[3])
    return rows.select("ring_type", "account_id", "merchant_name", "amount_inr", "device_fingerprint", "risk_score", "risk_tier")


@query("plant_low_and_slow", "", """
SELECT 'acc_evasion_' || s_suppkey || '_' || lpad(CAST(i AS VARCHAR), 3, '0') AS account_id, CAST(20000 AS DOUBLE) AS amount, round(ln(20001.0), 6) AS total_sent_log,
  round(ln(22001.0), 6) AS total_received_log, CAST(0.35 AS DOUBLE) AS balance_drain_ratio, CAST(0.04 AS DOUBLE) AS local_clustering_coefficient FROM supplier CROSS JOIN range(1, 26) g(i)""")
def plant_low_and_slow(spark, folder):
    rows = plant.plant_low_and_slow(_anchors(spark, folder))
    return rows.select(
        "account_id", "amount", r("total_sent_log").alias("total_sent_log"), r("total_received_log").alias("total_received_log"),
        "balance_drain_ratio", "local_clustering_coefficient",
    )


@query("detection_summary", "", """
SELECT detector, n * 25 AS n_accounts, CASE WHEN s >= 0.40 THEN n * 25 ELSE 0 END AS caught_count, CASE WHEN s >= 0.40 THEN CAST(100 AS DOUBLE) ELSE 0 END AS detection_rate_pct,
  round(s, 4) AS mean_score, CASE WHEN s >= 0.40 THEN CAST(0 AS DOUBLE) ELSE 100 END AS evasion_success_pct
FROM (SELECT count(*) AS n FROM supplier) CROSS JOIN (
  SELECT 'tabular' AS detector, 1 / (1 + exp(-(-4.0 - 1.2 * 0.05 + (0.12 - 0.15) * 2 + 0.0))) AS s
  UNION ALL SELECT 'graph', 1 / (1 + exp(-(-3.8 - 0.8 * 0.5)))
  UNION ALL SELECT 'hybrid', greatest(0.01, 1 / (1 + exp(-(0.52 * (-4.0 - 0.06 - 0.06) + 0.48 * (-3.8 - 0.4))))))""")
def detection_summary(spark, folder):
    f = feature_columns()
    scored = plant.plant_low_and_slow(_anchors(spark, folder)).select(
        "account_id", scoring.tabular_score(f).alias("tabular"), scoring.graph_score(f).alias("graph"), scoring.champion_score(f).alias("hybrid")
    )
    return metrics.detection_summary(scored, ["tabular", "graph", "hybrid"])


def _fraud_and_clean(spark, folder):
    nodes = cut_lineage(labelled_matrix(spark, folder).select(
        F.col("account_id").alias("id"), "label", scoring.champion_score(feature_columns()).alias("y_prob")
    ))
    return nodes, nodes.where("label = 1").select("id"), nodes.where("label = 0").select("id")


@query("decoy_edges", "labels_of", f"""
WITH c AS MATERIALIZED (SELECT account_id, row_number() OVER (ORDER BY account_id) AS pos, count(*) OVER () AS n FROM labels_of WHERE label = 0),
w AS (SELECT account_id AS src, k, i AS copy, {HASH.format("'0:' || account_id || ':' || k || ':' || i")} % (SELECT max(n) FROM c) + 1 AS pos
  FROM labels_of CROSS JOIN (SELECT unnest([10, 50, 100, 500]) AS k) CROSS JOIN range(1, 501) g(i) WHERE label = 1 AND i <= k)
SELECT CAST(k AS INTEGER) AS k, src, CAST(copy AS INTEGER) AS copy, c.account_id AS dst FROM w JOIN c USING (pos)""")
def decoy_edges(spark, folder):
    _, fraud, clean = _fraud_and_clean(spark, folder)
    return plant.decoy_edges(fraud, clean, k_values=(0, 10, 50, 100, 500))


@query("stress_curve", "labels_of acct cedges", f"""
WITH c AS MATERIALIZED (SELECT account_id, row_number() OVER (ORDER BY account_id) AS pos, count(*) OVER () AS n FROM labels_of WHERE label = 0),
ks AS (SELECT unnest([0, 10, 50, 100, 500]) AS k),
w AS (SELECT account_id AS src, k, {HASH.format("'0:' || account_id || ':' || k || ':' || i")} % (SELECT max(n) FROM c) + 1 AS pos
  FROM labels_of CROSS JOIN ks CROSS JOIN range(1, 501) g(i) WHERE label = 1 AND i <= k),
e AS (SELECT k, src, dst FROM cedges CROSS JOIN ks UNION ALL SELECT k, src, c.account_id FROM w JOIN c USING (pos)
  UNION ALL SELECT k, account_id, account_id FROM labels_of CROSS JOIN ks),
s AS MATERIALIZED (SELECT k, src, avg(prob) AS score FROM e JOIN acct ON account_id = dst GROUP BY 1, 2),
lad AS (SELECT k, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
  SELECT k, round(score, 12) AS x, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM s JOIN labels_of ON account_id = src GROUP BY 1, 2) WINDOW w AS (PARTITION BY k ORDER BY x DESC)),
ap AS (SELECT k, CASE WHEN max(tp) > 0 THEN sum(pos * 1.0 * tp / (tp + fp)) / max(tp) ELSE 0 END AS pr_auc FROM lad GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN score >= 0.05 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1), 6) AS recall,
  round(avg(CAST(label AS DOUBLE)) FILTER (WHERE score >= 0.05), 6) AS precision,
  round(any_value(pr_auc), 6) AS pr_auc, round(avg(score) FILTER (WHERE label = 1), 6) AS mean_fraud_score
FROM s JOIN labels_of ON account_id = src JOIN ap USING (k) GROUP BY k""")
def stress_curve(spark, folder):
    """Recall, precision and PR-AUC at k decoys, measured on neighbour-averaged scores."""
    nodes, fraud, clean = _fraud_and_clean(spark, folder)
    levels = (0, 10, 50, 100, 500)
    decoys = plant.decoy_edges(fraud, clean, k_values=levels)
    got = learn.stress_curve(
        fraud, clean, stored_edges(spark, folder), nodes.select("id", "y_prob"), decoys, k_values=levels, threshold=0.05
    )
    return rounded(got, "recall", "precision", "pr_auc", "mean_fraud_score")


# --- streams ----------------------------------------------------------------------------------------


def _stream(spark, folder):
    return jobs.event_stream(spark, folder, files="events.parquet")


@query("payment_event_source", "", """
SELECT 'acc_' || user_id AS account_id, event_type AS method, value AS amount_inr, event_id FROM events""")
def payment_event_source(spark, folder):
    """Events written as payment events in JSON, then read as a stream with a fixed schema."""
    path = scratch_path(spark, "payment-events")
    views.events(spark, folder).select(
        F.col("event_id").cast("string").alias("payment_id"), F.concat(F.lit("acc_"), F.col("user_id").cast("string")).alias("account_id"),
        F.col("value").alias("amount_inr"), F.col("event_type").alias("method"), F.col("ts").alias("timestamp"),
    ).write.json(path)
    stream = files.payment_event_stream(spark, path)
    return jobs.run_to_table(
        stream.select("account_id", "method", "amount_inr", F.col("payment_id").cast("bigint").alias("event_id")), label="events"
    )


_HOUR = 3_600_000_000


@query("stream_velocity", "ev", """
SELECT event_id, count(*) OVER w AS tx_velocity, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS amount_velocity FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def stream_velocity(spark, folder):
    """Exact trailing totals as events arrive; equal to the batch operator."""
    got = jobs.exact_velocity(_stream(spark, folder))
    return got.select("event_id", "tx_velocity", F.col("amount_velocity").cast("double").alias("amount_velocity"))


@query("stream_velocity_sliding", "ev", f"""
SELECT user_id, h * {_HOUR} AS start_us, count(*) AS tx_velocity, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount_velocity
FROM (SELECT *, unnest(range(ts_us // {_HOUR} - 23, ts_us // {_HOUR} + 1)) AS h FROM ev) GROUP BY 1, 2""")
def stream_velocity_sliding(spark, folder):
    """Every window as it stands when the feed ends, those still open included."""
    return jobs.sliding_totals(_stream(spark, folder)).withColumn("amount_velocity", F.col("amount_velocity").cast("double"))


@query("stream_rate_limit", "ev", """
SELECT event_id, c AS requests, c > 3 AS is_limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS c FROM ev)""")
def stream_rate_limit(spark, folder):
    got = jobs.stream_rate_limit(_stream(spark, folder), max_requests=3, window_sec=7200)
    return got.select("event_id", "requests", "is_limited")


_SNAP = "SELECT account_id, max(written_us) AS written_us, arg_max(score, written_us) AS score, max(written_us) + 86400000000 AS expire_us FROM score_log GROUP BY 1"


@query("stream_score", "ev score_log", f"""
SELECT event_id, round(CASE WHEN ts_us < expire_us THEN 0.5 * p + 0.5 * score ELSE p END, 8) AS fraud_probability, coalesce(ts_us < expire_us, FALSE) AS cache_hit
FROM (SELECT *, least(1.0, value / 500.0) AS p FROM ev) LEFT JOIN ({_SNAP}) s ON s.account_id = user_id""")
def stream_score(spark, folder):
    snapshot = snapshots.snapshot_upsert(
        None, views.score_log(spark, folder), key="account_id", written_us="written_us", value="score"
    ).withColumnRenamed("account_id", "user_id")
    scored = jobs.score_events(_stream(spark, folder), snapshot, key="user_id", probability=F.least(F.lit(1.0), F.col("value") / 500.0))
    rows = jobs.run_to_table(scored.select("event_id", "fraud_probability", "cache_hit"), label="scores")
    return rounded(rows, "fraud_probability", digits=8)


@query("stream_nearline_ttl", "score_log ev", _SNAP)
def stream_nearline_ttl(spark, folder):
    writes = _stream(spark, folder).where("event_type = 'view'").select(
        F.col("user_id").alias("account_id"), F.col("ts").alias("written_at"), F.round(F.col("value") / 600.0, 6).alias("score")
    )
    return jobs.nearline_table(writes)


@query("stream_ring_alert", "report", RING_REPORT_SQL, {
    "ptx": "SELECT * FROM (SELECT *, max(timestamp) OVER () AS newest FROM ({original})) WHERE timestamp > newest - 864000"
})
def stream_ring_alert(spark, folder):
    """Rings among the payments of the last ten days of the feed."""
    path = scratch_path(spark, "payment-feed")
    views.payments(spark, folder).write.parquet(path)
    schema = views.payments(spark, folder).schema
    stream = spark.readStream.schema(schema).parquet(path)
    alerts = jobs.ring_alerts(stream, views.risk_scores(spark, folder), window_sec=10 * 86_400)
    return alerts.withColumn("total_exposure", F.col("total_exposure").cast("double")).drop("batch")


@query("stream_drift", "ev", f"""
WITH p AS MATERIALIZED ({psi_sql(['value', 'user_id'], 'ev', 'ts_us <= 1705276800000000')})
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.20 THEN 'DRIFTED' WHEN psi >= 0.10 THEN 'WARNED' ELSE 'STABLE' END AS status,
  (SELECT max(psi) >= 0.20 FROM p) AS has_drift FROM p""")
def stream_drift(spark, folder):
    """Every micro-batch against the first half of the feed."""
    feed = views.events(spark, folder)
    half = 1_705_276_800_000_000
    path = scratch_path(spark, "drift-feed")
    feed.where(F.col("ts_us") > half).select("value", "user_id").write.parquet(path)
    stream = spark.readStream.schema("value DOUBLE, user_id BIGINT").parquet(path)
    got = jobs.drift_batches(stream, feed.where(F.col("ts_us") <= half).select("value", "user_id"), score="value", features=["user_id"])
    return rounded(got, "psi").drop("batch")


@query("stream_dedupe", "ev", "SELECT DISTINCT user_id, ts_us, value FROM ev")
def stream_dedupe(spark, folder):
    """Every event arrives twice; one copy stays."""
    stream = _stream(spark, folder)
    twice = stream.union(_stream(spark, folder)).select("user_id", "ts", "ts_us", "value")
    kept = jobs.dedupe(twice, keys=["user_id", "ts_us", "value"])
    return jobs.run_to_table(kept.select("user_id", "ts_us", "value"), label="dedupe")


@query("stream_audit", "ev", """
SELECT 'C' || user_id AS account_id, 'CONFIRMED_FLAG' AS decision, 'analyst_' || (event_id % 5) AS analyst_id, value / 600 AS risk_score,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ev""")
def stream_audit(spark, folder):
    requests = _stream(spark, folder).select(
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("account_id"), F.lit("CONFIRMED_FLAG").alias("decision"),
        F.concat(F.lit("analyst_"), (F.col("event_id") % 5).cast("string")).alias("analyst_id"), (F.col("value") / 600).alias("risk_score"),
        F.lit(None).cast("string").alias("notes"), F.lit("Flagged").alias("action_taken"), F.col("ts").alias("requested_at"),
    )
    return jobs.audit_log(requests).select("account_id", "decision", "analyst_id", "risk_score", "timestamp")


@query("stream_session_burst", "ev", f"""
SELECT user_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS events FROM (
  SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS g FROM (
    SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) < {4 * _HOUR} THEN 0 ELSE 1 END AS s FROM ev))
GROUP BY user_id, g HAVING count(*) >= 4""")
def stream_session_burst(spark, folder):
    """Four-hour gap, because the sparse events have no five-minute bursts; sessions still open when the feed ends included."""
    rows = jobs.all_session_bursts(_stream(spark, folder), gap="4 hours", min_events=4)
    return rows.select("user_id", "start_us", (F.col("end_us") - 4 * _HOUR).alias("end_us"), "events")


@query("session_bursts", "ev", f"""
SELECT user_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS events FROM (
  SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS g FROM (
    SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) < {4 * _HOUR} THEN 0 ELSE 1 END AS s FROM ev))
GROUP BY user_id, g HAVING count(*) >= 4""")
def session_bursts(spark, folder):
    return temporal.session_bursts(views.events(spark, folder), key="user_id", ts_us="ts_us", gap_sec=4 * 3600, min_events=4)


@query("stream_merchant_minute", "ev", """
SELECT device_id, ts_us // 60000000 * 60000000 AS minute_us, count(*) AS total, count(*) FILTER (WHERE value > 100) AS flagged,
  round(count(*) FILTER (WHERE value > 100) * 1.0 / count(*), 6) AS flag_rate FROM ev GROUP BY 1, 2""")
def stream_merchant_minute(spark, folder):
    """Devices stand in for merchants; values above 100 for flagged payments."""
    minutes = jobs.merchant_minute(_stream(spark, folder), merchant="device_id", flagged=F.col("value") > 100)
    return rounded(jobs.run_updates(minutes, ["device_id", "minute_us"], label="minutes"), "flag_rate")
