"""Queries: scans, sinks, scalar functions and account scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ATTRIBUTION_TERMS, EDGE_PAYLOAD_FIELDS, FEATURES, MERCHANT_CATEGORIES, PAYMENT_METHODS, UNIT_INTERVAL_FEATURES
from ..functions import explain, probability, scoring, transaction, vectors
from ..functions.scoring import feature_columns
from ..operators import audit, features, plant, propagate, review, snapshots
from ..session import scratch_path
from ..sources import files, views
from .inputs import matrix, r, rounded, scored_accounts
from .registry import query
from .sql_views import VIEWS

EPOCH_DAY = 86_400


# --- scans and sinks --------------------------------------------------------------------


@query("txn_scan", "txn", "SELECT count(*) AS rows, round(avg(isFraud), 6) AS fraud_rate FROM txn")
def txn_scan(spark, folder):
    return rounded(features.scan_summary(views.transactions(spark, folder)), "fraud_rate")


@query("edge_table_read", "gtx", """
SELECT tx_id, nameOrig, nameDest, step, round(ln(1 + amount), 6) AS amount_log FROM gtx WHERE step <= 371""")
def edge_table_read(spark, folder):
    path = scratch_path(spark, "edges")
    files.write_edges(features.prepare_edges(views.transactions(spark, folder)), path)
    edges = files.read_edges(spark, path, until_step=371)
    return edges.select("tx_id", "nameOrig", "nameDest", "step", r("amount_log").alias("amount_log"))


@query("edge_table_write", "gtx", "SELECT CAST(step // 24 AS INTEGER) AS day, count(*) AS n FROM gtx GROUP BY 1")
def edge_table_write(spark, folder):
    path = scratch_path(spark, "edges")
    files.write_edges(features.prepare_edges(views.transactions(spark, folder)), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("feature_cache", "fm", """
SELECT count(*) AS n, round(sum(total_sent_log), 4) AS sent, round(sum(k_core_number), 4) AS cores,
  round(sum(pagerank), 6) AS rank_mass FROM fm""")
def feature_cache(spark, folder):
    return matrix(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("total_sent_log"), 4).alias("sent"),
        r(F.sum("k_core_number"), 4).alias("cores"), r(F.sum("pagerank")).alias("rank_mass"),
    )


def _audit_requests(spark, folder):
    """One analyst decision per order, at the order's own time."""
    orders = views.table(spark, folder, "orders")
    return orders.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_id"),
        F.when(F.col("o_orderstatus") == "F", "CONFIRMED_FLAG").otherwise("OVERRIDDEN_CLEAN").alias("decision"),
        F.concat(F.lit("analyst_"), (F.col("o_orderkey") % 7).cast("string")).alias("analyst_id"),
        (F.col("o_totalprice").cast("double") / 600000.0).alias("risk_score"),
        F.when(F.col("o_orderkey") % 3 == 0, "checked by phone").alias("notes"),
        F.lit("Flagged for Physical Delivery Verification").alias("action_taken"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))).alias("requested_at"),
    )


_AUDIT_SQL = """
SELECT account_id, decision, analyst_id, risk_score, notes, action_taken, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
  'audit_' || substr(sha256(account_id || '|' || analyst_id || '|' || decision || '|' || CAST(epoch_us(stamp) AS VARCHAR)), 1, 14) AS audit_id
FROM (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS account_id,
    CASE WHEN o_orderstatus = 'F' THEN 'CONFIRMED_FLAG' ELSE 'OVERRIDDEN_CLEAN' END AS decision,
    'analyst_' || CAST(o_orderkey % 7 AS VARCHAR) AS analyst_id, CAST(o_totalprice AS DOUBLE) / 600000.0 AS risk_score,
    CASE WHEN o_orderkey % 3 = 0 THEN 'checked by phone' ELSE 'No note was left by the analyst.' END AS notes,
    'Flagged for Physical Delivery Verification' AS action_taken,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS stamp
  FROM orders)"""


@query("audit_append", "", _AUDIT_SQL)
def audit_append(spark, folder):
    path = scratch_path(spark, "audit")
    audit.audit_append(audit.audit_records(_audit_requests(spark, folder)), path)
    return spark.read.parquet(path).drop("month")


@query("audit_list", "", f"SELECT *, count(*) OVER () AS total_records FROM ({_AUDIT_SQL}) ORDER BY timestamp DESC, audit_id")
def audit_list(spark, folder):
    return audit.audit_list(audit.audit_records(_audit_requests(spark, folder)))


@query("audit_export_csv", "", _AUDIT_SQL)
def audit_export_csv(spark, folder):
    path = scratch_path(spark, "audit-csv")
    records = audit.audit_records(_audit_requests(spark, folder))
    audit.audit_export_csv(records, path)
    return spark.read.schema(records.schema).option("header", True).csv(path)


@query("audit_export_json", "", _AUDIT_SQL)
def audit_export_json(spark, folder):
    path = scratch_path(spark, "audit-json")
    records = audit.audit_records(_audit_requests(spark, folder))
    audit.audit_export_json(records, path)
    return spark.read.schema(records.schema).json(path)


def _score_snapshot(spark, folder):
    log = views.score_log(spark, folder)
    # the even half stands for the stored snapshot, the odd half for new writes
    old = snapshots.snapshot_upsert(None, log.where(F.col("written_us") % 2 == 0), key="account_id", written_us="written_us", value="score")
    return snapshots.snapshot_upsert(old, log.where(F.col("written_us") % 2 == 1), key="account_id", written_us="written_us", value="score")


_SNAPSHOT_SQL = """
SELECT account_id, max(written_us) AS written_us, arg_max(score, written_us) AS score,
  max(written_us) + 86400000000 AS expire_us FROM score_log GROUP BY account_id"""


@query("score_snapshot_upsert", "score_log", _SNAPSHOT_SQL)
def score_snapshot_upsert(spark, folder):
    return _score_snapshot(spark, folder)


@query("score_lookup_ttl", "score_log ev", f"""
SELECT event_id, CASE WHEN s.expire_us IS NOT NULL AND ts_us < s.expire_us THEN s.score END AS score,
  coalesce(ts_us < s.expire_us, FALSE) AS cache_hit
FROM ev LEFT JOIN ({_SNAPSHOT_SQL}) s ON s.account_id = ev.user_id""")
def score_lookup_ttl(spark, folder):
    requests = views.events(spark, folder).select("event_id", F.col("user_id").alias("account_id"), "ts_us")
    found = snapshots.lookup_ttl(requests, _score_snapshot(spark, folder), key="account_id", value="score", now_us=F.col("ts_us"))
    return found.select("event_id", "score", "cache_hit")


def _feature_snapshot(spark, folder):
    """Feature records written at a time that follows from the account."""
    base = matrix(spark, folder)
    number = F.substring("account_id", 2, 18).cast("bigint")
    written = base.select("account_id", (number % 1000 * 1_000_000).alias("written_us"), snapshots.feature_record().alias("record"))
    return snapshots.snapshot_upsert(None, written, key="account_id", written_us="written_us", value="record", ttl_sec=500)


@query("feature_snapshot_upsert", "fm", """
SELECT account_id, CAST(substr(account_id, 2) AS BIGINT) % 1000 * 1000000 AS written_us,
  CAST(substr(account_id, 2) AS BIGINT) % 1000 * 1000000 + 500000000 AS expire_us,
  round(degree_ratio, 6) AS degree_ratio, round(total_sent_log, 6) AS total_sent_log FROM fm""")
def feature_snapshot_upsert(spark, folder):
    return _feature_snapshot(spark, folder).select(
        "account_id", "written_us", "expire_us", r("record.degree_ratio").alias("degree_ratio"),
        r("record.total_sent_log").alias("total_sent_log"),
    )


@query("feature_lookup_ttl", "fm", """
SELECT account_id, CAST(substr(account_id, 2) AS BIGINT) % 1000 + 500 > 800 AS cache_hit,
  CASE WHEN CAST(substr(account_id, 2) AS BIGINT) % 1000 + 500 > 800 THEN round(degree_ratio, 6) END AS degree_ratio FROM fm""")
def feature_lookup_ttl(spark, folder):
    requests = matrix(spark, folder).select("account_id", F.lit(800_000_000).cast("bigint").alias("now_us"))
    found = snapshots.lookup_ttl(requests, _feature_snapshot(spark, folder), key="account_id", value="record", now_us=F.col("now_us"))
    return found.select("account_id", "cache_hit", r("record.degree_ratio").alias("degree_ratio"))


@query("drift_reference_write", "scored", "SELECT count(*) AS n, round(sum(y_prob), 4) AS total FROM scored")
def drift_reference_write(spark, folder):
    path = scratch_path(spark, "drift-reference")
    files.write_drift_reference(views.scored_orders(spark, folder).select("y_prob", "amount"), path)
    return files.read_drift_reference(spark, path).agg(F.count(F.lit(1)).alias("n"), r(F.sum("y_prob"), 4).alias("total"))


@query("drift_reference_read", "scored", "SELECT y_prob, amount FROM scored")
def drift_reference_read(spark, folder):
    path = scratch_path(spark, "drift-reference")
    files.write_drift_reference(views.scored_orders(spark, folder).select("y_prob", "amount"), path)
    return files.read_drift_reference(spark, path)


@query("metrics_sink", "scored", """
SELECT segment AS model, round(avg(y_prob), 6) AS mean_score, count(*) AS n FROM scored GROUP BY segment""")
def metrics_sink(spark, folder):
    path = scratch_path(spark, "metrics")
    rows = views.scored_orders(spark, folder).groupBy(F.col("segment").alias("model")).agg(
        r(F.avg("y_prob")).alias("mean_score"), F.count(F.lit(1)).alias("n")
    )
    files.write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("payload_explode", "ptx", """
SELECT transaction_id, customer_id, merchant_id, device_id, amount, CAST(timestamp AS DOUBLE) AS timestamp, rto_flag FROM ptx""")
def payload_explode(spark, folder):
    path = scratch_path(spark, "payloads")
    names = ["transaction_id", "customer_id", "merchant_id", "device_id", "ip_id", "address_id", "promo_id",
             "bank_account_id", "amount", "timestamp", "rto_flag", "chargeback_flag"]
    documents = views.payments(spark, folder).select(
        F.array(F.struct(*names)).alias("transactions"),
        F.create_map(F.col("customer_id"), F.lit(0.5)).alias("risk_scores"),
    )
    documents.write.json(path)
    rows, _ = files.explode_payload(files.read_payload(spark, path))
    return rows.select("transaction_id", "customer_id", "merchant_id", "device_id", "amount", "timestamp", "rto_flag")


# --- transaction columns ------------------------------------------------------------------


@query("fraud_type_filter", "gtx", "SELECT type, count(*) AS n FROM gtx GROUP BY type")
def fraud_type_filter(spark, folder):
    return features.fraud_type_filter(views.transactions(spark, folder)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("type_encode", "txn", """
SELECT tx_id, CAST(CASE type WHEN 'PAYMENT' THEN 0 WHEN 'TRANSFER' THEN 1 WHEN 'CASH_OUT' THEN 2 WHEN 'DEBIT' THEN 3 WHEN 'CASH_IN' THEN 4 END AS INTEGER) AS type_encoded FROM txn""")
def type_encode(spark, folder):
    return views.transactions(spark, folder).select("tx_id", transaction.type_code(F.col("type")).alias("type_encoded"))


@query("amount_log", "txn", "SELECT tx_id, round(ln(1 + amount), 6) AS amount_log FROM txn")
def amount_log(spark, folder):
    return views.transactions(spark, folder).select("tx_id", r(transaction.amount_log(F.col("amount"))).alias("amount_log"))


@query("hour_cyclic", "txn", """
SELECT tx_id, round(sin(2 * pi() * step / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * step / 24), 6) + 0.0 AS hour_cos FROM txn""")
def hour_cyclic(spark, folder):
    # + 0.0 turns a rounded -0.0 into 0.0
    return views.transactions(spark, folder).select(
        "tx_id",
        (r(transaction.hour_sin(F.col("step"))) + 0.0).alias("hour_sin"),
        (r(transaction.hour_cos(F.col("step"))) + 0.0).alias("hour_cos"),
    )


@query("edge_features", "gtx", """
SELECT tx_id, nameOrig, nameDest, round(ln(1 + amount), 6) AS a0, round(sin(2 * pi() * step / 24), 6) + 0.0 AS a1,
  round(cos(2 * pi() * step / 24), 6) + 0.0 AS a2 FROM gtx""")
def edge_features(spark, folder):
    edges = features.fraud_type_filter(views.transactions(spark, folder)).withColumn(
        "attr", transaction.edge_vector(F.col("amount"), F.col("step"))
    )
    return edges.select("tx_id", "nameOrig", "nameDest", *[(r(F.col("attr")[i]) + 0.0).alias(f"a{i}") for i in range(3)])


@query("edge_payload_vector", "ptx", "SELECT transaction_id, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS v{i}" for i, e in enumerate(
        ["0", "amount", "CASE WHEN rto_flag = 1 THEN amount ELSE 0 END", "chargeback_flag", "rto_flag", "0", "0", "0", "0", "1", "1", "1"]
    )) + " FROM ptx")
def edge_payload_vector(spark, folder):
    vector = transaction.edge_payload_vector({
        "amount": F.col("amount"),
        "refund_amount": F.when(F.col("rto_flag") == 1, F.col("amount")).otherwise(0.0),
        "chargeback_flag": F.col("chargeback_flag"),
        "rto_flag": F.col("rto_flag"),
    })
    rows = views.payments(spark, folder).select("transaction_id", vector.alias("v"))
    return rows.select("transaction_id", *[F.col("v")[i].alias(f"v{i}") for i in range(len(EDGE_PAYLOAD_FIELDS))])


@query("tokenize_identifier", "", """
SELECT c_custkey, 'tok_' || substr(sha256('account_token_salt::' || c_name), 1, 16) AS token FROM customer""")
def tokenize_identifier(spark, folder):
    return views.table(spark, folder, "customer").select("c_custkey", transaction.tokenize_identifier(F.col("c_name")).alias("token"))


@query("nan_to_zero", "", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN 0.0 ELSE o_totalprice END AS value FROM orders""")
def nan_to_zero(spark, folder):
    key = F.col("o_orderkey") % 5
    holed = F.when(key == 0, F.lit(float("nan"))).when(key == 1, F.lit(None)).otherwise(F.col("o_totalprice"))
    return views.table(spark, folder, "orders").select("o_orderkey", transaction.nan_to_zero(holed).alias("value"))


@query("entity_id", "", """
SELECT o_orderkey, 'pay_' || substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)), 1, 14) AS payment_id FROM orders""")
def entity_id(spark, folder):
    return views.table(spark, folder, "orders").select(
        "o_orderkey", transaction.entity_id("pay", F.col("o_orderkey"), F.col("o_custkey")).alias("payment_id")
    )


_MCC_VALUES = ", ".join(f"({i}, '{m}', '{n}', {t}, {b})" for i, (m, n, t, b) in enumerate(MERCHANT_CATEGORIES))
_HASH = "(('0x' || substr(md5({0}), 1, 8))::BIGINT)"


@query("payment_method_mix", "", f"""
SELECT mcc, method, count(*) AS n, round(avg(o_totalprice / avg_ticket), 6) AS ticket_ratio FROM (
  SELECT o_orderkey, o_totalprice, o_custkey % 4 AS pos,
    CASE WHEN u < 0.68 THEN 'upi' WHEN u < 0.92 THEN 'card' ELSE 'netbanking' END AS method
  FROM (SELECT *, ({_HASH.format("'method:' || CAST(o_orderkey AS VARCHAR)")} + 0.5) / 4294967296.0 AS u FROM orders))
JOIN (VALUES {_MCC_VALUES}) m(pos, mcc, name, avg_ticket, risk_base) USING (pos) GROUP BY mcc, method""")
def payment_method_mix(spark, folder):
    categories = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(MERCHANT_CATEGORIES)], "pos int, mcc string, name string, avg_ticket double, risk_base double"
    )
    u = plant.hash_uniform("method", F.col("o_orderkey"))
    method, bound = None, 0.0
    for name, share in PAYMENT_METHODS[:-1]:
        bound = round(bound + share, 2)
        method = F.when(u < bound, name) if method is None else method.when(u < bound, name)
    tagged = views.table(spark, folder, "orders").select(
        "o_totalprice", (F.col("o_custkey") % 4).cast("int").alias("pos"), method.otherwise(PAYMENT_METHODS[-1][0]).alias("method")
    )
    # four fixed categories: always small
    return tagged.join(F.broadcast(categories), "pos").groupBy("mcc", "method").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.col("o_totalprice") / F.col("avg_ticket"))).alias("ticket_ratio")
    )


@query("method_detail", "", f"""
SELECT o_orderkey, CASE o_custkey % 3
  WHEN 0 THEN ['Google Pay','PhonePe','Paytm UPI','CRED UPI','BHIM UPI','WhatsApp Pay'][{_HASH.format("'app:' || o_orderkey")} % 6 + 1] || ' (user_' ||
    ({_HASH.format("'vpa:' || o_orderkey")} % 9000 + 1000) || ['@okhdfcbank','@okaxis','@paytm','@ybl','@ibl','@ptaxis','@apl'][{_HASH.format("'handle:' || o_orderkey")} % 7 + 1] || ')'
  WHEN 1 THEN ['RuPay','Visa','Mastercard'][{_HASH.format("'network:' || o_orderkey")} % 3 + 1] || ' •••• ' || ({_HASH.format("'card:' || o_orderkey")} % 9000 + 1000)
  ELSE 'NetBanking (' || ['HDFC','ICICI','SBI','Axis','Kotak','Punjab National Bank'][{_HASH.format("'bank:' || o_orderkey")} % 6 + 1] || ')' END AS detail FROM orders""")
def method_detail(spark, folder):
    turn = F.col("o_custkey") % 3
    method = F.when(turn == 0, "upi").when(turn == 1, "card").otherwise("netbanking")
    return views.table(spark, folder, "orders").select(
        "o_orderkey", transaction.method_detail(method, F.col("o_orderkey")).alias("detail")
    )


# --- account scores ---------------------------------------------------------------------------


_RULES_SQL = ", ".join(
    f"CASE WHEN {c} < 0 THEN '{c}:min' END" + (f", CASE WHEN {c} > 1 THEN '{c}:max' END" if c in UNIT_INTERVAL_FEATURES else "")
    for c in FEATURES if c != "balance_drain_ratio"
)


@query("validate_account_features", "fm", f"""
SELECT account_id, array_to_string(list_filter([{_RULES_SQL}], lambda v: v IS NOT NULL), ',') AS violated
FROM (SELECT * REPLACE (degree_ratio - 0.5 AS degree_ratio, night_tx_fraction * 3 AS night_tx_fraction) FROM fm)""")
def validate_account_features(spark, folder):
    """Shifted on purpose, so that both kinds of rule are broken somewhere."""
    shifted = matrix(spark, folder).withColumn("degree_ratio", F.col("degree_ratio") - 0.5).withColumn(
        "night_tx_fraction", F.col("night_tx_fraction") * 3
    )
    return shifted.select("account_id", F.array_join(scoring.violated_rules(feature_columns()), ",").alias("violated"))


@query("champion_score", "acct", "SELECT account_id, round(prob, 6) AS prob FROM acct")
def champion_score(spark, folder):
    return scored_accounts(spark, folder).select("account_id", r("prob").alias("prob"))


@query("tabular_component_score", "acct", "SELECT account_id, round(tab_logit, 6) AS logit, round(1 / (1 + exp(-tab_logit)), 6) AS score FROM acct")
def tabular_component_score(spark, folder):
    f = feature_columns()
    return matrix(spark, folder).select("account_id", r(scoring.tabular_logit(f)).alias("logit"), r(scoring.tabular_score(f)).alias("score"))


@query("graph_component_score", "acct", "SELECT account_id, round(graph_logit, 6) AS logit, round(1 / (1 + exp(-graph_logit)), 6) AS score FROM acct")
def graph_component_score(spark, folder):
    f = feature_columns()
    return matrix(spark, folder).select("account_id", r(scoring.graph_logit(f)).alias("logit"), r(scoring.graph_score(f)).alias("score"))


@query("console_rule_score", "fm", """
SELECT account_id, round(p, 6) AS prob,
  CASE WHEN p >= 0.8 THEN 'CRITICAL' WHEN p >= 0.42 THEN 'HIGH' WHEN p >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  CASE WHEN p < 0.42 THEN 'Clean Baseline' WHEN degree_ratio >= 10 AND balance_drain_ratio >= 0.8 THEN 'Promo-Abuse Ring'
    WHEN amount_spike_ratio >= 5 AND night_tx_fraction >= 0.5 THEN 'Account-Takeover Checkout Surge'
    WHEN degree_ratio >= 15 THEN 'Return-Fraud Ring' ELSE 'Chargeback Collusion Cluster' END AS ring
FROM (SELECT *, greatest(0.01, least(0.99, 1 / (1 + exp(-(-3.8
    + CASE WHEN balance_drain_ratio > 0.8 THEN 3.0 ELSE -1.0 END + CASE WHEN degree_ratio > 4 THEN 2.5 ELSE -0.8 END
    + CASE WHEN night_tx_fraction > 0.5 THEN 1.5 ELSE 0 END + CASE WHEN amount_spike_ratio > 3 THEN 1.8 ELSE 0 END
    - CASE WHEN local_clustering_coefficient > 0.1 THEN 2.0 ELSE 0 END))))) AS p FROM fm)""")
def console_rule_score(spark, folder):
    f = feature_columns()
    p = F.col("p")
    return matrix(spark, folder).withColumn("p", scoring.console_score(f)).select(
        "account_id", r(p).alias("prob"), scoring.console_tier(p).alias("tier"), scoring.console_ring_type(f, p).alias("ring")
    )


_TIER = "CASE WHEN {0} >= 0.80 THEN 'CRITICAL' WHEN {0} >= 0.50 THEN 'HIGH' WHEN {0} >= 0.20 THEN 'MEDIUM' ELSE 'LOW' END"


@query("risk_tier", "acct scored", f"""
SELECT 'account' AS what, {_TIER.format('prob')} AS tier, count(*) AS n FROM acct GROUP BY 2
UNION ALL SELECT 'order', {_TIER.format('y_prob')}, count(*) FROM scored GROUP BY 2""")
def risk_tier(spark, folder):
    def counted(df, what, p):
        return df.groupBy(scoring.risk_tier(F.col(p)).alias("tier")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "tier", "n")

    return counted(scored_accounts(spark, folder), "account", "prob").union(counted(views.scored_orders(spark, folder), "order", "y_prob"))


@query("flag_decision", "scored", "SELECT id, y_prob >= 0.42 AS is_flagged FROM scored")
def flag_decision(spark, folder):
    return views.scored_orders(spark, folder).select("id", scoring.is_flagged(F.col("y_prob")).alias("is_flagged"))


@query("nearline_blend", "acct risk_scores", """
SELECT account_id, round(CASE WHEN score IS NOT NULL THEN 0.5 * prob + 0.5 * score ELSE prob END, 6) AS fraud_probability,
  score IS NOT NULL AS cache_hit FROM acct LEFT JOIN risk_scores ON customer_id = 'c' || substr(account_id, 2)""")
def nearline_blend(spark, folder):
    cached = views.risk_scores(spark, folder).select(
        F.concat(F.lit("C"), F.substring("customer_id", 2, 20)).alias("account_id"), F.col("score").alias("cached")
    )
    return scored_accounts(spark, folder).join(cached, "account_id", "left").select(
        "account_id", r(scoring.nearline_blend(F.col("prob"), F.col("cached"))).alias("fraud_probability"),
        F.col("cached").isNotNull().alias("cache_hit"),
    )


_W = "1.27"
_ATTR = {
    "balance_drain_ratio": f"round((balance_drain_ratio - 0.35) * 0.22 / {_W} * 3.5, 4)",
    "degree_ratio": f"round((degree_ratio - 1.2) * 0.15 / {_W} * 0.4, 4)",
    "night_tx_fraction": f"round((night_tx_fraction - 0.15) * 0.11 / {_W} * 2.0, 4)",
    "amount_spike_ratio": f"round((amount_spike_ratio - 1.0) * 0.11 / {_W} * 0.8, 4)",
    "local_clustering_coefficient": f"round((0.15 - local_clustering_coefficient) * 0.06 / {_W} * 4.0, 4)",
    "tx_velocity_24h": f"round((tx_velocity_24h - 5.0) * 0.08 / {_W} * 0.05, 4)",
}


@query("linear_attribution", "fm", "SELECT account_id, " + ", ".join(f"{e} AS s_{n}" for n, e in _ATTR.items()) + " FROM fm")
def linear_attribution(spark, folder):
    terms = explain.attribution(feature_columns())
    rows = matrix(spark, folder).select("account_id", terms.alias("a"))
    return rows.select("account_id", *[F.col("a")[i]["value"].alias(f"s_{n}") for i, n in enumerate(ATTRIBUTION_TERMS)])


@query("top_contributors", "fm", """
WITH long AS (""" + " UNION ALL ".join(
    f"SELECT account_id, {i} AS pos, '{n}' AS feature, {e} AS value FROM fm" for i, (n, e) in enumerate(_ATTR.items())) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(value) DESC, pos) AS rk FROM long)
SELECT account_id, string_agg(feature, ',' ORDER BY rk) AS top_features, round(sum(value), 4) AS top_sum
FROM ranked WHERE rk <= 4 GROUP BY account_id""")
def top_contributors(spark, folder):
    top = matrix(spark, folder).select("account_id", explain.top_contributors(feature_columns(), 4).alias("t"))
    return top.select(
        "account_id", F.array_join(F.transform("t", lambda e: e["feature"]), ",").alias("top_features"),
        r(F.aggregate("t", F.lit(0.0), lambda acc, e: acc + e["value"]), 4).alias("top_sum"),
    )


@query("account_ring_typing", "ringed", "SELECT account_id, ring_type FROM ringed")
def account_ring_typing(spark, folder):
    return scored_accounts(spark, folder).select("account_id", "ring_type")


def _head(z: str) -> str:
    return f"round(greatest(0.01, least(0.99, 1 / (1 + exp(-({z}))))), 4)"


@query("sub_risk_heads", "fm", f"""
SELECT account_id, {_head('-2.5 + 3.0 * balance_drain_ratio + 0.15 * degree_ratio')} AS promo_abuse_risk,
  {_head('-3.0 + 0.2 * degree_ratio + 0.3 * amount_spike_ratio')} AS return_fraud_risk,
  {_head('-2.8 + 2.5 * fraud_type_fraction + 1.2 * night_tx_fraction')} AS chargeback_collusion_risk,
  {_head('-3.2 + 0.06 * tx_velocity_24h + 0.4 * amount_spike_ratio')} AS ato_surge_risk FROM fm""")
def sub_risk_heads(spark, folder):
    heads = scoring.sub_risks(feature_columns())
    return matrix(spark, folder).select("account_id", *[c.alias(n) for n, c in heads.items()])


@query("recommended_action", "ringed", """
SELECT account_id, CASE WHEN prob >= 0.80 THEN 'Flag for 2-Person Manual Verification (' || ring_type || ' Suspected)'
  WHEN prob >= 0.42 THEN 'Queue for Secondary Review (Elevated Risk: ' || CAST(CAST(round(prob * 100) AS INTEGER) AS VARCHAR) || '%)'
  ELSE 'Allow Transaction (Standard Clearance)' END AS action, TRUE AS human_confirmation_required FROM ringed""")
def recommended_action(spark, folder):
    return scored_accounts(spark, folder).select(
        "account_id", scoring.recommended_action(F.col("prob"), F.col("ring_type")).alias("action"),
        F.lit(True).alias("human_confirmation_required"),
    )


@query("expected_review_cost", "scored", "SELECT id, CAST(CASE WHEN y_prob >= 0.42 THEN 350 ELSE 0 END AS DOUBLE) AS expected_cost FROM scored")
def expected_review_cost(spark, folder):
    flagged = scoring.is_flagged(F.col("y_prob"))
    return views.scored_orders(spark, folder).select("id", scoring.expected_review_cost(flagged).alias("expected_cost"))


@query("investigator_briefing", "ringed", """
SELECT account_id, prob < 0.30 AS is_safe, prob >= 0.30 AND degree_ratio >= 10 AS extreme_ratio,
  prob >= 0.30 AND degree_ratio >= 4 AND degree_ratio < 10 AS asymmetric_ratio,
  prob >= 0.30 AND balance_drain_ratio >= 0.85 AS drained, prob >= 0.30 AND night_tx_fraction >= 0.60 AS night,
  prob >= 0.30 AND amount_spike_ratio >= 3 AS surge,
  prob >= 0.30 AND local_clustering_coefficient < 0.05 AND degree_ratio > 3 AS isolated FROM ringed""")
def investigator_briefing(spark, folder):
    """Which sentences hold, read from the finished text; wording is unit-tested."""
    f = feature_columns()
    text = explain.briefing(F.col("account_id"), F.col("prob"), scoring.risk_tier(F.col("prob")), f, F.col("ring_type"))
    rows = scored_accounts(spark, folder).select("account_id", text.alias("t"))
    marks = {
        "is_safe": "**Low risk (", "extreme_ratio": "hub of a star", "asymmetric_ratio": "an even flow",
        "drained": "leaves again at once", "night": "midnight and six", "surge": "the week before.", "isolated": "hardly deal with each other",
    }
    return rows.select("account_id", *[F.contains("t", F.lit(mark)).alias(name) for name, mark in marks.items()])


_CF_STEPS = [
    ("balance_drain_ratio", "least(balance_drain_ratio, 0.25)"), ("degree_ratio", "least(degree_ratio, 1.2)"),
    ("night_tx_fraction", "least(night_tx_fraction, 0.10)"), ("amount_spike_ratio", "least(amount_spike_ratio, 1.0)"),
    ("local_clustering_coefficient", "greatest(local_clustering_coefficient, 0.22)"),
]


def _score_sql(source: str) -> str:
    """The champion score in SQL over a table of features named ``source``."""
    logits = VIEWS["logits"].strip().removesuffix("FROM fm")
    return VIEWS["acct"].replace("FROM logits", f"FROM ({logits} FROM {source})")


def _cf_sql() -> str:
    ctes, replaced = [], []
    for i, (name, expr) in enumerate(_CF_STEPS, start=1):
        replaced.append(f"{expr} AS {name}")
        ctes.append(f"f{i} AS MATERIALIZED (SELECT * REPLACE ({', '.join(replaced)}) FROM fm)")
        ctes.append(f"s{i} AS MATERIALIZED ({_score_sql(f'f{i}')})")
    risky = " WHEN ".join(f"p{i} <= 0.35 THEN p{i}" for i in range(1, 5))
    stop = " WHEN ".join(f"p{i} <= 0.35 THEN {i}" for i in range(1, 5))
    moved = " + ".join(
        f"CASE WHEN stop >= {i} AND a.{n} {'<' if i == 5 else '>'} {g} THEN 1 ELSE 0 END"
        for i, (n, g) in enumerate([("balance_drain_ratio", 0.25), ("degree_ratio", 1.2), ("night_tx_fraction", 0.10),
                                    ("amount_spike_ratio", 1.0), ("local_clustering_coefficient", 0.22)], start=1)
    )
    joins = " ".join(f"JOIN (SELECT account_id, prob AS p{i} FROM s{i}) t{i} USING (account_id)" for i in range(1, 6))
    return f"""WITH {', '.join(ctes)}
SELECT account_id, a.prob > 0.35 AS is_flagged, round(CASE WHEN a.prob <= 0.35 THEN a.prob WHEN {risky} ELSE p5 END, 4) AS counterfactual_probability,
  CAST(CASE WHEN a.prob <= 0.35 THEN 0 ELSE {moved} END AS INTEGER) AS n_changes
FROM (SELECT *, CASE WHEN {stop} ELSE 5 END AS stop FROM acct {joins}) a"""


@query("counterfactual", "acct", _cf_sql())
def counterfactual(spark, folder):
    rows = review.with_counterfactual(scored_accounts(spark, folder), name="c")
    return rows.select(
        "account_id", "c.is_flagged", r("c.counterfactual_probability", 4).alias("counterfactual_probability"),
        F.size("c.changes_required").alias("n_changes"),
    )


@query("account_review", "ringed risk_scores", """
WITH b AS (SELECT r.* REPLACE (CASE WHEN score IS NOT NULL THEN 0.5 * prob + 0.5 * score ELSE prob END AS prob), score
  FROM ringed r LEFT JOIN risk_scores ON customer_id = 'c' || substr(account_id, 2))
SELECT account_id, round(prob, 6) AS fraud_probability, prob >= 0.42 AS is_flagged,
  CASE WHEN prob >= 0.80 THEN 'CRITICAL' WHEN prob >= 0.50 THEN 'HIGH' WHEN prob >= 0.20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  score IS NOT NULL AS cache_hit, score AS nearline_score, CAST(CASE WHEN prob >= 0.42 THEN 350 ELSE 0 END AS DOUBLE) AS expected_cost,
  prob > 0.35 AS needs_change, greatest(0.01, least(0.99, round(1 / (1 + exp(-(-2.5 + 3.0 * balance_drain_ratio + 0.15 * degree_ratio))), 4))) AS promo_abuse_risk,
  CAST(0.0083 AS DOUBLE) AS theoretical_bayes_threshold FROM b""")
def account_review(spark, folder):
    """The whole review record; its flat fields are compared, nested ones have own queries."""
    nearline = views.risk_scores(spark, folder).select(
        F.concat(F.lit("C"), F.substring("customer_id", 2, 20)).alias("account_id"), "score"
    )
    return review.review_accounts(matrix(spark, folder), nearline).select(
        "account_id", "fraud_probability", "is_flagged", "risk_tier", "cache_hit", "nearline_score", "expected_cost",
        F.col("counterfactual.is_flagged").alias("needs_change"), "sub_risks.promo_abuse_risk", "theoretical_bayes_threshold",
    )


# --- probability and vectors ----------------------------------------------------------------------


@query("prior_correction", "scored", """
SELECT id, round(o / (1 + o), 8) AS corrected FROM (
  SELECT id, p / (1 - p) * (0.0013 / (1 - 0.0013)) / (pi / (1 - pi)) AS o FROM (
    SELECT id, greatest(1e-7, least(1 - 1e-7, y_prob)) AS p, avg(y_true) OVER () AS pi FROM scored))""")
def prior_correction(spark, folder):
    scored = views.scored_orders(spark, folder)
    rate = scored.agg(F.avg("y_true")).scalar()
    return scored.select("id", F.round(probability.prior_correction(F.col("y_prob"), rate), 8).alias("corrected"))


@query("bayes_threshold", "", """
SELECT o_orderkey, round(350.0 / (350.0 + o_totalprice), 8) AS threshold, round(350.0 / 42350.0, 6) AS default_threshold FROM orders""")
def bayes_threshold(spark, folder):
    """Per order, its own amount standing as the loss; next to the default threshold."""
    own = probability.bayes_threshold(350.0, F.col("o_totalprice"))
    return views.table(spark, folder, "orders").select(
        "o_orderkey", F.round(own, 8).alias("threshold"), F.round(probability.bayes_threshold(), 6).alias("default_threshold")
    )


@query("prob_to_logit", "scored", "SELECT id, round(ln(greatest(1e-6, least(1 - 1e-6, y_prob)) / (1 - greatest(1e-6, least(1 - 1e-6, y_prob)))), 6) AS logit FROM scored")
def prob_to_logit(spark, folder):
    return views.scored_orders(spark, folder).select("id", r(probability.prob_to_logit(F.col("y_prob"))).alias("logit"))


@query("focal_loss", "scored", """
SELECT round(avg(l), 8) AS mean_loss, round(sum(l), 4) AS sum_loss FROM (
  SELECT 0.5 * power(CASE WHEN y_true = 1 THEN 1 - y_prob ELSE y_prob END, 2)
    * -ln(CASE WHEN y_true = 1 THEN y_prob ELSE 1 - y_prob END) AS l FROM scored)""")
def focal_loss(spark, folder):
    loss = probability.focal_loss(probability.prob_to_logit(F.col("y_prob")), F.col("y_true"))
    return views.scored_orders(spark, folder).agg(r(F.avg(loss), 8).alias("mean_loss"), r(F.sum(loss), 4).alias("sum_loss"))


@query("l2_normalize", "vlong", """
SELECT id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) + 0.0 AS x FROM vlong""")
def l2_normalize(spark, folder):
    # a second scaling by 3 makes the input visibly longer than one
    rows = views.vectors(spark, folder).select("id", vectors.l2_normalize(vectors.scale(F.col("vec"), F.lit(3.0))).alias("v"))
    return rows.select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("bigint").alias("pos"), (r("x") + 0.0).alias("x"))


@query("cosine_similarity", "vecs emb_edges", """
SELECT src, dst, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity
FROM emb_edges JOIN vecs a ON a.id = src JOIN vecs b ON b.id = dst""")
def cosine_similarity(spark, folder):
    sims = propagate.edge_similarity(views.vectors(spark, folder), views.vector_edges(spark, folder))
    return sims.select("src", "dst", r("similarity").alias("similarity"))


@query("feature_json", "fm", "SELECT account_id, round(pagerank, 8) AS pagerank, round(total_sent_log, 6) AS total_sent_log, k_core_number FROM fm")
def feature_json(spark, folder):
    text = matrix(spark, folder).select("account_id", snapshots.feature_json().alias("j"))
    parsed = text.select("account_id", snapshots.parse_feature_json(F.col("j")).alias("f"))
    return parsed.select("account_id", r("f.pagerank", 8).alias("pagerank"), r("f.total_sent_log").alias("total_sent_log"), "f.k_core_number")
