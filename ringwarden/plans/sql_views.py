"""The input views and shared steps in plain SQL, for checking results.

Written independently of the DataFrame code: PageRank and core numbers are
unrolled rounds, components a recursive reachability query.
"""

from __future__ import annotations

import re

from ..constants import FEATURES

PAGERANK_ROUNDS = 20
CORE_ROUNDS = 15

_DAY = "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"

VIEWS: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def _view(name: str, body: str, *needs: str) -> None:
    VIEWS[name], NEEDS[name] = body, needs


_view("txn", f"""
SELECT tx_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest, newbalanceDest,
  CASE WHEN type IN ('TRANSFER','CASH_OUT') AND st = 'F' AND amount > 400000 THEN 1 ELSE 0 END AS isFraud,
  0 AS isFlaggedFraud
FROM (
  SELECT o_orderkey AS tx_id,
    CAST(({_DAY} % 31) * 24 + o_orderkey % 24 AS INTEGER) AS step,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
      WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'DEBIT' ELSE 'CASH_IN' END AS type,
    o_totalprice AS amount, o_orderstatus AS st,
    'C' || CAST(o_custkey AS VARCHAR) AS nameOrig,
    greatest(c_acctbal, 0.0) * 100 + o_totalprice AS oldbalanceOrg,
    greatest(c_acctbal, 0.0) * 100 AS newbalanceOrig,
    'C' || CAST(pk % n AS VARCHAR) AS nameDest,
    0.0 AS oldbalanceDest, o_totalprice AS newbalanceDest
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
  CROSS JOIN (SELECT count(*) AS n FROM customer) nc
  WHERE o_custkey <> pk % n
) b""")

_view("ptx", f"""
SELECT 't' || CAST(o_orderkey AS VARCHAR) AS transaction_id, 'c' || CAST(o_custkey AS VARCHAR) AS customer_id,
  'm' || CAST(sk AS VARCHAR) AS merchant_id,
  CASE WHEN o_custkey % 10 < 3 AND o_orderkey % 4 = 1 THEN 'dev_' || CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS VARCHAR) END AS device_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'ip_' || CAST(CAST(floor(o_custkey / 4) AS BIGINT) AS VARCHAR) END AS ip_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'addr_' || CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS VARCHAR) END AS address_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'promo_' || CAST(CAST(floor(o_orderkey / 500) AS BIGINT) AS VARCHAR) END AS promo_id,
  CASE WHEN o_orderkey % 13 = 0 THEN 'bank_' || CAST(o_custkey AS VARCHAR) END AS bank_account_id,
  o_totalprice AS amount,
  CAST({_DAY} % 31 AS BIGINT) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey * 37) % 3600 AS timestamp,
  CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS rto_flag,
  CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS chargeback_flag
FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey""")

_view("scored", """
SELECT o_orderkey AS id,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 AND o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS y_true,
  round(1.0 / (1.0 + exp(-(-5.0 + 6.0 * o_totalprice / 500000.0
    + (CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) + 0.15 * (o_orderkey % 7)))), 6) AS y_prob,
  o_totalprice AS amount, o_orderpriority AS segment FROM orders""")

_view("risk_scores", """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS customer_id, CAST((c_custkey * 37) % 100 AS DOUBLE) / 100.0 AS score
FROM customer WHERE c_custkey % 5 <> 4""")

_view("gt_members", """
SELECT 'gt_' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS VARCHAR) AS ring_id,
  'c' || CAST(c_custkey AS VARCHAR) AS customer_id, CAST(86400 AS BIGINT) AS start_timestamp
FROM customer WHERE c_custkey % 30 < 3""")

_view("ev", """
SELECT event_id, user_id, ts, epoch_us(ts) AS ts_us, event_type, value,
  'dev_' || json_extract_string(props, '$.k') AS device_id FROM events""")

_view("score_log", """
SELECT user_id AS account_id, ts AS written_at, ts_us AS written_us, round(value / 600.0, 6) AS score
FROM ev WHERE event_type = 'view'""", "ev")

_view("vecs", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings")
_view("vlong", "SELECT id, unnest(range(0, 64)) AS pos, unnest(vec) AS x FROM vecs", "vecs")
_view("emb_edges", """
SELECT DISTINCT src, dst FROM (
  SELECT vec_id AS src, (vec_id * 7 + 3) % n AS dst FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) a
  UNION ALL SELECT vec_id, (vec_id * 13 + 5) % n FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM embeddings) b)
WHERE src <> dst""")

# --- account graph ---------------------------------------------------------------
_view("gtx", "SELECT * FROM txn WHERE type IN ('TRANSFER','CASH_OUT')", "txn")
_view("cedges", """
SELECT nameOrig AS src, nameDest AS dst, ln(1 + arg_max(amount, step * 1000000000000 + tx_id)) AS weight,
  max(step) AS step FROM gtx WHERE nameOrig <> nameDest GROUP BY 1, 2""", "gtx")
_view("gnodes", "SELECT src AS id FROM cedges UNION SELECT dst FROM cedges", "cedges")
_view("uedges", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM cedges WHERE src <> dst", "cedges")
_view("ulinks", "SELECT a AS node, b AS neighbor FROM uedges UNION ALL SELECT b, a FROM uedges", "uedges")
_view("deg", """
SELECT id, CAST(coalesce(i, 0) AS DOUBLE) AS in_degree, CAST(coalesce(o, 0) AS DOUBLE) AS out_degree,
  CAST(coalesce(o, 0) AS DOUBLE) / (coalesce(i, 0) + 1) AS degree_ratio
FROM gnodes LEFT JOIN (SELECT src, count(*) AS o FROM cedges GROUP BY 1) ON src = id
LEFT JOIN (SELECT dst, count(*) AS i FROM cedges GROUP BY 1) ON dst = id""", "gnodes", "cedges")

_view("shares", """
SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM cedges""", "cedges")
_view("pr_0", "SELECT id, 1.0 / (SELECT count(*) FROM gnodes) AS r FROM gnodes", "gnodes")
for _i in range(1, PAGERANK_ROUNDS + 1):
    _view(f"pr_{_i}", f"""
SELECT g.id, 0.15 / n.n + 0.85 * (coalesce(s.s, 0) + d.d / n.n) AS r
FROM gnodes g
CROSS JOIN (SELECT count(*) AS n FROM gnodes) n
CROSS JOIN (SELECT coalesce(sum(r), 0) AS d FROM pr_{_i - 1} WHERE id NOT IN (SELECT src FROM shares)) d
LEFT JOIN (SELECT dst, sum(share * r) AS s FROM shares JOIN pr_{_i - 1} ON src = id GROUP BY dst) s ON s.dst = g.id""",
          f"pr_{_i - 1}", "shares", "gnodes")
_view("pr", f"SELECT id, r AS pagerank FROM pr_{PAGERANK_ROUNDS}", f"pr_{PAGERANK_ROUNDS}")

_view("kc_0", "SELECT node, count(*) AS c FROM ulinks GROUP BY node", "ulinks")
for _i in range(1, CORE_ROUNDS + 1):
    _view(f"kc_{_i}", f"""
SELECT node, max(least(c, k)) AS c FROM (
  SELECT l.node, v.c, row_number() OVER (PARTITION BY l.node ORDER BY v.c DESC) AS k
  FROM ulinks l JOIN kc_{_i - 1} v ON v.node = l.neighbor) GROUP BY node""", f"kc_{_i - 1}", "ulinks")
_view("kcore", f"SELECT node AS id, CAST(c AS DOUBLE) AS k_core_number FROM kc_{CORE_ROUNDS}", f"kc_{CORE_ROUNDS}")

_view("tri", """
SELECT id, count(*) AS t FROM (
  SELECT unnest([e.a, e.b, f.b]) AS id FROM uedges e JOIN uedges f ON f.a = e.b JOIN uedges g ON g.a = e.a AND g.b = f.b)
GROUP BY id""", "uedges")
_view("clus", """
SELECT k.node AS id, coalesce(t, 0) AS triangles, k.c AS deg,
  CASE WHEN k.c < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (k.c * (k.c - 1)) END AS local_clustering_coefficient
FROM kc_0 k LEFT JOIN tri ON tri.id = k.node""", "kc_0", "tri")

# --- account features -------------------------------------------------------------
_view("tabout", """
SELECT nameOrig AS account_id, ln(1 + CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)) AS total_sent_log,
  CAST(count(*) AS DOUBLE) AS tx_count_out, CAST(count(DISTINCT nameDest) AS DOUBLE) AS unique_dest_count,
  ln(1 + CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*)) AS avg_sent_log,
  avg((oldbalanceOrg - newbalanceOrig) / (oldbalanceOrg + 1e-6)) AS balance_drain_ratio,
  avg(CASE WHEN step <= 6 THEN 1.0 ELSE 0.0 END) AS night_tx_fraction,
  avg(CASE WHEN type IN ('TRANSFER','CASH_OUT') THEN 1.0 ELSE 0.0 END) AS fraud_type_fraction
FROM txn GROUP BY nameOrig""", "txn")
_view("tabin", """
SELECT nameDest AS account_id, ln(1 + CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)) AS total_received_log,
  CAST(count(*) AS DOUBLE) AS tx_count_in, CAST(count(DISTINCT nameOrig) AS DOUBLE) AS unique_src_count,
  ln(1 + CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*)) AS avg_received_log
FROM txn GROUP BY nameDest""", "txn")
_view("tmp", """
SELECT account_id, tx_velocity_24h, tx_velocity_7d, amount_velocity_24h, amount_velocity_7d,
  amount_velocity_24h / (amount_velocity_7d + 1e-6) AS amount_spike_ratio
FROM (SELECT nameOrig AS account_id,
    CAST(count(*) FILTER (WHERE step >= t - 24) AS DOUBLE) AS tx_velocity_24h,
    CAST(count(*) FILTER (WHERE step >= t - 168) AS DOUBLE) AS tx_velocity_7d,
    ln(1 + CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE step >= t - 24), 0) AS DOUBLE)) AS amount_velocity_24h,
    ln(1 + CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE step >= t - 168), 0) AS DOUBLE)) AS amount_velocity_7d
  FROM txn CROSS JOIN (SELECT max(step) AS t FROM txn) m GROUP BY nameOrig)""", "txn")
_view("fm", "SELECT g.id AS account_id, " + ", ".join(f"coalesce({f}, 0.0) AS {f}" for f in FEATURES) + """
FROM gnodes g LEFT JOIN tabout o ON o.account_id = g.id LEFT JOIN tabin i ON i.account_id = g.id
LEFT JOIN tmp t ON t.account_id = g.id LEFT JOIN deg d ON d.id = g.id LEFT JOIN pr ON pr.id = g.id
LEFT JOIN kcore k ON k.id = g.id LEFT JOIN clus c ON c.id = g.id""",
      "gnodes", "tabout", "tabin", "tmp", "deg", "pr", "kcore", "clus")

# --- account scores -----------------------------------------------------------------
_view("logits", """
SELECT *, -4.0
  + CASE WHEN balance_drain_ratio > 0.80 THEN 2.4 + (balance_drain_ratio - 0.80) * 7.5
         WHEN balance_drain_ratio > 0.40 THEN 0.8 + (balance_drain_ratio - 0.40) * 2.5
         ELSE -1.2 * (0.40 - balance_drain_ratio) END
  + (night_tx_fraction - 0.15) * 2.0 + (fraud_type_fraction - 0.20) * 2.2
  + CASE WHEN amount_spike_ratio > 2.0 THEN least(2.5, (amount_spike_ratio - 2.0) * 0.45) ELSE 0 END
  + CASE WHEN tx_velocity_24h > 20.0 THEN least(1.8, (tx_velocity_24h - 20.0) * 0.025) ELSE 0 END AS tab_logit,
  -3.8
  + CASE WHEN degree_ratio > 4.0 THEN least(3.2, 1.0 + log2(degree_ratio / 4.0) * 1.1)
         WHEN degree_ratio > 1.5 THEN 0.4 * (degree_ratio - 1.5) ELSE -0.8 * (1.5 - degree_ratio) END
  + CASE WHEN local_clustering_coefficient > 0.12 THEN -2.4 * least(1.0, (local_clustering_coefficient - 0.12) / 0.25 + 0.3)
         WHEN local_clustering_coefficient < 0.04 THEN 0.9 * (1.0 - local_clustering_coefficient / 0.04) ELSE 0 END
  + CASE WHEN pagerank > 0.005 AND degree_ratio > 5.0 THEN 1.2
         WHEN pagerank > 0.005 AND degree_ratio < 1.0 THEN -0.8 ELSE 0 END
  + CASE WHEN k_core_number >= 10 AND local_clustering_coefficient > 0.15 THEN -0.6
         WHEN k_core_number >= 8 AND degree_ratio > 10.0 THEN 0.8 ELSE 0 END AS graph_logit,
  balance_drain_ratio <= 0.35 AND (local_clustering_coefficient >= 0.15 OR degree_ratio <= 0.8)
    AND night_tx_fraction <= 0.30 AND amount_spike_ratio <= 2.2 AS merchant
FROM fm""", "fm")
_view("acct", """
SELECT *, greatest(0.01, least(0.99, 1.0 / (1.0 + exp(-(
    0.52 * CASE WHEN merchant THEN least(tab_logit, -2.6) ELSE tab_logit END
  + 0.48 * CASE WHEN merchant THEN least(graph_logit, -2.8) ELSE graph_logit END))))) AS prob
FROM logits""", "logits")
_view("ringed", """
SELECT *, CASE WHEN prob < 0.30 THEN 'Clean Baseline'
  WHEN degree_ratio >= 10.0 AND balance_drain_ratio >= 0.80 THEN 'Promo-Abuse Ring'
  WHEN amount_spike_ratio >= 5.0 AND night_tx_fraction >= 0.50 THEN 'Account-Takeover Checkout Surge'
  WHEN degree_ratio >= 15.0 THEN 'Return-Fraud Ring'
  WHEN balance_drain_ratio >= 0.85 AND amount_spike_ratio >= 2.5 THEN 'Chargeback Collusion Cluster'
  ELSE 'Merchant Abuse Ring' END AS ring_type FROM acct""", "acct")
_view("labels_of", """
SELECT g.id AS account_id, CASE WHEN f.a IS NULL THEN 0 ELSE 1 END AS label
FROM gnodes g LEFT JOIN (SELECT DISTINCT nameOrig AS a FROM txn WHERE isFraud = 1) f ON f.a = g.id""", "gnodes", "txn")

# --- rings ------------------------------------------------------------------------------
_view("idrows", """
SELECT DISTINCT tx, kind, value FROM (
  SELECT transaction_id AS tx, unnest(['device_id','ip_id','address_id','promo_id','bank_account_id']) AS kind,
    unnest([device_id, ip_id, address_id, promo_id, bank_account_id]) AS value FROM ptx)
WHERE value IS NOT NULL AND value <> ''""", "ptx")
_view("anchored", """
SELECT kind, value, tx, min(tx) OVER (PARTITION BY kind, value) AS anchor FROM idrows""", "idrows")
_view("txlinks", """
SELECT DISTINCT tx AS a, anchor AS b FROM anchored WHERE tx <> anchor
UNION SELECT DISTINCT anchor, tx FROM anchored WHERE tx <> anchor""", "anchored")
_view("reach", """
SELECT a AS x, b AS y FROM txlinks UNION SELECT r.x, l.b FROM reach r JOIN txlinks l ON l.a = r.y""", "txlinks")
_view("comp", "SELECT x AS transaction_id, min(y) AS component FROM reach GROUP BY x", "reach")
_view("clustered", "SELECT p.*, c.component FROM ptx p JOIN comp c USING (transaction_id)", "ptx", "comp")
_view("entities", """
SELECT DISTINCT component, kind, entity FROM (
  SELECT component, unnest(['member','merchant','device','ip','address','promo']) AS kind,
    unnest([customer_id, merchant_id, device_id, ip_id, address_id, promo_id]) AS entity FROM clustered)
WHERE entity IS NOT NULL AND entity <> ''""", "clustered")
_view("ringtime", """
SELECT component, count(*) AS transaction_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_exposure,
  CAST(min(timestamp) AS DOUBLE) AS detected_at, max(rto_flag) = 1 AS any_rto, max(chargeback_flag) = 1 AS any_cb,
  1.0 / (1.0 + ((max(timestamp) - min(timestamp)) / (count(*) - 1.0)) / 3600.0) AS sync
FROM clustered GROUP BY component""", "clustered")
_view("ringconc", """
SELECT component, CAST(sum(CAST(coalesce(score, 0.1) AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS concentration
FROM entities LEFT JOIN risk_scores ON customer_id = entity WHERE kind = 'member' GROUP BY component""",
      "entities", "risk_scores")
_view("ringcount", "SELECT component, " + ", ".join(
    f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("member", "merchant", "device", "ip", "address", "promo")
) + " FROM entities GROUP BY component", "entities")
_view("report", """
SELECT t.component, detected_at, n_member AS entity_count, transaction_count, n_merchant AS merchant_count,
  n_device AS device_count, n_ip AS ip_count, n_address AS address_count, n_promo AS promo_count, total_exposure,
  round(concentration, 3) AS fraud_concentration, round(sync, 3) AS temporal_synchronization_score,
  round(least(1.0, n_merchant / 3.0), 3) AS cross_merchant_connectivity,
  CASE WHEN n_promo > 0 AND n_device <= 2 THEN 'PROMO_ABUSE_SYNDICATE'
    WHEN any_rto OR n_address = 1 THEN 'RTO_RETURN_FRAUD_LOOP' WHEN any_cb THEN 'CHARGEBACK_COLLUSION_CLUSTER'
    WHEN sync > 0.8 THEN 'ATO_VELOCITY_SURGE' ELSE 'COORDINATED_MULE_RING' END AS predicted_ring_type,
  CASE WHEN concentration >= 0.70 THEN 'CRITICAL' WHEN concentration >= 0.40 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
FROM ringtime t JOIN ringcount c USING (component) JOIN ringconc r USING (component)""",
      "ringtime", "ringcount", "ringconc")
_view("matches", """
SELECT o.component, o.ring_id, overlap, overlap * 1.0 / (nd + nt - overlap) AS jaccard
FROM (SELECT component, ring_id, count(*) AS overlap FROM entities JOIN gt_members ON customer_id = entity
      WHERE kind = 'member' GROUP BY 1, 2) o
JOIN (SELECT component, count(*) AS nd FROM entities WHERE kind = 'member' GROUP BY 1) d ON d.component = o.component
JOIN (SELECT ring_id, count(DISTINCT customer_id) AS nt FROM gt_members GROUP BY 1) t ON t.ring_id = o.ring_id
WHERE overlap * 1.0 / (nd + nt - overlap) >= 0.2""", "entities", "gt_members")

# --- typed graph ----------------------------------------------------------------------
_TOKEN = "'tok_' || substr(sha256('account_token_salt::' || {0}), 1, 16)"
_view("hedges", f"""
SELECT src_type, {_TOKEN.format('src_raw')} AS src_id, relation, dst_type, {_TOKEN.format('dst_raw')} AS dst_id, timestamp, amount FROM (
  SELECT 'customer' AS src_type, customer_id AS src_raw, 'PLACED' AS relation, 'transaction' AS dst_type, transaction_id AS dst_raw, timestamp, amount FROM ptx
  UNION ALL SELECT 'transaction', transaction_id, 'BELONGS_TO', 'merchant', merchant_id, timestamp, amount FROM ptx
  UNION ALL SELECT 'transaction', transaction_id, 'USED_DEVICE', 'device', device_id, timestamp, amount FROM ptx
  UNION ALL SELECT 'transaction', transaction_id, 'FROM_IP', 'ip', ip_id, timestamp, amount FROM ptx
  UNION ALL SELECT 'transaction', transaction_id, 'DELIVERED_TO', 'address', address_id, timestamp, amount FROM ptx
  UNION ALL SELECT 'transaction', transaction_id, 'USED_PROMO', 'promo', promo_id, timestamp, amount FROM ptx
  UNION ALL SELECT 'customer', customer_id, 'HAS_BANK_ACCOUNT', 'bank_account', bank_account_id, timestamp, amount FROM ptx
  UNION ALL SELECT 'transaction', transaction_id, 'GENERATED_REFUND', 'refund', 'ref_' || transaction_id, timestamp, amount FROM ptx WHERE rto_flag = 1
  UNION ALL SELECT 'transaction', transaction_id, 'GENERATED_CHARGEBACK', 'chargeback', 'cb_' || transaction_id, timestamp, amount FROM ptx WHERE chargeback_flag = 1)
WHERE src_raw IS NOT NULL AND dst_raw IS NOT NULL""", "ptx")
_view("hnodes", """
SELECT DISTINCT node_type, node_id FROM (
  SELECT src_type AS node_type, src_id AS node_id FROM hedges UNION ALL SELECT dst_type, dst_id FROM hedges)""", "hedges")

# --- score ladders ----------------------------------------------------------------------
_view("ladder", """
SELECT y_prob, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n
FROM (SELECT y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM scored GROUP BY y_prob)
WINDOW w AS (ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING)""", "scored")

_RECURSIVE = {"reach"}


def _ordered(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for needed in NEEDS[name]:
            visit(needed)
        seen.append(name)

    for name in names:
        visit(name)
    return seen


def compose(views: list[str], body: str, replaced: dict[str, str] | None = None) -> str:
    """``body`` with the views it needs in front as common table expressions.

    ``replaced`` gives another text for a view; ``{original}`` in it is the usual one.
    """
    texts = VIEWS | {k: v.replace("{original}", VIEWS[k]) for k, v in (replaced or {}).items()}
    names = _ordered(views)
    text = body.strip()
    if not names:
        return text
    parts = []
    for name in names:
        keyword = "" if name in _RECURSIVE else "MATERIALIZED "
        parts.append(f"{name} AS {keyword}({texts[name].strip()})")
    own = re.match(r"(?is)with\s+(?:recursive\s+)?", text)
    rest = ", " + text[own.end():] if own else "\n" + text
    return "WITH RECURSIVE " + ",\n".join(parts) + rest
