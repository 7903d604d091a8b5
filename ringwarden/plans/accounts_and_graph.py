"""Queries: joins, account aggregates, graph operators, time, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES, NEIGHBOR_CAPS, STRUCTURAL_FEATURES, TABULAR_FEATURES, TEMPORAL_FEATURES
from ..functions import vectors as vec
from ..functions.scoring import risk_tier
from ..operators import features, graph, hetero, metrics, propagate, temporal
from ..sources import views
from .inputs import account_edges, build_matrix, r, rounded, scored_accounts
from .registry import query
from .sql_views import PAGERANK_ROUNDS

CUTOFF = 371


def txn_of(spark, folder):
    return views.transactions(spark, folder)


# --- flagship -----------------------------------------------------------------------------


@query("alert_queue", "ringed", """
SELECT account_id, round(prob, 6) AS fraud_probability,
  CASE WHEN prob >= 0.80 THEN 'CRITICAL' WHEN prob >= 0.50 THEN 'HIGH' WHEN prob >= 0.20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  ring_type FROM ringed ORDER BY round(prob, 9) DESC, account_id LIMIT 100""")
def alert_queue(spark, folder):
    """Which accounts to review first: features, score, tier, ring type, top 100."""
    queue = metrics.alert_queue(
        scored_accounts(spark, folder).withColumn("key", F.round("prob", 9)), score="key", tie="account_id", budget=100
    )
    return queue.select(
        "account_id", r("prob").alias("fraud_probability"), risk_tier(F.col("prob")).alias("risk_tier"), "ring_type"
    )


# --- joins -----------------------------------------------------------------------------------


@query("all_accounts", "txn", "SELECT nameOrig AS account_id FROM txn UNION SELECT nameDest FROM txn")
def all_accounts(spark, folder):
    return features.all_accounts(txn_of(spark, folder))


@query("account_index", "txn", """
SELECT account_id, row_number() OVER (ORDER BY account_id) - 1 AS node_idx
FROM (SELECT nameOrig AS account_id FROM txn UNION SELECT nameDest FROM txn)""")
def account_index(spark, folder):
    return features.account_index(txn_of(spark, folder))


@query("known_account_semi", "txn gnodes", """
SELECT nameOrig AS account_id, count(*) AS n FROM txn WHERE nameOrig IN (SELECT id FROM gnodes) GROUP BY 1""")
def known_account_semi(spark, folder):
    txn = txn_of(spark, folder)
    nodes = features.all_accounts(features.fraud_type_filter(txn))
    sent = txn.groupBy(F.col("nameOrig").alias("account_id")).agg(F.count(F.lit(1)).alias("n"))
    return features.known_accounts(sent, nodes)


@query("unknown_account_anti", "txn", f"""
SELECT DISTINCT account_id FROM (SELECT nameOrig AS account_id FROM gt UNION ALL SELECT nameDest FROM gt)
WHERE account_id NOT IN (SELECT nameOrig FROM lt UNION ALL SELECT nameDest FROM lt)""".replace(
    "SELECT DISTINCT", f"WITH gt AS (SELECT * FROM txn WHERE step > {CUTOFF}), lt AS (SELECT * FROM txn WHERE step <= {CUTOFF}) SELECT DISTINCT", 1))
def unknown_account_anti(spark, folder):
    txn = txn_of(spark, folder)
    return features.unknown_accounts(
        features.all_accounts(txn.where(F.col("step") > CUTOFF)), features.all_accounts(features.snapshot(txn, CUTOFF))
    )


def _rounded_features(names):
    return ", ".join(f"round({n}, {9 if n == 'pagerank' else 6}) AS {n}" for n in names)


def _round_features(df, names):
    return df.select("account_id", *[r(n, 9 if n == "pagerank" else 6).alias(n) for n in names])


@query("feature_matrix", "fm", f"SELECT account_id, {_rounded_features(FEATURES)} FROM fm")
def feature_matrix(spark, folder):
    """Built from scratch, not read from the cache."""
    return _round_features(build_matrix(spark, folder), FEATURES)


@query("label_join", "labels_of", "SELECT account_id, label FROM labels_of")
def label_join(spark, folder):
    txn = txn_of(spark, folder)
    return features.label_join(features.all_accounts(features.fraud_type_filter(txn)), txn)


@query("node_last_step", "txn gnodes", """
SELECT id AS account_id, coalesce(s, 0) AS last_step FROM gnodes
LEFT JOIN (SELECT nameOrig, max(step) AS s FROM txn GROUP BY 1) ON nameOrig = id""")
def node_last_step(spark, folder):
    txn = txn_of(spark, folder)
    return features.node_last_step(features.all_accounts(features.fraud_type_filter(txn)), txn)


@query("endpoint_gather", "vecs emb_edges", """
SELECT src, dst, round(a.vec[1], 6) AS src_first, round(b.vec[64], 6) AS dst_last FROM emb_edges JOIN vecs a ON a.id = src JOIN vecs b ON b.id = dst""")
def endpoint_gather(spark, folder):
    met = propagate.gather(views.vector_edges(spark, folder), views.vectors(spark, folder))
    return met.select("src", "dst", r(F.col("x_src")[0]).alias("src_first"), r(F.col("x_dst")[63]).alias("dst_last"))


@query("nearline_asof_score", "ev score_log", """
SELECT event_id, user_id, CASE WHEN hit THEN score END AS nearline_score, hit AS cache_hit FROM (
  SELECT e.event_id, e.user_id, s.score, coalesce(e.ts_us - s.written_us < 86400000000, FALSE) AS hit
  FROM ev e ASOF LEFT JOIN score_log s ON e.user_id = s.account_id AND e.ts_us >= s.written_us)""")
def nearline_asof_score(spark, folder):
    return temporal.asof_score(
        views.events(spark, folder), views.score_log(spark, folder), key="user_id", event_id="event_id", event_us="ts_us",
        score_key="account_id", written_us="written_us", score="score",
    )


# --- account aggregates ---------------------------------------------------------------------


@query("out_account_features", "tabout", f"""
SELECT account_id, {_rounded_features(('total_sent_log', 'tx_count_out', 'unique_dest_count', 'avg_sent_log', 'balance_drain_ratio', 'night_tx_fraction', 'fraud_type_fraction'))} FROM tabout""")
def out_account_features(spark, folder):
    out = features.out_account_features(txn_of(spark, folder))
    return _round_features(out, [c for c in out.columns if c != "account_id"])


@query("in_account_features", "tabin", f"""
SELECT account_id, {_rounded_features(('total_received_log', 'tx_count_in', 'unique_src_count', 'avg_received_log'))} FROM tabin""")
def in_account_features(spark, folder):
    got = features.in_account_features(txn_of(spark, folder))
    return _round_features(got, [c for c in got.columns if c != "account_id"])


@query("tabular_features", "tabout tabin", "SELECT coalesce(o.account_id, i.account_id) AS account_id, " + ", ".join(
    f"round(coalesce({n}, 0.0), 6) AS {n}" for n in TABULAR_FEATURES) + " FROM tabout o FULL JOIN tabin i ON o.account_id = i.account_id")
def tabular_features(spark, folder):
    return _round_features(features.tabular_features(txn_of(spark, folder)), TABULAR_FEATURES)


@query("edge_collapse", "cedges", "SELECT src, dst, round(weight, 6) AS weight, step FROM cedges")
def edge_collapse(spark, folder):
    edges = graph.edge_collapse(features.fraud_type_filter(txn_of(spark, folder)))
    return edges.select("src", "dst", r("weight").alias("weight"), "step")


@query("degree", "deg", "SELECT id, in_degree, out_degree, round(degree_ratio, 6) AS degree_ratio FROM deg")
def degree(spark, folder):
    edges = graph.edge_collapse(features.fraud_type_filter(txn_of(spark, folder)))
    return rounded(graph.degree(edges), "degree_ratio")


@query("account_labels", "txn", "SELECT nameOrig AS account_id, CAST(max(isFraud) AS INTEGER) AS label FROM txn GROUP BY 1")
def account_labels(spark, folder):
    return features.account_labels(txn_of(spark, folder))


@query("graph_stats", "gtx labels_of", """
SELECT count(*) AS n_nodes, (SELECT count(*) FROM gtx) AS n_edges, CAST(sum(label) AS BIGINT) AS n_fraud_nodes,
  round(avg(label), 6) AS fraud_rate, (SELECT CAST(sum(isFraud) AS BIGINT) FROM gtx) AS n_fraud_edges FROM labels_of""")
def graph_stats(spark, folder):
    return rounded(features.graph_stats(txn_of(spark, folder)), "fraud_rate")


@query("hetero_nodes", "hnodes", "SELECT node_type, node_id FROM hnodes")
def hetero_nodes(spark, folder):
    return hetero.hetero_nodes(hetero.hetero_edges(views.payments(spark, folder)))


@query("hetero_edges", "hedges", "SELECT src_type, src_id, relation, dst_type, dst_id, timestamp, amount FROM hedges")
def hetero_edges(spark, folder):
    return hetero.hetero_edges(views.payments(spark, folder))


@query("hetero_stats", "hnodes hedges ptx gt_members", """
SELECT 'nodes' AS what, coalesce(node_type, 'TOTAL') AS name, CAST(count(*) AS DOUBLE) AS n FROM hnodes GROUP BY ROLLUP (node_type)
UNION ALL SELECT 'edges', coalesce(relation, 'TOTAL'), CAST(count(*) AS DOUBLE) FROM hedges GROUP BY ROLLUP (relation)
UNION ALL SELECT 'rings', 'count', CAST(count(DISTINCT ring_id) AS DOUBLE) FROM gt_members
UNION ALL SELECT 'rings', 'volume', CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM ptx WHERE customer_id IN (SELECT customer_id FROM gt_members)""")
def hetero_stats(spark, folder):
    payments = views.payments(spark, folder)
    counts = hetero.hetero_stats(hetero.hetero_edges(payments)).withColumn("n", F.col("n").cast("double"))
    volume = hetero.ring_volume(views.true_ring_members(spark, folder), payments)
    rings = volume.select(F.explode(F.array(
        F.struct(F.lit("rings").alias("what"), F.lit("count").alias("name"), F.col("total_rings").cast("double").alias("n")),
        F.struct(F.lit("rings").alias("what"), F.lit("volume").alias("name"), F.col("total_fraud_volume").cast("double").alias("n")),
    )).alias("e")).select("e.*")
    return counts.union(rings)


# --- structure --------------------------------------------------------------------------------


@query("pagerank", "pr", "SELECT id, round(pagerank, 9) AS pagerank FROM pr")
def pagerank(spark, folder):
    return rounded(graph.pagerank(account_edges(spark, folder), max_iter=PAGERANK_ROUNDS, tol=None), "pagerank", digits=9)


@query("k_core", "kcore", "SELECT id, k_core_number FROM kcore")
def k_core(spark, folder):
    return graph.k_core(account_edges(spark, folder))


@query("clustering_coefficient", "clus", "SELECT id, round(local_clustering_coefficient, 6) AS local_clustering_coefficient FROM clus")
def clustering_coefficient(spark, folder):
    return rounded(graph.clustering_coefficient(account_edges(spark, folder)), "local_clustering_coefficient")


@query("triangle_count", "clus", "SELECT id, triangles, deg FROM clus")
def triangle_count(spark, folder):
    return graph.triangle_count(account_edges(spark, folder))


@query("undirected_edges", "uedges", "SELECT a, b FROM uedges")
def undirected_edges(spark, folder):
    return graph.undirected_edges(graph.edge_collapse(features.fraud_type_filter(txn_of(spark, folder))))


@query("structural_features", "fm", f"SELECT account_id, {_rounded_features(STRUCTURAL_FEATURES)} FROM fm")
def structural_features(spark, folder):
    got = graph.structural_features(account_edges(spark, folder), max_iter=PAGERANK_ROUNDS, tol=None)
    return _round_features(got, STRUCTURAL_FEATURES)


_SEEDS = "(SELECT account_id AS seed FROM ringed ORDER BY round(prob, 9) DESC, account_id LIMIT 20)"


@query("two_hop_subgraph", "ringed cedges", f"""
WITH seeds AS MATERIALIZED {_SEEDS},
near AS (SELECT seed, src AS id FROM seeds JOIN cedges ON src = seed OR dst = seed UNION SELECT seed, dst FROM seeds JOIN cedges ON src = seed OR dst = seed UNION SELECT seed, seed FROM seeds)
SELECT DISTINCT seed, src, dst FROM near JOIN cedges ON (src = id OR dst = id) WHERE weight > 12.0""")
def two_hop_subgraph(spark, folder):
    seeds = graph.top_scored(
        scored_accounts(spark, folder).select(F.col("account_id").alias("id"), F.round("prob", 9).alias("p")), score="p", tie="id", k=20
    ).select("id")
    return graph.two_hop_subgraph(account_edges(spark, folder), seeds, weight="weight", min_weight=12.0)


@query("topk_frauds_to_explain", "acct", "SELECT account_id, round(prob, 6) AS prob FROM acct ORDER BY round(prob, 9) DESC, account_id LIMIT 5")
def topk_frauds_to_explain(spark, folder):
    rows = scored_accounts(spark, folder).select("account_id", F.round("prob", 9).alias("prob"))
    return rounded(graph.top_scored(rows, score="prob", tie="account_id", k=5), "prob")


def _sample_sql(fanout):
    ctes, names = ["r0 AS MATERIALIZED (SELECT DISTINCT nameOrig AS id FROM txn WHERE isFraud = 1)", "f0 AS (SELECT id FROM r0)"], []
    for h, k in enumerate(fanout, start=1):
        ctes.append(f"""h{h} AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst
          ORDER BY md5(src || '|' || dst || '|' || '{h}'), src) AS k FROM cedges WHERE dst IN (SELECT id FROM f{h - 1})) WHERE k <= {k})""")
        ctes.append(f"f{h} AS MATERIALIZED (SELECT DISTINCT src AS id FROM h{h} WHERE src NOT IN (SELECT id FROM r{h - 1}))")
        ctes.append(f"r{h} AS MATERIALIZED (SELECT id FROM r{h - 1} UNION SELECT id FROM f{h})")
        names.append(f"SELECT CAST({h} AS INTEGER) AS hop, src, dst FROM h{h}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(names)}"


@query("neighbor_sample", "txn cedges", _sample_sql((25, 10, 5)))
def neighbor_sample(spark, folder):
    fraud = txn_of(spark, folder).where("isFraud = 1").select(F.col("nameOrig").alias("id"))
    return graph.neighbor_sample(account_edges(spark, folder), fraud, fanout=(25, 10, 5))


_CAP = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in NEIGHBOR_CAPS.items()) + " ELSE 12 END"


@query("neighbor_topk_cap", "hedges", f"""
SELECT relation, dst_id, src_id, neighbor_rank FROM (
  SELECT relation, dst_id, src_id, row_number() OVER (PARTITION BY relation, dst_id ORDER BY timestamp DESC, amount DESC, src_id) AS neighbor_rank FROM hedges)
WHERE neighbor_rank <= {_CAP}""")
def neighbor_topk_cap(spark, folder):
    capped = graph.neighbor_topk_cap(hetero.hetero_edges(views.payments(spark, folder)), node="dst_id", tie="src_id")
    return capped.select("relation", "dst_id", "src_id", F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"))


@query("node_memory", "ev", """
SELECT user_id, max(ts_us) AS last_update, arg_max(event_type, ts_us) AS event_type, arg_max(value, ts_us) AS value
FROM ev WHERE ts_us <= 1705276800000000 GROUP BY user_id""")
def node_memory(spark, folder):
    return graph.node_memory(
        views.events(spark, folder), node="user_id", ts="ts_us", tie="event_id", message=["event_type", "value"], until=1705276800000000
    )


@query("rapid_passthrough", "txn", """
SELECT i.account_id, i.in_step, CAST(i.a AS DOUBLE) AS amount_in, i.n AS tx_in, CAST(sum(o.a) AS DOUBLE) AS amount_out,
  CAST(sum(o.n) AS BIGINT) AS tx_out, round(CAST(sum(o.a) AS DOUBLE) / CAST(i.a AS DOUBLE), 6) AS passthrough_ratio
FROM (SELECT nameDest AS account_id, step AS in_step, sum(CAST(amount AS DECIMAL(18,2))) AS a, count(*) AS n FROM txn GROUP BY 1, 2) i
JOIN (SELECT nameOrig AS account_id, step, sum(CAST(amount AS DECIMAL(18,2))) AS a, count(*) AS n FROM txn GROUP BY 1, 2) o
  ON o.account_id = i.account_id AND o.step BETWEEN i.in_step AND i.in_step + 2 GROUP BY 1, 2, 3, 4""")
def rapid_passthrough(spark, folder):
    rows = temporal.rapid_passthrough(txn_of(spark, folder))
    return rows.select(
        "account_id", "in_step", F.col("amount_in").cast("double").alias("amount_in"), "tx_in",
        F.col("amount_out").cast("double").alias("amount_out"), "tx_out", r("passthrough_ratio").alias("passthrough_ratio"),
    )


@query("snapshot_graph", "gtx", f"""
SELECT count(*) AS n_edges, (SELECT count(*) FROM (SELECT nameOrig FROM gtx WHERE step <= {CUTOFF} UNION SELECT nameDest FROM gtx WHERE step <= {CUTOFF})) AS n_nodes
FROM (SELECT DISTINCT nameOrig, nameDest FROM gtx WHERE step <= {CUTOFF})""")
def snapshot_graph(spark, folder):
    edges = graph.edge_collapse(features.snapshot(features.fraud_type_filter(txn_of(spark, folder)), CUTOFF))
    nodes = graph.edge_nodes(edges).agg(F.count(F.lit(1))).scalar()
    return edges.agg(F.count(F.lit(1)).alias("n_edges")).select("n_edges", nodes.alias("n_nodes"))


# --- vectors over edges ------------------------------------------------------------------------


DIM = 64


def _long(df, name="vec"):
    """(id, pos, x): one row per vector position, rounded, without negative zeros."""
    rows = df.select("id", F.posexplode(name).alias("pos", "x"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), (r("x") + 0.0).alias("x"))


@query("gcn_propagate", "vlong emb_edges", """
WITH d AS (SELECT id, 1.0 + count(dst) AS d FROM (SELECT DISTINCT id FROM vlong) LEFT JOIN emb_edges ON dst = id GROUP BY id),
e AS (SELECT src, dst FROM emb_edges UNION ALL SELECT id, id FROM d)
SELECT e.dst AS id, pos, round(sum(x / sqrt(a.d * b.d)), 6) + 0.0 AS x
FROM e JOIN vlong ON vlong.id = e.src JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst GROUP BY 1, 2""")
def gcn_propagate(spark, folder):
    return _long(propagate.gcn_propagate(views.vectors(spark, folder), views.vector_edges(spark, folder), dim=DIM))


@query("sage_mean_propagate", "vlong emb_edges", """
SELECT v.id, v.pos, round(coalesce(m, 0), 6) + 0.0 AS x FROM vlong v
LEFT JOIN (SELECT dst, pos, avg(x) AS m FROM emb_edges JOIN vlong ON id = src GROUP BY 1, 2) n ON n.dst = v.id AND n.pos = v.pos""")
def sage_mean_propagate(spark, folder):
    got = propagate.sage_mean_propagate(views.vectors(spark, folder), views.vector_edges(spark, folder), dim=DIM)
    return _long(got, "neighbor_mean")


# fixed demo attention weights: 1.0, 0.5, 0.25, 0.125 repeating
ATTENTION = [1.0 / 2 ** (i % 4) for i in range(DIM)]
_ATT_SQL = """
e AS (SELECT src, dst FROM emb_edges UNION ALL SELECT id, id FROM vecs),
s AS (SELECT e.src, e.dst, sum(CASE WHEN a.x + b.x > 0 THEN a.x + b.x ELSE 0.2 * (a.x + b.x) END * power(0.5, a.pos % 4)) AS s
  FROM e JOIN vlong a ON a.id = e.src JOIN vlong b ON b.id = e.dst AND b.pos = a.pos GROUP BY 1, 2),
w AS (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY dst) AS alpha FROM s)"""


@query("gat_attention", "vecs vlong emb_edges", f"""
WITH {_ATT_SQL} SELECT w.dst AS id, pos, round(sum(alpha * x), 6) + 0.0 AS x FROM w JOIN vlong ON id = w.src GROUP BY 1, 2""")
def gat_attention(spark, folder):
    got = propagate.gat_attention(
        views.vectors(spark, folder), views.vector_edges(spark, folder), dim=DIM, score=propagate.attention_score(ATTENTION)
    )
    return _long(got)


@query("gat_attention_weights", "vecs vlong emb_edges", f"WITH {_ATT_SQL} SELECT src, dst, round(alpha, 6) AS alpha FROM w")
def gat_attention_weights(spark, folder):
    got = propagate.attention_weights(
        views.vectors(spark, folder), views.vector_edges(spark, folder), score=propagate.attention_score(ATTENTION)
    )
    return rounded(got, "alpha")


@query("hetero_attention", "vlong emb_edges", """
WITH s AS (SELECT src, dst, CASE WHEN src % 2 = 0 THEN 1.0 ELSE 0.5 END * sum(a.x * b.x) / 8.0 AS s
  FROM emb_edges JOIN vlong a ON a.id = src JOIN vlong b ON b.id = dst AND b.pos = a.pos GROUP BY src, dst),
m AS (SELECT dst, pos, sum(x / (1 + exp(-s))) / count(*) AS m FROM s JOIN vlong ON id = src GROUP BY 1, 2)
SELECT v.id, v.pos, round(v.x + coalesce(m, 0), 6) + 0.0 AS x FROM vlong v LEFT JOIN m ON m.dst = v.id AND m.pos = v.pos""")
def hetero_attention(spark, folder):
    edges = views.vector_edges(spark, folder).withColumn("relation", F.when(F.col("src") % 2 == 0, "EVEN").otherwise("ODD"))
    got = propagate.hetero_attention(views.vectors(spark, folder), edges, dim=DIM, relation_weights={"EVEN": 1.0, "ODD": 0.5})
    return _long(got)


# demo heads: hidden unit j reads position j, all with given constants
HEADS = {
    name: ([[1.0 if p == (i + j) % DIM else 0.0 for p in range(DIM)] for j in range(4)], [0.1] * 4, [1.0, -1.0, 0.5, 0.25], -0.2)
    for i, name in enumerate(("p_promo", "p_return", "p_chargeback", "p_ato", "p_txn", "p_merchant", "p_ring"))
}
COMBINED = ("p_promo", "p_return", "p_chargeback", "p_ato")


def _heads_sql():
    def unit(k):
        return f"z[{k % DIM + 1}]"

    heads = []
    for i, name in enumerate(HEADS):
        terms = " + ".join(f"{w} * greatest(0, {unit(i + j)} + 0.1)" for j, w in enumerate((1.0, -1.0, 0.5, 0.25)))
        heads.append(f"1 / (1 + exp(-({terms} - 0.2))) AS {name}")
    joint = " + ".join(f"0.5 * {n}" for n in COMBINED)
    return f"""SELECT id, {', '.join(f'round({n}, 6) AS {n}' for n in HEADS)}, round(1 / (1 + exp(-({joint} + 0.1 * list_sum(z) - 1))), 6) AS p_global
FROM (SELECT id, z, {', '.join(heads)} FROM (SELECT id, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS z FROM vecs))"""


@query("multitask_heads", "vecs", _heads_sql())
def multitask_heads(spark, folder):
    got = propagate.multitask_heads(
        views.vectors(spark, folder), heads=HEADS, combined=COMBINED, combiner=([0.5] * 4 + [0.1] * DIM, -1.0)
    )
    return rounded(got, *HEADS, "p_global")


_SIM = "SELECT src, dst, list_cosine_similarity(a.vec, b.vec) AS s FROM emb_edges JOIN vecs a ON a.id = src JOIN vecs b ON b.id = dst"


@query("similarity_edge_filter", "vecs emb_edges", f"SELECT src, dst, round(s, 6) AS similarity FROM ({_SIM}) WHERE s >= 0.1")
def similarity_edge_filter(spark, folder):
    got = propagate.similarity_edge_filter(views.vectors(spark, folder), views.vector_edges(spark, folder), threshold=0.1)
    return rounded(got, "similarity")


@query("topk_fallback", "vecs emb_edges", f"""
SELECT src, dst, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (ORDER BY s DESC, src, dst) AS k, count(*) OVER () AS n FROM ({_SIM}))
WHERE k <= greatest(1, floor(0.2 * n))""")
def topk_fallback(spark, folder):
    """A threshold no edge reaches, so the best 20 % are kept."""
    got = propagate.similarity_edge_filter(views.vectors(spark, folder), views.vector_edges(spark, folder), threshold=1.5)
    return rounded(got, "similarity")


@query("care_aggregate", "vecs vlong emb_edges", f"""
WITH k AS ({_SIM}), m AS (SELECT dst, pos, avg(x) AS m FROM k JOIN vlong ON id = src WHERE s >= 0.1 GROUP BY 1, 2)
SELECT id, pos, round(x, 6) + 0.0 AS x FROM vlong
UNION ALL SELECT v.id, v.pos + 64, round(coalesce(m, 0), 6) + 0.0 FROM vlong v LEFT JOIN m ON m.dst = v.id AND m.pos = v.pos""")
def care_aggregate(spark, folder):
    return _long(propagate.care_aggregate(views.vectors(spark, folder), views.vector_edges(spark, folder), dim=DIM, threshold=0.1))


@query("policy_edge_filter", "vecs emb_edges", """
SELECT src, dst, round(p, 6) AS keep_prob FROM (
  SELECT src, dst, 1 / (1 + exp(-(0.5 * list_sum(b.vec) - 0.5 * list_sum(a.vec) + 2.0 * list_cosine_similarity(a.vec, b.vec)))) AS p
  FROM emb_edges JOIN vecs a ON a.id = src JOIN vecs b ON b.id = dst) WHERE p >= 0.5""")
def policy_edge_filter(spark, folder):
    weights = [0.5] * DIM + [-0.5] * DIM + [2.0, 0.0] + [0.0] * 12
    got = propagate.policy_edge_filter(views.vectors(spark, folder), views.vector_edges(spark, folder), weights=weights)
    return rounded(got, "keep_prob")


@query("balanced_edge_sample", "vecs emb_edges", """
WITH e AS (SELECT src, dst, label = 0 AS into_fraud FROM emb_edges JOIN vecs ON id = dst),
c AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(src AS VARCHAR) || '|' || CAST(dst AS VARCHAR) || '|42'), src, dst) AS k, count(*) OVER () AS n FROM e WHERE NOT into_fraud)
SELECT src, dst, into_fraud, CAST(copy AS INTEGER) AS copy FROM e CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS copy) WHERE into_fraud
UNION ALL SELECT src, dst, into_fraud, CAST(1 AS INTEGER) FROM c WHERE k <= floor(0.3 * n)""")
def balanced_edge_sample(spark, folder):
    labels = views.vectors(spark, folder).select("id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"))
    return propagate.balanced_edge_sample(views.vector_edges(spark, folder), labels)


@query("laplacian_weights", "emb_edges", """
WITH d AS (SELECT dst AS id, count(*) AS d FROM emb_edges GROUP BY 1)
SELECT src, dst, round(CASE WHEN a.d IS NULL THEN 0.0 ELSE -1.0 / sqrt(a.d * b.d) END, 6) + 0.0 AS weight
FROM emb_edges LEFT JOIN d a ON a.id = src JOIN d b ON b.id = dst""")
def laplacian_weights(spark, folder):
    got = propagate.laplacian_weights(views.vector_edges(spark, folder))
    return got.select("src", "dst", (r("weight") + 0.0).alias("weight"))


@query("chebyshev_filter", "vlong emb_edges", """
WITH d AS (SELECT dst AS id, count(*) AS d FROM emb_edges GROUP BY 1),
w AS (SELECT src, dst, CASE WHEN a.d IS NULL THEN 0.0 ELSE -1.0 / sqrt(a.d * b.d) END AS w FROM emb_edges LEFT JOIN d a ON a.id = src JOIN d b ON b.id = dst),
t1 AS MATERIALIZED (SELECT v.id, v.pos, v.x AS t0, coalesce(s, 0) AS x FROM vlong v LEFT JOIN (SELECT dst, pos, sum(w * x) AS s FROM w JOIN vlong ON id = src GROUP BY 1, 2) q ON q.dst = v.id AND q.pos = v.pos)
SELECT v.id, v.pos, round(v.t0 + v.x + 2 * coalesce(s, 0) - v.t0, 6) + 0.0 AS x
FROM t1 v LEFT JOIN (SELECT dst, pos, sum(w * x) AS s FROM w JOIN t1 ON id = src GROUP BY 1, 2) q ON q.dst = v.id AND q.pos = v.pos""")
def chebyshev_filter(spark, folder):
    return _long(propagate.chebyshev_filter(views.vectors(spark, folder), views.vector_edges(spark, folder), dim=DIM))


@query("infonce_loss", "vecs emb_edges", """
WITH n AS (SELECT count(*) AS n FROM vecs),
t AS (SELECT a.id, list_cosine_similarity(a.vec, b.vec) / 0.2 AS s, k = 1 AS pos FROM vecs a CROSS JOIN n CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) JOIN vecs b ON b.id = (a.id + k * k) % n)
SELECT round(avg(m - p), 6) AS loss FROM (SELECT id, ln(sum(exp(s))) AS m, max(s) FILTER (WHERE pos) AS p FROM t GROUP BY id)""")
def infonce_loss(spark, folder):
    nodes = views.vectors(spark, folder)
    n = nodes.agg(F.count(F.lit(1))).scalar()
    wanted = nodes.withColumn("n", n).select(
        F.col("id").alias("anchor_id"), F.col("vec").alias("anchor"), "n", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")
    ).withColumn("other_id", (F.col("anchor_id") + F.col("k") * F.col("k")) % F.col("n"))
    triples = wanted.join(nodes.select(F.col("id").alias("other_id"), F.col("vec").alias("other")), "other_id").withColumn(
        "is_positive", F.col("k") == 1
    )
    return rounded(propagate.infonce_loss(triples), "loss")


# --- time ---------------------------------------------------------------------------------------


@query("temporal_features", "tmp", f"SELECT account_id, {_rounded_features(TEMPORAL_FEATURES)} FROM tmp")
def temporal_features(spark, folder):
    return _round_features(features.temporal_features(txn_of(spark, folder)), TEMPORAL_FEATURES)


_FRAME = "OVER (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)"


@query("rolling_velocity", "ev", f"""
SELECT event_id, count(*) {_FRAME.format(86399999999)} AS tx_velocity,
  CAST(sum(CAST(value AS DECIMAL(18,2))) {_FRAME.format(86399999999)} AS DOUBLE) AS amount_velocity FROM ev""")
def rolling_velocity(spark, folder):
    got = temporal.rolling_velocity(views.events(spark, folder), key="user_id", ts_us="ts_us", amount="value")
    return got.select("event_id", "tx_velocity", F.col("amount_velocity").cast("double").alias("amount_velocity"))


@query("multi_velocity", "ev", f"""
SELECT event_id, count(*) {_FRAME.format(299999999)} AS velocity_5m, count(*) {_FRAME.format(3599999999)} AS velocity_1h,
  count(*) {_FRAME.format(86399999999)} AS velocity_24h FROM ev""")
def multi_velocity(spark, folder):
    got = temporal.multi_velocity(views.events(spark, folder), key="user_id", ts_us="ts_us")
    return got.select("event_id", "velocity_5m", "velocity_1h", "velocity_24h")


@query("delta_t_from_prev", "ev", """
SELECT event_id, round(coalesce(ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id), 0) / 1000000.0, 6) AS delta_t_from_prev FROM ev""")
def delta_t_from_prev(spark, folder):
    got = temporal.delta_t_from_prev(views.events(spark, folder), key="user_id", ts_us="ts_us", tie="event_id")
    return got.select("event_id", r("delta_t_from_prev").alias("delta_t_from_prev"))


@query("novelty_flags", "ev", """
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, device_id ORDER BY ts_us, event_id) = 1 THEN 1 ELSE 0 END AS device_novelty_flag,
  CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts_us, event_id) = 1 THEN 1 ELSE 0 END AS ip_novelty_flag FROM ev""")
def novelty_flags(spark, folder):
    """The event type stands in for the IP, which the events lack."""
    got = temporal.novelty_flags(
        views.events(spark, folder), owner="user_id", event_id="event_id", ts_us="ts_us",
        identifiers={"device_novelty_flag": "device_id", "ip_novelty_flag": "event_type"},
    )
    return got.select("event_id", "device_novelty_flag", "ip_novelty_flag")


@query("burst_detect", "ev", """
SELECT device_id, max(c) AS peak_events, count(*) FILTER (WHERE c >= 8) AS burst_events, count(DISTINCT user_id) AS actors FROM (
  SELECT *, count(*) OVER (PARTITION BY device_id ORDER BY ts_us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS c FROM ev)
GROUP BY device_id HAVING max(c) >= 8 AND count(DISTINCT user_id) >= 2""")
def burst_detect(spark, folder):
    return temporal.burst_detect(views.events(spark, folder), key="device_id", actor="user_id", ts_us="ts_us", min_events=8)


@query("rate_limit", "ev", f"""
SELECT event_id, c AS requests, c > 3 AS is_limited FROM (SELECT event_id, count(*) {_FRAME.format(7199999999)} AS c FROM ev)""")
def rate_limit(spark, folder):
    """Two-hour window and a limit of 3, so the sparse events reach it."""
    got = temporal.rate_limit(views.events(spark, folder), key="user_id", ts_us="ts_us", max_requests=3, window_sec=7200)
    return got.select("event_id", "requests", "is_limited")


@query("temporal_split", "txn", """
SELECT tx_id, CASE WHEN step <= q THEN 'train' ELSE 'test' END AS split FROM txn CROSS JOIN (SELECT quantile_cont(step, 0.8) AS q FROM txn)""")
def temporal_split(spark, folder):
    return temporal.temporal_split(txn_of(spark, folder).select("tx_id", "step"), step="step").select("tx_id", "split")


@query("temporal_masks", "txn gnodes", """
WITH s AS (SELECT id, coalesce(s, 0) AS s FROM gnodes LEFT JOIN (SELECT nameOrig, max(step) AS s FROM txn GROUP BY 1) ON nameOrig = id),
k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM s),
c AS (SELECT max(s) FILTER (WHERE i = floor(n * 0.7000000000000001)) AS v, max(s) FILTER (WHERE i = floor(n * 0.8)) AS t FROM k)
SELECT id AS account_id, CASE WHEN s <= v THEN 'train' WHEN s <= t THEN 'val' ELSE 'test' END AS split FROM s CROSS JOIN c""")
def temporal_masks(spark, folder):
    txn = txn_of(spark, folder)
    nodes = features.node_last_step(features.all_accounts(features.fraud_type_filter(txn)), txn)
    return temporal.temporal_masks(nodes, step="last_step").select("account_id", "split")


# --- leakage and set operations ---------------------------------------------------------------------


_ONLY_TEST = f"""SELECT nameOrig AS src, nameDest AS dst FROM txn WHERE step > {CUTOFF}
EXCEPT SELECT nameOrig, nameDest FROM txn WHERE step <= {CUTOFF}"""


@query("exclusive_test_edges", "txn", _ONLY_TEST)
def exclusive_test_edges(spark, folder):
    return features.exclusive_test_edges(txn_of(spark, folder), CUTOFF)


@query("leaked_edges", "txn", f"""
SELECT src, dst FROM (SELECT nameOrig AS src, nameDest AS dst FROM txn WHERE step <= {CUTOFF + 24}) INTERSECT {_ONLY_TEST.replace('EXCEPT', 'EXCEPT')}""".replace(
    "INTERSECT SELECT", "INTERSECT (SELECT", 1) + ")")
def leaked_edges(spark, folder):
    """A train graph built one day too long: the guard has to report that day's new pairs."""
    txn = txn_of(spark, folder)
    return features.leaked_edges(features.account_pairs(features.snapshot(txn, CUTOFF + 24)), txn, CUTOFF)


@query("leakage_guard", "txn", f"""
SELECT CAST(0 AS BIGINT) AS leaked_edges, CAST(0 AS BIGINT) AS label_columns, TRUE AS is_clean, 'clean' AS graph
UNION ALL SELECT (SELECT count(*) FROM ((SELECT nameOrig AS src, nameDest AS dst FROM txn WHERE step <= {CUTOFF + 24}) INTERSECT ({_ONLY_TEST}))), CAST(1 AS BIGINT), FALSE, 'leaky'""")
def leakage_guard(spark, folder):
    txn = txn_of(spark, folder)
    clean = features.leakage_guard(features.account_pairs(features.snapshot(txn, CUTOFF)), txn, CUTOFF, FEATURES)
    leaky = features.leakage_guard(
        features.account_pairs(features.snapshot(txn, CUTOFF + 24)), txn, CUTOFF, [*FEATURES, "isFraud"]
    )
    return clean.withColumn("graph", F.lit("clean")).union(leaky.withColumn("graph", F.lit("leaky")))
