"""Rule scores, tiers and decisions as plain Column expressions.

Every function takes a mapping from feature name to Column, so the same
expression serves a batch table, a stream, or a what-if copy with some
features replaced (see ``explain.counterfactual``). Nothing here leaves
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    COST_FALSE_POSITIVE,
    FEATURES,
    FLAG_THRESHOLD,
    MAX_BATCH_ACCOUNTS,
    TIERS,
    UNBOUNDED_FEATURES,
    UNIT_INTERVAL_FEATURES,
)

Features = Mapping[str, Column]


def feature_columns(prefix: str = "") -> dict[str, Column]:
    return {name: F.col(f"{prefix}{name}") for name in FEATURES}


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _only_if(condition: Column, amount: Column | float) -> Column:
    return F.when(condition, amount).otherwise(F.lit(0.0))


def tabular_logit(f: Features) -> Column:
    """Behaviour part: balance drain, night share, type share, spike, velocity."""
    drain, spike, velocity = f["balance_drain_ratio"], f["amount_spike_ratio"], f["tx_velocity_24h"]
    drain_effect = (
        F.when(drain > 0.80, 2.4 + (drain - 0.80) * 7.5)
        .when(drain > 0.40, 0.8 + (drain - 0.40) * 2.5)
        .otherwise(-1.2 * (0.40 - drain))
    )
    return (
        F.lit(-4.0)
        + drain_effect
        + (f["night_tx_fraction"] - 0.15) * 2.0
        + (f["fraud_type_fraction"] - 0.20) * 2.2
        + _only_if(spike > 2.0, F.least(F.lit(2.5), (spike - 2.0) * 0.45))
        + _only_if(velocity > 20.0, F.least(F.lit(1.8), (velocity - 20.0) * 0.025))
    )


def graph_logit(f: Features) -> Column:
    """Structure part: degree ratio, clustering, PageRank, core number."""
    ratio, clustering = f["degree_ratio"], f["local_clustering_coefficient"]
    rank, core = f["pagerank"], f["k_core_number"]
    ratio_effect = (
        F.when(ratio > 4.0, F.least(F.lit(3.2), 1.0 + F.log2(ratio / 4.0) * 1.1))
        .when(ratio > 1.5, 0.4 * (ratio - 1.5))
        .otherwise(-0.8 * (1.5 - ratio))
    )
    clustering_effect = (
        F.when(clustering > 0.12, -2.4 * F.least(F.lit(1.0), (clustering - 0.12) / 0.25 + 0.3))
        .when(clustering < 0.04, 0.9 * (1.0 - clustering / 0.04))
        .otherwise(0.0)
    )
    rank_effect = (
        F.when((rank > 0.005) & (ratio > 5.0), 1.2)
        .when((rank > 0.005) & (ratio < 1.0), -0.8)
        .otherwise(0.0)
    )
    core_effect = (
        F.when((core >= 10) & (clustering > 0.15), -0.6)
        .when((core >= 8) & (ratio > 10.0), 0.8)
        .otherwise(0.0)
    )
    return F.lit(-3.8) + ratio_effect + clustering_effect + rank_effect + core_effect


def looks_like_merchant(f: Features) -> Column:
    return (
        (f["balance_drain_ratio"] <= 0.35)
        & ((f["local_clustering_coefficient"] >= 0.15) | (f["degree_ratio"] <= 0.8))
        & (f["night_tx_fraction"] <= 0.30)
        & (f["amount_spike_ratio"] <= 2.2)
    )


def _merchant_capped(f: Features, logit: Column, cap: float) -> Column:
    # ``least`` passes over the null of a non-merchant, so the logit is stated once
    return F.least(logit, F.when(looks_like_merchant(f), F.lit(cap)))


def champion_score(f: Features) -> Column:
    """Two-part logistic score in [0.01, 0.99]."""
    behaviour = _merchant_capped(f, tabular_logit(f), -2.6)
    structure = _merchant_capped(f, graph_logit(f), -2.8)
    return clip(sigmoid(0.52 * behaviour + 0.48 * structure), 0.01, 0.99)


def tabular_score(f: Features) -> Column:
    return sigmoid(tabular_logit(f))


def graph_score(f: Features) -> Column:
    return sigmoid(graph_logit(f))


def console_score(f: Features) -> Column:
    """The coarser five-term score of the review console."""
    logit = (
        F.lit(-3.8)
        + F.when(f["balance_drain_ratio"] > 0.8, 3.0).otherwise(-1.0)
        + F.when(f["degree_ratio"] > 4.0, 2.5).otherwise(-0.8)
        + _only_if(f["night_tx_fraction"] > 0.5, F.lit(1.5))
        + _only_if(f["amount_spike_ratio"] > 3.0, F.lit(1.8))
        - _only_if(f["local_clustering_coefficient"] > 0.1, F.lit(2.0))
    )
    return clip(sigmoid(logit), 0.01, 0.99)


def console_tier(probability: Column) -> Column:
    return (
        F.when(probability >= 0.8, "CRITICAL")
        .when(probability >= FLAG_THRESHOLD, "HIGH")
        .when(probability >= 0.2, "MEDIUM")
        .otherwise("LOW")
    )


def console_ring_type(f: Features, probability: Column) -> Column:
    ratio, drain = f["degree_ratio"], f["balance_drain_ratio"]
    return (
        F.when(probability < FLAG_THRESHOLD, "Clean Baseline")
        .when((ratio >= 10.0) & (drain >= 0.8), "Promo-Abuse Ring")
        .when(
            (f["amount_spike_ratio"] >= 5.0) & (f["night_tx_fraction"] >= 0.5),
            "Account-Takeover Checkout Surge",
        )
        .when(ratio >= 15.0, "Return-Fraud Ring")
        .otherwise("Chargeback Collusion Cluster")
    )


def risk_tier(probability: Column) -> Column:
    ladder = None
    for floor, name in TIERS:
        hit = probability >= floor
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder.otherwise("LOW")


def is_flagged(probability: Column, threshold: float = FLAG_THRESHOLD) -> Column:
    return probability >= threshold


def nearline_blend(raw: Column, cached: Column, weight: float = 0.5) -> Column:
    return F.when(cached.isNotNull(), (1 - weight) * raw + weight * cached).otherwise(raw)


def ring_type(f: Features, probability: Column) -> Column:
    ratio, drain = f["degree_ratio"], f["balance_drain_ratio"]
    night, spike = f["night_tx_fraction"], f["amount_spike_ratio"]
    return (
        F.when(probability < 0.30, "Clean Baseline")
        .when((ratio >= 10.0) & (drain >= 0.80), "Promo-Abuse Ring")
        .when((spike >= 5.0) & (night >= 0.50), "Account-Takeover Checkout Surge")
        .when(ratio >= 15.0, "Return-Fraud Ring")
        .when((drain >= 0.85) & (spike >= 2.5), "Chargeback Collusion Cluster")
        .otherwise("Merchant Abuse Ring")
    )


# head -> (bias, {feature: weight})
SUB_RISK_HEADS = {
    "promo_abuse_risk": (-2.5, {"balance_drain_ratio": 3.0, "degree_ratio": 0.15}),
    "return_fraud_risk": (-3.0, {"degree_ratio": 0.2, "amount_spike_ratio": 0.3}),
    "chargeback_collusion_risk": (-2.8, {"fraud_type_fraction": 2.5, "night_tx_fraction": 1.2}),
    "ato_surge_risk": (-3.2, {"tx_velocity_24h": 0.06, "amount_spike_ratio": 0.4}),
}


def sub_risks(f: Features) -> dict[str, Column]:
    heads = {}
    for head, (bias, weights) in SUB_RISK_HEADS.items():
        logit = F.lit(bias)
        for name, weight in weights.items():
            logit = logit + weight * f[name]
        heads[head] = F.round(clip(sigmoid(logit), 0.01, 0.99), 4)
    return heads


def recommended_action(probability: Column, ring: Column) -> Column:
    percent = F.bround(probability * 100, 0).cast("int").cast("string")
    return (
        F.when(
            probability >= 0.80,
            F.concat(F.lit("Flag for 2-Person Manual Verification ("), ring, F.lit(" Suspected)")),
        )
        .when(
            probability >= FLAG_THRESHOLD,
            F.concat(F.lit("Queue for Secondary Review (Elevated Risk: "), percent, F.lit("%)")),
        )
        .otherwise("Allow Transaction (Standard Clearance)")
    )


def expected_review_cost(flagged: Column, cost: float = COST_FALSE_POSITIVE) -> Column:
    return F.when(flagged, F.lit(cost)).otherwise(F.lit(0.0))


def batch_size_ok(accounts: Column) -> Column:
    return (accounts >= 1) & (accounts <= MAX_BATCH_ACCOUNTS)


def violated_rules(f: Features) -> Column:
    """Names of the range rules a record breaks, in feature order; empty if valid."""
    checks = []
    for name in FEATURES:
        if name in UNBOUNDED_FEATURES:
            continue
        value = f[name]
        checks.append(F.when(value < 0, F.lit(f"{name}:min")))
        if name in UNIT_INTERVAL_FEATURES:
            checks.append(F.when(value > 1, F.lit(f"{name}:max")))
    return F.array_compact(F.array(*checks))
