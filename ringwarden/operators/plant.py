"""Planted rings and decoys, to measure how much a detector finds.

Every operator takes ``anchors`` (anchor BIGINT, base_ts BIGINT): one ring is
planted per anchor row, so the planted volume follows the anchor table. Picks
come from hashes of the row's own key; the same input gives the same rows on
every run and after every retry. Each ``plant_*`` returns payment rows, each
``truth_*`` the members for ``ring_eval``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.transaction import hash_number
from .ordered import Ascending, global_rank


def numbered_anchors(spark: SparkSession, n_rings: int = 1, base_ts: int = 1_788_300_000) -> DataFrame:
    return spark.range(n_rings).select(F.col("id").alias("anchor"), F.lit(base_ts).cast("bigint").alias("base_ts"))


def hash_pick(n: int | Column, *parts: Column | str) -> Column:
    return hash_number(*parts) % n


def hash_uniform(*parts: Column | str) -> Column:
    """Strictly between 0 and 1."""
    return (hash_number(*parts) + 0.5) / 4294967296.0


@dataclass(frozen=True)
class RingShape:
    """Sizes and shared identifiers of one ring type."""

    name: str
    accounts: int
    payments: int
    amount: float
    start: int
    spread: int
    promo_discount: float = 0.0
    devices: int = 0
    ips: int = 0
    addresses: int = 0
    shared_bank: bool = False
    promo: bool = False
    rto: bool = False
    chargeback: bool = False
    merchants: int = 1


# --- fixed values: planted ring sizes and amounts -----------------------------------
PROMO = RingShape("promo", 15, 3, 2500.0, 3600, 3601, promo_discount=1800.0, devices=2, ips=2, promo=True, merchants=3)
RTO = RingShape("rto", 10, 2, 48000.0, 7200, 7201, addresses=2, rto=True)
CHARGEBACK = RingShape("chargeback", 8, 2, 35000.0, 14400, 7201, shared_bank=True, chargeback=True)
ATO_ACCOUNTS, ATO_PAYMENTS, ATO_AMOUNT, ATO_START, ATO_GAP = 6, 5, 19500.0, 25000, 60


def _shared(prefix: str, count: int, shape: RingShape, key: Column) -> Column:
    """One of ``count`` identifiers of the ring, or none."""
    if count == 0:
        return F.lit(None).cast("string")
    pick = hash_pick(count, prefix, shape.name, key) + 1
    return F.concat(F.lit(f"{prefix}_{shape.name}_"), F.col("anchor").cast("string"), F.lit("_"), pick.cast("string"))


def _of_ring(prefix: str, wanted: bool, shape: RingShape) -> Column:
    if not wanted:
        return F.lit(None).cast("string")
    return F.concat(F.lit(f"{prefix}_{shape.name}_"), F.col("anchor").cast("string"))


def _member(shape: RingShape) -> Column:
    return F.concat_ws("_", F.lit(f"cust_{shape.name}"), F.col("anchor").cast("string"), F.col("account").cast("string"))


def _expand(anchors: DataFrame, accounts: int, payments: int) -> DataFrame:
    return anchors.withColumn("account", F.explode(F.sequence(F.lit(1), F.lit(accounts)))).withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.lit(payments)))
    )


def plant_ring(anchors: DataFrame, shape: RingShape) -> DataFrame:
    key = F.concat_ws("_", F.lit(f"tx_{shape.name}"), "anchor", "account", "n")
    merchant = hash_pick(shape.merchants, "merchant", shape.name, F.col("transaction_id")) + 1
    return (
        _expand(anchors, shape.accounts, shape.payments)
        .withColumn("transaction_id", key)
        .select(
            "transaction_id",
            _member(shape).alias("customer_id"),
            F.concat_ws("_", F.lit("merch"), F.col("anchor"), merchant).alias("merchant_id"),
            _shared("dev", shape.devices, shape, F.col("transaction_id")).alias("device_id"),
            _shared("ip", shape.ips, shape, F.col("transaction_id")).alias("ip_id"),
            _shared("addr", shape.addresses, shape, F.col("transaction_id")).alias("address_id"),
            _of_ring("promo", shape.promo, shape).alias("promo_id"),
            _of_ring("bank", shape.shared_bank, shape).alias("bank_account_id"),
            F.lit(shape.amount).alias("amount"),
            (F.col("base_ts") + shape.start + hash_pick(shape.spread, "time", F.col("transaction_id"))).alias("timestamp"),
            F.lit(int(shape.rto)).alias("rto_flag"),
            F.lit(int(shape.chargeback)).alias("chargeback_flag"),
            F.lit(shape.promo_discount).alias("promo_discount_amount"),
            F.lit(shape.amount if shape.rto else 0.0).alias("refund_amount"),
        )
    )


def truth_of(anchors: DataFrame, shape: RingShape) -> DataFrame:
    return anchors.withColumn("account", F.explode(F.sequence(F.lit(1), F.lit(shape.accounts)))).select(
        F.concat_ws("_", F.lit(f"ring_{shape.name}"), "anchor").alias("ring_id"),
        _member(shape).alias("customer_id"),
        (F.col("base_ts") + shape.start).alias("start_timestamp"),
    )


def plant_promo_ring(anchors: DataFrame) -> DataFrame:
    return plant_ring(anchors, PROMO)


def plant_rto_ring(anchors: DataFrame) -> DataFrame:
    return plant_ring(anchors, RTO)


def plant_chargeback_ring(anchors: DataFrame) -> DataFrame:
    return plant_ring(anchors, CHARGEBACK)


def plant_ato_ring(victims: DataFrame) -> DataFrame:
    """``victims``: (anchor, base_ts, customer_id) existing accounts taken over.

    Each pays five times a minute apart from the ring's one new device and IP.
    """
    surge = victims.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(ATO_PAYMENTS - 1))))
    key = F.concat_ws("_", F.lit("tx_ato"), "anchor", "customer_id", "n")
    merchant = hash_pick(4, "merchant", "ato", F.col("transaction_id")) + 1
    none = F.lit(None).cast("string")
    return surge.withColumn("transaction_id", key).select(
        "transaction_id",
        "customer_id",
        F.concat_ws("_", F.lit("merch"), F.col("anchor"), merchant).alias("merchant_id"),
        F.concat_ws("_", F.lit("dev_ato"), F.col("anchor")).alias("device_id"),
        F.concat_ws("_", F.lit("ip_ato"), F.col("anchor")).alias("ip_id"),
        none.alias("address_id"),
        none.alias("promo_id"),
        none.alias("bank_account_id"),
        F.lit(ATO_AMOUNT).alias("amount"),
        (F.col("base_ts") + ATO_START + F.col("n") * ATO_GAP).alias("timestamp"),
        F.lit(0).alias("rto_flag"),
        F.lit(0).alias("chargeback_flag"),
        F.lit(0.0).alias("promo_discount_amount"),
        F.lit(0.0).alias("refund_amount"),
    )


def ato_victims(anchors: DataFrame, customers: DataFrame, *, customer: str, per_ring: int = ATO_ACCOUNTS) -> DataFrame:
    """The ``per_ring`` accounts after each other, ring by ring, in customer order.

    ``anchors`` must be numbered 0.. without gaps in ``position``.
    """
    ranked = global_rank(customers.select(F.col(customer).alias("customer_id")), order=[Ascending("customer_id")], name="_r")
    placed = ranked.select("customer_id", F.floor((F.col("_r") - 1) / per_ring).cast("bigint").alias("position"))
    return anchors.join(placed, "position").select("anchor", "base_ts", "customer_id")


def plant_rows(base: DataFrame, planted: Sequence[DataFrame]) -> DataFrame:
    """Planted rows added to a base table, columns matched by name."""
    result = base
    for rows in planted:
        result = result.unionByName(rows.select(*[c for c in rows.columns if c in base.columns]))
    return result


def synthetic_background(
    customers: DataFrame, *, customer: str, payments_each: int = 5, n_merchants: int = 20,
    base_ts: int = 1_788_300_000, mu: float = 7.0, sigma: float = 0.8,
) -> DataFrame:
    """Clean payments of each customer: own identifiers, log-normal amount, one per hour."""
    key = F.concat_ws("_", F.lit("tx_clean"), "owner", "n")
    own = lambda prefix: F.concat_ws("_", F.lit(prefix), F.col("owner"))
    # Box-Muller on two hash numbers
    normal = F.sqrt(-2.0 * F.log(hash_uniform("u1", F.col("transaction_id")))) * F.cos(
        6.283185307179586 * hash_uniform("u2", F.col("transaction_id"))
    )
    return (
        customers.select(F.col(customer).cast("string").alias("owner"))
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(payments_each - 1))))
        .withColumn("transaction_id", key)
        .select(
            "transaction_id",
            own("cust_clean").alias("customer_id"),
            F.concat_ws("_", F.lit("merch"), hash_pick(n_merchants, "merchant", F.col("transaction_id")) + 1).alias("merchant_id"),
            own("dev_clean").alias("device_id"),
            own("ip_clean").alias("ip_id"),
            own("addr_clean").alias("address_id"),
            own("ph_clean").alias("phone_id"),
            own("em_clean").alias("email_id"),
            own("bank_clean").alias("bank_account_id"),
            F.concat(F.lit("asn_isp_"), (hash_pick(5, "asn", F.col("owner")) + 1).cast("string")).alias("asn_id"),
            F.concat(F.lit("pin_"), (hash_pick(50, "pin", F.col("owner")) + 100001).cast("string")).alias("pincode_id"),
            F.round(F.exp(F.lit(mu) + sigma * normal), 2).alias("amount"),
            (F.lit(base_ts).cast("bigint") + F.col("n") * 3600 + hash_pick(301, "time", F.col("transaction_id"))).alias("timestamp"),
        )
    )


# --- fixed values: event waves by ring type -----------------------------------------
# accounts, account prefix, merchant, mcc, amount, method, first score, score step, tier
WAVES = {
    "Promo-Abuse Ring": (6, "acc_syndicate", "QuickCommerce_5812", "5812", 599.0, "upi", 0.912, 0.012, "CRITICAL"),
    "Return-Fraud Ring": (4, "acc_return_ring", "Electronics_5732", "5732", 68490.0, "card", 0.885, 0.02, "HIGH"),
    "Chargeback Collusion Cluster": (5, "acc_cb_cluster", "DigitalGaming_5999", "5999", 8500.0, "card", 0.945, 0.008, "CRITICAL"),
    "Account-Takeover Checkout Surge": (5, "acc_ato_victim", "DigitalVouchers_5999", "5999", 15000.0, "netbanking", 0.965, 0.0, "CRITICAL"),
}


def plant_event_wave(anchors: DataFrame, ring_type: str = "Promo-Abuse Ring") -> DataFrame:
    """One wave of payment events per anchor, on one device and IP."""
    accounts, prefix, merchant, mcc, amount, method, first, step, tier = WAVES.get(
        ring_type, WAVES["Account-Takeover Checkout Surge"]
    )
    label = ring_type if ring_type in WAVES else "Account-Takeover Checkout Surge"
    i = F.col("i")
    return anchors.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(accounts - 1)))).select(
        F.concat_ws("_", F.lit("wave"), F.lit(mcc), F.col("anchor"), i).alias("event_key"),
        F.concat_ws("_", F.lit(prefix), F.col("anchor"), F.lpad((i + 1).cast("string"), 3, "0")).alias("account_id"),
        F.lit(merchant).alias("merchant_name"),
        F.lit(mcc).alias("mcc_code"),
        F.lit(amount).alias("amount_inr"),
        F.lit(method).alias("method"),
        F.concat(F.lit("ip_vpn_exit_"), F.col("anchor").cast("string")).alias("ip_hash"),
        F.concat(F.lit("dev_shared_cluster_"), F.col("anchor").cast("string")).alias("device_fingerprint"),
        F.round(F.lit(first) + i * step, 6).alias("risk_score"),
        F.lit(tier).alias("risk_tier"),
        F.lit(True).alias("is_planted_ring"),
        F.lit(label).alias("ring_type"),
        F.lit(True).alias("human_confirmation_required"),
    )


# --- fixed values: features of a low-and-slow account ---------------------------------
LOW_AND_SLOW = {
    "tx_count_out": 2.0,
    "tx_count_in": 2.0,
    "unique_dest_count": 2.0,
    "unique_src_count": 1.0,
    "balance_drain_ratio": 0.35,
    "night_tx_fraction": 0.12,
    "fraud_type_fraction": 0.20,
    "in_degree": 2.0,
    "out_degree": 2.0,
    "degree_ratio": 1.0,
    "pagerank": 0.0004,
    "k_core_number": 3.0,
    "local_clustering_coefficient": 0.04,
    "tx_velocity_24h": 2.0,
    "tx_velocity_7d": 5.0,
    "amount_spike_ratio": 1.15,
}


def plant_low_and_slow(anchors: DataFrame, *, accounts: int = 25, total_volume: float = 500_000.0) -> DataFrame:
    """Accounts that share a volume and stay below every rule limit."""
    share = F.lit(total_volume / accounts)
    volumes = {
        "total_sent_log": F.log1p(share),
        "total_received_log": F.log1p(share * 1.1),
        "avg_sent_log": F.log1p(share / 2.0),
        "avg_received_log": F.log1p(share),
        "amount_velocity_24h": F.log1p(share),
        "amount_velocity_7d": F.log1p(share),
    }
    columns = {**{k: F.lit(v) for k, v in LOW_AND_SLOW.items()}, **volumes}
    return anchors.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(accounts)))).select(
        F.concat_ws("_", F.lit("acc_evasion"), F.col("anchor"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("account_id"),
        share.alias("amount"),
        *[columns[name].alias(name) for name in FEATURES],
    )


def decoy_edges(fraud: DataFrame, clean: DataFrame, k_values: Sequence[int] = (0, 10, 50, 100, 500), seed: int = 0) -> DataFrame:
    """(k, src, copy, dst): k edges from every fraud node to hash-chosen clean nodes.

    Clean nodes get a dense position, so a pick is an equi-join and no fraud node
    ever meets all clean nodes.
    """
    positions = global_rank(clean.select("id"), order=[Ascending("id")], name="position").select(
        F.col("id").alias("dst"), "position"
    )
    n_clean = clean.agg(F.count(F.lit(1))).scalar()
    wanted = (
        fraud.select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(k) for k in k_values if k > 0])).alias("k"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k"))))
        .withColumn("n_clean", n_clean)
        .withColumn("position", hash_pick(F.col("n_clean"), str(seed), F.col("src"), F.col("k"), F.col("copy")) + 1)
    )
    return wanted.join(positions, "position").select("k", "src", "copy", "dst")
