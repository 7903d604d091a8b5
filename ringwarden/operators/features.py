"""Account features, labels, edges and the leakage guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES, FRAUD_TYPES, NIGHT_LAST_STEP, TABULAR_FEATURES
from ..functions import transaction as tx
from .ordered import Ascending, global_rank

MONEY = "decimal(18,2)"


def fraud_type_filter(df: DataFrame, enabled: bool = True) -> DataFrame:
    return df.where(F.col("type").isin(*FRAUD_TYPES)) if enabled else df


def scan_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg("isFraud").alias("fraud_rate"))


def prepare_edges(df: DataFrame, fraud_types_only: bool = True) -> DataFrame:
    """Transaction rows plus type code, log amount and hour position."""
    return fraud_type_filter(df, fraud_types_only).select(
        "*",
        tx.type_code(F.col("type")).alias("type_encoded"),
        tx.amount_log(F.col("amount")).alias("amount_log"),
        tx.hour_sin(F.col("step")).alias("hour_sin"),
        tx.hour_cos(F.col("step")).alias("hour_cos"),
    )


def snapshot(df: DataFrame, until_step: int, step: str = "step") -> DataFrame:
    """The table as known at ``until_step``; a filter the scan can push down."""
    return df.where(F.col(step) <= until_step)


def active_accounts_only(df: DataFrame, min_tx_per_account: int = 0) -> DataFrame:
    """Keep transactions of senders with enough transactions; off by default."""
    if min_tx_per_account <= 1:
        return df
    active = df.groupBy("nameOrig").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= min_tx_per_account
    )
    return df.join(active.select("nameOrig"), "nameOrig", "left_semi")


def all_accounts(df: DataFrame) -> DataFrame:
    origins = df.select(F.col("nameOrig").alias("account_id"))
    return origins.union(df.select(F.col("nameDest").alias("account_id"))).distinct()


def account_index(df: DataFrame) -> DataFrame:
    """Dense 0-based index by account id, for vector export only."""
    ranked = global_rank(all_accounts(df), order=[Ascending("account_id")], name="position")
    return ranked.select("account_id", (F.col("position") - 1).alias("node_idx"))


def _money_sum(column):
    # exact in any order, so a re-run on another partitioning gives the same features
    return F.sum(F.col(column).cast(MONEY)).cast("double")


def out_account_features(df: DataFrame, hour_of_day: bool = False) -> DataFrame:
    clock = F.pmod(F.col("step"), F.lit(24)) if hour_of_day else F.col("step")
    drain = (F.col("oldbalanceOrg") - F.col("newbalanceOrig")) / (F.col("oldbalanceOrg") + 1e-6)
    total, count = _money_sum("amount"), F.count(F.lit(1))
    return df.groupBy(F.col("nameOrig").alias("account_id")).agg(
        F.log1p(total).alias("total_sent_log"),
        count.cast("double").alias("tx_count_out"),
        F.countDistinct("nameDest").cast("double").alias("unique_dest_count"),
        F.log1p(total / count).alias("avg_sent_log"),
        F.avg(drain).alias("balance_drain_ratio"),
        F.avg(F.when(clock <= NIGHT_LAST_STEP, 1.0).otherwise(0.0)).alias("night_tx_fraction"),
        F.avg(F.when(F.col("type").isin(*FRAUD_TYPES), 1.0).otherwise(0.0)).alias("fraud_type_fraction"),
    )


def in_account_features(df: DataFrame) -> DataFrame:
    total, count = _money_sum("amount"), F.count(F.lit(1))
    return df.groupBy(F.col("nameDest").alias("account_id")).agg(
        F.log1p(total).alias("total_received_log"),
        count.cast("double").alias("tx_count_in"),
        F.countDistinct("nameOrig").cast("double").alias("unique_src_count"),
        F.log1p(total / count).alias("avg_received_log"),
    )


def tabular_features(df: DataFrame, hour_of_day: bool = False) -> DataFrame:
    """The 11 columns; both sides share the account key, so the join adds no shuffle."""
    joined = out_account_features(df, hour_of_day).join(in_account_features(df), "account_id", "full")
    return joined.select("account_id", *TABULAR_FEATURES).na.fill(0.0, list(TABULAR_FEATURES))


def temporal_features(df: DataFrame, day: int = 24, week: int = 168, as_of: int | None = None) -> DataFrame:
    """Sender counts and volumes near the table's last step.

    A known ``as_of`` step saves the pass that finds the last one.
    """
    last = df.agg(F.max("step")).scalar() if as_of is None else F.lit(as_of)
    marked = df.withColumn("_last", last)

    def recent(width, value):
        return F.when(F.col("step") >= F.col("_last") - width, value)

    money = F.col("amount").cast(MONEY)

    def volume(width):
        return F.log1p(F.coalesce(F.sum(recent(width, money)).cast("double"), F.lit(0.0)))

    sums = marked.groupBy(F.col("nameOrig").alias("account_id")).agg(
        F.count(recent(day, F.lit(1))).cast("double").alias("tx_velocity_24h"),
        F.count(recent(week, F.lit(1))).cast("double").alias("tx_velocity_7d"),
        volume(day).alias("amount_velocity_24h"),
        volume(week).alias("amount_velocity_7d"),
    )
    return sums.withColumn(
        "amount_spike_ratio", F.col("amount_velocity_24h") / (F.col("amount_velocity_7d") + 1e-6)
    )


def feature_matrix(
    nodes: DataFrame, tabular: DataFrame, structural: DataFrame, temporal: DataFrame
) -> DataFrame:
    """22 zero-filled columns per node; four inputs hashed on one key."""
    joined = (
        nodes.select("account_id")
        .join(tabular, "account_id", "left")
        .join(structural, "account_id", "left")
        .join(temporal, "account_id", "left")
    )
    return joined.select(
        "account_id", *[tx.nan_to_zero(F.col(name)).alias(name) for name in FEATURES]
    )


def account_labels(df: DataFrame) -> DataFrame:
    """1 for an origin of any fraud, over the full table."""
    return df.groupBy(F.col("nameOrig").alias("account_id")).agg(
        F.max(F.when(F.col("isFraud") == 1, 1).otherwise(0)).alias("label")
    )


def label_join(nodes: DataFrame, df: DataFrame) -> DataFrame:
    fraud = df.where(F.col("isFraud") == 1).select(F.col("nameOrig").alias("account_id")).distinct()
    marked = fraud.withColumn("label", F.lit(1))
    return nodes.join(marked, "account_id", "left").na.fill(0, ["label"])


def node_last_step(nodes: DataFrame, df: DataFrame) -> DataFrame:
    last = df.groupBy(F.col("nameOrig").alias("account_id")).agg(F.max("step").alias("last_step"))
    return nodes.join(last, "account_id", "left").na.fill(0, ["last_step"])


def known_accounts(df: DataFrame, known: DataFrame) -> DataFrame:
    return df.join(known.select("account_id"), "account_id", "left_semi")


def unknown_accounts(df: DataFrame, known: DataFrame) -> DataFrame:
    return df.join(known.select("account_id"), "account_id", "left_anti")


def graph_stats(df: DataFrame, fraud_types_only: bool = True) -> DataFrame:
    """Nodes, uncollapsed edges, fraud nodes and rate, fraud edges."""
    edges = fraud_type_filter(df, fraud_types_only)
    nodes = label_join(all_accounts(edges), df)
    node_side = nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("label").cast("bigint").alias("n_fraud_nodes")
    )
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    fraud_edges = edges.agg(F.coalesce(F.sum("isFraud"), F.lit(0)).cast("bigint")).scalar()
    return node_side.select(
        "n_nodes",
        n_edges.alias("n_edges"),
        "n_fraud_nodes",
        (F.col("n_fraud_nodes") / F.col("n_nodes")).alias("fraud_rate"),
        fraud_edges.alias("n_fraud_edges"),
    )


# --- leakage -------------------------------------------------------------------


def account_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst")).distinct()


def exclusive_test_edges(df: DataFrame, cutoff: int) -> DataFrame:
    """Pairs seen only after ``cutoff``."""
    return account_pairs(df.where(F.col("step") > cutoff)).subtract(account_pairs(snapshot(df, cutoff)))


def leaked_edges(train_edges: DataFrame, df: DataFrame, cutoff: int) -> DataFrame:
    """Pairs of a train graph that exist only after ``cutoff``; empty when clean."""
    return train_edges.select("src", "dst").intersect(exclusive_test_edges(df, cutoff))


LABEL_COLUMNS = ("label", "isFraud", "isFlaggedFraud", "y_true")


def label_columns_in(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in LABEL_COLUMNS]


def changed_features(before: DataFrame, after: DataFrame, key: str = "account_id") -> DataFrame:
    """Rows of ``before`` that ``after`` no longer holds unchanged; empty when clean."""
    return before.select(key, *[c for c in before.columns if c != key]).exceptAll(
        after.select(key, *[c for c in before.columns if c != key])
    )


def leakage_guard(train_edges: DataFrame, df: DataFrame, cutoff: int, feature_names: Sequence[str]) -> DataFrame:
    """One row: leaked pairs, label columns among features, verdict."""
    found = leaked_edges(train_edges, df, cutoff).agg(F.count(F.lit(1)).alias("leaked_edges"))
    labels = len(label_columns_in(feature_names))
    return found.select(
        "leaked_edges",
        F.lit(labels).cast("bigint").alias("label_columns"),
        ((F.col("leaked_edges") == 0) & F.lit(labels == 0)).alias("is_clean"),
    )
