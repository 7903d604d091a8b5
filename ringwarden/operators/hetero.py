"""Typed entity graph: tokenised nodes, relation edges, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RELATIONS, TOKEN_SALT
from ..functions.transaction import tokenize_identifier


def _entity(column: str) -> Column:
    return F.col(column)


def payment_relations() -> list[tuple[str, str, str, Column, Column]]:
    """(src type, relation, dst type, src id, dst id) that a payment row states."""
    tx = F.col("transaction_id")
    return [
        ("customer", "PLACED", "transaction", F.col("customer_id"), tx),
        ("transaction", "BELONGS_TO", "merchant", tx, F.col("merchant_id")),
        ("transaction", "USED_DEVICE", "device", tx, F.col("device_id")),
        ("transaction", "FROM_IP", "ip", tx, F.col("ip_id")),
        ("transaction", "DELIVERED_TO", "address", tx, F.col("address_id")),
        ("transaction", "USED_PROMO", "promo", tx, F.col("promo_id")),
        ("customer", "HAS_BANK_ACCOUNT", "bank_account", F.col("customer_id"), F.col("bank_account_id")),
        ("transaction", "GENERATED_REFUND", "refund", tx,
         F.when(F.col("rto_flag") == 1, F.concat(F.lit("ref_"), tx))),
        ("transaction", "GENERATED_CHARGEBACK", "chargeback", tx,
         F.when(F.col("chargeback_flag") == 1, F.concat(F.lit("cb_"), tx))),
    ]


def hetero_edges(
    rows: DataFrame,
    *,
    relations: Sequence[tuple[str, str, str, Column, Column]] | None = None,
    attributes: Mapping[str, Column] | None = None,
    salt: str = TOKEN_SALT,
) -> DataFrame:
    """Typed edges between tokenised entities, all relations from one pass.

    A relation outside the fixed list is dropped; so is an edge with a missing end.
    """
    attrs = attributes or {"timestamp": F.col("timestamp"), "amount": F.col("amount")}
    known = [r for r in (relations or payment_relations()) if tuple(r[:3]) in RELATIONS]
    entries = F.array(
        *[
            F.struct(
                F.lit(src_type).alias("src_type"), src.alias("src_raw"), F.lit(name).alias("relation"),
                F.lit(dst_type).alias("dst_type"), dst.alias("dst_raw"),
            )
            for src_type, name, dst_type, src, dst in known
        ]
    )
    present = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return (
        rows.select(F.explode(entries).alias("e"), *[c.alias(n) for n, c in attrs.items()])
        .where(present("e.src_raw") & present("e.dst_raw"))
        .select(
            "e.src_type",
            tokenize_identifier(F.col("e.src_raw"), salt).alias("src_id"),
            "e.relation",
            "e.dst_type",
            tokenize_identifier(F.col("e.dst_raw"), salt).alias("dst_id"),
            *attrs,
        )
    )


def hetero_nodes(edges: DataFrame) -> DataFrame:
    """Distinct (node_type, node_id) over both ends of all edges."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id")),
            F.struct(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id")),
        )
    )
    return edges.select(ends.alias("n")).select("n.node_type", "n.node_id").distinct()


def hetero_stats(edges: DataFrame) -> DataFrame:
    """Counts by node type and by relation, each with its total."""
    def counted(df, column, what):
        return (
            df.rollup(column)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(what).alias("what"), F.coalesce(column, F.lit("TOTAL")).alias("name"), "n")
        )

    return counted(hetero_nodes(edges), "node_type", "nodes").union(counted(edges, "relation", "edges"))


def ring_volume(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """Number of known rings and the volume their members moved."""
    members = truth.select("customer_id").distinct()
    volume = rows.join(members, "customer_id", "left_semi").agg(
        F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)")
    ).scalar()
    return truth.agg(F.countDistinct("ring_id").alias("total_rings")).select(
        "total_rings", volume.alias("total_fraud_volume")
    )
