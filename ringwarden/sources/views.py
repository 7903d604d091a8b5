"""Views that shape the star-schema tables into payment data.

Each view is a DataFrame over the given parquet tables, so scans keep column
pruning and filter pushdown, and work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date"))


def _prefixed(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def _is_risky_order():
    return (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``txn``: one row per order, five priorities standing for five types."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    parts = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_partkey").alias("part_key"))
    )
    n_customers = customers.agg(F.count(F.lit(1))).scalar()
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "TRANSFER")
        .when(F.col("o_orderpriority") == "2-HIGH", "CASH_OUT")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "PAYMENT")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "DEBIT")
        .otherwise("CASH_IN")
    )
    left_over = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100
    fraud = F.col("type").isin("TRANSFER", "CASH_OUT") & _is_risky_order()
    return (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("dest_key", F.col("part_key") % n_customers)
        .where(F.col("o_custkey") != F.col("dest_key"))
        .withColumn("type", kind)
        .select(
            F.col("o_orderkey").alias("tx_id"),
            ((_day("o_orderdate") % 31) * 24 + F.col("o_orderkey") % 24).cast("int").alias("step"),
            "type",
            F.col("o_totalprice").alias("amount"),
            _prefixed("C", F.col("o_custkey")).alias("nameOrig"),
            (left_over + F.col("o_totalprice")).alias("oldbalanceOrg"),
            left_over.alias("newbalanceOrig"),
            _prefixed("C", F.col("dest_key")).alias("nameDest"),
            F.lit(0.0).alias("oldbalanceDest"),
            F.col("o_totalprice").alias("newbalanceDest"),
            F.when(fraud, 1).otherwise(0).alias("isFraud"),
            F.lit(0).alias("isFlaggedFraud"),
        )
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """``ptx``: payments that may share device, IP, address, promo or bank."""
    sellers = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("supp_key"))
    )
    order, cust = F.col("o_orderkey"), F.col("o_custkey")

    def bucket(prefix, column, width):
        return _prefixed(prefix, F.floor(column / width).cast("bigint"))

    return (
        table(spark, folder, "orders")
        .join(sellers, F.col("l_orderkey") == order)
        .select(
            _prefixed("t", order).alias("transaction_id"),
            _prefixed("c", cust).alias("customer_id"),
            _prefixed("m", F.col("supp_key")).alias("merchant_id"),
            F.when((cust % 10 < 3) & (order % 4 == 1), bucket("dev_", cust, 3)).alias("device_id"),
            F.when(order % 7 == 0, bucket("ip_", cust, 4)).alias("ip_id"),
            F.when(order % 11 == 0, bucket("addr_", cust, 2)).alias("address_id"),
            F.when(order % 50 == 0, bucket("promo_", order, 500)).alias("promo_id"),
            F.when(order % 13 == 0, _prefixed("bank_", cust)).alias("bank_account_id"),
            F.col("o_totalprice").alias("amount"),
            (
                (_day("o_orderdate") % 31).cast("bigint") * 86400
                + (order % 24) * 3600
                + (order * 37) % 3600
            ).alias("timestamp"),
            F.when(order % 29 == 0, 1).otherwise(0).alias("rto_flag"),
            F.when(order % 97 == 0, 1).otherwise(0).alias("chargeback_flag"),
        )
    )


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """``scored``: id, y_true, y_prob, amount, plus the order's priority as segment."""
    logit = (
        -5.0
        + 6.0 * F.col("o_totalprice") / 500000.0
        + F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
        + 0.15 * (F.col("o_orderkey") % 7)
    )
    fraud = _is_risky_order() & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(fraud, 1).otherwise(0).alias("y_true"),
        F.round(1.0 / (1.0 + F.exp(-logit)), 6).alias("y_prob"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("segment"),
    )


def risk_scores(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .where(key % 5 != 4)
        .select(
            _prefixed("c", key).alias("customer_id"),
            (((key * 37) % 100).cast("double") / 100.0).alias("score"),
        )
    )


def true_ring_members(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .where(key % 30 < 3)
        .select(
            _prefixed("gt_", F.floor(key / 3).cast("bigint")).alias("ring_id"),
            _prefixed("c", key).alias("customer_id"),
            F.lit(86400).cast("bigint").alias("start_timestamp"),
        )
    )


def shape_events(raw: DataFrame) -> DataFrame:
    """Works on a batch or a streaming read of the events table."""
    return raw.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_type",
        "value",
        F.concat(F.lit("dev_"), F.get_json_object("props", "$.k")).alias("device_id"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_events(table(spark, folder, "events"))


def score_log(spark: SparkSession, folder: str) -> DataFrame:
    return (
        events(spark, folder)
        .where(F.col("event_type") == "view")
        .select(
            F.col("user_id").alias("account_id"),
            F.col("ts").alias("written_at"),
            F.col("ts_us").alias("written_us"),
            F.round(F.col("value") / 600.0, 6).alias("score"),
        )
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
    )


def vector_edges(spark: SparkSession, folder: str) -> DataFrame:
    """``emb_edges``: two derived neighbours per vector, no self-loops."""
    base = table(spark, folder, "embeddings").select(F.col("vec_id").alias("src"))
    n = base.agg(F.count(F.lit(1))).scalar()
    hop = F.explode(
        F.array((F.col("src") * 7 + 3) % F.col("n"), (F.col("src") * 13 + 5) % F.col("n"))
    )
    return (
        base.withColumn("n", n)
        .select("src", hop.alias("dst"))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
