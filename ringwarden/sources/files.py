"""Readers and writers with fixed schemas, and the keyed feature store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schemas import PAYLOAD, PAYMENT_EVENT, TRANSACTION


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSACTION).option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str, *, steps_per_day: int = 24) -> None:
    """Edge table in day folders, so a time cutoff skips whole folders."""
    daily = edges.withColumn("day", F.floor(F.col("step") / steps_per_day).cast("int")).hint("rebalance", "day")
    daily.write.mode("overwrite").partitionBy("day").parquet(path)


def read_edges(spark: SparkSession, path: str, *, until_step: int | None = None, steps_per_day: int = 24) -> DataFrame:
    edges = spark.read.parquet(path)
    if until_step is not None:
        edges = edges.where((F.col("day") <= until_step // steps_per_day) & (F.col("step") <= until_step))
    return edges.drop("day")


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_drift_reference(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def read_drift_reference(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def explode_payload(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions, risk scores) of ``{transactions: [...], risk_scores: {...}}`` documents."""
    transactions = documents.select(F.explode("transactions").alias("t")).select("t.*")
    scores = documents.select(F.explode("risk_scores").alias("customer_id", "score"))
    return transactions, scores


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).json(path)


def payment_event_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(PAYMENT_EVENT).format(fmt).load(path)


def feature_cache(spark: SparkSession, folder: str, key: dict[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """Build once per key, read back after that.

    The key must name the input and the cutoff: another input or cutoff is
    another artefact. A mark is written after the data, so a half-written artefact
    is built again.
    """
    text = "|".join(f"{k}={key[k]}" for k in sorted(key))
    path = f"{folder.rstrip('/')}/features-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    if not _exists(spark, f"{path}/done"):
        build().write.mode("overwrite").parquet(f"{path}/data")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/data")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False
