"""Analyst decisions: append, list, export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AUDIT_COLUMNS
from ..functions.transaction import entity_id
from ..session import store

DEFAULT_NOTE = "No note was left by the analyst."


def audit_records(requests: DataFrame) -> DataFrame:
    """The eight audit columns. The id follows from the request, so a retry repeats it."""
    return requests.select(
        entity_id("audit", F.col("account_id"), F.col("analyst_id"), F.col("decision"), F.unix_micros("requested_at")).alias("audit_id"),
        "account_id",
        "decision",
        "analyst_id",
        "risk_score",
        "action_taken",
        F.when(F.coalesce(F.col("notes"), F.lit("")) == "", DEFAULT_NOTE).otherwise(F.col("notes")).alias("notes"),
        F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


def audit_append(records: DataFrame, path: str) -> None:
    """Append what the log does not hold yet, one folder per month; running it again appends nothing.

    Only the ids of months that ``records`` touch are read. The rebalance keeps files few and splits a busy month.
    """
    spark = records.sparkSession
    monthly = _once(records).withColumn("month", F.substring("timestamp", 1, 7))
    try:
        log = spark.read.schema(monthly.select(*AUDIT_COLUMNS, "month").schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        months = monthly.select("month").distinct()
        known = log.select("month", "audit_id").join(months, "month", "left_semi").select("audit_id")
        monthly = store(monthly.join(known, "audit_id", "left_anti"), "audit")
    monthly.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def _once(records: DataFrame) -> DataFrame:
    """A retried append writes the same id again; it counts once."""
    return records.dropDuplicates(["audit_id"])


def audit_list(records: DataFrame) -> DataFrame:
    """Newest first, each row with the total; the total is one scalar, no window."""
    records = _once(records)
    total = records.agg(F.count(F.lit(1))).scalar()
    return records.select(*AUDIT_COLUMNS, total.alias("total_records")).orderBy(F.desc("timestamp"), F.asc("audit_id"))


def audit_export_csv(records: DataFrame, path: str) -> None:
    _once(records).select(*AUDIT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def audit_export_json(records: DataFrame, path: str) -> None:
    _once(records).select(*AUDIT_COLUMNS).write.mode("overwrite").json(path)
