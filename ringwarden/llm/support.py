"""What several operators share: stored steps, row keys, connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

# Rows and bytes that cross to Python at once.
ARROW_ROWS = "2000"
ARROW_BYTES = str(4 << 20)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application; Spark hands the archive out."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "ringwarden_tasks.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> SparkSession:
    """Make ready for Python tasks: the package is there, and batches are small, whatever the length of the texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def early_filters(spark: SparkSession) -> None:
    """Let joins drop rows by a Bloom filter of the small side before they are shuffled, whatever the size of the input."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the whole text with null as empty, and ``more`` columns; nothing else is read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def salt_of(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that links reach.

    Each round every id takes the smallest label among its neighbours and then that label's own
    label, so a path of n links takes about log(n) rounds. Both aggregates combine map-side, and
    every round is a written table. The label of a hub is one row, joined to many small link
    rows; adaptive execution splits the link side.
    """
    both = store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    lowest = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    labels = store(lowest.select("id", F.least("id", "low").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        met = labels.join(near, "id").select("id", "component", F.least("component", "seen").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("deeper"))
        step = met.join(jump, "low", "left").select(
            "id", F.least("low", "deeper").alias("component"), (F.least("low", "deeper") < F.col("component")).alias("moved")
        )
        step = store(step, "labels")
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
