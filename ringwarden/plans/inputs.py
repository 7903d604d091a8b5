"""Inputs several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import champion_score, feature_columns, ring_type
from ..operators import features as feat
from ..operators import graph
from ..operators.temporal import temporal_split
from ..session import cut_lineage, shared_folder, store
from ..sources import views
from ..sources.files import feature_cache
from .sql_views import PAGERANK_ROUNDS


def r(column: Column | str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named columns rounded, all others as they are."""
    return df.select(*[r(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def account_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Collapsed edges of the two fraud types, written once for the loops that reuse them."""
    return _edges_of(views.transactions(spark, folder))


def _edges_of(txn: DataFrame) -> DataFrame:
    return store(graph.edge_collapse(feat.fraud_type_filter(txn)), "edges")


def stored_payments(spark: SparkSession, folder: str) -> DataFrame:
    """The payments written once, for queries whose steps read them several times."""
    return store(views.payments(spark, folder), "payments")


def _once(spark: SparkSession, folder: str, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What the matrix and the training queries share, built once per input folder and application."""
    place = f"{shared_folder(spark)}/features-{spark.sparkContext.applicationId}"
    return feature_cache(spark, place, {"input": folder, "what": what}, build)


def stored_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions for features and edges, which each read another few columns."""
    return _once(spark, folder, "transactions", lambda: views.transactions(spark, folder))


def stored_edges(spark: SparkSession, folder: str) -> DataFrame:
    txn = stored_transactions(spark, folder)
    return _once(spark, folder, "edges", lambda: graph.edge_collapse(feat.fraud_type_filter(txn)))


def build_matrix(spark: SparkSession, folder: str) -> DataFrame:
    txn, edges = stored_transactions(spark, folder), stored_edges(spark, folder)
    nodes = graph.edge_nodes(edges).withColumnRenamed("id", "account_id")
    structural = graph.structural_features(edges, max_iter=PAGERANK_ROUNDS, tol=None)
    return feat.feature_matrix(nodes, feat.tabular_features(txn), structural, feat.temporal_features(txn))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The 22-feature matrix, built once per input folder and application."""
    store = f"{shared_folder(spark)}/features-{spark.sparkContext.applicationId}"
    key = {"input": folder, "cutoff": "all", "pagerank_rounds": PAGERANK_ROUNDS}
    return feature_cache(spark, store, key, lambda: build_matrix(spark, folder))


def scored_accounts(spark: SparkSession, folder: str) -> DataFrame:
    f = feature_columns()
    scored = matrix(spark, folder).withColumn("prob", champion_score(f))
    return scored.withColumn("ring_type", ring_type(f, F.col("prob")))


def labelled_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Matrix with label, last step and time split, written once: training reads it often."""
    txn = views.transactions(spark, folder)
    base = matrix(spark, folder)
    known = feat.node_last_step(feat.label_join(base, txn), txn)
    return cut_lineage(temporal_split(known, step="last_step"))
