"""Training, propagated models, cascades and federated averaging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURES, STRUCTURAL_FEATURES, TABULAR_FEATURES, TEMPORAL_FEATURES
from ..session import cut_lineage
from . import boost
from .boost import BoostedTrees
from .graph import sampling_key
from .metrics import average_precision_per, evaluate_model
from .ordered import Ascending, global_rank
from .propagate import gcn_propagate, sage_mean_propagate

FEATURE_SUBSETS = {
    "tabular": TABULAR_FEATURES,
    "graph": STRUCTURAL_FEATURES,
    "temporal": TEMPORAL_FEATURES,
    "tabular+temporal": TABULAR_FEATURES + TEMPORAL_FEATURES,
    "tabular+graph": TABULAR_FEATURES + STRUCTURAL_FEATURES,
    "all": FEATURES,
}


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: counts, ``neg/pos`` and the balanced weight of each class."""
    counts = df.agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg"),
    )
    n = F.col("pos") + F.col("neg")
    safe = lambda c: F.greatest(F.col(c), F.lit(1))
    return counts.select(
        "pos", "neg",
        (F.col("neg") / safe("pos")).alias("scale_pos_weight"),
        (n / (2 * safe("pos"))).alias("weight_pos"),
        (n / (2 * safe("neg"))).alias("weight_neg"),
    )


def with_balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``; training is eager, so the two class weights are read first."""
    w = class_weights(df, label).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, w["weight_pos"]).otherwise(w["weight_neg"]))


def with_positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    w = class_weights(df, label).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, w["scale_pos_weight"]).otherwise(1.0))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def train_logistic(train: DataFrame, features: Sequence[str] = FEATURES, label: str = "label"):
    """Standardised, class-balanced logistic model with L2 at ``C = 1``."""
    weighted = with_balanced_weight(train, label).persist()
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    model = LogisticRegression(
        featuresCol="scaled", labelCol=label, weightCol="weight", standardization=False,
        regParam=1.0 / max(weighted.count(), 1), maxIter=100,
    )
    fitted = Pipeline(stages=[_assembler(features), scaler, model]).fit(weighted)
    weighted.unpersist()
    return fitted


def train_gbt(
    train: DataFrame, features: Sequence[str] = FEATURES, label: str = "label", *,
    trees: int = 500, depth: int = 7, learning_rate: float = 0.05, subsample: float = 0.8, seed: int = 42,
) -> BoostedTrees:
    """Boosted trees, positives weighted by ``neg / pos``."""
    # read for weights, split points and trees
    weighted = with_positive_weight(train, label).persist()
    fitted = boost.fit(
        weighted, features, label=label, trees=trees, depth=depth, learning_rate=learning_rate,
        subsample=subsample, min_rows=5, l2=1.0, seed=seed,
    )
    weighted.unpersist()
    return fitted


def train_gbt_leafwise(
    train: DataFrame, validation: DataFrame, features: Sequence[str] = FEATURES, label: str = "label", *,
    trees: int = 600, depth: int = 7, leaves: int = 63, patience: int = 30, learning_rate: float = 0.05,
    subsample: float = 0.8, bins: int = 255, seed: int = 42,
) -> BoostedTrees:
    """Boosted trees that split the leaf of the highest gain first.

    Ends once the log loss of the validation rows has not fallen for ``patience`` trees.
    """
    both = with_positive_weight(train, label).withColumn("is_validation", F.lit(False)).unionByName(
        validation.withColumn("weight", F.lit(1.0)).withColumn("is_validation", F.lit(True))
    )
    both = both.persist()
    fitted = boost.fit(
        both, features, label=label, held="is_validation", trees=trees, depth=depth, leaves=leaves, patience=patience,
        learning_rate=learning_rate, subsample=subsample, bins=bins, min_rows=20, l2=0.0, seed=seed,
    )
    both.unpersist()
    return fitted


def predict(model, df: DataFrame, *, id_column: str = "account_id", label: str = "label") -> DataFrame:
    """(id, y_true, y_prob) as the metric operators take it."""
    chance = F.col("probability") if isinstance(model, BoostedTrees) else vector_to_array("probability")[1]
    return model.transform(df).select(F.col(id_column).alias("id"), F.col(label).alias("y_true"), chance.alias("y_prob"))


def batch_infer(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], *, id_column: str, features: Sequence[str]) -> DataFrame:
    """Score every row with an opaque model, Arrow batch by Arrow batch.

    Rows keep their id, so no order has to be kept.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch[id_column], "y_prob": score(batch[list(features)]).astype("float64")})

    return df.select(id_column, *features).mapInPandas(run, schema=f"id {kind}, y_prob double")


def feature_importances(model: BoostedTrees, features: Sequence[str], spark, top: int = 20) -> DataFrame:
    """Largest importances of a fitted tree model; as many rows as features at most."""
    rows = [(name, float(v)) for name, v in zip(features, model.importances())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(top)


def ablation_subsets(train: DataFrame, test: DataFrame, subsets=None, k_values=(100,), label: str = "label") -> DataFrame:
    """The same model and metrics over each feature subset of one cached matrix.

    The fits wait for each other's short jobs otherwise, so they run side by side.
    """
    train, test = train.persist(), test.persist()
    train.count(), test.count()

    def row(name: str, features: Sequence[str]) -> DataFrame:
        scored = predict(train_logistic(train, features, label), test, label=label).persist()
        got = evaluate_model(scored, name=name, k_values=k_values, threshold=0.5)
        return got.withColumn("n_features", F.lit(len(features)))

    chosen = dict(subsets or FEATURE_SUBSETS)
    with ThreadPoolExecutor(len(chosen)) as pool:
        rows = list(pool.map(inheritable_thread_target(train.sparkSession)(row), chosen.keys(), chosen.values()))
    return reduce(DataFrame.unionByName, rows)


# --- graph models ---------------------------------------------------------------------


def as_vectors(matrix: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return matrix.select(F.col("account_id").alias("id"), F.array(*[F.col(c) for c in features]).alias("vec"))


def from_vectors(nodes: DataFrame, prefix: str, dim: int) -> DataFrame:
    return nodes.select(F.col("id").alias("account_id"), *[F.col("vec")[i].alias(f"{prefix}{i}") for i in range(dim)])


def propagated_features(matrix: DataFrame, edges: DataFrame, *, hops: int = 2, layer: str = "gcn", features: Sequence[str] = FEATURES) -> DataFrame:
    """Features smoothed over ``hops`` layers (simple graph convolution, Wu et al. 2019)."""
    dim = len(features)
    nodes = as_vectors(matrix, features)
    for _ in range(hops):
        if layer == "gcn":
            nodes = gcn_propagate(nodes, edges, dim=dim)
        else:
            both = sage_mean_propagate(nodes, edges, dim=dim)
            nodes = both.select("id", F.zip_with("vec", "neighbor_mean", lambda a, b: (a + b) / 2).alias("vec"))
    return from_vectors(nodes, "p_", dim)


def propagated_classifier(matrix: DataFrame, edges: DataFrame, *, split: str = "split", label: str = "label", hops: int = 2, layer: str = "gcn") -> DataFrame:
    """(id, y_true, y_prob) of held-out nodes, trained on the train nodes only."""
    smooth = propagated_features(matrix, edges, hops=hops, layer=layer)
    names = [c for c in smooth.columns if c != "account_id"]
    # written once: the fit and the prediction would each propagate again
    joined = cut_lineage(matrix.select("account_id", label, split).join(smooth, "account_id"))
    model = train_logistic(joined.where(F.col(split) == "train"), names, label)
    return predict(model, joined.where(F.col(split) != "train"), label=label)


def hybrid_stack(matrix: DataFrame, graph_score: DataFrame, *, split: str = "split", label: str = "label", trees: int = 500) -> DataFrame:
    """Boosted trees over the 22 features and an earlier graph score.

    ``graph_score`` (id, y_prob) must come from data before the train rows end.
    """
    stacked = cut_lineage(matrix.join(
        graph_score.select(F.col("id").alias("account_id"), F.col("y_prob").alias("graph_score")), "account_id", "left"
    ).na.fill(0.0, ["graph_score"]))
    model = train_gbt(stacked.where(F.col(split) == "train"), [*FEATURES, "graph_score"], label, trees=trees)
    return predict(model, stacked.where(F.col(split) != "train"), label=label)


def two_stage_cascade(
    df: DataFrame, nearline: DataFrame, *, stage1: Column, stage1_threshold: float, stage2_threshold: float,
    key: str = "account_id", score: str = "score",
) -> DataFrame:
    """Rows above the cheap score, then above their nearline score.

    The cheap gate runs first, so only its survivors reach the join. Without a
    nearline score a row cannot pass stage two.
    """
    gated = df.withColumn("stage1_score", stage1).where(F.col("stage1_score") > stage1_threshold)
    known = nearline.select(F.col(key), F.col(score).alias("stage2_score"))
    return gated.join(known, key, "left").withColumn(
        "is_alert", F.coalesce(F.col("stage2_score") > stage2_threshold, F.lit(False))
    )


# --- federated --------------------------------------------------------------------------


def shard_stratified(df: DataFrame, *, id_column: str, label: str, n_shards: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``shard``: every label is dealt out evenly, in hash order."""
    keyed = df.withColumn("_key", sampling_key(id_column, seed=seed))
    ranked = global_rank(keyed, keys=[label], order=[Ascending("_key"), Ascending(id_column)], name="_r")
    return ranked.withColumn("shard", ((F.col("_r") - 1) % n_shards).cast("int")).select(*df.columns, "shard")


def federated_average(
    df: DataFrame, *, features: Sequence[str], label: str = "label", shard: str = "shard",
    rounds: int = 10, local_steps: int = 1, learning_rate: float = 0.5, l2: float = 1e-4,
) -> list[float]:
    """Weights (features, then intercept) after ``rounds`` of weight averaging.

    A shard stands for an institution and may be any size, so its local steps are
    balanced logistic gradients added up in parallel over all its rows; what meets
    on the driver is one weight vector per shard. Features are standardised per
    shard, as each institution would do.
    """
    names = list(features)
    moments = df.groupBy(shard).agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(names)],
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
    )
    # one row per shard (n_shards is a parameter), hence small enough to broadcast
    joined = df.join(F.broadcast(moments), shard)
    standard = [
        F.when(F.col(f"s_{i}") > 0, (F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}")).otherwise(F.lit(0.0))
        for i, c in enumerate(names)
    ]
    n, pos = F.col("_n"), F.col("_pos")
    balance = F.when(F.col(label) == 1, n / (2 * F.greatest(pos, F.lit(1)))).otherwise(n / (2 * F.greatest(n - pos, F.lit(1))))
    rows = joined.select(
        F.col(shard).alias("shard"), F.array(*standard, F.lit(1.0)).alias("x"),
        F.col(label).cast("double").alias("y"), balance.alias("w"),
    ).persist()
    size = len(names) + 1
    sizes = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    total = sum(sizes.values())
    weights = [0.0] * size
    for _ in range(rounds):
        local = {s: list(weights) for s in sizes}
        for _ in range(local_steps):
            local = _local_step(rows, local, size, learning_rate, l2)
        weights = [sum(sizes[s] / total * local[s][j] for s in sizes) for j in range(size)]
    rows.unpersist()
    return weights


def _local_step(rows: DataFrame, local: dict, size: int, rate: float, l2: float) -> dict:
    """One gradient step of every shard at once: a single grouped aggregate."""
    table = F.create_map(
        *[part for s, w in local.items() for part in (F.lit(s), F.array(*[F.lit(float(v)) for v in w]))]
    )
    margin = F.aggregate(
        F.zip_with("x", F.element_at(table, F.col("shard")), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )
    error = (1.0 / (1.0 + F.exp(-margin)) - F.col("y")) * F.col("w")
    grads = rows.select("shard", "x", error.alias("e")).groupBy("shard").agg(
        *[F.avg(F.col("e") * F.col("x")[j]).alias(f"g{j}") for j in range(size)]
    )
    return {
        r["shard"]: [w - rate * (r[f"g{j}"] + l2 * w) for j, w in enumerate(local[r["shard"]])]
        for r in grads.collect()
    }


def linear_score(features: Sequence[str], weights: Sequence[float]) -> Column:
    """Probability of given weights over already standardised columns."""
    logit = F.lit(float(weights[-1]))
    for name, weight in zip(features, weights):
        logit = logit + F.col(name) * float(weight)
    return 1.0 / (1.0 + F.exp(-logit))


def stress_curve(
    fraud: DataFrame, clean: DataFrame, edges: DataFrame, scores: DataFrame, decoys: DataFrame,
    *, k_values: Sequence[int], threshold: float = 0.5,
) -> DataFrame:
    """Recall, precision and PR-AUC per decoy count, measured on neighbour-averaged scores.

    A node's score is the mean of its own and its out-neighbours' scores, so every
    decoy edge to a clean node pulls a fraud node down. ``decoys`` is
    ``decoy_edges``; k = 0 is the untouched graph. Its edges are the same at all
    levels, so they are added up once per node and dealt to the levels as sums. The ranking takes
    scores that agree in twelve digits as equal, since sums differ in the last ones by order.
    """
    levels = F.array(*[F.lit(k) for k in k_values])
    own = scores.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    neighbor = scores.select(F.col("id").alias("dst"), "y_prob")
    added = [F.sum("y_prob").alias("s"), F.count("y_prob").alias("n")]
    base = edges.select("src", "dst").unionByName(own).join(neighbor, "dst").groupBy("src").agg(*added)
    # written once: the ranking and the other measures would each pick all decoys again
    extra = cut_lineage(decoys.select("k", "src", "dst").join(neighbor, "dst").groupBy("k", "src").agg(*added))
    mean = (
        base.select(F.explode(levels).alias("k"), "src", "s", "n").unionByName(extra)
        .groupBy("k", "src")
        .agg(F.try_divide(F.sum("s"), F.sum("n")).alias("score"))
    )
    labels = fraud.select("id", F.lit(1).alias("y")).union(clean.select("id", F.lit(0).alias("y")))
    marked = mean.join(labels, mean["src"] == labels["id"])
    hit, bad = F.col("score") >= threshold, F.col("y") == 1
    at_threshold = marked.groupBy("k").agg(
        F.avg(F.when(bad, F.when(hit, 1.0).otherwise(0.0))).alias("recall"),
        F.avg(F.when(hit, F.col("y").cast("double"))).alias("precision"),
        F.avg(F.when(bad, F.col("score"))).alias("mean_fraud_score"),
    )
    ranked = marked.select("k", F.col("y").alias("y_true"), F.round("score", 12).alias("y_prob"))
    area = average_precision_per(ranked, "k").withColumnRenamed("average_precision", "pr_auc")
    return at_threshold.join(area, "k").select("k", "recall", "precision", "pr_auc", "mean_fraud_score")
