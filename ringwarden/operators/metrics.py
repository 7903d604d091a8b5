"""Ranking, threshold and grid metrics over (id, y_true, y_prob) tables.

Scores are first added up per distinct value (or per grid step), so no metric
sorts raw rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE, FLAG_THRESHOLD
from .ordered import Descending, linear_quantiles, running_totals

MONEY = "decimal(18,2)"


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct column (scalar subquery, no join)."""
    return df.select(F.struct(*df.columns)).scalar()


def grid(start: float, stop: float, count: int) -> list[float]:
    step = (stop - start) / (count - 1)
    points = [start + i * step for i in range(count)]
    points[-1] = stop
    return points


F1_GRID = grid(0.01, 0.80, 80)
STACK_GRID = grid(0.01, 0.50, 50)


def steps_reached(value: Column, points: Sequence[float]) -> Column:
    """How many of the evenly spaced ``points`` are <= value.

    A division gives the step up to one; comparing with the neighbouring points
    makes it exact, at the same cost for any grid length.
    """
    n, start, width = len(points), points[0], points[1] - points[0]
    table = F.array(*[F.lit(float(p)) for p in points])
    guess = F.least(F.greatest(F.floor((value - start) / width), F.lit(-1)), F.lit(n - 1)).cast("int")
    next_point = F.element_at(table, F.least(guess + 2, F.lit(n)))
    this_point = F.element_at(table, F.greatest(guess + 1, F.lit(1)))
    return (
        F.when((guess + 1 < n) & (next_point <= value), guess + 2)
        .when((guess >= 0) & (this_point > value), guess)
        .otherwise(guess + 1)
    ).cast("int")


def score_ladder(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores, highest first, with positives and negatives at and down to each."""
    counts = df.groupBy(*keys, "y_prob").agg(
        F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("y_true") == 1, 0).otherwise(1)).cast("bigint").alias("neg"),
    )
    return running_totals(counts, keys=keys, order=[Descending("y_prob")], sums={"tp": "pos", "fp": "neg"})


def ladder_metrics(ladder: DataFrame, max_fpr: float = 1e-4) -> DataFrame:
    """average_precision, roc_auc and recall_at_fpr in one pass over the ladder."""
    totals = one_row(ladder.agg(F.max("tp").alias("p"), F.max("fp").alias("n")))
    marked = ladder.withColumn("_t", totals)
    p, n = F.col("_t.p"), F.col("_t.n")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    above = F.col("tp") - F.col("pos")
    return marked.agg(
        F.coalesce(F.sum(F.when(p > 0, F.col("pos") / p * precision)), F.lit(0.0)).alias("average_precision"),
        F.sum(F.when((p > 0) & (n > 0), F.col("neg") * (above + F.col("pos") / 2.0) / (p * n))).alias("roc_auc"),
        F.coalesce(
            F.max(F.when((p > 0) & (n > 0) & (F.col("fp") / n <= max_fpr), F.col("tp") / p)), F.lit(0.0)
        ).alias("recall_at_fpr"),
    )


def average_precision(df: DataFrame) -> DataFrame:
    return ladder_metrics(score_ladder(df)).select("average_precision")


def average_precision_per(df: DataFrame, key: str) -> DataFrame:
    """(key, average_precision) of each group of rows."""
    reached = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return score_ladder(df, [key]).groupBy(key).agg(
        F.when(F.max("tp") > 0, reached / F.max("tp")).otherwise(F.lit(0.0)).alias("average_precision")
    )


def roc_auc(df: DataFrame) -> DataFrame:
    return ladder_metrics(score_ladder(df)).select("roc_auc")


def recall_at_fpr(df: DataFrame, max_fpr: float = 1e-4) -> DataFrame:
    return ladder_metrics(score_ladder(df), max_fpr).select("recall_at_fpr")


def threshold_counts(df: DataFrame, points: Sequence[float] = F1_GRID) -> DataFrame:
    """tp, fp, fn, tn at every grid threshold (``y_prob >= t``).

    One aggregate brings the table down to at most ``len(points) + 1`` rows; only
    those go through the unpartitioned window.
    """
    spark = df.sparkSession
    binned = df.groupBy(steps_reached(F.col("y_prob"), points).alias("step")).agg(
        F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("y_true") == 1, 0).otherwise(1)).cast("bigint").alias("neg"),
    )
    steps = spark.range(len(points) + 1).select(F.col("id").cast("int").alias("step"))
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = steps.join(binned, "step", "left").na.fill(0)
    table = F.array(*[F.lit(float(p)) for p in points])
    return (
        full.select(
            "step",
            F.sum("pos").over(down).alias("tp"),
            F.sum("neg").over(down).alias("fp"),
            F.sum("pos").over(whole).alias("_p"),
            F.sum("neg").over(whole).alias("_n"),
        )
        .where(F.col("step") >= 1)
        .select(
            F.element_at(table, F.col("step")).alias("threshold"),
            "tp",
            "fp",
            (F.col("_p") - F.col("tp")).alias("fn"),
            (F.col("_n") - F.col("fp")).alias("tn"),
        )
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def smoothed_f1_of(tp: Column, fp: Column, fn: Column, epsilon: float = 1e-8) -> Column:
    precision, recall = tp / (tp + fp + epsilon), tp / (tp + fn + epsilon)
    return 2 * precision * recall / (precision + recall + epsilon)


def best_f1_threshold(df: DataFrame, points: Sequence[float] = F1_GRID, smoothed: bool = False) -> DataFrame:
    """First grid threshold with the highest F1."""
    score = smoothed_f1_of if smoothed else f1_of
    counts = threshold_counts(df, points).withColumn("f1", score(F.col("tp"), F.col("fp"), F.col("fn")))
    best = counts.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("minus_t"))).alias("b"))
    return best.select((-F.col("b.minus_t")).alias("threshold"), F.col("b.f1").alias("f1"))


def confusion_matrix(df: DataFrame, threshold: Column | float = FLAG_THRESHOLD) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit, fraud = F.col("y_prob") >= limit, F.col("y_true") == 1

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")

    return df.agg(
        count(hit & fraud).alias("tp"),
        count(hit & ~fraud).alias("fp"),
        count(~hit & fraud).alias("fn"),
        count(~hit & ~fraud).alias("tn"),
    )


def threshold_metrics(df: DataFrame, threshold: Column | float = FLAG_THRESHOLD) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion_matrix(df, threshold).select(
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
    )


def _top_rows(df: DataFrame, k: int) -> DataFrame:
    """The k best rows with their rank; never more than k rows in the window."""
    best = df.orderBy(F.desc("y_prob"), F.asc("id")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("y_prob"), F.asc("id"))))


def precision_recall_at_k(df: DataFrame, k_values: Sequence[int] = (100, 500, 1000)) -> DataFrame:
    """One row per K that the table is large enough for."""
    totals = one_row(
        df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).alias("pos"),
        )
    )
    per_k = (
        _top_rows(df, max(k_values))
        .select(
            F.explode(F.array(*[F.lit(k) for k in k_values])).alias("k"), "rank", "y_true"
        )
        .where(F.col("rank") <= F.col("k"))
        .groupBy("k")
        .agg(F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).alias("hits"))
        .withColumn("_t", totals)
    )
    return per_k.where(F.col("k") <= F.col("_t.n")).select(
        "k",
        (F.col("hits") / F.col("k")).alias("precision_at_k"),
        (F.col("hits") / (F.col("_t.pos") + 1e-6)).alias("recall_at_k"),
    )


def alert_queue(df: DataFrame, *, score: str, tie: str, budget: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tie)).limit(budget)


def dollar_capture(df: DataFrame, k: int = 100) -> DataFrame:
    """Share of all fraud money that the top K alerts hold."""
    def money(frame):
        return frame.agg(
            F.coalesce(F.sum(F.when(F.col("y_true") == 1, F.col("amount").cast(MONEY))).cast("double"), F.lit(0.0))
        )

    total = money(df).scalar()
    top = money(df.orderBy(F.desc("y_prob"), F.asc("id")).limit(k)).toDF("captured")
    return top.select("captured", total.alias("total"), _ratio(F.col("captured"), total).alias("dollar_capture"))


def evaluate_model(
    df: DataFrame,
    *,
    name: str = "model",
    threshold: float | None = None,
    k_values: Sequence[int] = (100, 500, 1000),
    points: Sequence[float] = F1_GRID,
) -> DataFrame:
    """Full metric row. Without ``threshold`` the best-F1 grid point is taken."""
    ladder = score_ladder(df)
    ranking = ladder_metrics(ladder)
    limit = F.lit(threshold) if threshold is not None else best_f1_threshold(df, points).select("threshold").scalar()
    at = one_row(threshold_metrics(df, limit))
    wide = precision_recall_at_k(df, k_values).agg(
        *[
            F.max(F.when(F.col("k") == k, F.col(f"{m}_at_k"))).alias(f"{m}_at_{k}")
            for k in k_values
            for m in ("precision", "recall")
        ]
    )
    top = one_row(wide)
    flat = ranking.select(
        F.col("average_precision").alias("pr_auc"), "roc_auc", at.alias("_at"), limit.alias("threshold"), top.alias("_top")
    )
    return flat.select(
        F.lit(name).alias("model"), "pr_auc", "roc_auc", "_at.f1", "_at.precision", "_at.recall", "threshold",
        *[f"_top.{m}_at_{k}" for k in k_values for m in ("precision", "recall")],
    )


def model_comparison(rows: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of several models in one table, best PR-AUC first."""
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row, allowMissingColumns=True)
    return result.orderBy(F.desc("pr_auc"))


def segment_comparison(df: DataFrame, segment: str, points: Sequence[float] = F1_GRID) -> DataFrame:
    """Precision, recall and F1 at the flag threshold per segment of one table."""
    hit, fraud = F.col("y_prob") >= FLAG_THRESHOLD, F.col("y_true") == 1
    counts = df.groupBy(segment).agg(
        F.sum(F.when(hit & fraud, 1).otherwise(0)).alias("tp"),
        F.sum(F.when(hit & ~fraud, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & fraud, 1).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        segment,
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
    )


# --- cost -------------------------------------------------------------------------


def cost_curve(
    df: DataFrame,
    points: Sequence[float] = F1_GRID,
    cost_fp: float = COST_FALSE_POSITIVE,
    cost_fn: float = COST_FALSE_NEGATIVE,
) -> DataFrame:
    return threshold_counts(df, points).select(
        "threshold", "fp", "fn", (F.col("fp") * cost_fp + F.col("fn") * cost_fn).alias("cost")
    )


def cost_optimal_threshold(curve: DataFrame) -> DataFrame:
    best = curve.agg(F.min(F.struct("cost", "threshold")).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.cost").alias("cost"))


# --- fixed values: the costed batch -------------------------------------------------
BATCH_SIZE = 10_000
BATCH_FRAUD = 13
BATCH_CLEAN = 9_987


def batch_cost_summary(
    metrics: DataFrame,
    *,
    model: str = "model",
    recall: str = "recall",
    precision_at_100: str = "precision_at_100",
    cost_fp: float = COST_FALSE_POSITIVE,
    cost_fn: float = COST_FALSE_NEGATIVE,
) -> DataFrame:
    """Expected counts and cost of a 10 000 transaction batch with 13 frauds."""
    r, p100 = F.col(recall), F.col(precision_at_100)
    tp, fn = BATCH_FRAUD * r, BATCH_FRAUD * (1.0 - r)
    from_precision = (tp * (1.0 / F.greatest(p100, F.lit(0.01)) - 1.0)).cast("int")
    fp = (
        F.when(p100 > 0, F.least(F.lit(BATCH_CLEAN), F.greatest(F.lit(2), from_precision)))
        .when(r == 0, 0)
        .otherwise(int(BATCH_CLEAN * 0.05))
    )
    return metrics.select(
        F.col(model).alias("model"),
        F.round(tp, 1).alias("expected_tp"),
        F.round(fn, 1).alias("expected_fn"),
        fp.cast("int").alias("expected_fp"),
        F.round(fp * cost_fp + fn * cost_fn, 2).alias("total_expected_cost"),
    )


def cost_savings(summary: DataFrame, baseline: str) -> DataFrame:
    base = summary.where(F.col("model") == baseline).agg(F.max("total_expected_cost")).scalar()
    return summary.select(
        "model", "total_expected_cost", F.round(base - F.col("total_expected_cost"), 2).alias("savings")
    )


# --- serving and fairness -----------------------------------------------------------


def latency_percentiles(df: DataFrame, latency_ms: str) -> DataFrame:
    """p50/p90/p95/p99, max, mean and sequential throughput of a request log."""
    q = one_row(linear_quantiles(df, latency_ms, {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}))
    totals = df.agg(
        F.max(latency_ms).alias("max"),
        F.avg(latency_ms).alias("mean"),
        (F.count(F.lit(1)) / (F.sum(latency_ms) / 1000.0)).alias("requests_per_sec"),
    )
    return totals.withColumn("_q", q).select(
        "_q.p50", "_q.p90", "_q.p95", "_q.p99", "max", "mean", "requests_per_sec"
    )


def category_rates(df: DataFrame, category: str) -> DataFrame:
    """Flag rate and false-positive rate per category."""
    flagged, clean = F.col("y_prob") >= FLAG_THRESHOLD, F.col("y_true") == 0
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(flagged, 1.0).otherwise(0.0)).alias("flag_rate"),
        F.coalesce(F.avg(F.when(clean, F.when(flagged, 1.0).otherwise(0.0))), F.lit(0.0)).alias("false_positive_rate"),
    )


def disparate_impact(df: DataFrame, group: str, protected: str, reference: str, floor: float = 0.80) -> DataFrame:
    """Approval rate of one group over another; fair when at least four fifths."""
    approved = F.when(F.col("y_prob") >= FLAG_THRESHOLD, 0.0).otherwise(1.0)
    rates = df.agg(
        F.avg(F.when(F.col(group) == protected, approved)).alias("protected_rate"),
        F.avg(F.when(F.col(group) == reference, approved)).alias("reference_rate"),
    )
    ratio = F.col("protected_rate") / F.col("reference_rate")
    return rates.select("protected_rate", "reference_rate", ratio.alias("impact_ratio"), (ratio >= floor).alias("passes"))


def detection_summary(df: DataFrame, detectors: Sequence[str], threshold: float = 0.40) -> DataFrame:
    """Per detector column: caught, rates and mean score over the planted accounts."""
    entries = F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("score")) for d in detectors])
    per = df.select(F.explode(entries).alias("e")).groupBy(F.col("e.detector").alias("detector")).agg(
        F.count(F.lit(1)).alias("n_accounts"),
        F.sum(F.when(F.col("e.score") >= threshold, 1).otherwise(0)).cast("bigint").alias("caught_count"),
        F.avg("e.score").alias("mean"),
    )
    share = F.col("caught_count") / F.col("n_accounts")
    return per.select(
        "detector", "n_accounts", "caught_count",
        F.round(share * 100, 1).alias("detection_rate_pct"),
        F.round("mean", 4).alias("mean_score"),
        F.round((1.0 - share) * 100, 1).alias("evasion_success_pct"),
    )
