"""The full review record of an account: score, reasons, what-if, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COUNTERFACTUAL_TARGET, FLAG_THRESHOLD
from ..functions import explain, probability, scoring
from ..functions.scoring import champion_score, feature_columns


def with_counterfactual(
    df: DataFrame, *, prob: str = "prob", score: explain.ScoreFunction = champion_score,
    target: float = COUNTERFACTUAL_TARGET, name: str = "counterfactual",
) -> DataFrame:
    """Adds the counterfactual struct; each step is scored once, as a column."""
    f = feature_columns()
    path = explain.counterfactual_path(f, score)
    steps = [f"_step_{i}" for i in range(len(path))]
    staged = df.withColumns({step: after for step, (_, _, after) in zip(steps, path)})
    result = explain.counterfactual(f, F.col(prob), [F.col(s) for s in steps], target)
    return staged.withColumn(name, result).drop(*steps)


def review_accounts(
    matrix: DataFrame, nearline: DataFrame | None = None, *, score: explain.ScoreFunction = champion_score,
    fallback: float = 0.05, model_version: str = "v2.0-champion",
) -> DataFrame:
    """One advisory record per account.

    ``nearline``: (account_id, score), unexpired scores only. A record that breaks
    no rule but cannot be scored gets ``fallback``.
    """
    f = feature_columns()
    scored = matrix.withColumn("_raw", F.coalesce(score(f), F.lit(fallback)))
    if nearline is None:
        scored = scored.withColumn("_near", F.lit(None).cast("double"))
    else:
        scored = scored.join(nearline.select("account_id", F.col("score").alias("_near")), "account_id", "left")
    blended = scored.withColumn("prob", scoring.nearline_blend(F.col("_raw"), F.col("_near")))
    typed = blended.withColumns({
        "_tier": scoring.risk_tier(F.col("prob")), "_ring": scoring.ring_type(f, F.col("prob")),
        "_flag": scoring.is_flagged(F.col("prob")),
    })
    p, ring, tier = F.col("prob"), F.col("_ring"), F.col("_tier")
    return with_counterfactual(typed, score=score).select(
        "account_id",
        F.round(p, 6).alias("fraud_probability"),
        F.col("_flag").alias("is_flagged"),
        tier.alias("risk_tier"),
        explain.top_contributors(f, 4).alias("top_contributing_features"),
        F.lit(model_version).alias("model_version"),
        F.col("_near").isNotNull().alias("cache_hit"),
        F.round("_near", 6).alias("nearline_score"),
        scoring.recommended_action(p, ring).alias("recommended_action"),
        F.lit(True).alias("human_confirmation_required"),
        explain.briefing(F.col("account_id"), p, tier, f, ring).alias("briefing"),
        F.col("counterfactual"),
        explain.attribution(f).alias("attribution"),
        F.lit(FLAG_THRESHOLD).alias("cost_optimal_threshold"),
        F.round(probability.bayes_threshold(), 4).alias("theoretical_bayes_threshold"),
        scoring.expected_review_cost(F.col("_flag")).alias("expected_cost"),
        ring.alias("ring_type"),
        F.struct(*[c.alias(n) for n, c in scoring.sub_risks(f).items()]).alias("sub_risks"),
    )
