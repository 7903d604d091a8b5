"""Probability arithmetic: priors, logits, losses, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE, DEPLOYED_BASE_RATE
from .scoring import clip, sigmoid


def prior_correction(
    probability: Column,
    sampled_rate: Column | float,
    deployed_rate: float = DEPLOYED_BASE_RATE,
    epsilon: float = 1e-7,
) -> Column:
    """Move a score from the training base rate to the deployed one by odds."""
    p = clip(probability, epsilon, 1.0 - epsilon)
    sampled = F.lit(sampled_rate) if isinstance(sampled_rate, float) else sampled_rate
    factor = F.lit(deployed_rate / (1.0 - deployed_rate)) / (sampled / (1.0 - sampled))
    odds = p / (1.0 - p) * factor
    return clip(odds / (1.0 + odds), 0.0, 1.0)


def bayes_threshold(
    cost_fp: Column | float = COST_FALSE_POSITIVE, cost_fn: Column | float = COST_FALSE_NEGATIVE
) -> Column:
    fp = cost_fp if isinstance(cost_fp, Column) else F.lit(cost_fp)
    fn = cost_fn if isinstance(cost_fn, Column) else F.lit(cost_fn)
    return fp / (fp + fn)


def prob_to_logit(probability: Column, epsilon: float = 1e-6) -> Column:
    p = clip(probability, epsilon, 1.0 - epsilon)
    return F.log(p / (1.0 - p))


def scaled_probability(logit: Column, temperature: Column | float, limit: float = 30.0) -> Column:
    return sigmoid(clip(logit / temperature, -limit, limit))


def log_loss(probability: Column, target: Column, epsilon: float = 1e-7) -> Column:
    p = clip(probability, epsilon, 1.0 - epsilon)
    return -(target * F.log(p) + (1.0 - target) * F.log(1.0 - p))


def focal_loss(logit: Column, target: Column, alpha: float = 0.5, gamma: float = 2.0) -> Column:
    """Per-row focal loss; reduce with ``avg`` or ``sum``."""
    # log(1 + e^-|x|) form, stable for large logits
    cross_entropy = (
        F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    )
    p = sigmoid(logit)
    p_true = F.when(target == 1, p).otherwise(1.0 - p)
    weight = F.when(target == 1, alpha).otherwise(1.0 - alpha)
    return weight * F.pow(1.0 - p_true, F.lit(gamma)) * cross_entropy
