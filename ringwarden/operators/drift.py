"""Population stability index over scores and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PSI_ALERT, PSI_WARN
from .metrics import one_row

EPSILON = 1e-4


def bin_index(value: Column, low: Column, high: Column, n_bins: int) -> Column:
    """Equal-width bin, the last one closed on the right."""
    spread = high - low
    position = F.when(spread > 0, F.floor((value - low) / spread * n_bins)).otherwise(F.lit(n_bins - 1))
    return F.greatest(F.lit(0), F.least(position, F.lit(n_bins - 1))).cast("int")


def histogram_equal_width(df: DataFrame, value: str, n_bins: int = 10) -> DataFrame:
    """(bin, n) for every bin, empty ones included."""
    bounds = one_row(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    counts = (
        df.where(F.col(value).isNotNull())
        .select(F.col(value), bounds.alias("_b"))
        .groupBy(bin_index(F.col(value), F.col("_b.lo"), F.col("_b.hi"), n_bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").na.fill(0, ["n"])


def psi_bins(reference: DataFrame, current: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(feature, bin, n_reference, n_current) over common bins of both populations.

    One pass finds all ranges, a second counts all bins; rows are added up per
    feature and bin in each task before the shuffle.
    """
    names = list(features)
    both = reference.select(*names, F.lit(1).alias("_ref")).unionAll(
        current.select(*names, F.lit(0).alias("_ref"))
    )
    bounds = one_row(
        both.agg(*[f(F.col(n).cast("double")).alias(f"{p}_{i}") for i, n in enumerate(names)
                   for p, f in (("lo", F.min), ("hi", F.max))])
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                bin_index(F.col(n).cast("double"), F.col(f"_b.lo_{i}"), F.col(f"_b.hi_{i}"), n_bins).alias("bin"),
            )
            for i, n in enumerate(names)
        ]
    )
    return (
        both.withColumn("_b", bounds)
        .select(F.explode(entries).alias("e"), "_ref")
        .groupBy("e.feature", "e.bin")
        .agg(F.sum("_ref").alias("n_reference"), F.sum(F.lit(1) - F.col("_ref")).alias("n_current"))
    )


def psi_from_bins(bins: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """PSI per feature. A bin empty on both sides adds nothing, so it may be absent."""
    totals = bins.groupBy("feature").agg(
        F.sum("n_reference").alias("_tr"), F.sum("n_current").alias("_tc")
    )
    r = F.col("n_reference") / F.col("_tr") + epsilon
    c = F.col("n_current") / F.col("_tc") + epsilon
    return bins.join(totals, "feature").groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def psi_features(reference: DataFrame, current: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    return psi_from_bins(psi_bins(reference, current, features, n_bins))


def psi_single(reference: DataFrame, current: DataFrame, value: str, n_bins: int = 10) -> DataFrame:
    return psi_features(reference, current, [value], n_bins).select("psi")


def drift_status(psi: Column) -> Column:
    return F.when(psi >= PSI_ALERT, "DRIFTED").when(psi >= PSI_WARN, "WARNED").otherwise("STABLE")


def drift_report(reference: DataFrame, current: DataFrame, *, score: str, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """PSI and status of the score and every feature, with the overall verdict."""
    rows = psi_features(reference, current, [score, *features], n_bins).withColumn(
        "status", drift_status(F.col("psi"))
    )
    verdict = rows.agg(F.max(F.col("psi") >= PSI_ALERT)).scalar()
    return rows.withColumn("has_drift", verdict)


def batch_score_summary(scored: DataFrame, reference: DataFrame) -> DataFrame:
    """Totals of a scored batch: flags, cache hits, score PSI and alert."""
    psi = psi_single(
        reference.select(F.col("y_prob").alias("_s")), scored.select(F.col("y_prob").alias("_s")), "_s"
    ).scalar()
    totals = scored.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.sum(F.when(F.col("is_flagged"), 1).otherwise(0)).cast("bigint").alias("flagged_accounts"),
        F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).cast("bigint").alias("cache_hits"),
    )
    return totals.select(
        "total_accounts", "flagged_accounts",
        (F.col("flagged_accounts") / F.col("total_accounts")).alias("flag_rate"),
        "cache_hits", psi.alias("drift_psi"), (psi >= PSI_ALERT).alias("drift_alert"),
    )
