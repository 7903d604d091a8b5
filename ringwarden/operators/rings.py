"""Candidate rings: reports, members, and evaluation against known rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_SCORE
from ..session import store
from .graph import linked_components
from .ordered import Ascending, global_rank
from .spread import per_key

MONEY = "decimal(18,2)"
# entity kind -> payment column
ENTITY_COLUMNS = {
    "member": "customer_id",
    "merchant": "merchant_id",
    "device": "device_id",
    "ip": "ip_id",
    "address": "address_id",
    "promo": "promo_id",
}
JACCARD_FLOOR = 0.2


def ring_payments(payments: DataFrame, **linking) -> DataFrame:
    """Payments that belong to a cluster of at least two, with ``component``."""
    return payments.join(linked_components(payments, **linking), "transaction_id")


def ring_entities(clustered: DataFrame) -> DataFrame:
    """(component, kind, entity): every distinct member and shared identifier.

    One row per entity, so a ring of any size stays spread over the cluster.
    """
    entries = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("entity")) for k, c in ENTITY_COLUMNS.items()]
    )
    return (
        clustered.select("component", F.explode(entries).alias("e"))
        .where(F.col("e.entity").isNotNull() & (F.col("e.entity") != ""))
        .select("component", "e.kind", "e.entity")
        .distinct()
    )


def ring_entity_lists(entities: DataFrame, chunk_size: int = 1000) -> DataFrame:
    """The same entities as lists of about ``chunk_size``, numbered from 0.

    Rings up to that size get one list per kind; a larger ring gets several, so
    no list grows with the ring. Nothing is left out.
    """
    sizes = per_key(entities.groupBy("component", "kind").agg(F.count(F.lit(1)).alias("n")))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_size)).cast("int")
    return (
        entities.join(sizes, ["component", "kind"])
        .withColumn("chunk", F.pmod(F.xxhash64("entity"), chunks).cast("int"))
        .groupBy("component", "kind", "chunk")
        .agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    )


def risk_score_lookup(members: DataFrame, scores: DataFrame, *, member: str, default: float = DEFAULT_SCORE) -> DataFrame:
    known = scores.select(F.col("customer_id").alias("_id"), F.col("score").alias("_score"))
    return members.join(known, F.col(member) == F.col("_id"), "left").select(
        *members.columns, F.coalesce("_score", F.lit(default)).alias("score")
    )


def synchronization(first: Column, last: Column, n: Column) -> Column:
    """``1 / (1 + mean gap in hours)``; the mean gap needs only the two ends."""
    gap = (last - first) / (n - 1)
    score = F.lit(1.0) / (F.lit(1.0) + gap / 3600.0)
    return F.when(n > 1, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))


def concentration_level(concentration: Column) -> Column:
    return F.when(concentration >= 0.70, "CRITICAL").when(concentration >= 0.40, "HIGH").otherwise("MEDIUM")


def cross_merchant(merchants: Column) -> Column:
    return F.least(F.lit(1.0), merchants / 3.0)


def predicted_type(promos, devices, addresses, any_rto, any_chargeback, sync) -> Column:
    return (
        F.when((promos > 0) & (devices <= 2), "PROMO_ABUSE_SYNDICATE")
        .when(any_rto | (addresses == 1), "RTO_RETURN_FRAUD_LOOP")
        .when(any_chargeback, "CHARGEBACK_COLLUSION_CLUSTER")
        .when(sync > 0.8, "ATO_VELOCITY_SURGE")
        .otherwise("COORDINATED_MULE_RING")
    )


def ring_concentration(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score of each ring's distinct members, with its level."""
    members = entities.where(F.col("kind") == "member").select(
        "component", F.col("entity").alias("customer_id")
    )
    scored = risk_score_lookup(members, scores, member="customer_id")
    # exact sum, so the mean does not depend on the order of the members
    total = F.sum(F.col("score").cast("decimal(18,6)")).cast("double")
    mean = scored.groupBy("component").agg((total / F.count(F.lit(1))).alias("concentration"))
    return mean.withColumn("level", concentration_level(F.col("concentration")))


def ring_timing(clustered: DataFrame) -> DataFrame:
    """Per ring: size, volume, flags, first payment and synchronisation."""
    at = F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0))
    grouped = clustered.groupBy("component").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(F.sum(F.col("amount").cast(MONEY)), F.lit(0)).cast("decimal(28,2)").alias("total_exposure"),
        F.min(at).alias("detected_at"),
        F.max(at).alias("last_at"),
        F.max(F.coalesce(F.col("rto_flag") != 0, F.lit(False))).alias("any_rto"),
        F.max(F.coalesce(F.col("chargeback_flag") != 0, F.lit(False))).alias("any_chargeback"),
    )
    return grouped.withColumn(
        "sync", synchronization(F.col("detected_at"), F.col("last_at"), F.col("transaction_count"))
    )


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("component").agg(
        *[
            F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
            for kind in ENTITY_COLUMNS
        ]
    )


def ring_report(
    payments: DataFrame, scores: DataFrame, *, min_concentration: float | None = None, **linking
) -> DataFrame:
    """One row per ring; members and identifiers are in ``ring_entities``.

    ``min_concentration`` drops rings whose mean member score is lower; off by default.
    """
    clustered = store(ring_payments(payments, **linking), "ring-payments")
    return report_from(clustered, store(ring_entities(clustered), "ring-entities"), scores, min_concentration=min_concentration)


def report_from(
    clustered: DataFrame, entities: DataFrame, scores: DataFrame, *, min_concentration: float | None = None
) -> DataFrame:
    joined = (
        ring_timing(clustered)
        .join(entity_counts(entities), "component", "left")
        .join(ring_concentration(entities, scores), "component", "left")
        .na.fill(0, [f"n_{k}" for k in ENTITY_COLUMNS])
    )
    concentration = F.coalesce("concentration", F.lit(DEFAULT_SCORE))
    if min_concentration is not None:
        joined = joined.where(concentration >= min_concentration)
    typed = joined.select(
        "component",
        "detected_at",
        F.col("n_member").alias("entity_count"),
        "transaction_count",
        F.col("n_merchant").alias("merchant_count"),
        F.col("n_device").alias("device_count"),
        F.col("n_ip").alias("ip_count"),
        F.col("n_address").alias("address_count"),
        F.col("n_promo").alias("promo_count"),
        "total_exposure",
        F.round(concentration, 3).alias("fraud_concentration"),
        F.round("sync", 3).alias("temporal_synchronization_score"),
        F.round(cross_merchant(F.col("n_merchant")), 3).alias("cross_merchant_connectivity"),
        predicted_type(
            F.col("n_promo"), F.col("n_device"), F.col("n_address"),
            F.col("any_rto"), F.col("any_chargeback"), F.col("sync"),
        ).alias("predicted_ring_type"),
        concentration_level(concentration).alias("risk_level"),
    )
    numbered = global_rank(typed, order=[Ascending("component")], name="ring_number")
    return numbered.select(
        F.concat(
            F.lit("RING_"), _padded(F.col("ring_number")), F.lit("_"), F.col("predicted_ring_type")
        ).alias("ring_id"),
        *typed.columns,
    )


def _padded(number: Column) -> Column:
    """At least three digits, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0"))


def ring_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("total_rings"),
        F.coalesce(F.sum("total_exposure"), F.lit(0)).cast("decimal(28,2)").alias("total_exposure"),
    )


# --- evaluation -------------------------------------------------------------------


def ring_truth_match(members: DataFrame, truth: DataFrame, *, floor: float = JACCARD_FLOOR) -> DataFrame:
    """(component, ring_id, overlap, jaccard) of detected and true rings that match.

    ``members``: (component, customer_id). ``truth``: (ring_id, customer_id, ...).
    Counted over an equi-join on the member, so rings without a common member
    never meet.
    """
    detected = members.select("component", "customer_id").distinct()
    known = truth.select("ring_id", "customer_id").distinct()
    detected_sizes = detected.groupBy("component").agg(F.count(F.lit(1)).alias("n_detected"))
    known_sizes = known.groupBy("ring_id").agg(F.count(F.lit(1)).alias("n_true"))
    overlap = detected.join(known, "customer_id").groupBy("component", "ring_id").agg(
        F.count(F.lit(1)).alias("overlap")
    )
    union = F.col("n_detected") + F.col("n_true") - F.col("overlap")
    return (
        overlap.join(detected_sizes, "component")
        .join(known_sizes, "ring_id")
        .select("component", "ring_id", "overlap", (F.col("overlap") / union).alias("jaccard"))
        .where(F.col("jaccard") >= floor)
    )


def member_jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two bounded lists; for unbounded rings use ``ring_truth_match``."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def post_detection_loss(matches: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """Per matching pair: amounts by true members at or after detection.

    ``matches``: (component, ring_id, detected_at). A true ring matched by two
    detected ones counts in both pairs.
    """
    at = F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0))
    paid = events.select(
        F.col("customer_id"), at.alias("paid_at"), F.coalesce("amount", F.lit(0.0)).cast(MONEY).alias("paid")
    )
    # both joins below read the pairs
    matches = store(matches, "matches")
    suspects = matches.join(truth.select("ring_id", "customer_id").distinct(), "ring_id")
    lost = (
        suspects.join(paid, "customer_id")
        .where(F.col("paid_at") >= F.col("detected_at"))
        .groupBy("component", "ring_id")
        .agg(F.sum("paid").cast("decimal(28,2)").alias("prevented"))
    )
    return matches.join(lost, ["component", "ring_id"], "left").na.fill(0, ["prevented"])


def ring_eval(report: DataFrame, members: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """Recall, mean time to first detection and loss prevented, as one row."""
    detected_at = report.select("component", "detected_at")
    started = truth.groupBy("ring_id").agg(F.min("start_timestamp").cast("double").alias("started_at"))
    matches = ring_truth_match(members, truth).join(detected_at, "component").join(started, "ring_id")
    delay = F.greatest(F.lit(0.0), F.col("detected_at") - F.coalesce("started_at", "detected_at"))
    pairs = post_detection_loss(matches.withColumn("delay", delay), truth, events)
    totals = pairs.agg(
        F.countDistinct("ring_id").alias("matched_true_rings"),
        F.coalesce(F.avg("delay"), F.lit(0.0)).alias("delay"),
        F.coalesce(F.sum("prevented"), F.lit(0)).cast("decimal(28,2)").alias("future_loss_prevented"),
    )
    n_true = truth.agg(F.countDistinct("ring_id")).scalar()
    n_detected = report.agg(F.count(F.lit(1))).scalar()
    return totals.select(
        n_true.alias("total_true_rings"),
        n_detected.alias("detected_rings_count"),
        "matched_true_rings",
        F.round(
            F.when(n_true == 0, F.lit(1.0)).otherwise(F.col("matched_true_rings") / n_true), 4
        ).alias("ring_recall"),
        F.round("delay", 1).alias("mean_ttfd_seconds"),
        "future_loss_prevented",
    )
