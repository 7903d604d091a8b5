"""Reliability, expected calibration error and the three calibrators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FLAG_THRESHOLD
from ..functions import probability as prob
from ..functions.scoring import clip
from ..session import shuffle_width, store
from .graph import sampling_key
from .metrics import grid, one_row, steps_reached
from .ordered import Ascending, Descending, global_rank, running_totals

Calibrator = Callable[[DataFrame], DataFrame]


def brier_score(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col("y_prob") - F.col("y_true"), F.lit(2.0))).alias("brier_score"))


def ece_bins(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_y, mean_p) of equal bins on [0, 1], closed on the left; the last on both."""
    edges = grid(0.0, 1.0, n_bins + 1)
    inside = df.where((F.col("y_prob") >= 0) & (F.col("y_prob") <= 1))
    index = F.least(steps_reached(F.col("y_prob"), edges) - 1, F.lit(n_bins - 1))
    return inside.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("mean_y"), F.avg("y_prob").alias("mean_p")
    )


def ece(df: DataFrame, n_bins: int = 10) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    gap = F.col("n") / F.col("total") * F.abs(F.col("mean_y") - F.col("mean_p"))
    return ece_bins(df, n_bins).withColumn("total", total).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("ece"))


def reliability_curve(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Mean label and mean score per non-empty bin; bins are closed on the right."""
    edges = grid(0.0, 1.0, n_bins + 1)
    table = F.array(*[F.lit(e) for e in edges])
    reached = steps_reached(F.col("y_prob"), edges)
    on_edge = F.element_at(table, F.greatest(reached, F.lit(1))) == F.col("y_prob")
    index = F.greatest(F.lit(0), F.least(F.when(on_edge, reached - 2).otherwise(reached - 1), F.lit(n_bins - 1)))
    return df.groupBy(index.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("prob_true"), F.avg("y_prob").alias("prob_pred")
    )


# --- temperature ------------------------------------------------------------------


def fit_temperature(df: DataFrame, *, low: float = 0.05, high: float = 20.0, points: int = 25, rounds: int = 5) -> float:
    """Temperature with the least log loss of ``logit / T``.

    The loss has one minimum in T. Each round is one aggregate that prices all
    candidates at once over the distinct scores; the driver sees ``points`` numbers.
    """
    counts = df.groupBy("y_prob").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("pos")
    ).persist()
    logit = prob.prob_to_logit(F.col("y_prob"))
    for _ in range(rounds):
        candidates = [low * (high / low) ** (k / (points - 1)) for k in range(points)]
        losses = counts.agg(
            *[F.sum(_weighted_loss(prob.scaled_probability(logit, t))).alias(f"l{k}") for k, t in enumerate(candidates)]
        ).first()
        best = min(range(points), key=lambda k: (losses[f"l{k}"], k))
        chosen = candidates[best]
        low, high = candidates[max(best - 1, 0)], candidates[min(best + 1, points - 1)]
    counts.unpersist()
    return max(chosen, 0.05)


def _weighted_loss(p: Column) -> Column:
    p = clip(p, 1e-7, 1.0 - 1e-7)
    return -(F.col("pos") * F.log(p) + (F.col("n") - F.col("pos")) * F.log(1.0 - p))


def temperature_calibrator(fit_on: DataFrame) -> Calibrator:
    t = fit_temperature(fit_on)
    return lambda df: df.withColumn(
        "y_cal", clip(prob.scaled_probability(prob.prob_to_logit(F.col("y_prob")), t), 0.0, 1.0)
    )


# --- Platt ------------------------------------------------------------------------


def fit_platt(fit_on: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the score, regularised as ``C = 1``.

    Newton's method on rows added up per score: a round is one aggregate of five sums.
    """
    counts = fit_on.groupBy(F.col("y_prob").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("double")).alias("pos")
    ).persist()
    start = counts.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    slope, intercept = 0.0, math.log((start["pos"] + 0.5) / (start["n"] - start["pos"] + 0.5)) if start["n"] else 0.0
    x, n = F.col("x"), F.col("n")
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-(F.lit(slope) * x + F.lit(intercept))))
        s = counts.agg(
            F.sum((n * p - F.col("pos")) * x).alias("gx"), F.sum(n * p - F.col("pos")).alias("g1"),
            F.sum(n * p * (1.0 - p) * x * x).alias("hxx"), F.sum(n * p * (1.0 - p) * x).alias("hx1"), F.sum(n * p * (1.0 - p)).alias("h11"),
        ).first()
        if s["h11"] is None:
            break
        gx, hxx = s["gx"] + slope, s["hxx"] + 1.0
        area = hxx * s["h11"] - s["hx1"] ** 2
        if area <= 0:  # all rows of one label: the intercept alone would run away
            break
        step = ((s["h11"] * gx - s["hx1"] * s["g1"]) / area, (hxx * s["g1"] - s["hx1"] * gx) / area)
        slope, intercept = slope - step[0], intercept - step[1]
        if max(map(abs, step)) < 1e-12:
            break
    counts.unpersist()
    return slope, intercept


def platt_calibrator(fit_on: DataFrame) -> Calibrator:
    slope, intercept = fit_platt(fit_on)
    return lambda df: df.withColumn("y_cal", 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("y_prob") + F.lit(intercept)))))


# --- isotonic ---------------------------------------------------------------------

# Slices that one task pools into one, and blocks up to which the fit is broadcast (32 bytes each).
SLICES_TOGETHER = 16
BROADCAST_BLOCKS = 1_000_000
_BLOCK = "part int, lo double, hi double, n long, pos long"


def _pooled(lo, hi, n, pos) -> list[list]:
    """Adjacent violators pooled from left to right; columns of the blocks left, means strictly rising.

    Means are compared in whole numbers, so the result does not depend on how the points were cut up.
    """
    out: list[list] = [[], [], [], []]
    los, his, ns, sums = out
    for a, b, k, y in zip(lo, hi, n, pos):
        while ns and sums[-1] * k >= y * ns[-1]:
            a = los.pop()
            his.pop()
            k += ns.pop()
            y += sums.pop()
        los.append(a)
        his.append(b)
        ns.append(k)
        sums.append(y)
    return out


def isotonic_blocks(fit_on: DataFrame) -> DataFrame:
    """(lo, hi, n, pos): the blocks of the best rising step function of the label over the score, exact.

    Rows are added up per score, so a frequent score is one point. Scores are range-split, each slice pools its points, and
    neighbouring slices are then pooled together, a few at a time: pooling the blocks of pooled slices gives what pooling
    all points would. The means of blocks rise strictly, so N rows leave about N**(2/3) blocks at most, and mostly
    a few hundred, however many scores there are. Null and NaN scores, and null labels, take no part.
    """
    known = fit_on.where(F.col("y_true").isNotNull() & F.col("y_prob").isNotNull() & ~F.isnan("y_prob"))
    points = known.groupBy(F.col("y_prob").cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("pos")
    )
    slices = shuffle_width(fit_on.sparkSession)
    ranged = points.repartitionByRange(slices, "x").sortWithinPartitions("x").select("x", "n", "pos")

    def pool_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[list] = [[], [], [], []]
        for batch in batches:
            x, n, pos = (c.to_pylist() for c in batch.columns)
            held = _pooled(held[0] + x, held[1] + x, held[2] + n, held[3] + pos)
        yield _blocks(part, held)

    def pool_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        return pa.Table.from_batches([_blocks(table.column("part")[0].as_py(), _pooled(*(table.column(c).to_pylist() for c in ("lo", "hi", "n", "pos"))))])

    blocks = store(ranged.mapInArrow(pool_slice, _BLOCK), "isotonic")
    while slices > 1:
        slices = -(-slices // SLICES_TOGETHER)
        together = blocks.withColumn("part", F.floor(F.col("part") / SLICES_TOGETHER).cast("int"))
        blocks = store(together.groupBy("part").applyInArrow(pool_group, _BLOCK), "isotonic")
    return blocks.drop("part")


def _blocks(part: int, columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.int32()), *arrays], names=["part", "lo", "hi", "n", "pos"])


def isotonic_calibrator(fit_on: DataFrame) -> Calibrator:
    """The exact monotone fit, linear between its blocks, clipped outside; null and NaN scores stay uncalibrated (null)."""
    blocks = isotonic_blocks(fit_on).withColumn("v", F.col("pos") / F.col("n"))
    count = blocks.count()
    if not count:
        return lambda df: df.withColumn("y_cal", F.lit(None).cast("double"))
    if count <= BROADCAST_BLOCKS:
        rows = blocks.select("lo", "hi", "v").orderBy("lo").collect()
        knots = np.array([(x, r["v"]) for r in rows for x in (r["lo"], r["hi"])]).T
        return lambda df: _interpolated(df, knots)
    knots = blocks.select(F.explode(F.array("lo", "hi")).alias("x"), "v").distinct()
    return lambda df: _interpolated_in_order(df, knots)


def _interpolated(df: DataFrame, knots: np.ndarray) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(knots)

    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x.to_numpy(dtype=float, na_value=np.nan), *shared.value))

    return df.withColumn("y_cal", F.nanvl(value(F.col("y_prob").cast("double")), F.lit(None).cast("double")))


def _interpolated_in_order(df: DataFrame, knots: DataFrame) -> DataFrame:
    """The same for fits of any size: scores and knots stand in one order, and each score looks at the knots on both sides."""
    scores = df.select(F.col("y_prob").cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).distinct()
    both = knots.select("x", F.struct("x", "v").alias("knot")).unionByName(
        scores.join(knots, "x", "left_anti").select("x", F.lit(None).cast("struct<x:double,v:double>").alias("knot"))
    )
    seen = running_totals(both, order=[Ascending("x")], lasts={"below": "knot"})
    seen = running_totals(seen, order=[Descending("x")], lasts={"above": "knot"})
    x0, v0, x1, v1 = (F.col(c) for c in ("below.x", "below.v", "above.x", "above.v"))
    inside = F.when(x1 > x0, v0 + (F.col("x") - x0) * (v1 - v0) / (x1 - x0)).otherwise(v0)
    values = seen.select("x", F.when(x0.isNull(), v1).when(x1.isNull(), v0).otherwise(inside).alias("y_cal"))
    return df.join(values.withColumnRenamed("x", "_x"), F.col("y_prob").cast("double") == F.col("_x"), "left").drop("_x")


CALIBRATORS: dict[str, Callable[[DataFrame], Calibrator]] = {
    "platt": platt_calibrator,
    "temperature": temperature_calibrator,
    "isotonic": isotonic_calibrator,
}


def stratified_halves(df: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``part`` fit / test: the rows of each label take turns in hash order, so both parts have its share to one row."""
    keyed = df.withColumn("_key", sampling_key("id", seed=seed))
    ranked = global_rank(keyed, keys=["y_true"], order=[Ascending("_key"), Ascending("id")], name="_r")
    return ranked.withColumn("part", F.when(F.col("_r") % 2 == 1, "fit").otherwise("test")).drop("_key", "_r")


def _metric_row(df: DataFrame, name: str) -> DataFrame:
    e = ece(df).scalar()
    return brier_score(df).select(
        F.lit(name).alias("method"), F.round("brier_score", 5).alias("brier_score"), F.round(e, 5).alias("ece")
    )


def calibration_compare(fit_on: DataFrame, test: DataFrame) -> DataFrame:
    """Brier and ECE on ``test``: uncalibrated and each method fitted on ``fit_on``."""
    result = _metric_row(test, "Uncalibrated")
    for name, fit in CALIBRATORS.items():
        calibrated = fit(fit_on)(test).withColumn("y_prob", F.col("y_cal"))
        result = result.unionByName(_metric_row(calibrated, name.capitalize()))
    return result


def calibration_lift(fit_on: DataFrame, test: DataFrame, method: str = "isotonic") -> DataFrame:
    """Before and after metrics with their reduction in percent."""
    calibrated = CALIBRATORS[method](fit_on)(test).withColumn("y_prob", F.col("y_cal"))
    after = one_row(brier_score(calibrated).select("brier_score", ece(calibrated).scalar().alias("ece")))
    before = brier_score(test).select("brier_score", ece(test).scalar().alias("ece"), after.alias("_after"))

    def reduction(name):
        return F.round((1.0 - F.col(f"_after.{name}") / F.greatest(F.col(name), F.lit(1e-6))) * 100, 2)

    return before.select(
        F.lit(method).alias("method"),
        F.round("brier_score", 5).alias("brier_before"),
        F.round("_after.brier_score", 5).alias("brier_after"),
        F.round("ece", 5).alias("ece_before"),
        F.round("_after.ece", 5).alias("ece_after"),
        reduction("brier_score").alias("brier_reduction_pct"),
        reduction("ece").alias("ece_reduction_pct"),
        F.round(prob.bayes_threshold(), 6).alias("bayes_optimal_threshold"),
        F.lit(FLAG_THRESHOLD).alias("operational_threshold"),
    )
