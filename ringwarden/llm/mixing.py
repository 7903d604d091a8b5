"""Soft-membership mixing: rates of documents whose expected domain tokens match target weights.

DataFrame functions only. A naive Bayes classifier over cheap measures of the text, counted on a
labelled table, gives every document a posterior over domains. Projected gradient steps then fit a
nonnegative rate for each document, so that the sums of rate x tokens x posterior come close to the targets in
the sense of least squares. Only sums with one entry per domain, or pair of domains, reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .support import texts_of

# Steps of each measure, and pseudo-counts of its classes.
BINS = 16
SMOOTHING = 1.0
# Posteriors never come nearer to 0 than this, so that no document is bound to one domain.
FLOOR = 1e-4
MAX_STEPS = 12
# Stop when the targets are met, or no step moves a rate or the distance, to this share.
TOLERANCE = 1e-6
# Distance to the targets, as a share of all tokens wanted, above which a fit is reported as missed.
MAX_DISTANCE = 0.005
# Room over the least total that the targets allow, and how often a derived total is raised by it.
TOTAL_ROOM = 1.1
MAX_TOTALS = 8


def tokens(text: Column) -> Column:
    """Runs of other than white space: the size that targets are stated in."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def measures(text: Column) -> Column:
    """array of the bin of each measure, all of them functions of the whole text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(text, "[ \n]+")
    lines = F.split(text, "\n")
    n_words = F.size(words).cast("double")
    share = lambda c: F.floor(F.sqrt(c / n) * BINS)
    values = [
        F.floor(F.log2(n_words)),
        F.floor(n / n_words),
        F.floor(F.size(F.array_distinct(words)) / n_words * BINS),
        F.floor(F.size(F.array_distinct(lines)) / F.size(lines) * BINS),
        F.floor(F.log2(n_words / F.size(lines)) + 4),
        share(n - F.length(F.translate(text, "#*$%&|<>!", ""))),
        share(n - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ""))),
    ]
    return F.array(*(F.least(F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)), F.lit(BINS - 1)).cast("int") for v in values))


N_MEASURES = 7


@dataclass
class Mixture:
    """A fitted classifier and rates; ``rate`` and ``posterior`` are Columns over a column of measures."""

    domains: list[str]
    log_prior: np.ndarray
    log_share: np.ndarray  # domain, measure, bin
    steps: list[np.ndarray] = field(default_factory=list)
    min_rate: float = 0.0
    start: float = 1.0
    shares: dict[str, float] = field(default_factory=dict)  # expected token share of each domain at the rates
    distance: float = 0.0  # what is left between the expected domain tokens and the targets, as a share of all wanted

    def posterior(self, bins: Column) -> Column:
        """array of one probability per domain."""
        scores = []
        for d in range(len(self.domains)):
            terms = [F.get(F.array(*(F.lit(float(x)) for x in self.log_share[d, m])), F.get(bins, F.lit(m))) for m in range(N_MEASURES)]
            scores.append(reduce(lambda a, b: a + b, terms, F.lit(float(self.log_prior[d]))))
        raised = _let(F.array(*scores), lambda s: F.transform(s, lambda x: F.greatest(F.exp(x - F.array_max(s)), F.lit(FLOOR))))
        return _let(raised, lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, y: a + y)))

    def rate(self, posterior: Column) -> Column:
        start = F.lit(float(max(self.start, self.min_rate)))
        if not self.steps:
            return start
        steps = F.array(*(F.array(*(F.lit(float(x)) for x in step)) for step in self.steps))

        def after(rate: Column, step: Column) -> Column:
            move = reduce(lambda a, b: a + b, (F.get(step, F.lit(d)) * F.get(posterior, F.lit(d)) for d in range(len(self.domains))))
            return F.greatest(F.lit(float(self.min_rate)), rate - move)

        return F.aggregate(steps, start, after)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fit_classifier(table: DataFrame, labelled: DataFrame) -> Mixture:
    """``table``: doc_id, bins. ``labelled``: doc_id, domain; rows with a null count for nothing.

    Of several labels of a document the smallest counts. Without labels there is one domain, "all".
    """
    one = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    seen = table.select("doc_id", "bins").join(one, "doc_id").select("domain", F.posexplode("bins").alias("m", "bin"))
    counts = seen.groupBy("domain", "m", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # domains x measures x bins
    domains = sorted({r["domain"] for r in counts}) or ["all"]
    n = np.zeros((len(domains), N_MEASURES, BINS))
    for r in counts:
        n[domains.index(r["domain"]), r["m"], r["bin"]] = r["n"]
    docs = n[:, 0].sum(axis=1) + SMOOTHING
    smooth = n + SMOOTHING
    return Mixture(domains, np.log(docs / docs.sum()), np.log(smooth / smooth.sum(axis=2, keepdims=True)))


def fit_rates(table: DataFrame, mixture: Mixture, target: dict[str, float], total_factor: float | None = 1.0, min_rate: float = 0.0) -> Mixture:
    """Projected gradient on half the squared distance of expected domain tokens to the targets.

    Targets are ``target`` weights of ``total_factor`` times all tokens. The gradient is taken in the metric of
    the tokens, and scaled by the sums of tokens x posterior x posterior over documents off the bound, which makes a
    step without bound exact. ``min_rate`` 0 allows a document to be left out; 1 only repeats documents.
    Domains that no document is labelled with have no posterior and their weight is spread over the others.

    With ``total_factor`` None the total follows from the bound: a domain holds at least ``min_rate`` times its tokens, so
    the total is the largest such share / weight with some room, raised until the targets are met. The shares reached and the
    distance left are kept in the mixture, and a distance above MAX_DISTANCE is warned of.
    """
    weights = np.array([max(0.0, target.get(d, 0.0)) for d in mixture.domains])
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(weights), 1 / len(weights))
    # rates follow from posteriors alone, and few of these are different
    table = store(table.groupBy("p").agg(F.sum("tokens").alias("tokens")), "posterior-tokens")
    if total_factor is not None:
        _descend(table, mixture, weights, total_factor, min_rate)
    else:
        held = table.agg(F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * F.get("p", F.lit(d))).alias(f"e{d}") for d in range(len(weights)))).first()
        bound = [held[f"e{d}"] / held["all"] / w for d, w in enumerate(weights) if w > 0] if held["all"] else []
        factor = max([1.0, *(min_rate * b * TOTAL_ROOM for b in bound)])
        for _ in range(MAX_TOTALS):
            _descend(table, mixture, weights, factor, min_rate)
            if mixture.distance <= MAX_DISTANCE:
                break
            factor *= TOTAL_ROOM
    if mixture.distance > MAX_DISTANCE:
        warnings.warn(f"mixing misses its targets: token shares {mixture.shares}, wanted {dict(zip(mixture.domains, weights.tolist()))}, distance {mixture.distance:.4f}", stacklevel=2)
    return mixture


def _descend(table: DataFrame, mixture: Mixture, weights: np.ndarray, total_factor: float, min_rate: float) -> None:
    """Fits the steps of one total; ``table``: p, tokens."""
    mixture.min_rate, mixture.start, mixture.steps, mixture.shares, mixture.distance = min_rate, total_factor, [], {}, 0.0
    best = np.inf
    p = [F.get("p", F.lit(d)) for d in range(len(mixture.domains))]
    pairs = [(a, b) for a in range(len(p)) for b in range(a + 1)]
    while True:
        rated = table.withColumn("rate", mixture.rate(F.col("p")))
        free = (F.col("rate") > min_rate).cast("double")
        row = rated.agg(
            F.sum("tokens").alias("all"), *(F.sum(F.col("rate") * F.col("tokens") * p[d]).alias(f"e{d}") for d in range(len(p))),
            *(F.sum(free * F.col("tokens") * p[a] * p[b]).alias(f"m{a}_{b}") for a, b in pairs),
        ).first()
        if not row["all"]:
            return
        goal = weights * total_factor * row["all"]
        reached = np.array([row[f"e{d}"] for d in range(len(p))])
        off = reached - goal
        distance = float(np.linalg.norm(off) / goal.sum())
        if distance > best:
            mixture.steps.pop()
            return
        mixture.shares = dict(zip(mixture.domains, (reached / max(reached.sum(), 1e-300)).tolist()))
        mixture.distance = distance
        scale = np.zeros((len(p), len(p)))
        for a, b in pairs:
            scale[a, b] = scale[b, a] = row[f"m{a}_{b}"]
        # a little of the trace keeps the scale regular when few documents are free
        step = np.linalg.solve(scale + np.eye(len(p)) * (np.trace(scale) * 1e-9 + 1e-9), off)
        if len(mixture.steps) == MAX_STEPS or distance <= TOLERANCE or np.abs(step).max() < TOLERANCE or distance > best * (1 - TOLERANCE):
            return
        best = distance
        mixture.steps.append(step)


def fit(docs: DataFrame, labelled: DataFrame, target: dict[str, float], total_factor: float | None = 1.0, min_rate: float = 0.0) -> tuple[Mixture, DataFrame]:
    """The mixture and its table: doc_id, tokens, draw and p, the posteriors, of every row."""
    text = texts_of(docs)
    # the draw that rounds a rate follows the row, so that a repeated run rounds alike
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    table = store(text.select("doc_id", tokens(F.col("text")).alias("tokens"), draw.alias("draw"), measures(F.col("text")).alias("bins")), "mixing")
    mixture = fit_classifier(table, labelled)
    scored = store(table.select("doc_id", "tokens", "draw", mixture.posterior(F.col("bins")).alias("p")), "posteriors")
    return fit_rates(scored, mixture, target, total_factor, min_rate), scored


def rates(docs: DataFrame, labelled: DataFrame, target: dict[str, float], total_factor: float | None = 1.0, min_rate: float = 0.0) -> DataFrame:
    """doc_id, tokens, one posterior column per domain, rate, and copies: the rate rounded up or down by the row's draw.

    Null text is empty and counts no token, repeated rows are rated each (alike), an empty table gives no rows.
    """
    mixture, table = fit(docs, labelled, target, total_factor, min_rate)
    rated = table.withColumn("rate", F.round(mixture.rate(F.col("p")), 9))
    named = [F.round(F.get("p", F.lit(k)), 9).alias(f"p_{d}") for k, d in enumerate(mixture.domains)]
    return rated.select("doc_id", "tokens", *named, "rate", F.floor(F.col("rate") + F.col("draw")).cast("long").alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, target: dict[str, float], total_factor: float | None = 1.0, min_rate: float = 0.0) -> DataFrame:
    """``docs`` with every row as often as its rate says; columns stay as they are. The rate is worked out anew from the text, without a join."""
    mixture, _ = fit(docs, labelled, target, total_factor, min_rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # measures are bound once: as plain columns each posterior term would work them out again
    rate = _let(measures(text), lambda bins: _let(mixture.posterior(bins), lambda p: F.round(mixture.rate(p), 9)))
    copies = F.array_repeat(F.lit(1), F.floor(rate + draw).cast("int"))
    return docs.select(F.struct(*docs.columns).alias("row"), F.explode(copies).alias("copy")).select("row.*")


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain, "good" or "poor", from a labels table."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))
