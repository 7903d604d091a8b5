"""Graph-layer aggregation over vector nodes, weights given.

Nodes are ``(id, vec ARRAY<DOUBLE>)``, edges ``(src, dst)``. Neighbour sums are
one hash aggregate with a sum per vector position, combined map-side, so a hub
node costs one partial row per task and vectors are never exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.scoring import sigmoid
from .graph import sampling_key
from ..session import store
from .ordered import Ascending, Descending, global_rank
from .spread import per_key


def gather(edges: DataFrame, nodes: DataFrame, *, vector: str = "vec") -> DataFrame:
    """Edges with both end vectors as ``x_src`` and ``x_dst``."""
    source = nodes.select(F.col("id").alias("src"), F.col(vector).alias("x_src"))
    target = nodes.select(F.col("id").alias("dst"), F.col(vector).alias("x_dst"))
    return edges.join(source, "src").join(target, "dst")


def _gather_source(edges: DataFrame, nodes: DataFrame, vector: str = "vec") -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src"), F.col(vector).alias("x_src")), "src")


def vector_sum(rows: DataFrame, *, by: str, vector: str, dim: int, weight: Column | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(by, total ARRAY, n, extra...) summed position by position."""
    factor = F.lit(1.0) if weight is None else weight
    sums = [F.sum(F.col(vector)[i] * factor).alias(f"_s{i}") for i in range(dim)]
    added = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *sums, *[c.alias(k) for k, c in (extra or {}).items()]
    )
    return added.select(by, "n", F.array(*[f"_s{i}" for i in range(dim)]).alias("total"), *(extra or {}))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def gcn_propagate(nodes: DataFrame, edges: DataFrame, *, dim: int) -> DataFrame:
    """Symmetric normalised sum with self-loops: ``sum x_u / sqrt(d_u d_v)``.

    The target's factor is taken after the sum, so degrees are joined per node
    only, never per edge.
    """
    degrees = nodes.select("id", "vec").join(in_degree(edges), "id", "left").select(
        "id", "vec", (F.coalesce("deg", F.lit(0)) + 1).cast("double").alias("d")
    )
    scaled = per_key(degrees.select("id", "d", vec.scale(F.col("vec"), 1.0 / F.sqrt("d")).alias("vec")))
    received = vector_sum(_gather_source(edges, scaled), by="dst", vector="x_src", dim=dim)
    joined = scaled.join(received.withColumnRenamed("dst", "id"), "id", "left")
    total = F.when(F.col("total").isNull(), F.col("vec")).otherwise(vec.add(F.col("vec"), F.col("total")))
    return joined.select("id", vec.scale(total, 1.0 / F.sqrt("d")).alias("vec"))


def sage_mean_propagate(nodes: DataFrame, edges: DataFrame, *, dim: int) -> DataFrame:
    """(id, vec, neighbor_mean): the self branch and the mean of in-neighbours."""
    received = vector_sum(_gather_source(edges, nodes), by="dst", vector="x_src", dim=dim)
    mean = vec.scale(F.col("total"), 1.0 / F.col("n"))
    return nodes.select("id", "vec").join(received.withColumnRenamed("dst", "id"), "id", "left").select(
        "id", "vec", F.coalesce(mean, vec.zeros(dim)).alias("neighbor_mean")
    )


def _leaky(value: Column, slope: float) -> Column:
    return F.when(value > 0, value).otherwise(value * slope)


def attention_score(attention: Sequence[float], slope: float = 0.2) -> Callable[[Column, Column], Column]:
    """``a · leaky(x_src + x_dst)`` with given attention weights, identity projections."""
    weights = vec.literal(attention)

    def score(x_src: Column, x_dst: Column) -> Column:
        return vec.dot(F.transform(vec.add(x_src, x_dst), lambda x: _leaky(x, slope)), weights)

    return score


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def gat_scores(nodes: DataFrame, edges: DataFrame, score) -> DataFrame:
    looped = with_self_loops(edges, nodes)
    return gather(looped, nodes).select("src", "dst", "x_src", score(F.col("x_src"), F.col("x_dst")).alias("score"))


def gat_attention(nodes: DataFrame, edges: DataFrame, *, dim: int, score) -> DataFrame:
    """Softmax-weighted sum over incoming edges and the node itself.

    Peak and normaliser are plain aggregates per node (combined map-side) rather
    than a window, so a hub's edges are never brought into one task.
    """
    # stored: the joins below deal the edges anew, and so can split those of a hub
    scored = store(gat_scores(nodes, edges, score), "gat-scores")
    peak = per_key(scored.groupBy("dst").agg(F.max("score").alias("peak")))
    weighted = scored.join(peak, "dst").withColumn("w", F.exp(F.col("score") - F.col("peak")))
    summed = vector_sum(weighted, by="dst", vector="x_src", dim=dim, weight=F.col("w"), extra={"mass": F.sum("w")})
    return summed.select(F.col("dst").alias("id"), vec.scale(F.col("total"), 1.0 / F.col("mass")).alias("vec"))


def attention_weights(nodes: DataFrame, edges: DataFrame, *, score) -> DataFrame:
    """(src, dst, alpha) of the same softmax."""
    scored = store(gat_scores(nodes, edges, score).drop("x_src"), "gat-scores")
    peak = per_key(scored.groupBy("dst").agg(F.max("score").alias("peak")))
    lifted = scored.join(peak, "dst").withColumn("w", F.exp(F.col("score") - F.col("peak")))
    mass = per_key(lifted.groupBy("dst").agg(F.sum("w").alias("mass")))
    return lifted.join(mass, "dst").select("src", "dst", (F.col("w") / F.col("mass")).alias("alpha"))


def hetero_attention(
    nodes: DataFrame, edges: DataFrame, *, dim: int, relation_weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Sigmoid attention per relation, averaged over all in-edges, plus the node itself.

    ``edges`` carry ``relation``; single head, identity projections.
    """
    factor = F.lit(1.0)
    for name, weight in (relation_weights or {}).items():
        factor = F.when(F.col("relation") == name, weight).otherwise(factor)
    met = gather(edges, nodes)
    alpha = sigmoid(vec.dot(F.col("x_src"), F.col("x_dst")) / (dim**0.5) * factor)
    summed = vector_sum(met.withColumn("alpha", alpha), by="dst", vector="x_src", dim=dim, weight=F.col("alpha"))
    mean = vec.scale(F.col("total"), 1.0 / F.greatest(F.col("n"), F.lit(1)))
    return nodes.select("id", "vec").join(summed.withColumnRenamed("dst", "id"), "id", "left").select(
        "id", F.when(F.col("total").isNull(), F.col("vec")).otherwise(vec.add(F.col("vec"), mean)).alias("vec")
    )


def multitask_heads(
    nodes: DataFrame,
    *,
    heads: Mapping[str, tuple[Sequence[Sequence[float]], Sequence[float], Sequence[float], float]],
    combined: Sequence[str],
    combiner: tuple[Sequence[float], float],
) -> DataFrame:
    """One probability per head and the combined one.

    ``heads``: name -> (hidden matrix, hidden bias, output weights, output bias).
    ``combiner`` weighs the ``combined`` heads followed by the embedding.
    """
    unit = vec.l2_normalize(F.col("vec"))
    base = nodes.select("id", unit.alias("z"))
    scored = base.select(
        "id", "z",
        *[
            sigmoid(vec.dot(vec.relu(vec.linear(F.col("z"), hidden, bias)), vec.literal(out)) + F.lit(float(shift))).alias(name)
            for name, (hidden, bias, out, shift) in heads.items()
        ],
    )
    weights, shift = combiner
    joint = F.concat(F.array(*[F.col(n) for n in combined]), F.col("z"))
    return scored.select(
        "id", *heads, sigmoid(vec.dot(joint, vec.literal(weights)) + F.lit(float(shift))).alias("p_global")
    )


# --- edge filters -------------------------------------------------------------------


def edge_similarity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return gather(edges, nodes).select(
        "src", "dst", vec.cosine_similarity(F.col("x_src"), F.col("x_dst")).alias("similarity")
    )


def keep_or_fallback(scored: DataFrame, *, score: str, threshold: float, share: float) -> DataFrame:
    """Rows at or above ``threshold``; if there are none, the best ``share`` (at least one)."""
    kept = scored.where(F.col(score) >= threshold)
    if not kept.isEmpty():
        return kept
    return top_share(scored, score=score, share=share)


def top_share(scored: DataFrame, *, score: str, share: float) -> DataFrame:
    """The best ``max(1, floor(share * n))`` rows; ties by src then dst."""
    ranked = global_rank(
        scored, order=[Descending(score), Ascending("src"), Ascending("dst")], name="_rank"
    )
    bound = scored.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share)))).scalar()
    return ranked.where(F.col("_rank") <= bound).drop("_rank")


def similarity_edge_filter(nodes: DataFrame, edges: DataFrame, *, threshold: float = 0.45, share: float = 0.2) -> DataFrame:
    return keep_or_fallback(edge_similarity(nodes, edges), score="similarity", threshold=threshold, share=share)


def care_aggregate(nodes: DataFrame, edges: DataFrame, *, dim: int, threshold: float = 0.45) -> DataFrame:
    """Self vector followed by the mean over the surviving neighbours."""
    kept = similarity_edge_filter(nodes, edges, threshold=threshold).select("src", "dst")
    return sage_mean_propagate(nodes, kept, dim=dim).select("id", F.concat("vec", "neighbor_mean").alias("vec"))


def edge_state(nodes: DataFrame, edges: DataFrame, *, attributes: str | None = None, delta_t: str | None = None, attribute_dim: int = 12) -> DataFrame:
    """Policy state per edge: target, neighbour, cosine, log time gap, 12 attributes."""
    attrs = F.col(attributes) if attributes else vec.zeros(attribute_dim)
    gap = F.log1p(F.greatest(F.col(delta_t), F.lit(0.0))) if delta_t else F.lit(0.0)
    met = gather(edges, nodes)
    cosine = vec.cosine_similarity(F.col("x_dst"), F.col("x_src"))
    return met.select(
        "src", "dst", F.concat(F.col("x_dst"), F.col("x_src"), F.array(cosine, gap), attrs).alias("state")
    )


def policy_edge_filter(
    nodes: DataFrame, edges: DataFrame, *, weights: Sequence[float], bias: float = 0.0,
    threshold: float = 0.5, share: float = 0.15, **state,
) -> DataFrame:
    """Edges whose keep probability under given linear weights is high enough."""
    scored = edge_state(nodes, edges, **state).select(
        "src", "dst", sigmoid(vec.dot(F.col("state"), vec.literal(weights)) + F.lit(bias)).alias("keep_prob")
    )
    return keep_or_fallback(scored, score="keep_prob", threshold=threshold, share=share)


def balanced_edge_sample(
    edges: DataFrame, labels: DataFrame, *, fraud_ratio: float = 4.0, clean_ratio: float = 0.3, seed: int = 42
) -> DataFrame:
    """Edges into fraud nodes repeated ``int(fraud_ratio)`` times, a hash-picked share of the rest.

    ``labels``: (id, label). Exactly ``int(clean_ratio * n)`` clean edges are kept.
    """
    marked = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst", "left").select(
        "src", "dst", (F.coalesce("label", F.lit(0)) == 1).alias("into_fraud")
    )
    repeats = F.explode(F.sequence(F.lit(1), F.lit(int(fraud_ratio))))
    fraud = marked.where("into_fraud").select("src", "dst", "into_fraud", repeats.alias("copy"))
    clean = marked.where("not into_fraud").withColumn("_key", sampling_key("src", "dst", seed=seed))
    ranked = global_rank(clean, order=[Ascending("_key"), Ascending("src"), Ascending("dst")], name="_rank")
    bound = clean.agg(F.floor(F.count(F.lit(1)) * F.lit(clean_ratio))).scalar()
    kept = ranked.where(F.col("_rank") <= bound)
    return fraud.unionByName(kept.select("src", "dst", "into_fraud", F.lit(1).alias("copy")))


# --- spectral -----------------------------------------------------------------------


def laplacian_weights(edges: DataFrame) -> DataFrame:
    """``-1 / sqrt(deg(src) deg(dst))`` by in-count; 0 where the source has none."""
    deg = per_key(in_degree(edges))
    source = deg.select(F.col("id").alias("src"), F.col("deg").alias("ds"))
    target = deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd"))
    weight = F.when(F.col("ds").isNull(), 0.0).otherwise(-1.0 / F.sqrt(F.col("ds") * F.col("dd")))
    return edges.join(target, "dst").join(source, "src", "left").select("src", "dst", weight.alias("weight"))


def laplacian_apply(nodes: DataFrame, weighted: DataFrame, *, vector: str, dim: int, name: str) -> DataFrame:
    """Adds ``name`` = L applied to ``vector`` (zeros where nothing comes in)."""
    summed = vector_sum(
        _gather_source(weighted, nodes, vector), by="dst", vector="x_src", dim=dim, weight=F.col("weight")
    )
    return nodes.join(summed.select(F.col("dst").alias("id"), F.col("total").alias(name)), "id", "left").withColumn(
        name, F.coalesce(name, vec.zeros(dim))
    )


def chebyshev_filter(
    nodes: DataFrame, edges: DataFrame, *, dim: int,
    weights: Sequence[Sequence[Sequence[float]]] | None = None, bias: Sequence[float] | None = None,
) -> DataFrame:
    """Order-2 filter: ``T0 = x, T1 = Lx, T2 = 2 L T1 - T0``, summed through given matrices.

    Without ``weights`` every matrix is the identity.
    """
    weighted = laplacian_weights(edges)
    first = laplacian_apply(nodes.select("id", F.col("vec").alias("t0")), weighted, vector="t0", dim=dim, name="t1")
    second = laplacian_apply(first, weighted, vector="t1", dim=dim, name="lt1")
    terms = second.select(
        "id", "t0", "t1", F.zip_with("lt1", "t0", lambda a, b: a * 2.0 - b).alias("t2")
    )
    parts = [F.col(f"t{k}") if weights is None else vec.linear(F.col(f"t{k}"), weights[k]) for k in range(3)]
    out = vec.add(vec.add(parts[0], parts[1]), parts[2])
    if bias is not None:
        out = vec.add(out, vec.literal(bias))
    return terms.select("id", out.alias("vec"))


# --- contrastive --------------------------------------------------------------------


def infonce_loss(triples: DataFrame, *, temperature: float = 0.2) -> DataFrame:
    """Mean loss of (anchor_id, anchor, other, is_positive) rows, one positive per anchor.

    Similarities lie within ±1/temperature, so the sums need no shift.
    """
    similarity = vec.cosine_similarity(F.col("anchor"), F.col("other")) / temperature
    per_anchor = triples.select("anchor_id", "is_positive", similarity.alias("s")).groupBy("anchor_id").agg(
        F.log(F.sum(F.exp("s"))).alias("log_mass"), F.max(F.when(F.col("is_positive"), F.col("s"))).alias("positive")
    )
    return per_anchor.agg(F.avg(F.col("log_mass") - F.col("positive")).alias("loss"))
