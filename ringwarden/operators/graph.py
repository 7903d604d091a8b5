"""Account graph: collapse, degree, PageRank, core numbers, triangles, components.

Edges are DataFrames, node ids stay the account strings. Loops cut their lineage
through the reliable checkpoint folder, so a lost executor costs one block of
rounds and never the whole run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LINK_KINDS, NEIGHBOR_CAP_DEFAULT, NEIGHBOR_CAPS
from ..session import cut_lineage, shuffle_width, store
from .ordered import Ascending, global_rank
from .spread import ROWS_PER_SLICE, SpreadRows, per_key, spread_rows

# Links of one task of the late rounds of core numbers, which read few.
ROWS_PER_TASK = 100_000


def edge_collapse(edges: DataFrame, *, tie: str = "tx_id") -> DataFrame:
    """One directed edge per ordered pair; the latest transaction sets weight and step."""
    return (
        edges.where(F.col("nameOrig") != F.col("nameDest"))
        .groupBy(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst"))
        .agg(F.max(F.struct("step", tie, F.log1p("amount").alias("weight"))).alias("latest"))
        .select("src", "dst", F.col("latest.weight").alias("weight"), F.col("latest.step").alias("step"))
    )


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """In and out degree and ``out / (in + 1)``: both ends counted in one aggregate."""
    end = F.explode(
        F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    return (
        edges.select(end.alias("e"))
        .groupBy(F.col("e.id").alias("id"))
        .agg(F.sum("e.i").cast("double").alias("in_degree"), F.sum("e.o").cast("double").alias("out_degree"))
        .withColumn("degree_ratio", F.col("out_degree") / (F.col("in_degree") + 1))
    )


def undirected_edges(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    way = F.explode(
        F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("neighbor")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("neighbor")),
        )
    )
    return pairs.select(way.alias("w")).select("w.node", "w.neighbor")


# --- PageRank --------------------------------------------------------------------


def _transition_rows(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to push rank along, nodes with a dangling mark).

    A node's out-edges carry its weight shares; one extra row per node carries
    its own history to itself.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out_weight"))
    marked = cut_lineage(
        nodes.join(out, "id", "left").select(
            "id",
            (F.coalesce("out_weight", F.lit(0.0)) <= 0).alias("dangling"),
            F.coalesce("out_weight", F.lit(0.0)).alias("out_weight"),
        )
    )
    pushes = edges.join(marked.where(~F.col("dangling")), F.col("src") == F.col("id")).select(
        "id", "dst", (F.col("weight") / F.col("out_weight")).alias("share"), F.lit(False).alias("own")
    )
    keeps = marked.select("id", F.col("id").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"))
    return pushes.unionByName(keeps), marked


def pagerank(
    edges: DataFrame,
    *,
    damping: float = 0.85,
    max_iter: int = 100,
    tol: float | None = 1e-6,
    block: int = 5,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Weighted PageRank; stops when the L1 change is below ``nodes * tol``.

    ``tol=None`` runs exactly ``max_iter`` rounds. Dangling mass is shared out
    evenly. The walk matrix is applied ``block`` times in one job, both to the
    current ranks and to the all-ones vector; the evenly shared parts are then
    added as a linear combination whose few factors are plain numbers. So a
    round is one join and one pre-aggregated shuffle, with no driver step
    inside a block. The first ranks are all equal, so without ``tol`` one walk of
    the all-ones vector serves for all rounds (``_fixed_rounds``).
    """
    nodes = edge_nodes(edges)
    transitions, marked = _transition_rows(edges, nodes)
    n = marked.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    rows = spread_rows(transitions, "id", "dst", rows_per_slice)
    if tol is None:
        ranks = _fixed_rounds(rows, marked.select("id"), n, max_iter, damping, block)
        rows.release()
        return ranks
    state = marked.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    done = 0
    while done < max_iter:
        rounds = min(block, max_iter - done)
        walked = cut_lineage(_walk(state, rows, rounds))
        factors = _even_shares(walked, rounds, damping, n)
        columns = [_rank_after(s, damping, factors) for s in range(rounds + 1)]
        stop = rounds
        converged = False
        if tol is not None:
            moves = walked.agg(
                *[F.sum(F.abs(columns[s] - columns[s - 1])).alias(f"m{s}") for s in range(1, rounds + 1)]
            ).first()
            for s in range(1, rounds + 1):
                if moves[f"m{s}"] < n * tol:
                    stop, converged = s, True
                    break
        state = walked.select("id", "dangling", columns[stop].alias("rank"))
        done += stop
        if converged:
            break
    rows.release()
    return state.select("id", F.col("rank").alias("pagerank"))


def _fixed_rounds(rows: SpreadRows, nodes: DataFrame, n: int, rounds: int, damping: float, block: int) -> DataFrame:
    """Ranks after exactly ``rounds``: a combination of the walks e0..e_rounds of the all-ones vector.

    What dangling nodes hold in a round is what the walk loses in the next one, so only sums reach the driver. A block
    of walks is written once; a row carries one value per round, and a node's own row those of its block so far.
    """
    walks, masses, done = [], [float(n)], 0
    last = nodes.select("id", F.lit(1.0).alias("e0"))
    while done < rounds:
        steps = min(block, rounds - done)
        walked = last
        for s in range(1, steps + 1):
            kept = [F.sum(F.when(F.col("own"), F.col(f"e{i}")).otherwise(0.0)).alias(f"e{i}") for i in range(s)]
            walked = rows.meet(walked).groupBy(F.col("dst").alias("id")).agg(
                *kept, F.sum(F.col("share") * F.col(f"e{s - 1}")).alias(f"e{s}")
            )
        walked = cut_lineage(walked)
        sums = walked.agg(*[F.sum(f"e{s}") for s in range(1, steps + 1)]).first()
        masses += list(sums)
        walks.append((done, steps, walked))
        done += steps
        last = walked.select("id", F.col(f"e{steps}").alias("e0"))
    # evenly[t]: what every node receives evenly in round t + 1; held: of its factors, those of the ranks after t rounds
    evenly, held = [], [1.0 / n]
    for _ in range(rounds):
        lost = sum(f * (masses[j] - masses[j + 1]) for j, f in enumerate(held))
        evenly.append((1 - damping) / n + damping * lost / n)
        held = [evenly[-1]] + [damping * f for f in held]
    parts = [
        walked.select("id", sum((F.lit(held[first + s]) * F.col(f"e{s}") for s in range(0 if first == 0 else 1, steps + 1)), F.lit(0.0)).alias("part"))
        for first, steps, walked in walks
    ]
    if not parts:
        return nodes.select("id", F.lit(1.0 / n).alias("pagerank"))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("pagerank"))


def _walk(state: DataFrame, rows: SpreadRows, rounds: int) -> DataFrame:
    """Columns r0..rk (walk of the ranks) and e0..ek (walk of the ones)."""
    current = state.select("id", "dangling", F.col("rank").alias("r0"), F.lit(1.0).alias("e0"))
    for s in range(1, rounds + 1):
        kept = [f"{v}{i}" for i in range(s) for v in ("r", "e")]
        current = rows.meet(current).groupBy(F.col("dst").alias("id")).agg(
            F.max(F.col("own") & F.col("dangling")).alias("dangling"),
            *[F.sum(F.when(F.col("own"), F.col(c)).otherwise(0.0)).alias(c) for c in kept],
            F.sum(F.col("share") * F.col(f"r{s - 1}")).alias(f"r{s}"),
            F.sum(F.col("share") * F.col(f"e{s - 1}")).alias(f"e{s}"),
        )
    return current


def _even_shares(walked: DataFrame, rounds: int, damping: float, n: int) -> list[float]:
    """g_1..g_k: what every node receives evenly in each round (g_0 unused)."""
    lost = walked.agg(
        *[F.sum(F.when(F.col("dangling"), F.col(f"{v}{s}")).otherwise(0.0)).alias(f"{v}{s}")
          for s in range(rounds) for v in ("r", "e")]
    ).first()
    shares = [0.0]
    for s in range(rounds):
        dangling_mass = damping**s * lost[f"r{s}"] + sum(
            damping**i * shares[s - i] * lost[f"e{i}"] for i in range(s)
        )
        shares.append((1 - damping) / n + damping * dangling_mass / n)
    return shares


def _rank_after(s: int, damping: float, shares: list[float]):
    rank = F.lit(damping**s) * F.col(f"r{s}")
    for i in range(s):
        rank = rank + F.lit(damping**i * shares[s - i]) * F.col(f"e{i}")
    return rank


# --- core numbers -----------------------------------------------------------------


def k_core(
    edges: DataFrame, *, max_rounds: int | None = None, block: int = 4, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Core number on the undirected simple graph by repeated H-index.

    Lü et al. 2016: starting at the degree, ``h = max v: min(v, neighbours with
    value >= v)`` converges to the core number. Neighbour values are counted per
    node first; a node sees at most sqrt(2 * edges) distinct values, so the window
    below stays small for a hub too.

    Values never rise, so nodes at or above a level that nothing fell below in a round
    are the core of that level. Levels settle long before the last one does: nodes
    below and above the levels still moving then leave the rounds, and those above
    stay as counts per neighbour. So the many late rounds read few rows.
    """
    links = spread_rows(_both_ways(undirected_edges(edges)), "neighbor", "node", rows_per_slice)
    core = cut_lineage(links.rows.groupBy("node").agg(F.count(F.lit(1)).alias("core")))
    levels, done, floor = _level_sizes(core), 0, 0
    fixed, settled = None, []
    while max_rounds is None or done < max_rounds:
        rounds = block if max_rounds is None else min(block, max_rounds - done)
        for _ in range(rounds):
            core = _h_index_round(links, core, fixed, floor)
        core = cut_lineage(core)
        done += rounds
        before, levels = levels, _level_sizes(core)
        moving = _moving_levels(before, levels)
        if moving is None:
            break
        low, high = moving
        left = sum(n for level, n in levels.items() if low <= level <= high)
        if 2 * left <= sum(levels.values()):
            inside = F.col("core").between(low, high)
            settled.append(core.where(~inside))
            links, fixed = _still_moving(links, core, fixed, low, high, rows_per_slice)
            core, floor = core.where(inside), low - 1
            levels = {level: n for level, n in levels.items() if low <= level <= high}
    links.release()
    for rows in settled:
        core = core.unionByName(rows)
    return core.select(F.col("node").alias("id"), F.col("core").cast("double").alias("k_core_number"))


def _level_sizes(core: DataFrame) -> dict[int, int]:
    """Nodes per value: at most sqrt(2 * edges) + 1 rows."""
    return {row["core"]: row["n"] for row in core.groupBy("core").agg(F.count(F.lit(1)).alias("n")).collect()}


def _moving_levels(before: dict[int, int], after: dict[int, int]) -> tuple[int, int] | None:
    """The lowest and the highest level that some node fell below, None if none did."""
    moving, gap = [], 0
    for level in sorted({*before, *after}, reverse=True):
        # so many more nodes were at this level or above it
        gap += before.get(level, 0) - after.get(level, 0)
        if gap:
            moving.append(level)
    if not moving:
        return None
    # the gap holds down to the next value that any node has
    settled = max((level for level in {*before, *after} if level < moving[-1]), default=0)
    return settled + 1, moving[0]


def _still_moving(
    links: SpreadRows, core: DataFrame, fixed: DataFrame | None, low: int, high: int, rows_per_slice: int
) -> tuple[SpreadRows, DataFrame]:
    """Links among nodes with values from ``low`` to ``high``, and counts of their settled neighbours above."""
    inside = core.where(F.col("core").between(low, high)).select("node")
    seen = links.meet(core.withColumnRenamed("node", "neighbor")).where(F.col("core") >= low)
    seen = store(seen.select("node", "neighbor", "core").join(inside, "node", "left_semi"), "core-links")
    links.release()
    above = seen.where(F.col("core") > high).groupBy("node", "core").agg(F.count(F.lit(1)).alias("n"))
    if fixed is not None:
        above = above.unionByName(fixed.where("n > 0").join(inside, "node", "left_semi").select("node", "core", "n"))
    # a row for each node, so that one without links left keeps its place
    places = inside.select("node", F.lit(low - 1).cast("bigint").alias("core"), F.lit(0).cast("bigint").alias("n"))
    left = seen.where(F.col("core") <= high).select("node", "neighbor")
    tasks = max(1, min(shuffle_width(seen.sparkSession), left.count() // ROWS_PER_TASK))
    return spread_rows(left, "neighbor", "node", rows_per_slice, tasks), cut_lineage(above.unionByName(places))


def _h_index_round(links: SpreadRows, core: DataFrame, fixed: DataFrame | None = None, floor: int = 0) -> DataFrame:
    seen = links.meet(core.withColumnRenamed("node", "neighbor"))
    counts = seen.groupBy("node", "core").agg(F.count(F.lit(1)).alias("n"))
    if fixed is not None:
        counts = counts.unionByName(fixed)
    at_least = F.sum("n").over(
        Window.partitionBy("node").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counts.withColumn("h", F.least("core", at_least))
        .groupBy("node")
        .agg(F.greatest(F.max("h"), F.lit(floor).cast("bigint")).alias("core"))
    )


# --- triangles --------------------------------------------------------------------


def triangle_count(edges: DataFrame) -> DataFrame:
    """Triangles per node.

    Edges point from lower to higher degree, so no node has more than
    sqrt(2 * edges) out-neighbours and each neighbour list is small even for a hub.
    Lists are intersected per edge; no wedge is ever written out.
    """
    pairs = undirected_edges(edges)
    links = _both_ways(pairs)
    degrees = per_key(links.groupBy("node").agg(F.count(F.lit(1)).alias("deg")))
    of_a = degrees.select(F.col("node").alias("a"), F.col("deg").alias("da"))
    of_b = degrees.select(F.col("node").alias("b"), F.col("deg").alias("db"))
    low_first = F.struct("da", "a") < F.struct("db", "b")
    oriented = (
        pairs.join(of_a, "a")
        .join(of_b, "b")
        .select(
            F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("u"),
            F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("v"),
        )
    )
    oriented = store(oriented, "oriented")
    lists = per_key(oriented.groupBy("u").agg(F.collect_list("v").alias("out")))
    common = (
        oriented.join(lists, "u")
        .join(lists.select(F.col("u").alias("v"), F.col("out").alias("out_v")), "v")
        .select("u", "v", F.array_intersect("out", "out_v").alias("common"))
        .where(F.size("common") > 0)
    )
    hits = common.select(
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.col("u").alias("id"), F.size("common").alias("t")),
                    F.struct(F.col("v").alias("id"), F.size("common").alias("t")),
                ),
                F.transform("common", lambda w: F.struct(w.alias("id"), F.lit(1).alias("t"))),
            )
        ).alias("hit")
    )
    found = hits.groupBy(F.col("hit.id").alias("id")).agg(F.sum("hit.t").alias("triangles"))
    return (
        degrees.select(F.col("node").alias("id"), F.col("deg"))
        .join(found, "id", "left")
        .select("id", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"), "deg")
    )


def clustering_coefficient(edges: DataFrame, *, directed_degree: bool = False) -> DataFrame:
    """``2T / (d(d-1))`` on the undirected simple graph, 0 below degree 2.

    ``directed_degree=True`` takes in-degree plus out-degree as ``d``.
    """
    counted = triangle_count(edges)
    if directed_degree:
        both = degree(edges).select("id", (F.col("in_degree") + F.col("out_degree")).alias("deg"))
        counted = counted.drop("deg").join(both, "id")
    d = F.col("deg")
    return counted.select(
        "id",
        F.when(d < 2, 0.0)
        .otherwise(2.0 * F.col("triangles") / (d * (d - 1)))
        .alias("local_clustering_coefficient"),
    )


def structural_features(edges: DataFrame, *, max_iter: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """The six structural columns keyed by ``account_id``."""
    return (
        degree(edges)
        .join(pagerank(edges, max_iter=max_iter, tol=tol), "id", "left")
        .join(k_core(edges), "id", "left")
        .join(clustering_coefficient(edges), "id", "left")
        .na.fill(0.0)
        .withColumnRenamed("id", "account_id")
    )


# --- linked identifiers ------------------------------------------------------------


def identifier_rows(
    payments: DataFrame, *, kinds: Sequence[str] = LINK_KINDS, shared_namespace: bool = False
) -> DataFrame:
    """(identifier, transaction) rows; empty and missing identifiers never link."""
    entries = F.array(
        *[
            F.struct(
                F.lit("any" if shared_namespace else kind).alias("kind"), F.col(kind).alias("value")
            )
            for kind in kinds
        ]
    )
    return (
        payments.select(F.col("transaction_id").alias("tx"), F.explode(entries).alias("e"))
        .where(F.col("e.value").isNotNull() & (F.col("e.value") != ""))
        .select("tx", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .distinct()
    )


def shared_identifier_links(
    payments: DataFrame, *, kinds: Sequence[str] = LINK_KINDS, shared_namespace: bool = False
) -> DataFrame:
    """Each transaction next to the first one that shares an identifier with it.

    The same reachability as all pairs, but linear in the rows: an identifier
    used by n transactions gives n - 1 links instead of n(n-1)/2 pairs.
    """
    rows = identifier_rows(payments, kinds=kinds, shared_namespace=shared_namespace)
    first = per_key(rows.groupBy("kind", "value").agg(F.min("tx").alias("anchor")))
    return rows.join(first, ["kind", "value"]).where(F.col("tx") != F.col("anchor"))


def connected_components(links: DataFrame, *, a: str, b: str) -> DataFrame:
    """(id, component) for linked ids; component = smallest id reachable.

    Alternating large-star and small-star (Kiveris et al. 2014): each step is a
    min per node and a join, edges never multiply, and rounds grow with the
    logarithm of the longest chain.
    """
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = cut_lineage(edges)
    while not _all_stars(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return members.union(roots).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on nothing.

    Steps keep connected nodes connected, so stars apart from each other are the
    components. One pre-aggregated count by node, stopped at the first exception.
    """
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                             F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.id").agg(
        F.sum("e.up").alias("up"), F.max("e.down").alias("down")
    )
    return nodes.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    way = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")),
                            F.struct(F.col("v").alias("n"), F.col("u").alias("m"))))
    both = edges.select(way.alias("w")).select("w.n", "w.m")
    smallest = per_key(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
    return (
        both.where(F.col("m") > F.col("n"))
        .join(smallest, "n")
        .select(F.col("m").alias("u"), F.col("low").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = per_key(edges.groupBy("u").agg(F.min("v").alias("low")))
    moved = edges.join(smallest, "u").select(
        F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                          F.struct(F.col("u").alias("u"), F.col("low").alias("v")))).alias("e")
    )
    return moved.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()


def linked_components(
    payments: DataFrame, *, kinds: Sequence[str] = LINK_KINDS, shared_namespace: bool = False
) -> DataFrame:
    """(transaction_id, component) of payments that share something; sizes >= 2."""
    links = shared_identifier_links(payments, kinds=kinds, shared_namespace=shared_namespace)
    return connected_components(links, a="tx", b="anchor").select(
        F.col("id").alias("transaction_id"), "component"
    )


def identifier_components(
    payments: DataFrame, *, kinds: Sequence[str] = LINK_KINDS, shared_namespace: bool = False
) -> DataFrame:
    """(transaction_id, component); a payment sharing nothing is its own component."""
    linked = linked_components(payments, kinds=kinds, shared_namespace=shared_namespace)
    return (
        payments.select("transaction_id")
        .distinct()
        .join(linked, "transaction_id", "left")
        .select("transaction_id", F.coalesce("component", "transaction_id").alias("component"))
    )


# --- neighbourhoods ---------------------------------------------------------------


# Seeds that one 64-bit word of a seed set stands for.
SEEDS_PER_WORD = 64


def numbered_seeds(seeds: DataFrame) -> DataFrame:
    """(seed, word, bit): every distinct seed has one bit of one word. Stored, so that a number stays what it is."""
    ranked = global_rank(seeds.select(F.col("id").alias("seed")).where("seed is not null").distinct(), order=[Ascending("seed")], name="rank")
    place = F.col("rank") - 1
    return store(ranked.select("seed", F.floor(place / SEEDS_PER_WORD).cast("int").alias("word"), (place % SEEDS_PER_WORD).cast("int").alias("bit")), "seeds")


def two_hop_sets(edges: DataFrame, numbered: DataFrame, *, weight: str | None = None, min_weight: float = 0.1) -> DataFrame:
    """(src, dst, word, seeds): each edge once for every word of seeds it is near to, with the bits of those seeds.

    Near is what touches a seed or one of its neighbours; first hops are of any weight. A hub that all seeds
    share costs its edges once for each 64 seeds, not once for each seed. Sets of bits are joined by ``bit_or``, which combines
    map-side; the sets of nodes are stored, so that adaptive execution splits the edges of a hub.
    """
    bits = numbered.select("seed", "word", F.expr("shiftleft(1L, bit) AS bits"))
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    hops = [
        ends.join(bits, ends[here] == bits["seed"]).select(F.col(there).alias("id"), "word", "bits")
        for here, there in (("src", "dst"), ("dst", "src"))
    ]
    near = bits.select(F.col("seed").alias("id"), "word", "bits").union(hops[0]).union(hops[1])
    near = store(near.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")), "near-seeds")
    kept = edges.where(F.col(weight) > min_weight) if weight else edges
    met = [kept.select("src", "dst").join(near, F.col(end) == F.col("id")).select("src", "dst", "word", "bits") for end in ("src", "dst")]
    return met[0].union(met[1]).groupBy("src", "dst", "word").agg(F.bit_or("bits").alias("seeds"))


def opened_sets(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """(seed, src, dst) of the sets of ``two_hop_sets``."""
    held = F.expr(f"filter(sequence(0, {SEEDS_PER_WORD - 1}), k -> (seeds & shiftleft(1L, k)) != 0)")
    return sets.withColumn("bit", F.explode(held)).join(numbered, ["word", "bit"]).select("seed", "src", "dst")


def two_hop_subgraph(
    edges: DataFrame, seeds: DataFrame, *, weight: str | None = None, min_weight: float = 0.1
) -> DataFrame:
    """(seed, src, dst): edges that touch a seed or one of its neighbours. ``two_hop_sets`` is the compact form."""
    numbered = numbered_seeds(seeds)
    return opened_sets(two_hop_sets(edges, numbered, weight=weight, min_weight=min_weight), numbered)


def sampling_key(*columns, seed: int = 0):
    """Order that looks random, yet is the same on every run and engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def neighbor_sample(
    edges: DataFrame, seeds: DataFrame, *, fanout: Sequence[int] = (25, 10, 5), seed: int = 0
) -> DataFrame:
    """(hop, src, dst): up to ``fanout[h]`` sampled in-edges per frontier node.

    The rank filter has a constant bound, so each task keeps only its best rows
    per node before the shuffle and a hub costs no more than any other node.
    """
    frontier = seeds.select("id").distinct()
    reached = frontier
    hops = []
    for hop, width in enumerate(fanout, start=1):
        candidates = edges.select("src", "dst").join(frontier, F.col("dst") == F.col("id"), "left_semi")
        order = Window.partitionBy("dst").orderBy(sampling_key("src", "dst", seed=seed + hop), "src")
        picked = cut_lineage(
            candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r")
        )
        hops.append(picked.select(F.lit(hop).alias("hop"), "src", "dst"))
        # nodes expanded once are not expanded again
        new = picked.select(F.col("src").alias("id")).distinct().join(reached, "id", "left_anti")
        frontier = cut_lineage(new)
        reached = reached.union(frontier)
    result = hops[0]
    for part in hops[1:]:
        result = result.union(part)
    return result


def neighbor_topk_cap(
    edges: DataFrame,
    *,
    node: str,
    relation: str = "relation",
    recency: str = "timestamp",
    amount: str = "amount",
    tie: str = "tx",
    caps: Mapping[str, int] = NEIGHBOR_CAPS,
    default_cap: int = NEIGHBOR_CAP_DEFAULT,
) -> DataFrame:
    """Latest edges per node and relation, up to the relation's cap."""
    cap = F.lit(default_cap)
    for name, k in caps.items():
        cap = F.when(F.col(relation) == name, k).otherwise(cap)
    order = Window.partitionBy(relation, node).orderBy(F.desc(recency), F.desc(amount), tie)
    ranked = edges.withColumn("neighbor_rank", F.row_number().over(order))
    # the constant bound lets every task drop rows before the shuffle
    largest = max([default_cap, *caps.values()])
    return ranked.where(F.col("neighbor_rank") <= largest).where(F.col("neighbor_rank") <= cap)


def top_scored(df: DataFrame, *, score: str, tie: str, k: int, mask: str | None = None) -> DataFrame:
    rows = df.where(F.col(mask)) if mask else df
    return rows.orderBy(F.desc(score), F.asc(tie)).limit(k)


def node_memory(events: DataFrame, *, node: str, ts: str, tie: str, message: Sequence[str], until=None) -> DataFrame:
    """Latest event of each node at or before ``until``."""
    rows = events if until is None else events.where(F.col(ts) <= until)
    latest = rows.groupBy(node).agg(F.max(F.struct(ts, tie, *message)).alias("m"))
    return latest.select(node, F.col(f"m.{ts}").alias("last_update"), *[F.col(f"m.{c}").alias(c) for c in message])
