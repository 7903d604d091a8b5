"""Boosted trees on gradient histograms, grown by levels or best leaf first.

Features are cut into bins once. A round then sends the tree so far out and adds up, per open node,
feature and bin, the gradients that come back; the rows stay where they are. Rows that fit one block
grow in one task, more are dealt over blocks. Gradients are rounded to multiples of a power of two and
draws follow from a row's values, so sums are exact and the same rows give the same trees however they
are dealt out.
"""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .ordered import Ascending, running_totals

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows one task holds, and the least worth a task of their own.
BLOCK_ROWS = 131_072
SMALL_BLOCK_ROWS = 32_768
# Blocks whose histograms the driver adds up itself; more are added up on the way.
FLAT_SUM = 16
CHECKPOINT_ROUNDS = 25
MIN_GAIN = 1e-6
MIN_HESSIAN = 1e-3


class BoostedTrees:
    """A fitted model; ``transform`` adds ``probability``, that of label 1."""

    def __init__(self, features: Sequence[str], cuts: list[np.ndarray], trees: list[dict]):
        self.features, self.cuts, self.trees = list(features), cuts, trees

    def transform(self, df: DataFrame) -> DataFrame:
        names, cuts, trees = self.features, self.cuts, self.trees

        def run(*columns):
            bins = np.stack([_binned(c.to_numpy("float64"), cut, name) for c, cut, name in zip(columns, cuts, names)])
            margin = np.zeros(bins.shape[1])
            for tree in trees:
                margin += tree["value"][_leaf_of(bins, tree)]
            return pd.Series(_chance(margin))

        score = F.pandas_udf(run, "double")
        return df.withColumn("probability", score(*[F.col(c).cast("double") for c in names]))

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            split = tree["feature"] >= 0
            np.add.at(total, tree["feature"][split], tree["gain"][split])
        return total / total.sum() if total.sum() > 0 else total


def fit(
    rows: DataFrame, features: Sequence[str], *, label: str, weight: str = "weight", held: str | None = None,
    id_column: str = "account_id", trees: int, depth: int, leaves: int | None = None, learning_rate: float,
    subsample: float, min_rows: int, l2: float, bins: int = 255, patience: int | None = None, seed: int = 42,
) -> BoostedTrees:
    """Trees on the rows that are not ``held``.

    With ``patience``, the fit ends when the log loss of the held rows has not fallen for so many trees
    and returns the trees up to the lowest. ``leaves`` splits the leaf of the highest gain first, up to
    that number. ``rows`` is read three times.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    is_held = F.col(held) if held else F.lit(False)
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_held, 1)).alias("held"),
        F.coalesce(F.sum(F.when(~is_held, F.col(weight))), F.lit(0.0)).alias("mass"),
    ).first()
    if sizes["n"] == sizes["held"]:
        raise ValueError("no rows to train on")
    cuts = cut_points(rows.where(~is_held), features, bins)
    plan = {
        "trees": trees, "depth": depth, "leaves": leaves, "rate": learning_rate, "subsample": subsample,
        "min_rows": min_rows, "l2": l2, "patience": patience if sizes["held"] else None, "seed": seed,
        "width": max(len(c) for c in cuts) + 1,
        # sums of whole numbers stay exact below 2**53
        "scale": 2.0 ** min(40, 51 - int(np.ceil(np.log2(max(sizes["mass"], 1.0))))),
    }
    n = sizes["n"]
    parts = 1
    if n > BLOCK_ROWS:
        spread = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_BLOCK_ROWS))
        parts = max(-(-n // BLOCK_ROWS), spread)
    blocks = _blocks(rows, features, cuts, label, weight, is_held, id_column, parts)
    if parts == 1:
        grown = pickle.loads(blocks.map(lambda block: pickle.dumps(_boost(_OneBlock(block, plan), plan))).first())
    else:
        shared_folder(rows.sparkSession)  # where checkpoints go
        grown = _boost(_DealtBlocks(blocks, plan), plan)
    return BoostedTrees(features, cuts, grown)


# --- bins -------------------------------------------------------------------------------


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature the borders between bins: one bin per value where they suffice, else equal shares of the rows.

    What reaches the driver is ``bins`` rows per feature at most.
    """
    values = F.array(*[F.col(c).cast("double") for c in features])
    counts = rows.select(F.posexplode(values).alias("j", "value")).groupBy("j", "value").agg(
        F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("one")
    )
    ladder = running_totals(counts, keys=["j"], order=[Ascending("value")], sums={"upto": "n", "place": "one"})
    # one row per feature
    totals = ladder.groupBy("j").agg(F.max("upto").alias("rows"), F.max("place").alias("values"))
    share = F.ceil(F.col("upto") * bins / F.col("rows"))
    grouped = ladder.join(F.broadcast(totals), "j").groupBy(
        "j", F.when(F.col("values") <= bins, F.col("place")).otherwise(share).alias("bin")
    ).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    found: dict[int, list[tuple]] = {}
    for r in grouped.collect():
        found.setdefault(r["j"], []).append((r["bin"], r["low"], r["high"]))
    return [_borders(sorted(found[j], key=lambda b: b[0])) for j in range(len(features))]


def _borders(groups: list[tuple]) -> np.ndarray:
    """Midway between neighbouring bins, but never at the upper one's value."""
    borders = []
    for (_, _, high), (_, low, _) in zip(groups, groups[1:]):
        if high is None or low is None:
            raise ValueError("a feature is null")
        with np.errstate(invalid="ignore"):
            middle = high + (np.float64(low) - high) / 2
        borders.append(middle if high <= middle < low else high)
    return np.array(borders, dtype="float64")


def _binned(values: np.ndarray, cuts: np.ndarray, name: str) -> np.ndarray:
    if np.isnan(values).any():
        raise ValueError(f"{name} is null or not a number")
    return np.searchsorted(cuts, values).astype("uint8")


def _blocks(rows, features, cuts, label, weight, is_held, id_column, parts):
    """An RDD of blocks: bins (feature by row), label, weight, held, draw key and score so far."""
    names = list(features)
    # equal rows draw alike, whatever task they are in
    key = F.xxhash64(*[c for c in (id_column,) if c in rows.columns], label, *names)
    wide = rows.select(
        *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)], F.col(label).cast("double").alias("y"),
        F.col(weight).cast("double").alias("w"), is_held.alias("held"), key.alias("key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            take = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            y = take("y").astype("float64")
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError(f"{label} must be 0 or 1")
            bins = np.stack([_binned(take(f"f{i}").astype("float64"), cuts[i], name) for i, name in enumerate(names)])
            held.append((bins, y.astype("int8"), take("w").astype("float64"), take("held").astype(bool), take("key").astype("int64").view("uint64")))
        if held:
            block = (np.concatenate([h[0] for h in held], axis=1), *[np.concatenate([h[i] for h in held]) for i in range(1, 5)])
            whole = pickle.dumps((*block, np.zeros(len(block[1]))))
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["block"])

    return wide.repartition(parts).mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


# --- rows -------------------------------------------------------------------------------


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(np.clip(-margin, -700.0, 700.0)))


def _leaf_of(bins: np.ndarray, tree: dict, node: np.ndarray | None = None, steps: int | None = None) -> np.ndarray:
    """Node of every row after ``steps`` splits, or its leaf."""
    feature, cut, left = tree["feature"], tree["cut"], tree["left"]
    at = np.arange(bins.shape[1])
    node = np.zeros(bins.shape[1], dtype="int64") if node is None else node
    for _ in range(tree["depth"] if steps is None else steps):
        f = feature[node]
        node = np.where(f >= 0, left[node] + (bins[f, at] > cut[node]), node)
    return node


def _drawn(key: np.ndarray, plan: dict, number: int) -> np.ndarray:
    """Rows of tree ``number``: a hash (splitmix64) of the row's key and the tree."""
    with np.errstate(over="ignore"):
        z = key + np.uint64((plan["seed"] * 0xD1342543DE82EF95 + (number + 1) * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * 2.0**-53 < plan["subsample"]


def _drawn_rows(block: tuple, plan: dict, number: int) -> tuple:
    """Bins, gradients and curvatures of the rows a tree is grown on."""
    bins, y, w, held, key, margin = block
    used = np.flatnonzero(_drawn(key, plan, number) & ~held)
    p, weight = _chance(margin[used]), w[used] * plan["scale"]
    return bins[:, used], np.rint(weight * (p - y[used])), np.rint(weight * p * (1.0 - p))


def _with_tree(block: tuple, tree: dict) -> tuple:
    return (*block[:5], block[5] + tree["value"][_leaf_of(block[0], tree)])


def _held_loss(block: tuple) -> float:
    """Log loss of the held rows, in whole multiples of 2**-20."""
    _, y, _, held, _, margin = block
    m = margin[held]
    return float(np.rint((np.logaddexp(0.0, m) - y[held] * m) * 2.0**20).sum())


def _histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """(3, nodes, features, bins): gradients, curvatures and rows of the ``wanted`` nodes."""
    slot_of = np.full(max(int(node.max(initial=0)), int(wanted.max())) + 1, -1, dtype="int64")
    slot_of[wanted] = np.arange(len(wanted))
    slot = slot_of[node]
    rows = np.flatnonzero(slot >= 0)
    base, g, h = slot[rows] * width, g[rows], h[rows]
    size = len(wanted) * width
    out = np.empty((3, len(wanted), len(bins), width))
    for f, column in enumerate(bins):
        index = base + column[rows]
        out[0, :, f] = np.bincount(index, g, size).reshape(-1, width)
        out[1, :, f] = np.bincount(index, h, size).reshape(-1, width)
        out[2, :, f] = np.bincount(index, minlength=size).reshape(-1, width)
    return out


class _OneBlock:
    """All rows in this process."""

    def __init__(self, block: tuple, plan: dict):
        self.block, self.plan = block, plan

    def next_round(self, tree: dict | None, number: int) -> tuple[float, np.ndarray]:
        if tree is not None:
            self.block = _with_tree(self.block, tree)
        self.drawn = _drawn_rows(self.block, self.plan, number)
        self.node = np.zeros(self.drawn[0].shape[1], dtype="int64")
        return _held_loss(self.block), _histograms(*self.drawn, self.node, np.zeros(1, dtype="int64"), self.plan["width"])

    def histograms(self, tree: dict, wanted: np.ndarray, number: int) -> np.ndarray:
        self.node = _leaf_of(self.drawn[0], tree, self.node, 1)
        return _histograms(*self.drawn, self.node, wanted, self.plan["width"])

    def release(self) -> None:
        pass


class _DealtBlocks:
    """Blocks cached over the cluster; scores go on by one tree a round."""

    def __init__(self, blocks, plan: dict):
        self.plan, self.blocks = plan, blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.checkpoint()

    def _added(self, job) -> list[np.ndarray]:
        parts = self.blocks.map(job)
        if self.blocks.getNumPartitions() > FLAT_SUM:
            return parts.treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])
        return [sum(part) for part in zip(*parts.collect())]

    def next_round(self, tree: dict | None, number: int) -> tuple[float, np.ndarray]:
        plan, before = self.plan, self.blocks
        if tree is not None:
            self.blocks = before.map(lambda block: _with_tree(block, tree)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % CHECKPOINT_ROUNDS == 0:
                self.blocks.checkpoint()

        def start(block):
            bins, g, h = _drawn_rows(block, plan, number)
            root = np.zeros(1, dtype="int64")
            return [_held_loss(block), _histograms(bins, g, h, np.zeros(len(g), dtype="int64"), root, plan["width"])]

        loss, root = self._added(start)
        if tree is not None:
            before.unpersist()
        return loss, root

    def histograms(self, tree: dict, wanted: np.ndarray, number: int) -> np.ndarray:
        plan = self.plan

        def level(block):
            bins, g, h = _drawn_rows(block, plan, number)
            return [_histograms(bins, g, h, _leaf_of(bins, tree), wanted, plan["width"])]

        return self._added(level)[0]

    def release(self) -> None:
        self.blocks.unpersist()


# --- trees ------------------------------------------------------------------------------


def _boost(rows, plan: dict) -> list[dict]:
    trees, best, lowest = [], 0, np.inf
    for number in range(plan["trees"]):
        loss, root = rows.next_round(trees[-1] if trees else None, number)
        if plan["patience"] and trees:
            if loss < lowest:
                best, lowest = len(trees), loss
            elif len(trees) - best >= plan["patience"]:
                break
        trees.append(_grow(rows, root, number, plan))
    else:
        if plan["patience"] and trees and rows.next_round(trees[-1], plan["trees"])[0] < lowest:
            best = len(trees)
    rows.release()
    return trees[:best] if plan["patience"] else trees


def _value(g: float, h: float, plan: dict) -> float:
    bottom = h / plan["scale"] + plan["l2"]
    return -plan["rate"] * (g / plan["scale"]) / bottom if bottom > 0 else 0.0


def _grow(rows, root: np.ndarray, number: int, plan: dict) -> dict:
    """One tree, a level a round: only the smaller child of a split is added up, the other is what remains of its parent.

    A node's best split does not depend on its neighbours, so the best-first tree is the part of the
    level-wise one that is left when its splits are taken by gain.
    """
    feature, cut, left, gain = [-1], [0], [-1], [0.0]
    value = [_value(*root[:2, 0, 0].sum(axis=1), plan)]
    open_nodes, sums = [0], root
    as_tree = lambda depth: {
        "feature": np.array(feature, "int64"), "cut": np.array(cut, "int64"), "left": np.array(left, "int64"),
        "value": np.array(value), "gain": np.array(gain), "depth": depth,
    }
    depth = 0
    while depth < plan["depth"] and open_nodes:
        depth += 1
        children = []  # slot of the parent, then (node, rows) of the smaller and of the larger child
        for slot, f, b, won, low in _best_splits(sums, plan):
            node = open_nodes[slot]
            feature[node], cut[node], left[node], gain[node] = f, b, len(feature), won
            whole = sums[:, slot, 0].sum(axis=1)
            for side in (low, whole - low):
                feature.append(-1), cut.append(0), left.append(-1), gain.append(0.0)
                value.append(_value(side[0], side[1], plan))
            first = left[node]
            pair = [(first, low[2]), (first + 1, whole[2] - low[2])]
            children.append((slot, *sorted(pair, key=lambda c: c[1])))
        if depth == plan["depth"]:
            break
        least = 2 * plan["min_rows"]
        grown = [c for c in children if c[2][1] >= least]
        if not grown:
            break
        asked = np.array([small for _, (small, _), _ in grown])
        got = rows.histograms(as_tree(depth), asked, number)
        rest = sums[:, [slot for slot, _, _ in grown]] - got
        small_too = [i for i, (_, (_, n), _) in enumerate(grown) if n >= least]
        open_nodes = [large for _, _, (large, _) in grown] + [grown[i][1][0] for i in small_too]
        sums = np.concatenate([rest, got[:, small_too]], axis=1)
    tree = as_tree(depth)
    return _best_first(tree, plan["leaves"]) if plan["leaves"] else tree


def _best_splits(sums: np.ndarray, plan: dict) -> Iterator[tuple]:
    """(slot, feature, bin, gain, sums left of the split) of the nodes worth splitting."""
    low = np.cumsum(sums, axis=3)
    whole = low[:, :, :1, -1:]
    high = whole - low
    scale, l2 = plan["scale"], plan["l2"]
    least = MIN_HESSIAN * scale
    fits = (low[2] >= plan["min_rows"]) & (high[2] >= plan["min_rows"]) & (low[1] >= least) & (high[1] >= least)
    strength = lambda s: (s[0] / scale) ** 2 / (s[1] / scale + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        won = np.where(fits, strength(low) + strength(high) - strength(whole), -np.inf)
    flat = won.reshape(len(won), -1)
    for slot, at in enumerate(flat.argmax(axis=1)):
        if flat[slot, at] > MIN_GAIN:
            f, b = divmod(int(at), won.shape[2])
            yield slot, f, b, float(flat[slot, at]), low[:, slot, f, b]


def _best_first(tree: dict, leaves: int) -> dict:
    """The splits made when the leaf of the highest gain is split until there are ``leaves``."""
    kept, heap = np.zeros(len(tree["feature"]), dtype=bool), [(-tree["gain"][0], 0)]
    while heap and kept.sum() < leaves - 1:
        _, node = heapq.heappop(heap)
        if tree["feature"][node] < 0:
            continue
        kept[node] = True
        for child in (tree["left"][node], tree["left"][node] + 1):
            heapq.heappush(heap, (-tree["gain"][child], int(child)))
    return tree | {"feature": np.where(kept, tree["feature"], -1), "gain": np.where(kept, tree["gain"], 0.0)}
