"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking by cosine.

Rotations are learned on a bounded sample, so that the signs of the rotated components make balanced binary codes (iterative
quantisation). The codes are cut into tables of w bits, w near log2 of the vectors, and vectors of one label that share
a table's bits meet. Their cosine from the original vectors, in double precision, decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width, store
from .support import components, small_batches

THRESHOLD = 0.93
# Bound of the sample the rotations are learned on.
SAMPLE = 20_000
ROUNDS = 30
# Share of pairs at the threshold that the tables bring together, by the angle alone.
RECALL = 0.99
MIN_BITS, MAX_BITS = 8, 30
# Vectors of one bucket that a task compares at once; a larger bucket is cut into tiles.
TILE = 2_000


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """An orthogonal matrix that brings the centred sample close to its signs (Gong and Lazebnik's iteration)."""
    d = sample.shape[1]
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(rounds if len(sample) else 0):
        u, _, v = np.linalg.svd(np.sign(sample @ q).T @ sample)
        q = (u @ v).T
    return q


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(n, 2)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _linked(u: np.ndarray, v: np.ndarray, ku: np.ndarray, kv: np.ndarray, table: int, threshold: float, same: bool):
    """Index pairs of vectors with enough cosine that no earlier table has brought together."""
    i, j = np.nonzero(u @ v.T >= threshold)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    if table and len(i):
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= ku[i, t] != kv[j, t]
        i, j = i[new], j[new]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected to."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Only rows of equal labels are compared. A vector that is null, zero, or holds null or non-finite components links with
    nothing, and so does one without label or vec_id; its component is its own vec_id. Vectors of another length than
    the most frequent one meet among themselves through zero padding. Equal vectors are one in the tables and count
    each in n_links. Repeated rows count as vectors of their own, though with one id.
    """
    spark = small_batches(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(column).cast("array<double>").alias("v")
    )
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("ok", F.coalesce(good & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    alike = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # equal vectors under equal ids leave one representative id for several vectors; the label keeps them apart
    reps = store(alike.select("rep", "label", "v", "copies", F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    width = reps.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    bits, tables = plan(sizes["n"], threshold)
    picked = reps.orderBy(F.xxhash64("rep", "label"), "rep", "label").limit(SAMPLE).select("v").collect()
    sample = np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in picked])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centre = sample.mean(axis=0)
    rotations = np.concatenate([learn_rotation(sample - centre, s) for s in range(-(-bits * tables // width))], axis=1)[:, : bits * tables]
    shared = spark.sparkContext.broadcast((rotations, centre))  # bits x tables columns

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, middle = shared.value
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            sign = ((u - middle) @ turn > 0).reshape(len(u), tables, bits)
            keys = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            packed = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), tables).cast(pa.list_(pa.int64()))
            unit = pa.array([x.tobytes() for x in u], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "label", "copies")] + [packed, unit], names=["node", "label", "copies", "keys", "unit"])

    coded = store(reps.select("node", "label", "copies", "v").mapInArrow(code, "node long, label long, copies long, keys array<long>, unit binary"), "codes")
    buckets = coded.select("node", "label", F.posexplode("keys").alias("t", "k")).groupBy("label", "t", "k").agg(F.count(F.lit(1)).alias("size"))
    # only buckets of two and more go on; stored, so that both sides of the join are dealt anew and hot ones split
    buckets = store(buckets.where("size > 1").select("label", "t", "k", F.ceil(F.col("size") / TILE).cast("int").alias("parts")), "vector-buckets")
    placed = coded.select("*", F.posexplode("keys").alias("t", "k")).join(buckets, ["label", "t", "k"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = ["label", "t", "k", "i", "j"]
    placed = placed.select("label", "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "keys", "unit")
    dealt = placed.repartition(shuffle_width(spark), *tile).sortWithinPartitions(*tile)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tiles(table: pa.Table, last: bool):
            place = np.stack([table.column(c).to_numpy() for c in tile], 1)
            cut = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            edges = [0, *cut.tolist(), len(place)]
            return [(a, b) for a, b in zip(edges[:-1], edges[1:])], edges[-2] if not last else len(place)

        def judge(table: pa.Table, spans: list[tuple[int, int]]) -> pa.RecordBatch | None:
            nodes, seen, lows = [], [], []
            units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(table), width)
            keys = np.array(table.column("keys").combine_chunks().flatten()).reshape(len(table), tables)
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            i_, j_, own_, t_ = (table.column(c).to_numpy() for c in ("i", "j", "own", "t"))
            for a, b in spans:
                if b - a < 2:
                    continue
                if i_[a] == j_[a]:
                    x = y = np.arange(a, b)
                else:
                    side = own_[a:b] == i_[a]
                    x, y = np.flatnonzero(side) + a, np.flatnonzero(~side) + a
                p, q = _linked(units[x], units[y], keys[x], keys[y], int(t_[a]), threshold, i_[a] == j_[a])
                if not len(p):
                    continue
                p, q = x[p] - a, y[q] - a
                count = np.bincount(p, copies[a + q], b - a) + np.bincount(q, copies[a + p], b - a)
                low = _forest(b - a, p, q)
                hit = np.flatnonzero(count)
                nodes.append(node[a + hit])
                seen.append(count[hit].astype(np.int64))
                lows.append(node[a + low[hit]])
            if not nodes:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (nodes, seen, lows)], names=["node", "n", "low"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            spans, done = tiles(table, False)
            if done:
                out = judge(table.slice(0, done), spans[:-1])
                held = table.slice(done).to_batches()
                if out is not None:
                    yield out
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                out = judge(table, tiles(table, True)[0])
                if out is not None:
                    yield out

    met = store(dealt.mapInArrow(compare, "node long, n long, low long"), "vector-links")
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    edges = met.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    joined = components(edges)
    named = reps.select("node", "rep", "label", "v", "copies").join(joined.withColumnRenamed("id", "node"), "node", "left")
    named = store(named.withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left"), "vector-classes")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(smallest, "component").select("label", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    found = store(found, "vector-classes")
    linkable = rows.where("ok").join(found, ["label", "v"]).select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out
