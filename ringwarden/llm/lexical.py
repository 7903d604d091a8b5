"""Ranked lexical search by dual trees.

Items and documents are sparse vectors over the words of the items: an item holds a word's weight, a document the word's
damped frequency, and the score is their product. Both sides are put into hierarchies whose nodes hold the
coordinate maxima of what lies below. The product of two nodes bounds the score of every pair below them, so a
pair of nodes is dropped with all its documents and items when its bound is below the weakest k-th score of these
items. What is left is scored in whole numbers. A first pass over the best batch of every tree gives k-th scores to start
from, so that every task of the second pass prunes with what the whole corpus has to offer. No pair that could be
among the best is dropped, equal scores included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .support import small_batches, texts_of
from .text_arrays import chunks
from .words import Words, WordTable

TOP = 10
LENGTH_PERCENT = 90  # share of the length in the damping
SATURATION_TENTHS = 8
# The scale of damped frequencies and of weights.
DAMPED = 1_000_000_000
SCALE = 1000
# Text bytes of the items searched for together; what is broadcast is at most some 100 times that.
BLOCK_BYTES = 128 << 10
# Documents of a batch, of a tree, and the fan-out between them; postings of a tree.
LEAF = 32
FAN_OUT = 8
TREE_DOCUMENTS = 4096
TREE_POSTINGS = 2_000_000
ITEM_LEAF = 4

_NO_ID = (1 << 63) - 1


@dataclass
class Items:
    """A block of items: words, weights, the damping's numbers, and the k-th scores known so far."""

    words: list[bytes]
    member: np.ndarray  # items x words, 0 or 1
    weight: np.ndarray | None = None
    per_length: tuple[int, int] = (0, 1)  # documents, words in them
    known: np.ndarray | None = None


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[int]]:
    """Items with a block number so that no block is much larger than ``block_bytes``, unless one item is."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text") + 16)
    blocks = (rows.agg(F.sum("size").alias("n")).first()["n"] or 0) // block_bytes + 1
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        # one row per block
        sizes = dealt.groupBy("block").agg(F.sum("size").alias("n"), F.count_distinct("item_id", "text").alias("items")).orderBy("block").collect()
        if all(r["n"] <= 4 * block_bytes or r["items"] <= 1 for r in sizes):
            return dealt, [r["block"] for r in sizes]
        blocks *= 2


def _gathered(texts: list[str]) -> Items:
    words = Words(pa.array(texts, pa.string()))
    listed = sorted({words.bytes_of(k) for k in range(len(words))})
    number = WordTable(listed).find(words)
    member = np.zeros((len(texts), len(listed)), np.int64)
    member[words.row, number] = 1
    return Items(listed, member)


def postings(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n (words of the text), and packed numbers and frequencies of those of ``words`` in it; stored."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = WordTable(shared.value), max(len(shared.value), 1)
        for batch in chunks(batches, "text"):
            found = Words(batch.column("text"))
            number = table.find(found)
            hit = number >= 0
            key, n = np.unique(found.row[hit] * size + number[hit], return_counts=True)
            ends = np.searchsorted(key, np.arange(1, found.n_rows + 1) * size)
            cut = lambda a: pa.array([x.tobytes() for x in np.split(a.astype("<u4"), ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.per_row), cut(key % size), cut(n)], names=["doc_id", "n", "words", "times"]
            )

    return store(docs.mapInArrow(work, "doc_id long, n long, words binary, times binary"), "postings")


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each word; a task sends one row per word at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("words").to_pylist()), "<u4"), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["word", "n"])

    out = np.zeros(size, np.int64)
    for r in held.select("words").mapInArrow(tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _maxima(dense: np.ndarray, fan_out: int) -> np.ndarray:
    return np.maximum.reduceat(dense, np.arange(0, len(dense), fan_out), axis=0)


class ItemTree:
    """Items in an order that puts those of like words side by side, and the maxima of each level, from the leaves up."""

    def __init__(self, vectors: np.ndarray):
        top = np.argsort(-vectors, axis=1, kind="stable")[:, :3]
        self.order = np.lexsort(top.T[::-1])
        self.vectors = vectors[self.order]
        self.levels = [_maxima(self.vectors, ITEM_LEAF)]
        while len(self.levels[-1]) > FAN_OUT:
            self.levels.append(_maxima(self.levels[-1], FAN_OUT))

    @property
    def n(self) -> int:
        return len(self.vectors)


class DocumentTree:
    """Documents of one task, ordered by their weightiest words, with the maxima of batches and of groups of batches."""

    def __init__(self, doc_ids: np.ndarray, row: np.ndarray, word: np.ndarray, value: np.ndarray, weight: np.ndarray):
        n = len(doc_ids)
        order = np.lexsort((-value * weight[word], row))
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        ranked = word[order]
        keys = []
        for k in range(2):
            at = first[:-1] + k
            has = at < first[1:]
            key = np.full(n, len(weight), np.int64)
            key[has] = ranked[at[has]]
            keys.append(key)
        order = np.lexsort((keys[1], keys[0], -weight[np.minimum(keys[0], len(weight) - 1)]))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.doc_ids = doc_ids[order]
        self.columns, column = np.unique(word, return_inverse=True)
        at = place[row]
        by = np.argsort(at, kind="stable")
        self.at, self.column, self.value = at[by], column[by], value[by]
        leaves = np.zeros((-(-n // LEAF), len(self.columns)))
        np.maximum.at(leaves, (self.at // LEAF, self.column), self.value)
        self.levels = [leaves]
        while len(self.levels[-1]) > FAN_OUT:
            self.levels.append(_maxima(self.levels[-1], FAN_OUT))

    def leaf(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document ids and dense rows of a batch."""
        lo, hi = np.searchsorted(self.at, [k * LEAF, (k + 1) * LEAF])
        ids = self.doc_ids[k * LEAF : (k + 1) * LEAF]
        dense = np.zeros((len(ids), len(self.columns)))
        dense[self.at[lo:hi] - k * LEAF, self.column[lo:hi]] = self.value[lo:hi]
        return ids, dense


class Best:
    """The best documents so far of each item, in the order of the item tree."""

    def __init__(self, known: np.ndarray, top: int):
        self.top = top
        self.score = np.zeros((len(known), top), np.int64)
        self.doc = np.full((len(known), top), _NO_ID, np.int64)
        self.known = np.maximum(known, 1)

    @property
    def weakest(self) -> np.ndarray:
        """A score that a further document must reach."""
        return np.maximum(self.score[:, -1], self.known)

    def offer(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores: items x documents."""
        some = (scores >= self.weakest[items][:, None]).any(axis=1)
        for i, row in zip(items[some].tolist(), scores[some]):
            fit = row >= max(self.score[i, -1], self.known[i])
            score, doc = np.concatenate([self.score[i], row[fit]]), np.concatenate([self.doc[i], ids[fit]])
            keep = np.lexsort((doc, -score))[: self.top]
            self.score[i], self.doc[i] = score[keep], doc[keep]


def _least(weakest: np.ndarray, size: int) -> np.ndarray:
    return np.minimum.reduceat(weakest, np.arange(0, len(weakest), size))


def _exact(vectors: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Scores in whole numbers: by floating point where all sums stay below 2**53."""
    if float(vectors.sum(axis=1).max(initial=0)) * float(dense.max(initial=0)) < 2.0**53:
        return np.rint(vectors @ dense.T).astype(np.int64)
    return vectors.astype(np.int64) @ dense.astype(np.int64).T


# Above 2**53 bounds are rounded; this much is added so that none is too low.
_ROUNDED = 1 + 1e-9


def search_tree(items: ItemTree, tree: DocumentTree, best: Best) -> int:
    """Descend both hierarchies together; ``best`` takes what is found. Returns how many batches were scored."""
    item_levels = [level[:, tree.columns] for level in items.levels]
    sizes = [ITEM_LEAF * FAN_OUT**k for k in range(len(item_levels))]
    i, d = len(item_levels) - 1, len(tree.levels) - 1
    alive = np.ones((len(item_levels[i]), len(tree.levels[d])), bool)
    while True:
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return 0
        bound = np.zeros(alive.shape)
        bound[np.ix_(rows, cols)] = item_levels[i][rows] @ tree.levels[d][cols].T * _ROUNDED
        alive &= bound >= _least(best.weakest, sizes[i])[:, None]
        if i == 0 and d == 0:
            break
        # the side with more levels left goes down; both where they are level
        down_i, down_d = i >= d and i > 0, d >= i and d > 0
        if down_i:
            i -= 1
            alive = np.repeat(alive, FAN_OUT, axis=0)[: len(item_levels[i])]
        if down_d:
            d -= 1
            alive = np.repeat(alive, FAN_OUT, axis=1)[:, : len(tree.levels[d])]
    scored = 0
    for leaf in np.argsort(-np.where(alive, bound, 0).max(axis=0), kind="stable").tolist():
        nodes = np.flatnonzero(alive[:, leaf] & (bound[:, leaf] >= _least(best.weakest, ITEM_LEAF)))
        if not len(nodes):
            continue
        which = (nodes[:, None] * ITEM_LEAF + np.arange(ITEM_LEAF)).ravel()
        which = which[which < items.n]
        ids, dense = tree.leaf(leaf)
        best.offer(which, ids, _exact(items.vectors[which][:, tree.columns], dense))
        scored += 1
    return scored


def best_batches(items: ItemTree, tree: DocumentTree, best: Best) -> None:
    """Score each item's own most promising batch."""
    bound = items.vectors[:, tree.columns] @ tree.levels[0].T
    favourite = bound.argmax(axis=1)
    for leaf in np.unique(favourite[bound.max(axis=1) > 0]).tolist():
        which = np.flatnonzero(favourite == leaf)
        ids, dense = tree.leaf(leaf)
        best.offer(which, ids, _exact(items.vectors[which][:, tree.columns], dense))


def _trees(batches: Iterator[pa.RecordBatch], items: Items, length_percent: int, tenths: int) -> Iterator[DocumentTree]:
    documents, words_of_all = items.per_length
    held, postings_held = [], 0

    def grown() -> DocumentTree:
        ids, n, row, word, times = (np.concatenate(c) for c in zip(*held))
        length = (100 - length_percent) + length_percent * n * documents // max(words_of_all, 1)
        value = DAMPED * times // (SCALE * times + tenths * length[row])
        return DocumentTree(ids, row, word, value, items.weight)

    count = 0
    for batch in batches:
        packed = [batch.column(c).to_pylist() for c in ("words", "times")]
        sizes = np.array([len(x) // 4 for x in packed[0]], np.int64)
        word, times = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in packed)
        ids = np.array(batch.column("doc_id").fill_null(_NO_ID), np.int64)
        n = np.array(batch.column("n"), np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ids):
            room = min(TREE_DOCUMENTS - count, len(ids) - start)
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(start + room, int(np.searchsorted(ends, before + TREE_POSTINGS - postings_held, side="right"))))
            after = int(ends[stop - 1])
            row = np.repeat(np.arange(stop - start), sizes[start:stop]) + count
            held.append((ids[start:stop], n[start:stop], row, word[before:after], times[before:after]))
            count, postings_held, start = count + stop - start, postings_held + after - before, stop
            if count >= TREE_DOCUMENTS or postings_held >= TREE_POSTINGS:
                yield grown()
                held, postings_held, count = [], 0, 0
    if held:
        yield grown()


def _searched(held: DataFrame, items: Items, top: int, length_percent: int, tenths: int, seeds: bool) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item; item is the row number in the block."""
    shared = held.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tree_of_items = ItemTree((own.member * own.weight).astype(np.float64))
        best = Best(own.known[tree_of_items.order], top)
        for tree in _trees(batches, own, length_percent, tenths):
            if len(tree.columns):
                (best_batches if seeds else search_tree)(tree_of_items, tree, best)
        place, k = np.nonzero(best.score >= best.known[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree_of_items.order[place]), pa.array(best.doc[place, k]), pa.array(best.score[place, k])], names=["item", "doc_id", "score"]
        )

    matching = held.where("length(words) > 0").select("doc_id", "n", "words", "times")
    return matching.mapInArrow(work, "item long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    items: DataFrame, docs: DataFrame, top: int = TOP, length_percent: int = LENGTH_PERCENT, tenths: int = SATURATION_TENTHS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` highest-scoring rows of ``docs`` for each row of ``items``.

    Only scores above 0 count; equal ones go by ascending doc_id, null last. Null text has no words, and an item without words
    finds nothing. Repeated documents are found each; an item_id that repeats is searched for once per row, and ranks
    count per row. Empty tables give no rows. Other columns are not read.
    """
    spark = small_batches(docs.sparkSession)
    rows = texts_of(docs)
    dealt, blocks = item_blocks(items, block_bytes)
    out = None
    for block in blocks:
        part = dealt.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()  # bounded by item_blocks
        known = _gathered([r["text"] for r in part])
        if not known.words:
            continue
        held = postings(rows, known.words)
        totals = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("words")).first()
        known.per_length = (totals["documents"], totals["words"] or 0)
        df = document_frequencies(held, len(known.words))
        known.weight = np.array([math.floor(SCALE * math.log((2 * totals["documents"] + 2) / (2 * int(k) + 1))) for k in df], np.int64)
        known.known = np.zeros(len(part), np.int64)
        seeds = _ranked(_searched(held, known, top, length_percent, tenths, True), top)
        for r in seeds.where(F.col("rank") == top).select("item", "score").collect():  # one row per item of the block
            known.known[r["item"]] = r["score"]
        found = _ranked(_searched(held, known, top, length_percent, tenths, False), top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(part)], "item long, item_id long")
        found = found.join(F.broadcast(names), "item").select(
            "item_id", "rank", F.nullif(F.col("doc_id"), F.lit(_NO_ID)).alias("doc_id"), "score"
        )
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
