"""Resampling of documents towards a target distribution by hashed n-gram features.

A feature is a run of one to ``longest`` words; its bucket is the CRC-32 of its bytes modulo the number of buckets. Words
follow Zipf's law, so a head of frequent words covers most occurrences: their CRC states, and the buckets of frequent
pairs of them, are worked out once and broadcast, and found by exact comparison of the bytes. Words of the tail are summed up
directly, and longer runs go on from the state of the run before. Either way gives the same bucket, so the totals
are exact and the head is a matter of speed only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import Ascending, Descending, global_rank
from ..session import store
from .support import small_batches, texts_of
from .text_arrays import chunks
from .words import Words, WordTable, crc32, crc32_space

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Sizes of the broadcast head: words and pairs of words.
HEAD_WORDS = 16_384
HEAD_PAIRS = 65_536
# Distinct words or pairs a task counts before it lets go of the rarest half; this changes which ones make the head, no total.
COUNTED = 400_000
# Fixed value: the smoothing of the gains.
SCALE = 1000


class _Tally:
    """Counts of up to COUNTED keys, each with columns that go along."""

    def __init__(self):
        self.key = self.n = None
        self.more: list[np.ndarray] = []

    def add(self, key: np.ndarray, *more: np.ndarray) -> None:
        found, first, n = np.unique(key, return_index=True, return_counts=True)
        more = [m[first] for m in more]
        if self.key is not None:
            found, n = np.concatenate([self.key, found]), np.concatenate([self.n, n])
            more = [np.concatenate(pair) for pair in zip(self.more, more)]
            found, first, back = np.unique(found, return_index=True, return_inverse=True)
            n = np.bincount(back, n, len(found)).astype(np.int64)
            more = [m[first] for m in more]
        self.key, self.n, self.more = found, n, more
        if len(found) > COUNTED:
            self._keep(COUNTED // 2)

    def _keep(self, most: int) -> None:
        top = np.argsort(-self.n, kind="stable")[:most]
        self.key, self.n, self.more = self.key[top], self.n[top], [m[top] for m in self.more]

    def top(self, most: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            self._keep(most)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*self.more, self.n)], names=names)


def _most_frequent(counted: DataFrame, most: int) -> list:
    """Rows with the highest n, ``most`` at most: a cut on an eighth of a doubling is found first, so no task sends more."""
    counted = store(counted.withColumn("step", F.floor(F.log2("n") * 8)), "frequent")
    held, cut = 0, None
    for r in sorted(counted.groupBy("step").agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["step"]):
        held += r["rows"]
        if held > most:
            break
        cut = r["step"]
    return [] if cut is None else counted.where(F.col("step") >= cut).collect()


def frequent_words(docs: DataFrame, most: int = HEAD_WORDS) -> list[bytes]:
    """The most frequent words of up to 16 bytes; a task sends its own ``most`` words at most."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in chunks(batches, "text"):
            low, high, whole = Words(batch.column("text")).packed()
            low, high = low[whole], high[whole]
            tally.add(low ^ high * np.uint64(0x9E3779B97F4A7C15), low.view(np.int64), high.view(np.int64))
        yield from tally.top(most, ["low", "high", "n"])

    counted = docs.select("text").mapInArrow(count, "low long, high long, n long").groupBy("low", "high").agg(F.sum("n").alias("n"))
    return sorted(np.array([r["low"], r["high"]], "<i8").tobytes().rstrip(b"\0") for r in _most_frequent(counted, most))


def frequent_pairs(docs: DataFrame, head: list[bytes], most: int = HEAD_PAIRS) -> np.ndarray:
    """Frequent pairs of neighbouring head words: number of the first times the head's size, plus that of the second."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tally, size = WordTable(shared.value), _Tally(), len(shared.value)
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text"))
            number = table.find(words)
            both = (number[:-1] >= 0) & (number[1:] >= 0) & (words.row[:-1] == words.row[1:])
            key = (number[:-1] * size + number[1:])[both]
            tally.add(key, key)
        yield from tally.top(most, ["pair", "n"])

    counted = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["pair"] for r in _most_frequent(counted, most)), np.int64)


@dataclass
class Head:
    """What is broadcast: frequent words with their CRC states, frequent pairs with their buckets."""

    words: list[bytes]
    states: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], pairs: np.ndarray, buckets: int) -> Head:
        column = pa.array([w.decode() for w in words], pa.string())
        listed = Words(column)
        states = crc32(listed, np.arange(len(words)))
        first, second = np.divmod(pairs, max(len(words), 1))
        after = crc32(listed, second, crc32_space(states[first]))
        return cls(words, states, pairs, (after % np.uint32(buckets)).astype(np.int64))


class Features:
    """Buckets of all features of a chunk of texts."""

    def __init__(self, head: Head, longest: int, buckets: int):
        self.head, self.longest, self.buckets = head, longest, buckets
        self.table = WordTable(head.words)

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of every feature, repeats included."""
        number = self.table.find(words)
        state = np.zeros(len(words), np.uint32)
        frequent = number >= 0
        state[frequent] = self.head.states[number[frequent]]
        tail = np.flatnonzero(~frequent)
        state[tail] = crc32(words, tail)
        rows, found = [words.row], [state % np.uint32(self.buckets)]
        for m in range(2, self.longest + 1):
            last = np.arange(m - 1, len(words))
            last = last[words.row[last] == words.row[last - m + 1]]
            bucket, rest = np.zeros(len(last), np.int64), np.arange(len(last))
            if m == 2 and self.longest == 2 and len(self.head.pairs):  # longer runs need the state of every pair
                pair = np.where((number[last - 1] >= 0) & (number[last] >= 0), number[last - 1] * len(self.head.words) + number[last], -1)
                at = np.minimum(np.searchsorted(self.head.pairs, pair), len(self.head.pairs) - 1)
                known = self.head.pairs[at] == pair
                bucket[known], rest = self.head.pair_buckets[at[known]], np.flatnonzero(~known)
            after = crc32(words, last[rest], crc32_space(state[last[rest] - m + 1]))
            bucket[rest] = after % np.uint32(self.buckets)
            rows.append(words.row[last])
            found.append(bucket)
            # a run is kept at its first word
            state = state.copy()
            state[last[rest] - m + 1] = after
        return np.concatenate(rows), np.concatenate(found)


def featured(docs: DataFrame, head: Head, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words and the packed buckets of every row, stored."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(head)
    kind = _width(buckets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value, longest, buckets)
        for batch in chunks(batches, "text"):
            words = Words(batch.column("text"))
            row, bucket = features.of(words)
            bucket = bucket[np.argsort(row, kind="stable")].astype(kind)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.n_rows))]) * kind.itemsize
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), words.n_rows, [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(bucket.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.per_row), packed.cast(pa.binary())], names=["doc_id", "n_words", "buckets"])

    return store(docs.mapInArrow(work, "doc_id long, n_words long, buckets binary"), "features")


def _width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every feature in a column of packed buckets."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values], np.int64) // kind.itemsize
    return np.repeat(np.arange(len(values)), sizes), np.frombuffer(b"".join(values), kind).astype(np.int64)


def bucket_totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows; a task sends one row per bucket at most."""
    kind = _width(buckets)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column("buckets"), kind)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much one feature of each bucket speaks for the target, in thousandths of a nat, rounded down."""
    k = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a row's features."""
    spark = small_batches(features.sparkSession)
    shared = spark.sparkContext.broadcast(gain)  # one number per bucket
    kind = _width(len(gain))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket = _unpacked(batch.column("buckets"), kind)
            total = np.bincount(row, shared.value[bucket], batch.num_rows).astype(np.int64)  # whole numbers far below 2**53
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(np.bincount(row, minlength=batch.num_rows)), pa.array(total)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return features.mapInArrow(add, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    percent: int = PERCENT, seed: int = SEED, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where it is not drawn.

    ``target`` is any table with a column text. The draw is without replacement: Gumbel noise from a hash of seed and doc_id is
    added to the weight, and the highest ``percent`` of the documents with ``min_words`` words are drawn.

    Null text has no words. A null doc_id hashes like an empty one and comes last among equal scores. Repeated rows count
    each, in the totals and in the draw. Empty tables give no rows, and an empty target is a uniform one. Other columns are not read.
    """
    rows, wanted = texts_of(docs), target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    words = frequent_words(rows, head_words)
    pairs = frequent_pairs(rows, words, head_pairs) if longest == 2 else np.zeros(0, np.int64)
    head = Head.of(words, pairs, buckets)
    features = featured(rows, head, longest, buckets)
    gain = gains(bucket_totals(features, buckets), bucket_totals(featured(wanted, head, longest, buckets), buckets))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-SCALE * F.log(-F.log((draw.cast("double") + 0.5) / float(1 << 32))))
    scored = store(weighted(features, gain).withColumn("score", F.col("weight") + noise), "importance")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("last")
    ranked = global_rank(able.select("*", last), order=[Descending("score"), Ascending("last")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).drop("last")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def importance_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
