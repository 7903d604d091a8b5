"""Token ids in Huffman-coded blocks.

Format. ``<path>/code``: Parquet, one row per used id: (id, bits), the code length. Codes are
canonical: ordered by length, then id. ``<path>/blocks``: Parquet, one row per block: part, block
(order within the part), ids_before (ids of earlier blocks of the part), n_docs, n_ids, payload.
Parts follow each other in ascending doc_id (null first), and so do blocks and documents. A payload
stands alone, all little-endian:

    uint32 n_docs, uint32 n_checkpoints, uint32 n_ids, uint32 n_bits
    n_docs bytes: 1 where doc_id is null
    n_docs x int64 doc_id, n_docs x uint32 length
    n_checkpoints x uint32: bit offset of every CHECKPOINT-th id
    the bits, highest first, padded with zero bytes

A reader starts at any checkpoint; this one decodes all stretches of a block side by side, one
table look-up per id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_width, store
from .support import small_batches
from .tokens import ID_TYPE, encoder, token_ids

MAX_BITS = 16
BLOCK_IDS = 1 << 17
CHECKPOINT = 128
PART_IDS = 8 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 where the count is 0.

    The limit rises to what the number of used ids needs. One used id gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    # level k: leaves and pairs of level k - 1, by weight; leaf or not is all that is kept
    levels, merged = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate([weight, merged])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        both = both[rank]
        merged = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(order) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of every used id: codes of one length count up in the order of ids."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=1))
    step = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step)[:-1]]) if len(order) else np.zeros(0, np.uint64)
    codes[order] = start >> (top - lengths[order]).astype(np.uint64)
    return codes


def encode_block(doc_ids: list, pieces: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate(pieces) if pieces else np.zeros(0, ID_TYPE)
    bits = lengths[ids]
    end = np.cumsum(bits)
    start = end - bits
    total = int(end[-1]) if len(end) else 0
    word = start >> 5
    room = 64 - (start & 31) - bits  # of the 64 bits from that word on, those after the code
    wide = codes[ids] << room.astype(np.uint64)
    n_words = (total >> 5) + 2
    # codes do not overlap, so their sum is their union; each half stays below 2**32
    out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n_words)
    out += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    marks = start[::CHECKPOINT].astype("<u4")
    head = np.array([len(doc_ids), len(marks), len(ids), total], "<u4")
    parts = [
        head, np.array([d is None for d in doc_ids], np.uint8), np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([len(p) for p in pieces], "<u4"), marks, out.astype(np.uint32).astype(">u4"),
    ]
    return b"".join(p.tobytes() for p in parts)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The id and code length that any ``top`` next bits begin with."""
    top = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    times = (1 << (top - lengths[order])).astype(np.int64)
    symbol = np.repeat(order, times)
    fill = (1 << top) - len(symbol)
    return (
        np.concatenate([symbol, np.zeros(fill, np.int64)]).astype(ID_TYPE),
        np.concatenate([np.repeat(lengths[order], times), np.ones(fill, np.int64)]),
        top,
    )


def decode_block(payload: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, lengths, and all ids of a block."""
    symbol, width, top = table
    n_docs, n_marks, n_ids, _ = (int(x) for x in np.frombuffer(payload, "<u4", 4))
    at = 16
    null = np.frombuffer(payload, np.uint8, n_docs, at)
    at += n_docs
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    at += 8 * n_docs
    lengths = np.frombuffer(payload, "<u4", n_docs, at)
    at += 4 * n_docs
    position = np.frombuffer(payload, "<u4", n_marks, at).astype(np.int64)
    at += 4 * n_marks
    words = np.frombuffer(payload, ">u4", -1, at).astype(np.uint64)
    window = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((CHECKPOINT, n_marks), ID_TYPE)
    shift, mask = np.uint64(64 - top), np.uint64((1 << top) - 1)
    last = n_ids - (n_marks - 1) * CHECKPOINT  # ids after the last checkpoint
    for k in range(min(CHECKPOINT, n_ids)):
        if k == last:
            position = position[:-1]
        ahead = (window[position >> 5] >> (shift - (position & 31).astype(np.uint64))) & mask
        out[k, : len(position)] = symbol[ahead]
        position = position + width[ahead]
    ids = out.T.reshape(-1)[:n_ids]
    return [None if z else int(d) for z, d in zip(null, doc_ids)], lengths, ids


def count_ids(ids: DataFrame, vocabulary: int, packed_type: np.dtype = ID_TYPE) -> np.ndarray:
    """How often each id occurs in the whole corpus; at most ``vocabulary`` rows reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            joined = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(joined, packed_type), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    sums = ids.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in sums.collect():
        counts[row["id"]] = row["n"]
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, max_bits: int = MAX_BITS) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending doc_id order.

    Null text is empty: its end id alone. Null doc_ids come first; rows of one doc_id stand together,
    shorter ones first. An empty table gives a code and blocks without rows.
    """
    spark = small_batches(docs.sparkSession)
    ids = store(token_ids(docs, tokenizer, end_id, compact=True), "token-ids")
    vocabulary, packed_type = encoder(tokenizer).size, encoder(tokenizer).dtype
    counts = count_ids(ids, vocabulary, packed_type)
    lengths = code_lengths(counts, max_bits)
    codes = canonical_codes(lengths)
    table = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(table, "id long, bits long").coalesce(1).write.parquet(f"{path}/code")

    shared = spark.sparkContext.broadcast((lengths, codes))  # as long as the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held_ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            payload = encode_block(held_ids, held, *shared.value)
            row = {"part": [part], "block": [number], "ids_before": [before], "n_docs": [len(held)], "n_ids": [size], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held_ids.append(doc_id)
                held.append(np.frombuffer(packed.as_buffer(), packed_type))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    number, before = number + 1, before + size
                    held_ids, held, size = [], [], 0
        if held:
            yield flush()

    parts = max(shuffle_width(spark), int(counts.sum()) // PART_IDS)
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids").select("doc_id", "ids")
    ordered.mapInArrow(blocks, "part long, block long, ids_before long, n_docs long, n_ids long, payload binary").write.parquet(
        f"{path}/blocks"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files."""
    small_batches(spark)
    code = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/code").collect()}
    lengths = np.zeros(max(code, default=0) + 1, np.int64)
    lengths[list(code)] = list(code.values())
    shared = spark.sparkContext.broadcast(decode_table(lengths))
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(base), "part").select((F.col("base") + F.col("ids_before")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                doc_ids, n, ids = decode_block(payload.as_buffer(), shared.value)
                ends = np.cumsum(n, dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], ends * ID_TYPE.itemsize]).astype(np.int32))
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - n), pa.array(n.astype(np.int64)), packed],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def huffman_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids, read the files back, and describe each document by what they hold."""
    spark = docs.sparkSession
    path = scratch_path(spark, "huffman")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
