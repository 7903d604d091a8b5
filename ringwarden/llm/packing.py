"""Cost-balanced packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import small_batches, texts_of
from .tokens import ID_TYPE, REMEMBERED_WORDS, encoder, token_ids

CAPACITY = 2048
# Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. At 4096 tokens both parts are equal.
LINEAR = 1.0
QUADRATIC = 1.0 / 4096
# Text bytes packed together: some 1.5 million tokens, 750 sequences.
GROUP_BYTES = 4 << 20
# Pieces that go back to Spark at once: at most 1 MB of ids.
PIECE_ROWS = 128


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """(document, start, length, sequence, offset) of every piece; ``lengths`` are positive.

    A document of ``capacity`` tokens or more first gives up whole sequences. What is left goes, longest
    first, to the cheapest sequence it fits into; where it fits into none it is cut over the
    cheapest sequences with room. There are just as many sequences as the tokens need, so less than one sequence
    of a group is padding.
    """
    lengths = np.asarray(lengths, np.int64)
    whole, rest = lengths // capacity, lengths % capacity
    doc = np.repeat(np.arange(len(lengths)), whole)
    n_whole = len(doc)
    start = (np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    pieces = [np.stack([doc, start, np.full(n_whole, capacity), np.arange(n_whole), np.zeros(n_whole, np.int64)], 1)]
    n_open = -(-int(rest.sum()) // capacity)
    cost, room = np.zeros(n_open), np.full(n_open, capacity, np.int64)
    placed: list[tuple[int, int, int, int, int]] = []
    order = np.argsort(-rest, kind="stable")
    for d in order[: int((rest > 0).sum())].tolist():
        n, at = int(rest[d]), int(whole[d]) * capacity
        while n:
            fits = np.where(room >= n, cost, np.inf)
            k = int(fits.argmin())
            take = n
            if fits[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
                take = int(room[k])
            placed.append((d, at, take, n_whole + k, capacity - int(room[k])))
            cost[k] += linear * take + quadratic * take * take
            room[k] -= take
            n, at = n - take, at + take
    pieces.append(np.array(placed, np.int64).reshape(-1, 5))
    return np.concatenate(pieces)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, remembered: int = REMEMBERED_WORDS
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Documents are dealt by a hash into groups of about ``group_bytes`` of text, each packed by one task; copies of a row go to
    groups of their own, so no row that repeats fills a group;
    sequence_id is the group times 2**32 plus the sequence's number in it. Null text is empty and gives
    one piece of the end id. Repeated rows are packed each. An empty table gives no pieces. ``remembered``: as in ``token_ids``.
    """
    small_batches(docs.sparkSession)
    rows = texts_of(docs)
    size = rows.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    groups = int(size) // group_bytes + 1
    ids = token_ids(rows, tokenizer, end_id, compact=True, place=True, remembered=remembered)
    ids = ids.withColumn("deal", F.pmod(F.xxhash64("place"), F.lit(groups))).drop("place")
    packed_type = encoder(tokenizer, remembered).dtype

    def packed(table: pa.Table) -> pa.Table:
        data = table.column("ids").to_pylist()
        doc_ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(data)), key=lambda i: (-len(data[i]), doc_ids[i] is None, doc_ids[i] or 0, zlib.crc32(data[i])))
        width = packed_type.itemsize
        lengths = np.array([len(data[i]) // width for i in order], np.int64)
        p = assign(lengths, capacity)
        wide = lambda x: np.frombuffer(x, packed_type).astype(ID_TYPE).tobytes()
        base = table.column("deal")[0].as_py() << 32
        doc = [order[i] for i in p[:, 0].tolist()]
        pieces = pa.table({
            "doc_id": pa.array([doc_ids[i] for i in doc], pa.int64()),
            "start": p[:, 1], "length": p[:, 2],
            "ids": pa.array([wide(data[i][s * width : (s + n) * width]) for i, s, n in zip(doc, p[:, 1].tolist(), p[:, 2].tolist())], pa.binary()),
            "doc_tokens": lengths[p[:, 0]], "sequence_id": base + p[:, 3], "offset": p[:, 4],
        })
        return pa.Table.from_batches(pieces.to_batches(max_chunksize=PIECE_ROWS), pieces.schema)

    return ids.groupBy("deal").applyInArrow(
        packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def packing_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    pieces = pack(docs, tokenizer, end_id)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
