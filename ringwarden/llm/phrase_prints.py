"""Fingerprints of documents from Lempel-Ziv phrases.

A text's bytes are parsed from left to right into phrases, each the longest one of the dictionary so far and one byte more,
which the dictionary then holds too (LZ78). Texts that compress well together share phrases. The set of phrases is hashed, and its
smallest hashes are the signature; of two signatures, the smallest hashes of the union that lie in both estimate the
Jaccard similarity of the phrase sets. A set no larger than the signature is held whole, and then the estimate is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .support import small_batches, texts_of
from .text_arrays import Texts

# Hashes of a signature; the standard error of a likeness is at most 0.044.
SIZE = 128
# Text bytes whose phrases are hashed at once, and parts of the order for each shuffle partition.
CHUNK_BYTES = 1 << 20
PARTS_PER_TASK = 4


def extend(trie: dict[int, int], node: int, data: bytes) -> int:
    """Parse ``data`` from ``node`` on and return the node at its end.

    A key is the number of a phrase (0: none) times 256 plus the byte that follows it; it stands for a phrase of its own, whose
    number times 256 is the value. Keys stand in the order of the phrases.
    """
    get, fresh = trie.get, len(trie) + 1 << 8
    for byte in data:
        if (node := get(key := node | byte)) is None:
            trie[key] = fresh
            fresh += 256
            node = 0
    return node


def parsed(data: bytes) -> np.ndarray:
    """Keys of all phrases. What is left at the end repeats an earlier phrase."""
    trie: dict[int, int] = {}
    extend(trie, 0, data)
    return np.fromiter(trie, np.int64, len(trie))


def parsed_both(data: bytes, cut: int, other: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Phrase keys of ``data``, and of its first ``cut`` bytes with ``other`` after them; the part before the cut is parsed once."""
    trie: dict[int, int] = {}
    node = extend(trie, 0, data[:cut])
    shared = len(trie)
    extend(trie, node, data[cut:])
    own = np.fromiter(trie, np.int64, len(trie))
    for _ in range(len(trie) - shared):
        trie.popitem()
    extend(trie, node, other)
    return own, np.fromiter(trie, np.int64, len(trie))


def phrase_lengths(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes of every phrase; ``first``: where the phrases of its text start."""
    parent = keys >> 8
    lengths = np.ones(len(keys), np.int64)
    at = np.flatnonzero(parent)  # phrases that are one byte longer than another one, whose length is not added yet
    up = first[at] + parent[at] - 1
    known = np.ones(len(keys), bool)
    known[at] = False
    while len(at):
        ready = known[up]
        lengths[at[ready]] = lengths[up[ready]] + 1
        known[at[ready]] = True
        at, up = at[~ready], up[~ready]
    return lengths


def signatures(texts: list[bytes], keys: list[np.ndarray], size: int = SIZE) -> list[np.ndarray]:
    """The smallest distinct 32-bit hashes of each text's phrases, ascending."""
    t = Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64))
    counts = np.array([len(k) for k in keys], np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    lengths = phrase_lengths(np.concatenate(keys), first)
    end = np.cumsum(lengths)
    end += t.off[row] - (end - lengths)[first]
    h = t.hash(end - lengths, end) >> np.uint64(32)
    key = np.sort(row.astype(np.uint64) << np.uint64(32) | h)
    key = key[np.diff(key, prepend=~key[:1]).astype(bool)]
    edges = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + size)] for a, b in zip(edges[:-1], edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    union, times = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((times[:size] == 2).sum() / min(size, len(union)))


def printed(signature: np.ndarray) -> str:
    """Eight hex digits for each hash."""
    return signature.astype(">u4").tobytes().hex()


def _judged(rows: list[tuple]) -> Iterator[tuple]:
    """Results of all ``rows`` (doc_id, text) but the last, each with the one after it."""
    texts, keys, shown = [], [], []
    for (doc_id, text), (_, after) in zip(rows, rows[1:]):
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        data, changed = text.encode(), edited.encode()
        cut = len(text[: n - n // 3].encode())
        texts += [data, changed]
        keys += parsed_both(data, cut, changed[cut:])
        shown.append((doc_id, n, hashlib.sha256(changed).hexdigest()))
    last = rows[-1][1].encode()
    held = signatures([*texts, last], [*keys, parsed(last)])
    for k, (doc_id, n, digest) in enumerate(shown):
        own, changed, after = held[2 * k], held[2 * k + 1], held[min(2 * k + 2, len(held) - 1)]
        yield doc_id, n, digest, printed(own), printed(changed), likeness(own, changed), likeness(own, after)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is the one that follows in descending doc_id; the first one follows the last. Null doc_ids come last; rows
    of one doc_id go by a hash of their texts, then by the texts, and repeated rows follow each other. Null text is empty; an empty text has an empty fingerprint
    and is like other empty texts only. A table of one row follows itself, an empty one gives no rows. Other columns are not read.

    Keys alone are range-split first, which gives the first row of each part of the order. Then every text is sent to its part
    once, and the first row of a part also to the end of the part before it.
    """
    spark = small_batches(docs.sparkSession)
    rows = texts_of(docs)
    # ascending order of these is the order of the documents
    place = [F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("turned"), F.xxhash64("text").alias("mark")]
    keyed = rows.select(*place, "doc_id", "text")
    count = shuffle_width(spark) * PARTS_PER_TASK
    narrow = keyed.select("unnamed", "turned", "mark").repartitionByRange(count, "unnamed", "turned", "mark")
    firsts = narrow.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("unnamed", "turned", "mark")).alias("at"))
    borders = sorted(tuple(r["at"]) for r in firsts.collect())  # one row per part
    if not borders:
        return spark.createDataFrame([], _SCHEMA)
    edge = np.array(borders, [("unnamed", "?"), ("turned", "<i8"), ("mark", "<i8")])
    shared = spark.sparkContext.broadcast(edge)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = shared.value
        sent = set()
        for batch in batches:
            key = np.empty(batch.num_rows, border.dtype)
            for name in border.dtype.names:
                key[name] = batch.column(name).to_numpy(zero_copy_only=False)
            part = np.searchsorted(border, key, side="right") - 1
            yield _placed(batch, part, False)
            new = [k for k in np.flatnonzero(border[part] == key).tolist() if not (part[k] in sent or sent.add(part[k]))]
            if new:
                yield _placed(batch.take(pa.array(new)), (part[new] - 1) % len(border), True)

    def _placed(batch: pa.RecordBatch, part: np.ndarray, guest: bool) -> pa.RecordBatch:
        more = [pa.array(part.astype(np.int64)), pa.array(np.full(len(part), guest))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "guest"])

    schema = "unnamed boolean, turned long, mark long, doc_id long, text string, part long, guest boolean"
    dealt = keyed.mapInArrow(deal, schema).repartition(shuffle_width(spark), "part")
    dealt = dealt.sortWithinPartitions("part", "guest", "unnamed", "turned", "mark", "text").select("part", "guest", "doc_id", "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, closed = 0, None, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in _judged(held)], schema=kind)

        for batch in batches:
            for p, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if p != part:
                    part, closed, held, size = p, False, [], 0
                if closed:
                    continue
                held.append((doc_id, text))
                size += len(text)
                if guest or size > CHUNK_BYTES and len(held) > 1:
                    yield done()
                    closed = guest
                    held, size = held[-1:], len(text)

    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in _NAMES[2:5]), *((c, pa.float64()) for c in _NAMES[5:])])
    return dealt.mapInArrow(judge, _SCHEMA)
