"""Compression-distance classification of toxic text.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A text is cut into short windows
of whole words, and each window is compressed once with the ordinary dictionary and once with the toxic
dictionary set before it. Ordinary content lies at the same distance in both, so a window gets shorter only where
the toxic dictionary has something to say; the bytes saved are the distance. Calibrated weights turn the
savings of a text into a score.

The toxic dictionary is trained on what toxic samples say and ordinary samples hardly do: whole toxic texts are mostly
ordinary words, which would crowd the others out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .support import small_batches, texts_of
from .text_arrays import Texts, chunks

# Bound of the labelled sample that is fitted on: texts of each label, and bytes of one text.
SAMPLE_TOXIC = 1600
SAMPLE_ORDINARY = 3200
SAMPLE_BYTES = 20_000
WINDOW_BYTES = 128
ORDINARY_DICTIONARY = 114_688
TOXIC_DICTIONARY = 2_048
# A word is toxic material when so many toxic samples hold it, and so many times the ordinary share.
MIN_TEXTS = 8
MIN_RATIO = 16.0
SAVED_STEPS = (1, 2, 3, 4, 6)
RIDGE = 0.05

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # bias first
    mean: np.ndarray
    spread: np.ndarray


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY, window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def _windows(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of windows of whole words, with a byte to either side where there is one."""
    starts, ends = t.words
    row = t.word_row
    if not len(starts):
        return starts, ends, row
    cell = (starts - t.off[row]) // WINDOW_BYTES
    first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(cell, prepend=-1).astype(bool))
    last = np.append(first[1:], len(starts)) - 1
    lo = np.maximum(starts[first] - 1, t.off[row[first]])
    hi = np.minimum(ends[last] + 1, t.off[row[first] + 1])
    return lo, hi, row[first]


def _sizes(compressor: zstandard.ZstdCompressor, data: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    segments = np.stack([lo, hi - lo], 1).astype("<u8").tobytes()
    packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
    return np.array([len(x) for x in packed], np.int64)


def savings(column: pa.Array, ordinary: zstandard.ZstdCompressor, both: zstandard.ZstdCompressor) -> np.ndarray:
    """Measures of each text: the most bytes a window saves, how many windows save so much, and its windows."""
    t = Texts.of(column)
    t = Texts(_LOWER[t.data], t.off)
    lo, hi, row = _windows(t)
    out = np.zeros((t.n, 2 + len(SAVED_STEPS)))
    if len(lo):
        data = t.data.tobytes()
        saved = _sizes(ordinary, data, lo, hi) - _sizes(both, data, lo, hi)
        np.maximum.at(out[:, 0], row, np.clip(saved, 0, 12))
        for k, least in enumerate(SAVED_STEPS):
            out[:, 1 + k] = np.log1p(np.bincount(row[saved >= least], minlength=t.n))
        out[:, -1] = np.log1p(np.bincount(row, minlength=t.n))
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def fit(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """A model from labelled texts; ``share`` is the share of toxic texts that scores are calibrated for."""
    label = np.array(toxic, np.int64)
    held = [Counter(), Counter()]
    for t, y in zip(texts, label):  # one text's words at a time, so the driver never has those of all
        held[y].update(set(_LETTERS.findall(t.lower())))
    n = np.bincount(label, minlength=2)
    odd = {
        w for w, k in held[1].items() if k >= MIN_TEXTS and k / max(n[1], 1) >= MIN_RATIO * (held[0][w] + 0.2) / max(n[0], 1)
    }
    toxic_samples = [(" " + " ".join(w for w in _LETTERS.findall(t.lower()) if w in odd) + " ").encode() for t, y in zip(texts, label) if y]
    toxic_samples = [s for s in toxic_samples if len(s) > 2]
    plain = [t.lower().encode() for t, y in zip(texts, label) if not y]
    plain = [p[k : k + 256] for p in plain for k in range(0, len(p), 256)]
    ordinary, poison = _dictionary(plain, ORDINARY_DICTIONARY), _dictionary(toxic_samples, TOXIC_DICTIONARY)
    # every word once more in full, the most frequent nearest
    listed = " ".join(sorted(odd, key=lambda w: (held[1][w], w))[-TOXIC_DICTIONARY // 8 :])
    poison = poison + f" {listed} ".encode()
    x = np.zeros((0, 2 + len(SAVED_STEPS)))
    if texts:
        alone, both = _compressor(ordinary), _compressor(poison + ordinary)
        sample = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        x = np.concatenate([savings(batch.column("text"), alone, both) for batch in chunks([sample], "text")])
    mean, spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    weights = np.zeros(x.shape[1] + 1)
    if n.min() == 0:
        weights[0] = -20.0 if n[1] == 0 else 20.0
        return Model(ordinary, poison, weights, mean, spread)
    share = n[1] / n.sum() if share is None else share
    case = np.where(label == 1, share / n[1], (1 - share) / n[0]) * len(label)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / spread], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (case * (p - label)) + RIDGE * weights
        hessian = (z * (case * p * (1 - p) + 1e-9)[:, None]).T @ z + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Model(ordinary, poison, weights, mean, spread)


def held_out_fold(doc_id: str = "doc_id"):
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold, drawn by a hash of doc_id.

    Of several labels of one document the highest counts; null labels do not.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out_fold())
    counts = {r["toxic"]: r["n"] for r in marks.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = (_sampled(docs, marks.where((F.col("toxic") == 1) == bool(y)), counts.get(y, 0), n, sample_bytes) for y, n in ((1, sample_toxic), (0, sample_ordinary)))
    total = sum(counts.values())
    return fit(bad + good, [1] * len(bad) + [0] * len(good), counts.get(1, 0) / total if bad and good else None)


def _sampled(docs: DataFrame, marks: DataFrame, count: int, most: int, longest: int) -> list[str]:
    """Texts of the ``most`` documents of ``marks`` (``count`` rows) whose hashed ids are lowest, without those above ``longest`` bytes.

    The ids are drawn first, below a hash that lets a few more than ``most`` through; no text is shuffled for it, and the driver gets the
    chosen texts only. Of several texts under one id the smallest counts.
    """
    if not count:
        return []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    below = int(min(1.0, (most + 4 * most**0.5 + 8) / count) * (1 << 32))
    drawn = sorted((r["place"], r["doc_id"]) for r in marks.select("doc_id", place.alias("place")).where(F.col("place") < below).collect())[:most]
    spark = docs.sparkSession
    if not drawn:
        return []
    # as one literal: rows of Python would take Python workers of their own on each executor, which stay
    ids = spark.range(1).select(F.explode(F.split(F.lit(",".join(str(i) for _, i in drawn)), ",").cast("array<long>")).alias("doc_id"))
    chosen = texts_of(docs).join(F.broadcast(ids), "doc_id", "left_semi").where(F.octet_length("text") <= longest)
    texts = {r["doc_id"]: r["text"] for r in chosen.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [texts[i] for _, i in drawn if i in texts]


def scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, ``more`` columns and score of every row, whole texts; null text is empty and scored as such."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long")}).select("doc_id", "text", *more)
    kept = list(rows.schema.fields)
    schema = StructType([*kept, StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ordinary, both = _compressor(m.ordinary), _compressor(m.toxic + m.ordinary)
        for batch in chunks(batches, "text"):
            x = (savings(batch.column("text"), ordinary, both) - m.mean) / m.spread
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights[1:] + m.weights[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(p, 6))], names=[f.name for f in kept] + ["score"])

    return rows.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    out = scored(docs.select("doc_id", "text"), fit_on(docs, labels))
    return out.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    # columns that clash with the working names are carried in a struct; the text is sent once
    boxed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    kept = scored(boxed, fit_on(docs, labels), "row").where("score < 0.5")
    return kept.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
