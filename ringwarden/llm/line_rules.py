"""Quality rules: per-text measures, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .support import small_batches, texts_of
from .text_arrays import BASE, Texts, _power_tables, chunks, mix

# A line in more documents of one host than this is boilerplate.
MAX_DOCUMENTS = 20
# A document is depleted when less than this share, or fewer than this many, of its words stay.
MIN_SHARE_LEFT = 0.5
MIN_WORDS_LEFT = 10
# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
# Shares of a hot line's rows when the boilerplate is looked up.
SALTS = 16

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _row_key(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Equal for equal hashes of one row only."""
    return mix(h ^ mix(rows.astype(np.uint64)))


def _sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each stretch."""
    powers, inverse = _power_tables(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def _lines_with_words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that hold a word: start, end, row, first word, number of words."""
    starts, ends = t.lines
    of_word = np.searchsorted(starts, t.words[0], side="right") - 1
    line, first, n = np.unique(of_word, return_index=True, return_counts=True)
    return starts[line], ends[line], t.row_of(starts[line]), first, n


def measure_texts(column: pa.Array) -> dict[str, object]:
    """Measures of each text, and its distinct normalised lines with the words they hold in all."""
    t = Texts.of(column)
    solid_char = t.solid & ((t.data & 0xC0) != 0x80)
    row_sums = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[t.off])
    starts, ends, row, first, n_words = _lines_with_words(t)
    distinct = np.unique(_row_key(t.hash(starts, ends), row), return_index=True)[1]
    window, h = t.windows(WINDOW)
    _, back, times = np.unique(_row_key(h, t.word_row[window]), return_inverse=True, return_counts=True)
    twice = window[times[back] >= 2] if len(window) else window
    edge = np.zeros(len(t.word_row) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    repeated = np.cumsum(edge)[:-1] > 0

    folded = Texts(t.data, t.off, True)
    normal = _sequence_hash(folded.hash(*t.words), first, first + n_words)
    _, one, back = np.unique(_row_key(normal, row), return_index=True, return_inverse=True)
    total = np.bincount(back, n_words, len(one)).astype(np.int64)
    order = np.argsort(row[one], kind="stable")
    counts = t.per_row(row[one])
    return {
        "n_words": t.per_row(t.word_row),
        "word_chars": row_sums(solid_char).astype(np.int64),
        "n_symbols": row_sums(_IS_SYMBOL[t.data]).astype(np.int64),
        "n_dup_lines": t.per_row(row) - t.per_row(row[distinct]),
        "n_repeat_words": t.per_row(t.word_row[repeated]),
        "text_hash": t.hash(t.off[:-1], t.off[1:]).view(np.int64),
        "line_counts": counts,
        "line_hash": normal[one][order].view(np.int64),
        "line_words": total[order],
    }


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash"]


def measured(docs: DataFrame, host: str = "source", keep_text: bool = False) -> DataFrame:
    """doc_id, host, the measures, and lines: an array of (h, words) of the distinct normalised lines."""
    small_batches(docs.sparkSession)
    rows = texts_of(docs, F.col(host).cast("string").alias("host"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            m = measure_texts(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(m["line_counts"])]).astype(np.int32))
            lines = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(m["line_hash"]), pa.array(m["line_words"])], names=["h", "words"]))
            columns = [batch.column("doc_id"), batch.column("host"), *(pa.array(m[k]) for k in _MEASURES), lines]
            names = ["doc_id", "host", *_MEASURES, "lines"]
            if keep_text:
                columns, names = [*columns, batch.column("text")], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, host string, " + ", ".join(f"{k} long" for k in _MEASURES) + ", lines array<struct<h: long, words: long>>"
    return rows.mapInArrow(measure, schema + (", text string" if keep_text else ""))


def _lookup(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose host and h are ``wanted``; rows of a hot line are dealt over SALTS shares."""
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"]).drop("salt")


def judge_lines(
    docs: DataFrame,
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
    min_share_left: float = MIN_SHARE_LEFT,
    min_words_left: int = MIN_WORDS_LEFT,
    keep_text: bool = False,
    copies_count: bool = False,
) -> DataFrame:
    """Measures of every document, words_left, dropped lines, base_failed and kept.

    A line is normalised by lower-casing ASCII letters and reducing white space; lines without a word
    do not count. For each host the documents with the line are counted: with ``copies_count`` all distinct
    doc_ids, else copies of one text as one document, for use after or before deduplication. Null text is empty, null hosts are one host
    apart from the empty one, rows with a null doc_id are a document each, repeated rows give a row each and count once. An empty document has failed the base rules. ``keep_text`` adds
    the text without the dropped lines.
    """
    table = store(
        measured(docs, host, keep_text).withColumn("row_id", F.monotonically_increasing_id()), "line-measures"
    )
    # null and empty hosts stay apart
    owner = F.when(F.col("host").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("host")))
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row_id")).alias("row")) if copies_count else F.col("text_hash")
    lines = table.select("row_id", owner.alias("host"), document.alias("document"), F.explode("lines").alias("l"))
    lines = lines.select("row_id", "host", "document", F.col("l.h").alias("h"), F.col("l.words").alias("words"))
    # rows with a line are no fewer than its documents and combine before the shuffle, so only lines in many rows are counted by document
    many = store(lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents).select("host", "h"), "many-rows")
    seen = store(_lookup(lines, many), "rows-of-common-lines")
    # one row per boilerplate line; stored, so that the join below sees its size
    common = store(
        seen.select("host", "h", "document").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents).select("host", "h"),
        "common-lines",
    )
    hit = _lookup(seen, common)
    lost = hit.groupBy("row_id").agg(F.sum("words").alias("lost"), F.collect_list("h").alias("dropped"))
    out = table.join(lost, "row_id", "left").withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("words_left") < min_words_left) | (F.col("words_left") < min_share_left * F.col("n_words"))
    out = out.select(
        "doc_id", "host", *_MEASURES[:-1], "words_left", F.coalesce("dropped", F.array().cast("array<long>")).alias("dropped"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *(["text"] if keep_text else []),
    )
    return without_lines(out) if keep_text else out


def without_lines(judged: DataFrame) -> DataFrame:
    """The judged rows with the dropped lines taken out of ``text``."""
    schema = judged.schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            t = Texts.of(batch.column("text"), fold=True)
            starts, ends, row, first, n = _lines_with_words(t)
            h = _sequence_hash(t.word_hash, first, first + n).view(np.int64)
            gone: list[set] = [set(x) for x in batch.column("dropped").to_pylist()]
            keep = np.ones(len(t.data), bool)
            for s, e, r, x in zip(starts.tolist(), ends.tolist(), row.tolist(), h.tolist()):
                if x in gone[r]:
                    keep[s : min(e + 1, int(t.off[r + 1]))] = False
            texts = [t.data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(t.off[:-1].tolist(), t.off[1:].tolist())]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return judged.mapInArrow(strip, schema)


def rules_digest(docs: DataFrame) -> DataFrame:
    return judge_lines(docs, copies_count=True).select("doc_id", *_MEASURES[:-1], "base_failed", "kept", "words_left")
