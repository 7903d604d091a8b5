"""Near-duplicate texts: ProbMinHash signatures, banding, exact verification, components.

Shingles are runs of five words (ASCII letters in lower case; a shorter text is one shingle). Each distinct shingle has
weight 1, however often it occurs, since sets decide. A shingle's arrivals form a Poisson process of its weight; an arrival
falls on a random register, and a register keeps the shingle that came first. A text is done when no further arrival can
come before the latest register. Two signatures agree in a register with the probability Jaccard similarity of
the shingle sets. Texts that agree in a whole band become candidates, and exact shingle sets decide: two texts are linked
at a Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .support import components, early_filters, small_batches, texts_of
from .text_arrays import BASE, Texts, _power_tables, chunks, mix

WORDS = 5
THRESHOLD = 0.8
# 36 bands of 7 registers: a pair at 0.8 shares a band with probability 0.9998, one at 0.5 with 0.25.
BANDS = 36
ROWS = 7
REGISTERS = BANDS * ROWS
# Two bits of each register tell unlike texts apart before they are compared; three and a half standard errors of the estimate at 0.8,
# which lose no more pairs than the bands do.
SKETCH_WORDS = -(-REGISTERS // 32)
SKETCH_SLACK = 3.5 * 4 / 3 * (0.85 * 0.15 / REGISTERS) ** 0.5
# Leaders of a bucket in the first round; each later round takes so many times more.
MORE_LEADERS = 32
MAX_ROUNDS = 24
# Classes that no doc_id can name have numbers from here on.
NAMED_BY_WORDS = 1 << 62


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text."""
    first, h = t.windows(WORDS)
    row = t.word_row[first]
    short_word = np.flatnonzero(np.bincount(t.word_row, minlength=t.n)[t.word_row] < WORDS)
    if len(short_word):
        rows, start, n = np.unique(t.word_row[short_word], return_index=True, return_counts=True)
        powers, inverse = _power_tables(len(t.word_hash))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.word_hash * powers[: len(t.word_hash)])])
        s = short_word[start]
        own = mix((prefix[s + n] - prefix[s]) * inverse[s] + n.astype(np.uint64))
        row, h = np.concatenate([row, rows]), np.concatenate([h, own])
    _, one = np.unique(mix(h ^ mix(row.astype(np.uint64))), return_index=True)
    return row[one], h[one]


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers: the element that arrives first at each register; 0 for rows without elements."""
    first = np.full(n * registers, np.inf)
    element = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    time = np.zeros(len(h))
    active, turn = np.arange(len(h)), 0
    while len(active):
        draw = mix(h[active] + np.uint64(turn * 0xD6E8FEB86659FD93 % (1 << 64)))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        time[active] += gap / weight[active]
        alive = time[active] < latest[row[active]]
        active, draw = active[alive], draw[alive]
        cell = row[active] * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, time[active])
        won = first[cell] == time[active]
        element[cell[won]] = h[active[won]]
        latest = first.reshape(n, registers).max(axis=1)
        turn += 1
    return element.reshape(n, registers)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprint(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_hash, key (equal for equal word sequences), n_words, bands and sketch of every row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            t = Texts.of(batch.column("text"), fold=True)
            row, h = shingles(t)
            s = signatures(row, h, np.ones(len(h)), t.n)
            folded = np.zeros((t.n, BANDS), np.uint64)
            for k in range(ROWS):
                folded = mix(folded * np.uint64(BASE) + s[:, k::ROWS])
            folded = mix(folded + np.arange(BANDS, dtype=np.uint64))
            two = np.zeros((t.n, SKETCH_WORDS * 32), np.uint64)
            two[:, :REGISTERS] = mix(s) & np.uint64(3)
            sketch = (two.reshape(t.n, SKETCH_WORDS, 32) << (2 * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
            n_words = t.per_row(t.word_row)
            powers, inverse = _power_tables(len(t.word_hash))
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.word_hash * powers[: len(t.word_hash)])])
            end = np.cumsum(n_words)
            key = mix((prefix[end] - prefix[end - n_words]) * inverse[end - n_words] + n_words.astype(np.uint64))
            listed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.view(np.int64).reshape(-1)), a.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(key.view(np.int64)), pa.array(n_words), listed(folded), listed(sketch)],
                names=["doc_id", "text_hash", "key", "n_words", "bands", "sketch"],
            )

    rows = texts_of(docs, _text_hash().alias("text_hash"))
    out = rows.mapInArrow(work, "doc_id long, text_hash long, key long, n_words long, bands array<long>, sketch array<long>")
    return store(out.withColumn("row_id", F.monotonically_increasing_id()), "fingerprints")


def _alike(a: Column, b: Column) -> Column:
    """Whether two sketches leave room for a similarity of THRESHOLD."""
    odd = F.lit(0)
    for k in range(SKETCH_WORDS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        odd = odd + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    # unequal registers still agree in two bits a quarter of the time
    return odd <= F.lit(int((1 - THRESHOLD + SKETCH_SLACK) * 0.75 * REGISTERS) + 1)


def _earlier(marks: Column, band: Column) -> Column:
    """Codes of the shared buckets that a text has in bands before ``band``."""
    return F.transform(F.filter(marks, lambda m: m["band"] < band), lambda m: m["code"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of THRESHOLD; ``texts``: rep, text."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.select("a", "b", "text_a", "text_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a"):
            sets = []
            for side in ("text_a", "text_b"):
                row, h = shingles(Texts.of(batch.column(side), fold=True))
                sets.append((row, mix(h ^ mix(row.astype(np.uint64)))))
            (row_a, key_a), (row_b, key_b) = sets
            n = batch.num_rows
            shared = np.bincount(row_a[np.isin(key_a, key_b)], minlength=n)
            union = np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - shared
            keep = pa.array(shared >= THRESHOLD * union - 1e-9)
            yield batch.select(["a", "b"]).filter(keep)

    small_batches(pairs.sparkSession)
    return both.mapInArrow(judge, "a long, b long")


def links(reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(id, component) of all linked representatives, or None; ``reps``: rep, text_id, text_hash, bands, sketch.

    The text of a representative is that of the rows of ``docs`` with its text_id as doc_id and its text_hash.

    In each round a bucket's leaders, the texts that share most buckets first, meet the members of
    other components, and then leave the bucket. A bucket is done when its members are of one component. Every pair
    of a bucket is thus compared or already connected, but a group of copies costs its size and not its square.
    A pair meets in the first band it shares only, told by 32 bits of each shared bucket, so it is met once. The rows that
    rounds keep are narrow; sketches and codes are joined to them only where texts meet.
    """
    early_filters(docs.sparkSession)
    each = reps.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.col("band").cast("byte").alias("band"), F.xxhash64("band", "value").alias("bucket"))
    # stored tables with a condition on them are what Spark makes early filters of: few buckets are shared, few texts candidates
    sizes = store(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    shared = store(each.join(sizes.where("size > 1"), "bucket"), "buckets")
    if shared.isEmpty():
        return None
    mark = F.struct("band", F.shiftright("bucket", 32).cast("int").alias("code"))
    popular = shared.groupBy("rep").agg(F.sum("size").alias("popular"), F.collect_list(mark).alias("marks"))  # at most one mark per band
    known = store(popular.join(reps.select("rep", "text_id", "text_hash", "sketch"), "rep"), "candidates")
    members = store(shared.select("rep", "bucket", "band").join(known.select("rep", "popular"), "rep"), "members")
    wanted = known.where("popular > 1").select("rep", F.col("text_id").alias("doc_id"), "text_hash")
    texts = texts_of(docs, _text_hash().alias("text_hash")).join(wanted, ["doc_id", "text_hash"])
    # grouped by the join's keys first, so that no text is shuffled again
    texts = store(texts.groupBy("doc_id", "text_hash", "rep").agg(F.min("text").alias("text")).select("rep", "text"), "candidate-texts")
    labels, found = None, None
    leaders_per_bucket = 1
    for turn in range(MAX_ROUNDS):
        now = members.withColumn("component", F.col("rep")) if labels is None else members.join(
            labels.withColumnRenamed("id", "rep"), "rep", "left"
        ).withColumn("component", F.coalesce("component", "rep"))
        if turn == 0:  # every bucket holds two texts
            members = now
        else:
            open_buckets = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
            members = store(now.join(open_buckets, "bucket", "left_semi"), "members")
            if members.isEmpty():
                break
        part = F.pmod(F.hash("rep", "bucket"), F.lit(leaders_per_bucket))
        leaders = members.groupBy("bucket", part.alias("part")).agg(F.max(F.struct("popular", "rep", "component", "band")).alias("leader"))
        leaders = store(leaders.select("bucket", *(F.col(f"leader.{c}").alias(f"l_{c}") for c in ("rep", "component", "band"))), "leaders")
        met = members.withColumn("leads", F.lit(None).cast("boolean"))
        if leaders_per_bucket > 1:  # one leader has no other to meet
            met = members.join(leaders.select("bucket", F.col("l_rep").alias("rep"), F.lit(True).alias("leads")), ["bucket", "rep"], "left")
        met = met.join(known.select("rep", "sketch", "marks"), "rep").select(
            "bucket", "rep", "component", "leads", "sketch", _earlier(F.col("marks"), F.col("band")).alias("earlier")
        )
        lead = leaders.join(known.select(F.col("rep").alias("l_rep"), F.col("sketch").alias("l_sketch"), "marks"), "l_rep").select(
            "bucket", "l_rep", "l_component", "l_sketch", _earlier(F.col("marks"), F.col("l_band")).alias("l_earlier")
        )
        met = met.join(
            lead,
            (met["bucket"] == lead["bucket"])
            & (met["component"] != lead["l_component"])
            & (met["leads"].isNull() | (met["rep"] < lead["l_rep"]))
            & _alike(met["sketch"], lead["l_sketch"])
            & ~F.arrays_overlap(met["earlier"], lead["l_earlier"]),
        )
        # leaders leave the bucket, so no later round meets the pair again
        pairs = store(met.select(F.least("rep", "l_rep").alias("a"), F.greatest("rep", "l_rep").alias("b")), "pairs")
        new = store(verified(pairs, texts), "links")
        found = new if found is None else found.unionByName(new)
        if not new.isEmpty():
            labels = components(found)
        members = members.drop("component").join(leaders.select("bucket", F.col("l_rep").alias("rep")), ["bucket", "rep"], "left_anti")
        leaders_per_bucket *= MORE_LEADERS
    else:
        raise RuntimeError("buckets left open")
    return labels


def representatives(rows: DataFrame) -> DataFrame:
    """One row per word sequence of ``rows`` (``fingerprint``): key, rep, keeper, text_id, text_hash, bands, sketch.

    A doc_id speaks for one word sequence only, that of the smallest key under it. ``rep`` is the smallest doc_id that speaks
    for the sequence; where all its ids speak for others, a number of 2^62 or more made of its words. ``keeper`` is
    the doc_id of the row to keep.
    """
    known = rows.where("n_words > 0 and doc_id is not null")
    # the wide columns are shuffled once, by key, and the ids apart from them
    texts = known.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("own"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    speaks = known.groupBy("doc_id").agg(F.min("key").alias("key")).groupBy("key").agg(F.min("doc_id").alias("speaker"))
    made = F.col("key").bitwiseAND(F.lit(NAMED_BY_WORDS - 1)) + F.lit(NAMED_BY_WORDS)
    return store(
        texts.join(speaks, "key", "left").select(
            "key", F.coalesce("speaker", made).alias("rep"), F.coalesce("speaker", F.col("own.doc_id")).alias("keeper"),
            F.col("own.doc_id").alias("text_id"), F.col("own.text_hash").alias("text_hash"), "bands", "sketch",
        ),
        "representatives",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_hash, key, class_id, kept and n_words of every row; links join classes, equal words are one class without a comparison.

    class_id is the smallest doc_id in the class, and kept marks the rows of that doc_id and its words. A text without words is like no other: its
    class is its own doc_id. Rows with a null doc_id take the class of their text, null if it has none, and kept is null.
    Repeated rows are in one class. Of rows that repeat a doc_id with other texts each has the class of its text; the doc_id
    names one of these classes, the others are named by the next doc_id that can, or if there is none by a number of 2^62 or more.
    """
    rows = fingerprint(docs)
    reps = representatives(rows)
    labels = links(reps.select("rep", "text_id", "text_hash", "bands", "sketch"), docs)
    named = reps.select("key", "keeper", "rep", F.col("rep").alias("class_id"))
    if labels is not None:
        named = named.drop("class_id").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class_id", F.coalesce("component", "rep"))
    named = store(named.select("key", "class_id", F.when(F.col("class_id") == F.col("rep"), F.col("keeper")).alias("keeper"), F.lit(True).alias("named")), "classes")
    out = rows.select("row_id", "doc_id", "text_hash", "key", "n_words").join(named, "key", "left")
    kept = F.when(F.col("doc_id").isNotNull(), F.col("named").isNull() | F.coalesce(F.col("doc_id") == F.col("keeper"), F.lit(False)))
    return out.select("row_id", "doc_id", "text_hash", "key", F.coalesce("class_id", "doc_id").alias("class_id"), kept.alias("kept"), "n_words")


def near_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: one row of those that ``near_duplicates`` marks as kept.

    Of such rows that differ in more than words one stays. Rows with a null doc_id stay, since nothing names them.
    """
    found = near_duplicates(docs).where("kept")
    keep = found.groupBy(F.col("doc_id").alias("kept_id"), "key").agg(F.min("text_hash").alias("kept_hash")).select("kept_id", "kept_hash")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("kept_id"), _text_hash().alias("kept_hash"))
    held = held.join(keep, ["kept_id", "kept_hash"], "left_semi").dropDuplicates(["kept_id", "kept_hash"]).select("row.*")
    return held.unionByName(docs.where("doc_id is null"))
