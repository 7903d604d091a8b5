"""Structured Streaming jobs.

Keyed windows use the built-in window aggregates, whose partial aggregation
keeps a hot account cheap. Exact trailing windows, rings and drift go through
``foreachBatch`` over a stored history, so no state of one key has to fit in
one task. The library's default watermark is 24 hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CACHE_TTL_SECONDS
from ..operators import audit as audit_ops
from ..operators.drift import drift_report
from ..operators.rings import ring_report
from ..operators.snapshots import is_live
from ..operators.spread import per_key
from ..operators.temporal import MICROS, rate_limit, rolling_velocity
from ..schemas import EVENT
from ..session import scratch_path
from ..sources.views import shape_events

WATERMARK = "24 hours"
MONEY = "decimal(28,2)"


# --- sources and sinks ------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str, *, files: str = "events*.parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT).option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return shape_events(reader.parquet(folder))


def run_to_table(stream: DataFrame, *, mode: str = "append", label: str = "stream", folder: str | None = None) -> DataFrame:
    """Run over everything available, write Parquet below ``folder``, read all of it back.

    With a ``folder`` a later call goes on where the last one stopped, with the state it had; without, a new one is
    made in the shared folder.
    """
    spark = stream.sparkSession
    base = folder or scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_batches(
    stream: DataFrame, step: Callable[[DataFrame, int, str], None], *, label: str, folder: str | None = None, mode: str = "append"
) -> str:
    """Run ``step(batch, batch_id, folder)`` over everything available and return the folder; goes on as ``run_to_table`` does."""
    base = folder or scratch_path(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, batch_id: step(batch, batch_id, base))
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return base


def run_updates(aggregate: DataFrame, keys: list[str], *, label: str, folder: str | None = None) -> DataFrame:
    """Run an aggregate in update mode: each batch writes the rows it changed, and a key's latest row counts.

    Windows that the watermark still holds open are among them, as they stand.
    """
    base = run_batches(aggregate, lambda batch, batch_id, at: _write_batch(batch, at, "out", batch_id), label=label, folder=folder, mode="update")
    rows = read_batches(aggregate.sparkSession, base, "out")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in aggregate.columns if c not in keys]), "batch").alias("w"))
    return latest.select(*keys, "w.*").select(*aggregate.columns)


def run_complete(aggregate: DataFrame, *, label: str, folder: str | None = None) -> DataFrame:
    """Run an aggregate in complete mode: the rows as they stand after the last batch, open windows included.

    For aggregates that update mode does not take, such as session windows; their state keeps every window. Two folders
    take turns, so the output holds at most two copies.
    """

    def step(batch: DataFrame, batch_id: int, at: str) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{at}/out/batch={batch_id % 2}")

    base = run_batches(aggregate, step, label=label, folder=folder, mode="complete")
    rows = read_batches(aggregate.sparkSession, base, "out")
    return rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar()).select(*aggregate.columns)


def _write_batch(df: DataFrame, folder: str, name: str, batch_id: int) -> None:
    """One folder per batch id: a batch that is run again replaces its own output."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


# --- windows --------------------------------------------------------------------------------


def sliding_velocity(events: DataFrame, *, key: str = "user_id", amount: str = "value", width: str = "24 hours", slide: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Count and sum per key over sliding windows."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width, slide).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("tx_velocity"), F.sum(F.col(amount).cast("decimal(18,2)")).cast(MONEY).alias("amount_velocity"))
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tx_velocity", "amount_velocity")
    )


def sliding_totals(
    events: DataFrame, *, key: str = "user_id", amount: str = "value", width_sec: int = 86_400, slide_sec: int = 3600,
    late_sec: int = 86_400, into: str | None = None,
) -> DataFrame:
    """Every row of ``sliding_velocity`` as it stands when the feed ends, by tiles of one slide.

    The stream keeps one row per key and tile; a tile is dealt to its windows at the end, where a key has one row
    per tile however many events it has. So neither state nor output of the stream holds an event once per window. A tile waits
    until the last of its windows would close, so no event that a window would take is late.
    """
    tile = f"{slide_sec} seconds"
    tiles = sliding_velocity(events, key=key, amount=amount, width=tile, slide=tile, watermark=f"{late_sec + width_sec - slide_sec} seconds")
    rows = run_updates(tiles.drop("window_end"), [key, "window_start"], label="tiles", folder=into)
    back = F.explode(F.sequence(F.lit(0), F.lit(width_sec // slide_sec - 1)))
    start = F.unix_micros("window_start") - F.col("back") * F.lit(slide_sec * MICROS)
    dealt = rows.repartition(key).withColumn("back", back).withColumn("start_us", start)
    return dealt.groupBy(key, "start_us").agg(
        F.sum("tx_velocity").alias("tx_velocity"), F.sum("amount_velocity").cast(MONEY).alias("amount_velocity")
    )


def slot_width(keep_sec: int) -> int:
    """Seconds per history folder: a window touches at most two, and folders stay few."""
    return max(keep_sec, 6 * 3600)


def keep_history(batch: DataFrame, batch_id: int, folder: str, *, slot) -> None:
    """Store a batch in time-slot folders; running it again replaces its own files only."""
    stored = batch.withColumn("slot", slot.cast("bigint")).withColumn("batch", F.lit(batch_id)).hint("rebalance", "slot")
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(
        f"{folder}/history"
    )


def read_history(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """Stored rows of a slot range; only the folders of those slots are opened."""
    base = f"{folder}/history"
    reader = spark.read.option("basePath", base)
    if last - first > 2000:
        return reader.parquet(base).where(F.col("slot").between(first, last))
    slots = ",".join(str(s) for s in range(first, last + 1))
    return reader.parquet(f"{base}/slot={{{slots}}}")


def with_recent_history(batch: DataFrame, batch_id: int, folder: str, *, ts_us: str, keep_sec: int) -> DataFrame:
    """This batch plus stored rows that can still fall into its windows; stores the batch."""
    reach = keep_sec * MICROS
    slot = F.floor(F.col(ts_us) / (slot_width(keep_sec) * MICROS))
    keep_history(batch, batch_id, folder, slot=slot)
    span = batch.agg(F.min(slot).alias("s0"), F.max(slot).alias("s1"), F.min(ts_us).alias("t0"), F.max(ts_us).alias("t1")).first()
    if span["s0"] is None:
        return batch.withColumn("is_new", F.lit(True))
    nearby = read_history(batch.sparkSession, folder, span["s0"] - 1, span["s1"] + 1)
    known = nearby.where((F.col("batch") <= batch_id) & F.col(ts_us).between(span["t0"] - reach, span["t1"]))
    return known.withColumn("is_new", F.col("batch") == batch_id).drop("batch", "slot")


def exact_velocity(events: DataFrame, *, key: str = "user_id", amount: str = "value", ts_us: str = "ts_us", window_sec: int = 86_400, into: str | None = None) -> DataFrame:
    """Exact trailing totals of every event, as known when its batch arrived."""

    def step(batch: DataFrame, batch_id: int, folder: str) -> None:
        rows = with_recent_history(batch, batch_id, folder, ts_us=ts_us, keep_sec=window_sec)
        totals = rolling_velocity(rows, key=key, ts_us=ts_us, amount=amount, window_sec=window_sec)
        _write_batch(totals.where("is_new").drop("is_new"), folder, "out", batch_id)

    folder = run_batches(events, step, label="velocity", folder=into)
    return read_batches(events.sparkSession, folder, "out").drop("batch")


def stream_rate_limit(events: DataFrame, *, key: str = "user_id", ts_us: str = "ts_us", max_requests: int = 100, window_sec: int = 60, into: str | None = None) -> DataFrame:
    """Requests in the trailing window, counted over batch and stored history."""

    def step(batch: DataFrame, batch_id: int, folder: str) -> None:
        rows = with_recent_history(batch, batch_id, folder, ts_us=ts_us, keep_sec=window_sec)
        limited = rate_limit(rows, key=key, ts_us=ts_us, max_requests=max_requests, window_sec=window_sec)
        _write_batch(limited.where("is_new").drop("is_new"), folder, "out", batch_id)

    folder = run_batches(events, step, label="rate-limit", folder=into)
    return read_batches(events.sparkSession, folder, "out").drop("batch")


def session_burst(events: DataFrame, *, key: str = "user_id", gap: str = "5 minutes", min_events: int = 5, watermark: str = WATERMARK) -> DataFrame:
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("events"))
        .where(F.col("events") >= min_events)
        .select(key, F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "events")
    )


def all_session_bursts(events: DataFrame, *, into: str | None = None, **options) -> DataFrame:
    """Sessions as they stand when the feed ends, those that the watermark holds open included."""
    return run_complete(session_burst(events, **options), label="sessions", folder=into)


def merchant_minute(events: DataFrame, *, merchant: str, flagged, watermark: str = WATERMARK) -> DataFrame:
    """Events, flagged events and their share per merchant and minute."""
    hits = F.sum(F.when(flagged, 1).otherwise(0)).cast("bigint")
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 minute").alias("w"), merchant)
        .agg(F.count(F.lit(1)).alias("total"), hits.alias("flagged"))
        .select(merchant, F.unix_micros("w.start").alias("minute_us"), "total", "flagged", (F.col("flagged") / F.col("total")).alias("flag_rate"))
    )


def dedupe(events: DataFrame, *, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


# --- scoring -----------------------------------------------------------------------------------


def score_events(events: DataFrame, snapshot: DataFrame, *, key: str, probability, value: str = "score") -> DataFrame:
    """Stateless score of each event, blended with a stored score still alive at event time.

    The snapshot side is a static join; Spark broadcasts it only while its size
    is under the session's broadcast limit.
    """
    stored = per_key(snapshot.select(F.col(key), F.col(value).alias("_cached"), F.col("expire_us").alias("_expire")))
    live = F.coalesce(is_live(F.col("ts_us"), F.col("_expire")), F.lit(False))
    cached = F.when(live, F.col("_cached"))
    return events.join(stored, key, "left").select(
        *events.columns,
        F.when(cached.isNotNull(), 0.5 * probability + 0.5 * cached).otherwise(probability).alias("fraud_probability"),
        cached.isNotNull().alias("cache_hit"),
    )


def nearline_scores(
    writes: DataFrame, *, key: str = "account_id", ts: str = "written_at", score: str = "score", ttl_sec: int = CACHE_TTL_SECONDS,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Latest score per key and slot of one TTL, with its expiry, kept up to date (update mode).

    A max over (time, score) is combined before the state, so a hot key costs one state row a slot. A live write lies in the
    slot of now or the one before, so slots that the watermark has left behind leave the state: it holds the keys of about two TTLs and
    not every key ever seen. Without a TTL nothing expires, and neither does the state.
    """
    at = F.max(F.struct(F.unix_micros(ts).alias("at"), F.col(score).alias("score"))).alias("w")
    if not ttl_sec:
        return writes.groupBy(key).agg(at).select(key, F.col("w.at").alias("written_us"), F.col("w.score").alias("score"), F.lit(0).cast("bigint").alias("expire_us"))
    slots = writes.withWatermark(ts, watermark).groupBy(F.window(ts, f"{ttl_sec} seconds"), key).agg(at)
    return slots.select(key, F.col("w.at").alias("written_us"), F.col("w.score").alias("score"), (F.col("w.at") + ttl_sec * MICROS).alias("expire_us"))


def nearline_table(writes: DataFrame, *, label: str = "nearline", into: str | None = None, **options) -> DataFrame:
    """Run to a stored snapshot: each batch writes its updated slots, the newest write of a key wins."""
    step = lambda batch, batch_id, at: _write_batch(batch, at, "out", batch_id)
    base = run_batches(nearline_scores(writes, **options), step, label=label, folder=into, mode="update")
    key = options.get("key", "account_id")
    newest = read_batches(writes.sparkSession, base, "out").groupBy(key).agg(F.max(F.struct("written_us", "score", "expire_us")).alias("w"))
    return newest.select(key, "w.written_us", "w.score", "w.expire_us")


# --- rings, drift, audit ----------------------------------------------------------------------------


def ring_alerts(payments: DataFrame, scores: DataFrame, *, window_sec: int = 86_400, into: str | None = None) -> DataFrame:
    """Ring report after every batch over the payments of the last ``window_sec``."""

    def step(batch: DataFrame, batch_id: int, folder: str) -> None:
        spark = batch.sparkSession
        width = slot_width(window_sec)
        keep_history(batch, batch_id, folder, slot=F.floor(F.col("timestamp") / width))
        # one row per batch: how far the feed has come
        _write_batch(batch.agg(F.max("timestamp").alias("newest")), folder, "marks", batch_id)
        newest = read_batches(spark, folder, "marks").where(F.col("batch") <= batch_id).agg(F.max("newest").alias("t")).first()["t"]
        if newest is None:
            return
        recent = read_history(spark, folder, int((newest - window_sec) // width), int(newest // width)).where(
            (F.col("batch") <= batch_id) & (F.col("timestamp") > newest - window_sec)
        )
        _write_batch(ring_report(recent.drop("batch", "slot"), scores), folder, "out", batch_id)

    folder = run_batches(payments, step, label="rings", folder=into)
    return read_batches(payments.sparkSession, folder, "out")


def drift_batches(scored: DataFrame, reference: DataFrame, *, score: str, features: list[str], into: str | None = None) -> DataFrame:
    """Drift report of every micro-batch against the reference."""

    def step(batch: DataFrame, batch_id: int, folder: str) -> None:
        _write_batch(drift_report(reference, batch, score=score, features=features), folder, "out", batch_id)

    folder = run_batches(scored, step, label="drift", folder=into)
    return read_batches(scored.sparkSession, folder, "out")


def audit_log(requests: DataFrame, *, into: str | None = None) -> DataFrame:
    """Append-only decision log through a checkpointed file sink."""
    return run_to_table(audit_ops.audit_records(requests), label="audit", folder=into)
