"""Trailing windows, novelty, as-of lookups and time splits."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CACHE_TTL_SECONDS
from .ordered import (
    HOT_GROUP_ROWS,
    Ascending,
    linear_quantiles,
    running_totals,
    split_by_heat,
    value_ladder,
)

MICROS = 1_000_000
MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"


def trailing_totals(
    df: DataFrame,
    *,
    key: str,
    ts_us: str,
    windows: Mapping[str, int],
    amount: str | None = None,
    hot_limit: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Per event: how many events (and how much) in each trailing window.

    ``windows`` maps a suffix to a width in seconds; the frame is open on the
    left and closed on the right. Adds ``count_<suffix>`` and, with ``amount``,
    ``sum_<suffix>``. Ordinary keys use one sort and RANGE frames; a key above
    ``hot_limit`` events is counted by sliced arrival and expiry totals.
    """
    cold, hot = split_by_heat(df, [key], hot_limit)
    result = _framed_totals(cold, key, ts_us, windows, amount)
    if hot is not None:
        result = result.unionByName(_swept_totals(hot, key, ts_us, windows, amount))
    return result


def _framed_totals(df, key, ts_us, windows, amount):
    by_time = Window.partitionBy(key).orderBy(ts_us)
    columns = []
    for suffix, width in windows.items():
        frame = by_time.rangeBetween(-(width * MICROS) + 1, 0)
        columns.append(F.count(F.lit(1)).over(frame).alias(f"count_{suffix}"))
        if amount:
            columns.append(F.sum(F.col(amount).cast(MONEY)).over(frame).cast(MONEY_SUM).alias(f"sum_{suffix}"))
    return df.select("*", *columns)


def _swept_totals(df, key, ts_us, windows, amount):
    """Each event adds at its time and subtracts when it leaves a window."""
    zero_money = F.lit(0).cast(MONEY_SUM)
    per_time = df.groupBy(key, ts_us).agg(
        F.count(F.lit(1)).alias("_c"),
        (F.sum(F.col(amount).cast(MONEY)).cast(MONEY_SUM) if amount else zero_money).alias("_s"),
    )

    def moves(at, entering: bool, leaving_suffix: str | None):
        columns = [F.col(key), at.alias("_at"), F.lit(1 if entering else 0).alias("_phase")]
        for suffix in windows:
            live = entering or suffix == leaving_suffix
            sign = F.lit(1 if entering else -1)
            columns.append((F.col("_c") * sign if live else F.lit(0)).cast("bigint").alias(f"_c_{suffix}"))
            columns.append((F.col("_s") * sign if live else zero_money).cast(MONEY_SUM).alias(f"_s_{suffix}"))
        return per_time.select(*columns)

    steps = [moves(F.col(ts_us), True, None)]
    steps += [moves(F.col(ts_us) + width * MICROS, False, s) for s, width in windows.items()]
    swept = reduce(DataFrame.unionByName, steps)
    grouped = swept.groupBy(key, "_at", "_phase").agg(
        *[F.sum(f"_c_{s}").alias(f"_c_{s}") for s in windows],
        *[F.sum(f"_s_{s}").cast(MONEY_SUM).alias(f"_s_{s}") for s in windows],
    )
    sums = {f"count_{s}": f"_c_{s}" for s in windows}
    if amount:
        sums |= {f"sum_{s}": f"_s_{s}" for s in windows}
    totals = running_totals(grouped, keys=[key], order=[Ascending("_at"), Ascending("_phase")], sums=sums)
    arrivals = totals.where("_phase = 1").select(
        F.col(key).alias("_key"),
        F.col("_at").alias("_time"),
        *[F.col(c).cast(MONEY_SUM).alias(c) if c.startswith("sum_") else F.col(c) for c in sums],
    )
    match = F.col(key).eqNullSafe(F.col("_key")) & (F.col(ts_us) == F.col("_time"))
    ordered = [f"{p}_{s}" for s in windows for p in (("count", "sum") if amount else ("count",))]
    return df.join(arrivals, match).select(*df.columns, *ordered)


def rolling_velocity(df, *, key, ts_us, amount, window_sec=86_400, dedupe_same_amount=False, hot_limit=HOT_GROUP_ROWS):
    """Trailing count and volume per event.

    ``dedupe_same_amount`` counts events of one key with equal time and amount once.
    """
    rows = df.dropDuplicates([key, ts_us, amount]) if dedupe_same_amount else df
    totals = trailing_totals(
        rows, key=key, ts_us=ts_us, windows={"w": window_sec}, amount=amount, hot_limit=hot_limit
    )
    return totals.withColumnsRenamed({"count_w": "tx_velocity", "sum_w": "amount_velocity"})


def multi_velocity(df, *, key, ts_us, hot_limit=HOT_GROUP_ROWS):
    """Counts over 5 minutes, 1 hour and 24 hours from one sort."""
    totals = trailing_totals(
        df, key=key, ts_us=ts_us, windows={"5m": 300, "1h": 3600, "24h": 86_400}, hot_limit=hot_limit
    )
    return totals.withColumnsRenamed(
        {"count_5m": "velocity_5m", "count_1h": "velocity_1h", "count_24h": "velocity_24h"}
    )


def rate_limit(df, *, key, ts_us, max_requests=100, window_sec=60, hot_limit=HOT_GROUP_ROWS):
    totals = trailing_totals(
        df, key=key, ts_us=ts_us, windows={"w": window_sec}, hot_limit=hot_limit
    ).withColumnRenamed("count_w", "requests")
    return totals.withColumn("is_limited", F.col("requests") > max_requests)


def burst_detect(df, *, key, actor, ts_us, window_sec=86_400, min_events=5, min_actors=2, hot_limit=HOT_GROUP_ROWS):
    """Shared keys whose trailing window reaches ``min_events``, used by several actors."""
    totals = trailing_totals(df, key=key, ts_us=ts_us, windows={"w": window_sec}, hot_limit=hot_limit)
    return (
        totals.groupBy(key)
        .agg(
            F.max("count_w").alias("peak_events"),
            F.sum(F.when(F.col("count_w") >= min_events, 1).otherwise(0)).alias("burst_events"),
            F.countDistinct(actor).alias("actors"),
        )
        .where((F.col("peak_events") >= min_events) & (F.col("actors") >= min_actors))
    )


def delta_t_from_prev(df, *, key, ts_us, tie, hot_limit=HOT_GROUP_ROWS):
    """Seconds since the key's previous event; 0 for its first."""
    cold, hot = split_by_heat(df, [key], hot_limit)
    by_time = Window.partitionBy(key).orderBy(ts_us, tie)
    result = cold.withColumn("_prev", F.lag(ts_us).over(by_time))
    if hot is not None:
        carried = running_totals(
            hot, keys=[key], order=[Ascending(ts_us), Ascending(tie)], lasts={"_prev": ts_us}, exclude_current=True
        )
        result = result.unionByName(carried)
    gap = (F.col(ts_us) - F.col("_prev")) / MICROS
    return result.withColumn("delta_t_from_prev", F.coalesce(gap, F.lit(0.0))).drop("_prev")


def novelty_flags(df, *, owner, event_id, ts_us, identifiers: Mapping[str, str]):
    """1 where the owner uses this identifier for the first time.

    First uses are found by an aggregate (combined map-side) and joined back on
    the unique event id, so an owner with very many events is no hot group.
    """
    result = df
    for flag, identifier in identifiers.items():
        first = (
            df.where(F.col(identifier).isNotNull())
            .groupBy(owner, identifier)
            .agg(F.min_by(event_id, F.struct(ts_us, event_id)).alias(event_id))
            .select(event_id, F.lit(1).alias(flag))
        )
        result = result.join(first, event_id, "left").fillna(0, [flag])
    return result


def asof_score(
    events: DataFrame,
    scores: DataFrame,
    *,
    key: str,
    event_id: str,
    event_us: str,
    score_key: str,
    written_us: str,
    score: str,
    ttl_sec: int = CACHE_TTL_SECONDS,
    hot_limit: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Latest score written at or before each event and still inside its TTL.

    Writes at the event's own time are visible to it; of two writes at one time
    the larger score wins. ``ttl_sec=0`` never expires.
    """
    writes = (
        scores.groupBy(F.col(score_key).alias("_key"), F.col(written_us).alias("_at"))
        .agg(F.max(score).alias("_score"))
        .select("_key", "_at", F.lit(0).alias("_phase"), F.lit(None).cast("bigint").alias("_event"),
                F.struct(F.col("_at").alias("at"), F.col("_score").alias("score")).alias("_write"))
    )
    reads = events.select(
        F.col(key).alias("_key"), F.col(event_us).alias("_at"), F.lit(1).alias("_phase"),
        F.col(event_id).cast("bigint").alias("_event"),
        F.lit(None).cast(writes.schema["_write"].dataType).alias("_write"),
    )
    line = writes.unionByName(reads)
    cold, hot = split_by_heat(line, ["_key"], hot_limit)
    latest = Window.partitionBy("_key").orderBy("_at", "_phase", "_event").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    filled = cold.withColumn("_latest", F.last("_write", ignorenulls=True).over(latest))
    if hot is not None:
        filled = filled.unionByName(
            running_totals(
                hot, keys=["_key"], order=[Ascending("_at"), Ascending("_phase"), Ascending("_event")],
                lasts={"_latest": "_write"},
            )
        )
    age = F.col("_at") - F.col("_latest.at")
    fresh = F.col("_latest").isNotNull() & (F.lit(ttl_sec == 0) | (age < ttl_sec * MICROS))
    return filled.where("_phase = 1").select(
        F.col("_event").alias(event_id),
        F.col("_key").alias(key),
        F.when(fresh, F.col("_latest.score")).alias("nearline_score"),
        fresh.alias("cache_hit"),
    )


def temporal_split(df: DataFrame, *, step: str, test_fraction: float = 0.2) -> DataFrame:
    """Adds ``split``: train up to the interpolated quantile, test after it."""
    cut = linear_quantiles(df, step, {"cut": 1.0 - test_fraction}).scalar()
    return df.withColumn("split", F.when(F.col(step) <= cut, "train").otherwise("test"))


def temporal_masks(
    df: DataFrame, *, step: str, val_fraction: float = 0.1, test_fraction: float = 0.2
) -> DataFrame:
    """Adds ``split``: train / val / test cut at ranked elements of ``step``."""
    ladder = value_ladder(df, step)
    total = ladder.agg(F.max("upto")).scalar()
    marks = ladder.withColumn("_total", total)

    def element(fraction):
        index = F.floor(F.col("_total") * F.lit(fraction))
        return marks.agg(F.min(F.when(F.col("upto") > index, F.col("value")))).scalar()

    val_cut = element(1 - val_fraction - test_fraction)
    test_cut = element(1 - test_fraction)
    return df.withColumn(
        "split",
        F.when(F.col(step) <= val_cut, "train").when(F.col(step) <= test_cut, "val").otherwise("test"),
    )


def session_bursts(df, *, key, ts_us, gap_sec=300, min_events=5, hot_limit=HOT_GROUP_ROWS):
    """Gap sessions with at least ``min_events`` events, per key."""
    cold, hot = split_by_heat(df.select(key, ts_us), [key], hot_limit)
    by_time = Window.partitionBy(key).orderBy(ts_us)
    marked = cold.withColumn("_prev", F.lag(ts_us).over(by_time))
    starts = (F.col("_prev").isNull() | (F.col(ts_us) - F.col("_prev") >= gap_sec * MICROS)).cast("bigint")
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("_start", starts).withColumn("_session", F.sum("_start").over(running))
    sessions = _sessions(numbered, key, ts_us)
    if hot is not None:
        times = hot.groupBy(key, ts_us).agg(F.count(F.lit(1)).alias("_n"))
        prev = running_totals(times, keys=[key], order=[Ascending(ts_us)], lasts={"_prev": ts_us}, exclude_current=True)
        hot_numbered = running_totals(
            prev.withColumn("_start", starts), keys=[key], order=[Ascending(ts_us)], sums={"_session": "_start"}
        )
        sessions = sessions.unionByName(_sessions(hot_numbered, key, ts_us, "_n"))
    return sessions.where(F.col("events") >= min_events)


def _sessions(numbered, key, ts_us, weight=None):
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return numbered.groupBy(key, "_session").agg(
        size.alias("events"), F.min(ts_us).alias("start_us"), F.max(ts_us).alias("end_us")
    ).drop("_session")


def rapid_passthrough(
    df: DataFrame,
    *,
    account_in: str = "nameDest",
    account_out: str = "nameOrig",
    step: str = "step",
    amount: str = "amount",
    within: int = 2,
) -> DataFrame:
    """Money received at a step and sent on within ``within`` steps.

    Both sides are added up per account and step first; each outgoing total then
    meets the ``within + 1`` receiving steps it can belong to. No in x out pairs.
    """
    received = df.groupBy(F.col(account_in).alias("account_id"), F.col(step).alias("in_step")).agg(
        F.sum(F.col(amount).cast(MONEY)).cast(MONEY_SUM).alias("amount_in"), F.count(F.lit(1)).alias("tx_in")
    )
    sent = df.groupBy(F.col(account_out).alias("account_id"), F.col(step).alias("out_step")).agg(
        F.sum(F.col(amount).cast(MONEY)).cast(MONEY_SUM).alias("amount_out"), F.count(F.lit(1)).alias("tx_out")
    )
    reachable = sent.select(
        "account_id",
        F.explode(F.sequence(F.col("out_step") - within, F.col("out_step"))).alias("in_step"),
        "amount_out",
        "tx_out",
    ).groupBy("account_id", "in_step").agg(
        F.sum("amount_out").cast(MONEY_SUM).alias("amount_out"), F.sum("tx_out").alias("tx_out")
    )
    return received.join(reachable, ["account_id", "in_step"]).withColumn(
        "passthrough_ratio", F.col("amount_out").cast("double") / F.col("amount_in").cast("double")
    )
