"""Keyed snapshots with expiry: upsert, lookup, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CACHE_TTL_SECONDS, FEATURES
from ..schemas import FEATURE_RECORD

MICROS = 1_000_000
from .spread import per_key


def with_expiry(df: DataFrame, *, written_us: str, ttl_sec: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Adds ``expire_us``; 0 means never."""
    expiry = F.col(written_us) + ttl_sec * MICROS if ttl_sec > 0 else F.lit(0).cast("bigint")
    return df.withColumn("expire_us", expiry)


def snapshot_upsert(
    old: DataFrame | None, new: DataFrame, *, key: str, written_us: str, value: str, ttl_sec: int = CACHE_TTL_SECONDS
) -> DataFrame:
    """One row per key, the latest write; of two writes at one time the larger value.

    A max over (time, value) combines map-side, so a key written very often
    sends one row per task.
    """
    fresh = with_expiry(new.select(key, written_us, value), written_us=written_us, ttl_sec=ttl_sec)
    rows = fresh if old is None else old.select(key, written_us, value, "expire_us").unionByName(fresh)
    latest = rows.groupBy(key).agg(F.max(F.struct(written_us, value, "expire_us")).alias("w"))
    return latest.select(key, f"w.{written_us}", f"w.{value}", "w.expire_us")


def is_live(now_us: Column, expire_us: Column) -> Column:
    return (expire_us == 0) | (now_us < expire_us)


def lookup_ttl(requests: DataFrame, snapshot: DataFrame, *, key: str, value: str, now_us: Column) -> DataFrame:
    """Requests with the stored value where it is present and unexpired.

    The snapshot is written first, so that the requests of a hot key can be split: a join with an
    aggregate on the key would keep the aggregate's partitions.
    """
    stored = per_key(snapshot.select(key, F.col(value).alias("_value"), F.col("expire_us").alias("_expire")))
    joined = requests.join(stored, key, "left")
    live = F.coalesce(is_live(now_us, F.col("_expire")), F.lit(False)) & F.col("_value").isNotNull()
    return joined.select(*requests.columns, F.when(live, F.col("_value")).alias(value), live.alias("cache_hit"))


def feature_record() -> Column:
    return F.struct(*[F.col(name).cast("double").alias(name) for name in FEATURES])


def feature_json() -> Column:
    return F.to_json(feature_record())


def parse_feature_json(text: Column) -> Column:
    return F.from_json(text, FEATURE_RECORD)
