"""Ranks, running sums and quantiles that no single task has to hold.

A window without a partition key, or one partitioned by an account that owns a
third of all rows, sends those rows to one task. The operators here range-split
the ordered rows into even slices instead, work inside a slice, and carry the
totals of earlier slices over. A slice border cuts at most one key, so the
carried rows number at most two per slice and are safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width

# A window group above this many rows takes the sliced way.
HOT_GROUP_ROWS = 2_000_000

SLICE = "_slice"


@dataclass(frozen=True)
class Ascending:
    """Sort column; ``Descending`` flips it."""

    name: str

    def column(self) -> Column:
        return F.col(self.name).asc()


class Descending(Ascending):
    def column(self) -> Column:
        return F.col(self.name).desc()


Order = Sequence[Ascending]


def running_totals(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    order: Order,
    sums: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
    exclude_current: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``keys``.

    ``sums`` maps new column -> summed column; ``lasts`` maps new column -> the
    column whose latest non-null value is carried. ``order`` should be unique
    within ``keys``; equal rows stay in one slice, in no set order.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    count = slices or shuffle_width(df.sparkSession)
    by = [F.col(k).asc() for k in keys] + [o.column() for o in order]
    # Materialised once: a slice number must not change between the two reads below.
    sliced = cut_lineage(df.repartitionByRange(count, *by).withColumn(SLICE, F.spark_partition_id()))

    inside = (
        Window.partitionBy(SLICE, *keys)
        .orderBy(*[o.column() for o in order])
        .rowsBetween(Window.unboundedPreceding, -1 if exclude_current else Window.currentRow)
    )
    local = sliced.select(
        "*",
        *[F.sum(source).over(inside).alias(f"_in_{name}") for name, source in sums.items()],
        *[F.last(source, ignorenulls=True).over(inside).alias(f"_in_{name}") for name, source in lasts.items()],
    )

    carry = _carried(sliced, keys, order, sums, lasts)
    joined = _join_carry(local, carry, keys)
    result = joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.coalesce(f"_in_{n}", f"_carry_{n}").alias(n) for n in lasts],
    )
    return result


def _carried(sliced: DataFrame, keys, order: Order, sums, lasts) -> DataFrame:
    """Per slice border: what the key held before this slice began."""
    position = F.struct(*[F.col(o.name) for o in order])
    newest_first = all(isinstance(o, Descending) for o in order)
    pick_last = F.min_by if newest_first else F.max_by
    totals = sliced.groupBy(SLICE, *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(source).alias(f"_part_{name}") for name, source in sums.items()],
        *[
            pick_last(F.when(F.col(source).isNotNull(), F.col(source)), F.when(F.col(source).isNotNull(), position)).alias(f"_part_{name}")
            for name, source in lasts.items()
        ],
    )
    # group size <= number of slices, whatever the key holds
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    cut_keys = totals.withColumn("_spans", F.count(F.lit(1)).over(whole)).where("_spans > 1")
    return cut_keys.select(
        F.col(SLICE).alias("_carry_slice"),
        *[F.col(k).alias(f"_carry_key_{k}") for k in keys],
        *[F.sum(f"_part_{name}").over(before).alias(f"_carry_{name}") for name in sums],
        *[F.last(f"_part_{name}", ignorenulls=True).over(before).alias(f"_carry_{name}") for name in lasts],
    )


def _join_carry(local: DataFrame, carry: DataFrame, keys) -> DataFrame:
    match = F.col(SLICE) == F.col("_carry_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_carry_key_{k}"))
    # at most two rows per slice border (see module docstring)
    return local.join(F.broadcast(carry), match, "left")


def global_rank(df: DataFrame, *, order: Order, name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """1-based row number over the whole table or within ``keys``."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(counted, keys=keys, order=order, sums={name: "_one"})
    return ranked.select(*df.columns, name)


def value_ladder(df: DataFrame, value: str, slices: int | None = None) -> DataFrame:
    """Distinct values with their count and running count, ascending."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return running_totals(counts, order=[Ascending("value")], sums={"upto": "n"}, slices=slices)


def linear_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles.

    Same definition as ``percentile``, but the counts per value stay spread over
    the cluster instead of growing inside one aggregation buffer.
    """
    ladder = value_ladder(df, value)
    total = ladder.agg(F.max("upto")).scalar()
    with_total = ladder.withColumn("_total", total)
    columns = []
    for name, q in quantiles.items():
        at = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        low_value = F.min(F.when(F.col("upto") > low, F.col("value")))
        high_value = F.min(F.when(F.col("upto") > high, F.col("value")))
        part = F.max(at - low)
        columns.append((low_value + (high_value - low_value) * part).cast("double").alias(name))
    return with_total.agg(*columns)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_GROUP_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    Map-side combined count; the result has at most ``rows / limit`` rows.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    found = cut_lineage(counted.select(*keys))
    return None if found.isEmpty() else found


def split_by_heat(df: DataFrame, keys: Sequence[str], limit: int = HOT_GROUP_ROWS):
    """(cold rows, hot rows or None)."""
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    match = None
    for k in keys:
        term = df[k].eqNullSafe(hot[k])
        match = term if match is None else match & term
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi")
