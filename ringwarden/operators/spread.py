"""Rows kept ready for repeated joins on a key, hot keys spread over slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width, store

# Rows of one key that may land in one task.
ROWS_PER_SLICE = 1_000_000


def per_key(rows: DataFrame) -> DataFrame:
    """``rows``, one for each key of a coming join, written and read back.

    An aggregate on the join key lends its partitioning to the join, and then adaptive execution leaves
    the hot keys of the other side whole. Read from a table, this side has an exchange of its own below the
    join, so hot partitions are split, and a size that is known, so a small side is broadcast.
    """
    return store(rows, "per-key")


@dataclass
class SpreadRows:
    """Cached rows, hashed on ``key`` (and on a slice of it where a key is hot).

    A loop that joins the same rows again and again keeps them partitioned, so
    each round moves only the small side. A plain hash would put a key that owns
    a third of the rows into one task of every round; here such a key's rows are
    dealt over several slices and the small side's row is sent to each of them.
    """

    rows: DataFrame
    key: str
    hot: DataFrame | None

    def meet(self, values: DataFrame) -> DataFrame:
        """Join with one row per key."""
        if self.hot is None:
            return self.rows.join(values, self.key)
        slices = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
        copies = values.join(self.hot, self.key, "left").withColumn("slice", slices).drop("slices")
        return self.rows.join(copies, [self.key, "slice"]).drop("slice")

    def release(self) -> None:
        self.rows.unpersist()


def spread_rows(
    rows: DataFrame, key: str, deal_by: str, rows_per_slice: int = ROWS_PER_SLICE, width: int | None = None
) -> SpreadRows:
    """Partition and cache ``rows`` on ``key``; hot keys are dealt by a hash of ``deal_by``.

    The table of hot keys has at most ``rows / rows_per_slice`` rows.
    """
    width = width or shuffle_width(rows.sparkSession)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_slice)
    hot = cut_lineage(sizes.select(key, F.ceil(F.col("n") / rows_per_slice).cast("int").alias("slices")))
    if hot.isEmpty():
        return SpreadRows(rows.repartition(width, key).persist(), key, None)
    dealt = rows.join(hot, key, "left").withColumn(
        "slice", F.pmod(F.xxhash64(deal_by), F.coalesce("slices", F.lit(1))).cast("int")
    )
    return SpreadRows(dealt.drop("slices").repartition(width, key, "slice").persist(), key, hot)
