"""Grouped primitives that stay balanced when one key holds a large share of the rows.

Window functions put every row of a key into one task. The helpers here first work inside
`(key, segment)` groups, where a segment is a slice of the ordering column, and then carry
only one small row per segment across the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: the row with the greatest `order`. Partially aggregated before the shuffle."""
    pick = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*")


def oldest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: the row with the smallest `order`. Partially aggregated before the shuffle."""
    pick = F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*")


def first_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows per key. The rank filter is pushed below the shuffle as a per-task group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def time_segment(column: str, seconds: int = 86_400) -> Column:
    """Slice number of a timestamp column; monotone in time."""
    return F.floor(F.unix_timestamp(F.col(column).cast("timestamp")) / F.lit(seconds)).cast("long")


def number_segment(column: str, width: int = 10_000) -> Column:
    """Slice number of an integer column; monotone in the column."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column],
    segment: Column,
) -> DataFrame:
    """Inclusive running sums per key, in two levels.

    `segment` must be a non-decreasing function of the first ordering column. Rows are windowed
    inside `(keys, segment)`; per-segment totals are accumulated across the key and added back.
    With no keys this is a global running sum without a single-task sort.
    """
    group = [*keys, "_segment"]
    inputs = {f"_in_{name}": expr for name, expr in measures.items()}
    rows = df.withColumns({"_segment": segment, **inputs})
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_run_{name}": F.sum(f"_in_{name}").over(inside) for name in measures})
    totals = rows.groupBy(*group).agg(*[F.sum(f"_in_{name}").alias(f"_tot_{name}") for name in measures])
    # Without keys the carry runs over the segment totals alone: one row per time or id slice.
    carry_window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    across = carry_window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*group, *[F.coalesce(F.sum(f"_tot_{n}").over(across), F.lit(0)).alias(f"_carry_{n}") for n in measures])
    joined = local.join(carry, group)
    return joined.withColumns({n: F.col(f"_run_{n}") + F.col(f"_carry_{n}") for n in measures}).drop(
        "_segment", *[f"{p}{n}" for n in measures for p in ("_in_", "_run_", "_carry_")]
    )


def position_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str = "position") -> DataFrame:
    """1-based position of every row within its key, in two levels (a row_number that tolerates hot keys)."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, segment)
