"""Exact positions and grouped lists without collecting a group in one task.

Positions come from one distributed sort. The sorted rows are written to the
checkpoint folder, so that the counts taken from them and the rows joined to
those counts are the same rows even when an executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

_SLICE_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def positions(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Add the 0-based place of every row in ``order``, counted within each key.

    ``order`` has to be total (end it with a unique column). A hot key is spread
    over as many sort slices as its rows need: only one summary row per key and
    slice meets in a window.
    """
    sorted_rows = durable(
        df.orderBy(*[F.col(k) for k in keys], *order).withColumn(
            "_slot", F.monotonically_increasing_id()
        )
    )
    sliced = sorted_rows.select(
        *df.columns,
        F.shiftright("_slot", _SLICE_BITS).alias("_slice"),
        F.col("_slot").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1)).alias("_local"),
    )
    # One row per key and slice, one row per slice: the latter is bounded by the task count.
    runs = sliced.groupBy("_slice", *keys).agg(
        F.min("_local").alias("_head"), F.count(F.lit(1)).alias("_rows")
    )
    slices = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = slices.select(
        F.col("_slice").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before")
    )
    if not keys:
        placed = sliced.join(F.broadcast(offsets), F.col("_slice") == F.col("_s"))
        return placed.select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))
    starts = runs.join(F.broadcast(offsets), F.col("_slice") == F.col("_s")).select(
        F.col("_slice").alias("_s"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        "_before",
        F.min(F.col("_before") + F.col("_head")).over(Window.partitionBy(*keys)).alias("_first"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    matched = sliced.join(starts, reduce(lambda a, b: a & b, same, F.col("_slice") == F.col("_s")))
    return matched.select(
        *df.columns, (F.col("_before") + F.col("_local") - F.col("_first")).alias(name)
    )


def running_total(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str], amount: Column, name: str
) -> DataFrame:
    """Add the exact sum of ``amount`` over a row and all rows before it in ``order``, within each key.

    Sorted like ``positions``: a window holds one sort slice of a key or one row per slice, never a whole key.
    """
    sorted_rows = durable(
        df.withColumn("_amount", amount).orderBy(*[F.col(k) for k in keys], *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_slot", _SLICE_BITS))
    by_slice = sorted_rows.groupBy("_slice", *keys).agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.select(
        F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    so_far = Window.partitionBy("_slice", *keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = sorted_rows.withColumn("_local", F.sum("_amount").over(so_far)).join(
        starts, reduce(lambda a, b: a & b, same, F.col("_slice") == F.col("_s"))
    )
    return joined.select(*df.columns, (F.col("_start") + F.col("_local")).alias(name))


def part_of(name: str, size: int) -> Column:
    """Which range of ``size`` whole numbers a value falls in, by whole-number division."""
    return F.expr(f"`{name}` div {size}L")


def chunked_lists(
    df: DataFrame, keys: Sequence[str], order_id: str, value: str, size: int = 4096
) -> DataFrame:
    """Grouped values as ordered lists of at most ``size`` values: (keys, part, values).

    A part is a range of places within the key, so a key with up to ``size`` values has one
    list; a longer list is its parts joined in ``part`` order. Null values keep their place.
    """
    placed = positions(df.select(*keys, order_id, value), [F.col(order_id)], keys, name="_place")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_place").alias("i"), F.col(value).alias("v"))))
    return (
        placed.groupBy(*keys, part_of("_place", size).alias("part"))
        .agg(pairs.alias("_pairs"))
        .select(*keys, "part", F.transform("_pairs", lambda p: p["v"]).alias("values"))
    )
