"""Mixing sources to target weights, as a curriculum with time-varying weights.

Each source has a weight schedule over training time 0..1, linear from ``1 + tilt`` to ``1 - tilt``
times its weight, so its integral is the weight. The integral up to time t, times the source's
target, is the source's cumulative demand for words. A document's place in the shuffled order of
its source, in words, is looked up in the inverse of that demand and gives its training position.
A second or third copy follows one or two whole source sizes later. Copies beyond the target have no
position. Documents are range-sorted by position.

Places in a source are running sums over a hash order. They are summed in bins of the hash
range, as many as the rows of a source need, so a hot source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .names import free_prefix

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
BIN_ROWS = 2_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add weight and target to one row per source (source, rows, source_size).

    Sources by code point, null last, take the weights in turn. A target is ``weight * level`` up to
    ``MOST_COPIES`` times the source's size; the level is such that all targets add up to all
    sizes. It is found by the sources in order of size per weight: those below the level are full.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1))
    weighed = weighed.withColumn("most", F.col("source_size") * MOST_COPIES)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("source_size").over(Window.partitionBy())
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("_level", (total - before) / open_weight).withColumn("_place", F.row_number().over(order))
    fits = F.when(F.col("weight") * F.col("_level") <= F.col("most"), F.col("_place"))
    level = F.min_by("_level", fits).over(Window.partitionBy())
    target = F.least(F.col("weight") * level, F.col("most").cast("double"))
    return levels.select("source", "rows", "source_size", "weight", target.alias("target"))


def _inverse_demand(share: Column, tilt: Column) -> Column:
    """The time at which the integral of ``1 + tilt - 2 * tilt * t`` reaches ``share``."""
    root = F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)
    return F.when(tilt == 0, share).otherwise(2 * share / (1 + tilt + root))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), tilts: tuple[float, ...] = (0.5, 0.0, -0.5), seed: str = "mix"
) -> DataFrame:
    """All documents with size, source_size, target, copies, taken and positions, range-sorted by position.

    The size is the number of words (0 for a null or empty text); ``taken`` is size times copies.
    ``positions`` has one time in 0..1 per copy, ``position`` is the first, null for a document
    that is not taken; those come last. A null source is a source of its own. The order within a source
    is by md5 of seed and doc_id, then size and text, so reruns agree; rows equal in all of these are
    interchangeable. Empty documents get copies by their place like others, but a
    source of empty documents alone has target 0 and is not taken. All columns of ``docs`` are
    kept; the names added here replace equal ones. An empty table gives an empty result.
    """
    added = ["size", "source_size", "target", "copies", "taken", "positions", "position"]
    docs = docs.drop(*added)
    x = free_prefix(docs.columns)
    col = lambda name: F.col(x + name)
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = durable(docs.select("source", order.alias(x + "order"), size.alias("size")))
    totals = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    if len(tilts) < max(weights):
        raise ValueError("one tilt for each weight")
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), F.col("weight").cast("int"))
    sources = durable(
        source_targets(totals, weights).select(
            F.col("source").alias(x + "source"), "source_size", "target",
            F.ceil(F.col("rows") / BIN_ROWS).alias(x + "bins"), tilt.alias(x + "tilt"),
        )
    )
    same_source = F.col("source").eqNullSafe(col("source"))
    share = F.conv(F.substring(col("order"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    bin_of = F.floor(share * col("bins"))

    binned = narrow.join(sources, same_source).groupBy(x + "source", bin_of.alias(x + "b")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy(x + "source").orderBy(x + "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(
        binned.select(
            col("source").alias(x + "s"), x + "b", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias(x + "start")
        )
    )

    rows = docs.withColumns({x + "order": order, "size": size}).join(sources, same_source).withColumn(x + "bin", bin_of)
    rows = rows.join(starts, F.col("source").eqNullSafe(col("s")) & (col("bin") == col("b")))
    within = Window.partitionBy("source", x + "bin").orderBy(x + "order", "doc_id", "size", F.xxhash64("text"))
    running = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn(x + "middle", col("start") + running + F.col("size") / 2)
    shares = F.transform(
        F.array(*[F.lit(i) for i in range(MOST_COPIES)]),
        lambda i: F.try_divide(col("middle") + i * F.col("source_size"), F.col("target")),
    )
    rows = rows.withColumn(x + "shares", F.filter(shares, lambda s: s < 1))
    rows = rows.withColumn("positions", F.transform(x + "shares", lambda s: _inverse_demand(s, col("tilt"))))
    copies = F.size("positions")
    return (
        rows.withColumns({
            "copies": copies,
            "taken": F.col("size") * copies,
            "position": F.when(copies > 0, F.element_at("positions", 1)),
        })
        .select(*docs.columns, *added)
        .repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"))
        .sortWithinPartitions(F.col("position").asc_nulls_last(), F.col("doc_id"))
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The taken documents in training order, one row per copy, with the columns of ``docs``.

    Columns of ``docs`` that share a name with one that ``mix`` adds are kept as they are.
    """
    x = free_prefix(docs.columns)
    named = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "source") else f"{x}{c}") for c in docs.columns])
    mixed = mix(named, **options)
    at = free_prefix(mixed.columns) + "at"
    copies = mixed.select(*named.columns, F.explode("positions").alias(at))
    ordered = copies.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id")
    return ordered.select(*named.columns).toDF(*docs.columns)
