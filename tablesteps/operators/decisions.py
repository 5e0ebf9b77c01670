"""Decisions that hold for a whole column of a table, for many tables in one job.

A cell table is long: (table_id, row_id, col, cell). What cuts a column into lists, whether it is a column of numbers
and whether these are whole follows from all its cells, so each is one aggregate per (table_id, col) with partial sums on the map
side. The decisions are one row per column and are joined back to the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import DELIMITERS, list_parts
from ..functions.values import float_text, null_false, num


def column_decisions(cells: DataFrame) -> DataFrame:
    """Per column of a table: (table_id, col, delimiter, numeric, whole).

    ``delimiter`` cuts the cells into most parts, the earlier of DELIMITERS on a tie and for a column of nulls.
    ``numeric`` holds if every cell is null, empty or a number; ``whole`` if every cell is a number without a fraction,
    which one null or empty cell already denies.
    """
    cell = F.col("cell")
    parts = {mark: F.coalesce(F.sum(F.size(F.split(cell, mark))), F.lit(0)) for mark in DELIMITERS}
    number = num(cell)
    found = cells.groupBy("table_id", "col").agg(
        *[total.alias(f"_{i}") for i, total in enumerate(parts.values())],
        F.bool_and(cell.isNull() | (cell == "") | number.isNotNull()).alias("numeric"),
        F.bool_and(null_false(number == F.floor(number))).alias("whole"),
    )
    most = F.greatest(*[F.col(f"_{i}") for i in range(len(DELIMITERS))])
    delimiter = F.coalesce(*[F.when(F.col(f"_{i}") == most, F.lit(mark)) for i, mark in enumerate(DELIMITERS)])
    return found.select("table_id", "col", delimiter.alias("delimiter"), "numeric", "whole")


def decided_cells(cells: DataFrame) -> DataFrame:
    """Adds to each cell: ``parts`` by its column's delimiter, ``number`` or ``text`` as the column is numeric or not,
    and ``shown``, the number without a fraction if all numbers of the column are whole.

    A null cell has no parts and is null elsewhere. A null ``table_id`` is a table like any other.
    """
    keys = [F.col(k) for k in ("table_id", "col")]
    named = column_decisions(cells).withColumnsRenamed({"table_id": "_table", "col": "_col"})
    same = keys[0].eqNullSafe(F.col("_table")) & keys[1].eqNullSafe(F.col("_col"))
    return cells.join(named, same).select(
        *cells.columns, list_parts(F.col("cell"), F.col("delimiter")).alias("parts"),
        F.when(F.col("numeric"), num(F.col("cell"))).alias("number"), F.when(~F.col("numeric"), F.col("cell")).alias("text"),
        _shown(F.col("cell"), F.col("whole")).alias("shown"),
    )


def _shown(cell: Column, whole: Column) -> Column:
    number = num(cell)
    return F.when(number.isNull(), cell).when(whole, number.cast("bigint").cast("string")).otherwise(float_text(number))
