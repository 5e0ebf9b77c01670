"""Table steps: selection, comparison, grouping, having, order, limit, set operations.

A table is a DataFrame with a unique ``id``; a total row carries ``agg = 1``.
Sub-queries that stand for one value are scalar sub-queries over a one-row
aggregate, so an empty one is null and a comparison with it is false.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_number, compare_values, null_false, num
from .positions import positions

# ---- selection and comparison -------------------------------------------------


def data_rows(df: DataFrame) -> DataFrame:
    """Rows that are data, without total rows."""
    return df.filter(F.col("agg") == 0)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def compare(df: DataFrame, name: str, op: str, value) -> Column:
    """Column against a literal.

    ``=`` and ``!=`` cast the literal to the column's type. The order tests turn a
    text column into numbers when the literal is a number, otherwise they compare
    texts.
    """
    if op in ("=", "!="):
        literal = F.lit(value).cast(df.schema[name].dataType)
        return compare_values(F.col(name), op, literal)
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    left = as_number(df, name) if numeric and _is_text(df, name) else F.col(name)
    return compare_values(left, op, F.lit(value))


def equals_or_none(df: DataFrame, name: str, value: str) -> Column:
    """``=``, but ``'none'`` means null when no cell spells the word."""
    same = compare(df, name, "=", value)
    if value != "none":
        return same
    spelled = df.filter(same).select(F.lit(1)).exists()
    return F.when(spelled, same).otherwise(F.col(name).isNull())


def split_literals(text: str) -> list[str]:
    """Literals of an ``in`` list; commas inside single quotes do not cut."""
    parts, quoted, current = [], False, ""
    for mark in text:
        quoted ^= mark == "'"
        if mark == "," and not quoted:
            parts.append(current)
            current = ""
        else:
            current += mark
    parts.append(current)
    return [p[1:-1] if len(p) > 1 and p[0] == p[-1] and p[0] in "'\"" else p for p in map(str.strip, parts)]


def isin_text(df: DataFrame, name: str, text: str) -> Column:
    kind = df.schema[name].dataType
    return null_false(F.col(name).isin([F.lit(v).cast(kind) for v in split_literals(text)]))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, map(null_false, predicates))


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, map(null_false, predicates))


# ---- one-value sub-queries ----------------------------------------------------


def first_value(df: DataFrame, value: str, order_id: str = "id") -> DataFrame:
    """One row: the value at the smallest id."""
    return df.agg(F.min_by(value, order_id).alias(value))


def where_scalar(df: DataFrame, name: str, op: str, sub: DataFrame, offset: float = 0) -> DataFrame:
    """Rows whose column compares with a one-row, one-column sub-query plus ``offset``."""
    bound = sub.scalar() + F.lit(offset) if offset else sub.scalar()
    return df.filter(compare_values(F.col(name), op, bound))


def scalar_pair(left: DataFrame, right: DataFrame, combine, name: str) -> DataFrame:
    """``combine(left value, right value)`` of two one-row, one-column tables."""
    value = left.columns[0]
    return left.select(combine(F.col(value), right.scalar()).alias(name))


def scalar_diff(
    left: DataFrame, right: DataFrame, name: str, absolute: bool = False, plus: float = 0, empty: float | None = None
) -> DataFrame:
    """Left value minus right value; a side without a row or with null counts as ``empty``."""

    def difference(a: Column, b: Column) -> Column:
        if empty is not None:
            a, b = F.coalesce(a, F.lit(empty)), F.coalesce(b, F.lit(empty))
        gap = F.abs(a - b) if absolute else a - b
        return gap + F.lit(plus) if plus else gap

    return scalar_pair(left, right, difference, name)


# ---- arithmetic ---------------------------------------------------------------


def add_columns(df: DataFrame, left: str, op: str, right: str) -> Column:
    """Two columns combined as numbers; bad texts and division by zero are null."""
    a, b = as_number(df, left), as_number(df, right)
    return _combined(a, op, b)


def _combined(a: Column, op: str, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "/": lambda: F.try_divide(a, b)}[op]()


def list_numbers(items: Column) -> Column:
    """A list of texts as numbers, if every item is one, empty or null; otherwise nulls in all places."""
    numeric = F.forall(items, lambda c: c.isNull() | (c == "") | num(c).isNotNull())
    return F.transform(items, lambda c: F.when(numeric, num(c)))


def list_arithmetic(left: str, right: str, **signs: str) -> Column:
    """Two columns of lists of texts combined place by place: a list of structs with one field per named sign.

    Lists of a row pair by place; where one is shorter, null or no list of numbers, the answer is null. Exploded with
    ``posexplode_outer``, two empty or null lists keep one row without place or answer.
    """
    a, b = (list_numbers(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in (left, right))
    return F.zip_with(a, b, lambda x, y: F.struct(*[_combined(x, sign, y).alias(name) for name, sign in signs.items()]))


# ---- aggregation and grouping -------------------------------------------------


def sum_coerced(df: DataFrame, name: str) -> Column:
    """Sum of the numbers in a column; cells that are no number are skipped, none gives 0."""
    return F.coalesce(F.sum(as_number(df, name)), F.lit(0.0))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).filter(F.col(name).isNotNull()).distinct()


def group_agg(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates per key; rows without a key belong to no group."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)


def group_contains(value: Column, literal) -> Column:
    """Some value of the group equals the literal."""
    return F.bool_or(null_false(value == F.lit(literal)))


def group_any_differs(value: Column, literal) -> Column:
    """Some value of the group differs; a missing value counts as different."""
    return F.bool_or(F.coalesce(value != F.lit(literal), F.lit(True)))


def group_all(value: Column, op: str, literal) -> Column:
    """Every value of the group satisfies the comparison."""
    return F.bool_and(compare_values(value, op, F.lit(literal)))


def group_any_in(value: Column, literals: Sequence) -> Column:
    return F.bool_or(null_false(value.isin(list(literals))))


# ---- order and limit ----------------------------------------------------------


def complete(df: DataFrame, value: str, key: str) -> DataFrame:
    """Rows that take part in an ordering: neither value nor key is missing."""
    return df.filter(F.col(value).isNotNull() & F.col(key).isNotNull())


def sort_keys(df: DataFrame, key: str, desc: bool = False, order_id: str = "id") -> list[Column]:
    """Sort expressions with id as tie-break; descending over one constant key flips the input."""
    if not desc:
        return [F.col(key).asc(), F.col(order_id).asc()]
    constant = df.agg(F.coalesce(F.min(key) == F.max(key), F.lit(True))).scalar()
    tie = F.when(constant, -F.col(order_id)).otherwise(F.col(order_id))
    return [F.col(key).desc(), tie.asc()]


def ordered(df: DataFrame, value: str, key: str, desc: bool = False, order_id: str = "id") -> DataFrame:
    rows = complete(df, value, key)
    return rows.orderBy(*sort_keys(rows, key, desc, order_id))


def ranked(df: DataFrame, value: str, key: str, desc: bool = False, order_id: str = "id") -> DataFrame:
    """Like ``ordered``, with the place of every row written out as ``rank`` (from 1)."""
    rows = complete(df, value, key)
    placed = positions(rows, sort_keys(rows, key, desc, order_id), name="_pos")
    return placed.withColumn("rank", F.col("_pos") + 1).drop("_pos")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in order with their rank; each task keeps ``n`` rows."""
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return df.orderBy(*order).limit(n).withColumn("rank", rank)


# ---- set operations -----------------------------------------------------------


SPREAD_ROWS = 1_000_000  # rows of one value that meet in one task


def intersect_rows(left: DataFrame, right: DataFrame, name: str, spread_on: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """Left rows whose value occurs on the right; duplicates stay and null meets null.

    The right side is reduced to its distinct values first. Values with more than ``rows`` rows on the left are
    counted, and each is spread over as many tasks as its count asks for; there is at most one such value in ``rows`` rows.
    """
    counted = left.groupBy(F.col(name).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    hot = counted.select("_hot", F.ceil(F.col("_n") / rows).alias("_tasks"))
    tasks = F.coalesce("_tasks", F.lit(1))
    wanted = right.select(F.col(name).alias("_v")).distinct().join(hot, F.col("_v").eqNullSafe(F.col("_hot")), "left")
    wanted = wanted.select("_v", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1)).alias("_copy"))
    salted = left.join(hot, F.col(name).eqNullSafe(F.col("_hot")), "left")
    salted = salted.select(*left.columns, F.pmod(F.xxhash64(spread_on), tasks).alias("_salt"))
    same = F.col(name).eqNullSafe(F.col("_v")) & (F.col("_salt") == F.col("_copy"))
    return salted.join(wanted, same, "left_semi").drop("_salt")


def group_intersect(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows whose value occurs in the same group on the right; duplicates stay and null meets null.

    Rows meet by key and value, so a large group is spread by its values.
    """
    wanted = right.select(F.col(key).alias("_k"), F.col(value).alias("_v")).distinct()
    return left.join(wanted, F.col(key).eqNullSafe(F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")), "left_semi")


def group_union(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Each group's distinct values of both sides; a group of either side alone is kept."""
    return left.select(key, value).unionByName(right.select(key, value)).distinct()


def union_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


