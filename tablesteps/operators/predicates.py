"""A predicate index: condition lists matched to rows by keys instead of by trying every pair.

Records repeat condition lists, so distinct lists of a table are matched once. A list is looked
up by one of its columns, its access column: the column of its first ``=``, or else of its first ``>`` or
``<``. With ``=`` a row is found by the value of its cell. With ranges, cells are numbered by the bin they
fall in and a list is found in the bins between its bounds alone. Bin edges are literals of the lists
themselves, so cells outside all ranges meet nothing. What is found is then tested against the whole list in
the row.

A cell and a literal compare as numbers in a ``real`` column, else as lists of tokens, so an
access path has two key spaces. Joins are plain equi-joins on (table, path, key), which Spark broadcasts or splits by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import null_false
from ..session import durable

EDGES = 64  # bin edges of a column of a table, one bin more

EQUAL, ABOVE, BELOW = 0, 1, 2
NUMBER, TEXT = "N", "T"


def token_key(tokens: Column) -> Column:
    """A text that sorts as the token list does, element by element and a prefix first."""
    end, zero = F.lit("\x00\x01"), F.lit("\x00")
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.replace(t, zero, F.lit("\x00\x02")), end)), "")


def number_key(number: Column) -> Column:
    """A text that is equal for equal numbers, both zeros included."""
    return (number + F.lit(0.0)).cast("string")


def _keys(num: Column, tokens: Column) -> Column:
    """The keys of a literal: one per space in which it has a value."""
    key = F.array(
        F.struct(F.lit(NUMBER).alias("space"), num.alias("num"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(TEXT).alias("space"), F.lit(None).cast("double").alias("num"), token_key(tokens).alias("text")),
    )
    return F.filter(key, lambda k: k["num"].isNotNull() | k["text"].isNotNull())


def condition_lists(records: DataFrame, literal) -> DataFrame:
    """Distinct condition lists of each table: (list_id, table_id, conds, sels, col, kind).

    ``literal`` makes the struct of ``num`` and ``tokens`` of a condition's text. ``sels`` are the columns that
    records with the list select. ``col`` is the access column and ``kind`` its kind of access: ``=``, ``~`` for ranges, or
    ``all`` for a list without conditions. Records without a ``list_id`` match nothing and are left out.
    """
    lists = records.filter("list_id IS NOT NULL").groupBy("list_id", "table_id", F.array_sort(F.array_distinct("conds")).alias("conds")).agg(
        F.collect_set("sel").alias("sels")
    )
    typed = F.transform("conds", lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), literal(c["val"]).alias("v")))
    typed = F.transform(typed, lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), c["v"]["num"].alias("num"), c["v"]["tokens"].alias("tokens")))
    equal = F.filter("conds", lambda c: c["op"] == EQUAL)
    access = F.coalesce(F.get(equal, F.lit(0)), F.get("conds", F.lit(0)))
    lists = lists.withColumns({"conds": typed, "col": access["col"], "kind": F.when(access.isNull(), "all").when(access["op"] == EQUAL, "=").otherwise("~")})
    return durable(lists)


def list_id(table: Column, conds: Column) -> Column:
    """The same number for equal condition lists of a table, in whatever order.

    Null for a list that nothing can satisfy: it is null itself or has an unknown operator, a null column or a null text.
    """
    sound = F.forall(conds, lambda c: null_false(c["op"].isin(EQUAL, ABOVE, BELOW)) & c["col"].isNotNull() & c["val"].isNotNull())
    return F.when(sound, F.xxhash64(table, F.array_sort(F.array_distinct(conds))))


def _edges(lists: DataFrame) -> DataFrame:
    """Bin edges of every column that a range leads to: (table_id, col, space, nums, texts).

    Of many literals those with the smallest hashes are taken: an even choice, and never more than EDGES of a column.
    """
    ranges = lists.filter("kind = '~'").select("table_id", "col", F.explode("conds").alias("c")).filter("c.col = col")
    values = ranges.select("table_id", "col", F.explode(_keys(F.col("c.num"), F.col("c.tokens"))).alias("k"))
    values = values.select("table_id", "col", "k.*").distinct()
    place = F.row_number().over(Window.partitionBy("table_id", "col", "space").orderBy(F.xxhash64("num", "text"), "num", "text"))
    chosen = values.withColumn("_place", place).filter(F.col("_place") <= EDGES)
    return durable(chosen.groupBy("table_id", "col", "space").agg(
        F.array_sort(F.collect_list("num")).alias("nums"), F.array_sort(F.collect_list("text")).alias("texts")
    ))


def _bin(num: Column, text: Column, nums: Column, texts: Column) -> Column:
    """How many edges are at or below a value; never falls as the value rises."""
    return F.size(F.filter(nums, lambda e: e <= num)) + F.size(F.filter(texts, lambda e: e <= text))


def _path(p) -> Column:
    return F.concat_ws("", p["col"].cast("string"), p["kind"], p["space"])


def _with_edges(accesses: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the edges of (table_id, col, kind, space); ranges of a column without edges lead to nothing."""
    named = edges.select(F.col("table_id").alias("_table"), F.col("col").alias("_col"), F.col("space").alias("_space"), "nums", "texts")
    same = (F.col("kind") == "~") & (F.col("table_id") == F.col("_table")) & (F.col("col") == F.col("_col")) & (F.col("space") == F.col("_space"))
    return accesses.join(named, same, "left").filter("kind <> '~' OR nums IS NOT NULL").drop("_table", "_col", "_space")


def _list_keys(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """(list_id, table_id, path, key, conds, sels): every key under which a list is looked up."""
    mine = F.filter("conds", lambda c: c["col"] == F.col("col"))
    first_equal = F.get(F.filter(mine, lambda c: c["op"] == EQUAL), F.lit(0))
    # The literal of an equal access is the key; a range is usable in a space if all its literals have a value there.
    numbers = F.forall(mine, lambda c: (c["op"] == EQUAL) | c["num"].isNotNull())
    none = F.struct(F.lit(None).cast("string").alias("space"), F.lit(None).cast("double").alias("num"), F.lit("").alias("text"))
    either = F.array(*[F.struct(F.lit(s).alias("space"), F.lit(None).cast("double").alias("num"), F.lit("").alias("text")) for s in (NUMBER, TEXT)])
    spaces = (
        F.when(F.col("kind") == "all", F.array(none))
        .when(F.col("kind") == "=", _keys(first_equal["num"], first_equal["tokens"]))
        .otherwise(F.filter(either, lambda k: (k["space"] == TEXT) | numbers))
    )
    spread = lists.select("*", F.explode(spaces).alias("k")).select("*", "k.space")

    def bound(op: int, pick, other: Column) -> Column:
        """The narrowest bin that the conditions of one direction on the access column allow."""
        bins = F.transform(F.filter(mine, lambda c: c["op"] == op), lambda c: _bin(
            F.when(F.col("space") == NUMBER, c["num"]), F.when(F.col("space") == TEXT, token_key(c["tokens"])), F.col("nums"), F.col("texts")
        ))
        return F.coalesce(pick(bins), other)

    low, high = bound(ABOVE, F.array_max, F.lit(0)), bound(BELOW, F.array_min, F.size("nums") + F.size("texts"))
    bins = F.when(F.col("_low") <= F.col("_high"), F.transform(F.sequence("_low", "_high"), lambda b: b.cast("string")))
    keys = F.when(F.col("kind") == "~", bins).otherwise(F.array(F.coalesce(number_key(F.col("k.num")), "k.text")))
    found = _with_edges(spread, edges).withColumns({"_low": low, "_high": high})
    return found.select("list_id", "table_id", "conds", "sels", _path({c: F.col(c) for c in ("col", "kind", "space")}).alias("path"), F.explode(keys).alias("key"))


def _paths(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """The access paths of each table: (table_id, paths); a column has four at most."""
    spaces = F.when(F.col("kind") == "all", F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(NUMBER), F.lit(TEXT)))
    accesses = lists.select("table_id", "col", "kind").distinct().select("*", F.explode(spaces).alias("space"))
    found = _with_edges(accesses.withColumn("col", F.when(F.col("kind") != "all", F.col("col"))), edges)
    return found.groupBy("table_id").agg(F.collect_list(F.struct("col", "space", "kind", "nums", "texts")).alias("paths"))


def _row_keys(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(table_id, row_id, cells, path, key): a row under every access path of its table in which its cell has a value."""

    def key(p: Column) -> Column:
        cell = F.get("cells", p["col"])
        num = F.when((p["space"] == NUMBER) & (cell["kind"] == "real"), cell["num"])
        text = F.when((p["space"] == TEXT) & (cell["kind"] != "real"), token_key(cell["tokens"]))
        found = F.when(p["kind"] == "=", F.coalesce(number_key(num), text)).otherwise(
            F.when(num.isNotNull() | text.isNotNull(), _bin(num, text, p["nums"], p["texts"]).cast("string"))
        )
        return F.when(p["kind"] == "all", F.lit("")).otherwise(found)

    keyed = F.transform("paths", lambda p: F.struct(_path(p).alias("path"), key(p).alias("key")))
    found = rows.join(paths, "table_id").select("table_id", "row_id", "cells", F.explode(keyed).alias("_k"))
    return found.filter("_k.key IS NOT NULL").select("table_id", "row_id", "cells", "_k.*")


def matches(lists: DataFrame, rows: DataFrame, satisfies) -> DataFrame:
    """(list_id, row_id, cells, sels) for every row that satisfies all conditions of a list.

    ``rows`` have typed cells; ``satisfies(cell, condition)`` tests one condition in the row.
    """
    edges = _edges(lists)
    left = _row_keys(rows, _paths(lists, edges)).alias("l")
    right = _list_keys(lists, edges).alias("r")
    same = (F.col("l.table_id") == F.col("r.table_id")) & (F.col("l.path") == F.col("r.path")) & (F.col("l.key") == F.col("r.key"))
    met = left.join(right, same).filter(F.forall("conds", lambda c: satisfies(F.get("cells", c["col"]), c)))
    return met.select("list_id", "row_id", "cells", "sels")
