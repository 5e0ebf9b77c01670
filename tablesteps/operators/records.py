"""Batched structured queries: many (column, aggregate, conditions) records over many tables.

Inputs
  records  query_id BIGINT, table_id, sel INT, agg INT,
           conds ARRAY<STRUCT<col INT, op INT, val STRING>>
  rows     table_id, row_id BIGINT, cells ARRAY<STRING>, types ARRAY<STRING>

Records are grouped by their condition lists; a predicate index leads a list to the rows whose
cell has the value, or lies in a bin between the bounds, that one of its conditions asks for, and the other
conditions are tested in the row. Aggregates are taken once per condition list and column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import float_text, locale_float, null_false
from ..session import durable
from .positions import part_of, positions
from .predicates import condition_lists, list_id, matches

# Aggregate and operator codes and their words.
AGGREGATES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
OPERATORS = ["=", ">", "<", "OP"]
MAX, MIN, COUNT, SUM, AVG = 1, 2, 3, 4, 5
EMPTY_ANSWER = "none"


def conditions(column_index: Column, operator_index: Column, condition: Column) -> Column:
    """Three parallel arrays as one array of triples; the shortest array decides the length."""
    zipped = F.arrays_zip(column_index, operator_index, condition)
    shortest = F.least(F.size(column_index), F.size(operator_index), F.size(condition))
    return F.transform(
        F.slice(zipped, F.lit(1), shortest),
        lambda c: F.struct(
            c["0"].cast("int").alias("col"), c["1"].cast("int").alias("op"), c["2"].cast("string").alias("val")
        ),
    )


def match_tokens(text: Column) -> Column:
    """Lower-case word and punctuation runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+|(?U)[^\w\s]+)"), F.lit(1))


def typed_value(text: Column, kind: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        text.alias("text"),
        F.when(kind == "real", locale_float(text)).alias("num"),
        F.when(kind != "real", match_tokens(text)).alias("tokens"),
    )


def typed_rows(rows: DataFrame) -> DataFrame:
    """Cells as structs of kind, text, number and match tokens."""
    cells = F.transform(
        F.arrays_zip(F.col("cells").alias("c"), F.col("types").alias("t")),
        lambda z: typed_value(z["c"], z["t"]),
    )
    return rows.withColumn("cells", cells)


def _satisfies(cell: Column, cond: Column) -> Column:
    """One condition on one typed cell; values of unlike type never match."""

    def by_operator(left: Column, right: Column) -> Column:
        return F.when(cond["op"] == 0, left == right).when(cond["op"] == 1, left > right).when(
            cond["op"] == 2, left < right
        )

    return null_false(
        F.when(cell["kind"] == "real", by_operator(cell["num"], cond["num"])).otherwise(
            by_operator(cell["tokens"], cond["tokens"])
        )
    )


def _literal(text: Column) -> Column:
    return F.struct(locale_float(text).alias("num"), match_tokens(text).alias("tokens"))


def _named(records: DataFrame) -> DataFrame:
    sel = F.coalesce("sel", F.lit(-1))  # no column: the cell is null
    return records.withColumns({"list_id": list_id(F.col("table_id"), F.col("conds")), "sel": sel})


def selected_cells(named: DataFrame, rows: DataFrame) -> DataFrame:
    """(list_id, sel, row_id, cell): the selected cells of the rows that a condition list of some record admits.

    Records that share table, conditions and column share these lines. The rows are spread first: one has a line per list it meets,
    and a task sorts the lines of its rows to sum them up, so a file small enough for one task of a scan would fill one task's memory.
    """
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "table_id", "row_id")
    met = matches(condition_lists(named, _literal), typed_rows(rows), _satisfies)
    return met.select(
        "list_id", "row_id", F.explode(F.transform("sels", lambda s: F.struct(s.alias("sel"), F.get("cells", s).alias("cell")))).alias("c")
    ).select("list_id", "c.sel", "row_id", "c.cell")


def _for_records(named: DataFrame, lines: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Lines of (list_id, sel) with the records they belong to."""
    wanted = named.select("query_id", "agg", F.col("list_id").alias("_list"), F.col("sel").alias("_sel"), *columns)
    return wanted.join(lines, (F.col("_list") == F.col("list_id")) & (F.col("_sel") == F.col("sel")), how)


def matching_rows(records: DataFrame, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, agg, row_id, cell) for every row that satisfies all conditions of a record.

    Columns of the records named in ``carry`` come along.
    """
    named = _named(records)
    return _for_records(named, selected_cells(named, rows), *carry).select("query_id", "agg", *carry, "row_id", "cell")


def type_errors(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Per record, conditions whose literal is no number although the column is ``real``."""
    kinds = rows.select("table_id", "types").distinct().groupBy("table_id").agg(F.min("types").alias("types"))
    bad = F.filter(
        "conds", lambda c: (F.get("types", c["col"]) == "real") & locale_float(c["val"]).isNull()
    )
    return records.join(kinds, "table_id").select("query_id", F.size(bad).cast("bigint").alias("type_errors"))


def _totals(cells: DataFrame) -> DataFrame:
    """Per condition list and column all that any aggregate needs: rows, sum, whether all are numbers, largest and smallest.

    Of equal values the largest is the last row and the smallest the first one.
    """
    real = F.col("cell.kind") == "real"
    rank = F.struct("cell.num", F.when(~real, F.col("cell.text")).alias("text"), "row_id")
    row = F.struct("row_id", "cell")
    return cells.groupBy("list_id", "sel").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(real).alias("_real"), F.sum("cell.num").alias("_sum"),
        F.max_by(row, rank).alias("_last"), F.min_by(row, rank).alias("_first"),
    )


def _extreme() -> Column:
    return F.when(F.col("agg") == MAX, F.col("_last")).otherwise(F.col("_first"))


def _number(digits: int | None) -> Column:
    """The number a count, sum or mean answers with; sums and means over text columns have none."""
    total = F.col("_sum") if digits is None else F.round("_sum", digits)
    return (
        F.when(F.col("agg") == COUNT, F.coalesce("rows", F.lit(0)).cast("double"))
        .when((F.col("agg") == SUM) & F.col("_real"), total)
        .when((F.col("agg") == AVG) & F.col("_real"), total / F.col("rows"))
    )


def extremes(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Per max or min record with rows: their number and the one row it selects.

    Of equal values a max takes the last row and a min the first one.
    """
    wanted = _named(records.filter(F.col("agg").isin(MAX, MIN)))
    return _for_records(wanted, _totals(selected_cells(wanted, rows))).select("query_id", "rows", _extreme().alias("extreme"))


def numbers(records: DataFrame, rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Per other record: rows matched, and the number a count, sum or mean answers with.

    Sums are as they are unless ``digits`` asks for a rounding, which hides the order in which parts were added.
    """
    wanted = _named(records.filter(~F.col("agg").isin(MAX, MIN)))
    per_record = _for_records(wanted, _totals(selected_cells(wanted, rows)), how="left")
    return per_record.select("query_id", "agg", F.coalesce("rows", F.lit(0)).alias("rows"), _number(digits).alias("value"))


def _with_number_text(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add ``out``: the text as a number prints, or as it is when it is no number."""
    numbered = df.withColumn("_number", locale_float(text))
    return numbered.withColumn(out, F.coalesce(float_text(F.col("_number")), text)).drop("_number")


def answers(records: DataFrame, rows: DataFrame, digits: int | None = None) -> DataFrame:
    """Answers in long form: (query_id, row_id, answer).

    A number answers with one line and no ``row_id``; cell answers keep one line
    per row, so an answer over a large table stays distributed. A cell that is the
    only one prints as a number when it is one. The rows are read and matched once: the selected cells
    are written, summed up per condition list, and only read again for records that no single line settles.
    """
    named = _named(records)
    cells = durable(selected_cells(named, rows))
    per_record = _for_records(named, _totals(cells), how="left").select(
        "query_id", "agg", F.col("_list").alias("list_id"), F.col("_sel").alias("sel"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("agg").isin(MAX, MIN), _extreme()).alias("extreme"), _number(digits).alias("value"),
    )
    empty = F.when((F.col("rows") == 0) & (F.col("agg") != COUNT), F.lit(EMPTY_ANSWER))
    per_record = _with_number_text(per_record, F.col("extreme.cell.text"), "_picked").withColumn(
        "answer", F.coalesce(empty, float_text(F.col("value")), F.when(F.col("agg").isin(MAX, MIN), F.coalesce("_picked", F.lit(EMPTY_ANSWER))))
    )
    settled = per_record.filter(F.col("answer").isNotNull()).select("query_id", F.col("extreme.row_id").alias("row_id"), "answer")
    still_open = per_record.filter(F.col("answer").isNull()).select("query_id", "agg", "list_id", "sel", F.col("rows").alias("_rows"))
    shown = _with_number_text(_for_records(still_open, cells, "_rows"), F.col("cell.text"), "_shown")
    shown = shown.select("query_id", "row_id", F.when(F.col("_rows") == 1, F.col("_shown")).otherwise(F.col("cell.text")).alias("answer"))
    return settled.unionByName(shown)


def answer_texts(long_answers: DataFrame, size: int = 4096) -> DataFrame:
    """Answers joined by ``, `` in parts of at most ``size`` lines: (query_id, part, answer).

    An answer of up to ``size`` lines is one row.
    """
    placed = positions(long_answers, [F.col("row_id")], keys=["query_id"], name="_place")
    pairs = F.array_sort(F.collect_list(F.struct("_place", "answer")))
    return (
        placed.groupBy("query_id", part_of("_place", size).alias("part"))
        .agg(F.array_join(F.transform(pairs, lambda p: p["answer"]), ", ").alias("answer"))
    )


def record_text(agg: Column, sel: Column, conds: Column) -> Column:
    """``SELECT MAX col2 FROM table WHERE col0 = "x"``; no aggregate leaves two blanks."""
    words = F.array(*[F.lit(a) for a in AGGREGATES])
    signs = F.array(*[F.lit(o) for o in OPERATORS])
    clauses = F.transform(
        conds,
        lambda c: F.concat(
            F.lit("col"), c["col"].cast("string"), F.lit(" "), F.get(signs, c["op"]), F.lit(' "'), c["val"], F.lit('"')
        ),
    )
    head = F.concat(F.lit("SELECT "), F.get(words, agg), F.lit(" col"), sel.cast("string"), F.lit(" FROM table"))
    where = F.concat(F.lit(" WHERE "), F.array_join(clauses, " AND "))
    return F.when(F.size(conds) > 0, F.concat(head, where)).otherwise(head)


def same_record(left: Column, right: Column, in_order: bool = False) -> Column:
    """Equal column, aggregate and conditions; values ignore case, order only matters on request."""

    def clauses(record: Column) -> Column:
        lowered = F.transform(
            record["conds"],
            lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), F.lower(c["val"]).alias("val")),
        )
        return lowered if in_order else F.array_sort(F.array_distinct(lowered))

    return (
        (left["sel"] == right["sel"]) & (left["agg"] == right["agg"]) & (clauses(left) == clauses(right))
    )
