"""Column decisions over many tables in one job: delimiters, numeric columns and whole numbers per table."""

from pyspark.sql import functions as F

from ..operators import decisions as C
from .registry import num_sql, query

# One table per nation, its customers as rows, three columns: lists with a delimiter that differs from table to table,
# numbers that some tables spoil by a text, and whole numbers that some tables spoil by a fraction or a null.
_CELLS_SQL = """cells AS (
  SELECT c_nationkey AS table_id, c_custkey AS row_id, unnest([0, 1, 2]) AS col, unnest([
    concat(c_mktsegment, mark, ' a/b', mark, ' ', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN mark ELSE '' END),
    CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 50 < 5 THEN c_mktsegment WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_acctbal AS VARCHAR) END,
    CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 40 < 8 THEN NULL WHEN c_nationkey % 4 = 1 AND c_custkey % 40 < 8 THEN concat(c_custkey, '.5') ELSE concat(c_custkey, '.0') END]) AS cell
  FROM (SELECT *, [',', '-', chr(10)][c_nationkey % 3 + 1] AS mark FROM customer))"""

_DECISIONS_SQL = f"""
WITH {_CELLS_SQL},
numbered AS (SELECT *, {num_sql('cell')} AS number FROM cells),
decisions AS (
  SELECT table_id, col, CASE WHEN a >= b AND a >= n THEN ',' WHEN b >= n THEN '-' ELSE chr(10) END AS delimiter, "numeric", whole
  FROM (SELECT table_id, col, coalesce(sum(len(string_split(cell, ','))), 0) AS a, coalesce(sum(len(string_split(cell, '-'))), 0) AS b,
               coalesce(sum(len(string_split(cell, chr(10)))), 0) AS n, bool_and(cell IS NULL OR cell = '' OR number IS NOT NULL) AS "numeric",
               bool_and(coalesce(number = floor(number), false)) AS whole
        FROM numbered GROUP BY table_id, col))"""


def _cells(t):
    nation, customer = F.col("c_nationkey"), F.col("c_custkey")
    mark = F.when(nation % 3 == 0, ",").when(nation % 3 == 1, "-").otherwise("\n")
    few = customer % 40 < 8
    values = F.array(
        F.concat("c_mktsegment", mark, F.lit(" a/b"), mark, F.lit(" "), customer, F.when(customer % 3 == 0, mark).otherwise("")),
        F.when((nation % 2 == 0) & (customer % 50 < 5), F.col("c_mktsegment")).when(customer % 7 == 0, "").otherwise(F.col("c_acctbal").cast("string")),
        F.when((nation % 4 == 0) & few, None).when((nation % 4 == 1) & few, F.concat(customer, F.lit(".5"))).otherwise(F.concat(customer, F.lit(".0"))),
    )
    rows = t.columns("customer", "c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal")
    return rows.select(nation.alias("table_id"), customer.alias("row_id"), F.posexplode(values).alias("col", "cell"))


@query("table_column_decisions", _DECISIONS_SQL + " SELECT * FROM decisions")
def table_column_decisions(t):
    return C.column_decisions(_cells(t))


@query("table_lists", _DECISIONS_SQL + """
SELECT table_id, row_id, array_to_string(list_filter(flatten(list_transform(list_transform(string_split(cell, delimiter), lambda p: trim(p)), lambda q: string_split(q, '/'))), lambda s: s <> ''), ' | ') AS parts
FROM cells JOIN decisions USING (table_id, col) WHERE col = 0""")
def table_lists(t):
    return C.decided_cells(_cells(t)).filter("col = 0").select("table_id", "row_id", F.array_join("parts", " | ").alias("parts"))


@query("table_numbers", _DECISIONS_SQL + """
SELECT table_id, row_id, CASE WHEN "numeric" THEN number END AS number, CASE WHEN NOT "numeric" THEN cell END AS text
FROM numbered JOIN decisions USING (table_id, col) WHERE col = 1""")
def table_numbers(t):
    return C.decided_cells(_cells(t)).filter("col = 1").select("table_id", "row_id", "number", "text")


@query("table_whole_numbers", _DECISIONS_SQL + """
SELECT table_id, row_id, CASE WHEN number IS NULL THEN cell WHEN whole THEN CAST(CAST(number AS BIGINT) AS VARCHAR) ELSE CAST(number AS VARCHAR) END AS shown
FROM numbered JOIN decisions USING (table_id, col) WHERE col = 2""")
def table_whole_numbers(t):
    return C.decided_cells(_cells(t)).filter("col = 2").select("table_id", "row_id", "shown")
