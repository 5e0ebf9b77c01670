"""Column decisions per table against the ones over a single relation."""

from pyspark.sql import functions as F

from tablesteps.functions import derive as D
from tablesteps.functions import values as V
from tablesteps.operators import decisions as C

CELLS = "table_id string, row_id bigint, col int, cell string"
TABLES = {
    ("a", 0): ["x, y", "z", None], ("a", 1): ["1", "", None, "2.5"], ("b", 0): ["x-y-z", "p,q"], ("b", 1): ["1", "two"],
    ("c", 0): ["k\nl\nm", "n, o"], ("c", 1): ["1.0", "2"], (None, 0): [None, None], (None, 1): ["3.0", "4.5"], ("d", 0): ["a,b-c"],
}


def rows():
    return [(t, i, c, cell) for (t, c), cells in TABLES.items() for i, cell in enumerate(cells)]


def test_every_table_decides_for_itself(spark):
    got = C.decided_cells(spark.createDataFrame(rows(), CELLS)).collect()
    assert len(got) == len(rows())
    for (table, col), cells in TABLES.items():
        alone = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
        listed = D.derive(alone, ["c_list"])
        number, text = V.numeric_or_text(alone, "c")
        want = {r.i: (r.c_list, r.number, r.text) for r in listed.select("i", "c_list", number.alias("number"), text.alias("text")).collect()}
        mine = {r.row_id: (r.parts, r.number, r.text) for r in got if r.table_id == table and r.col == col}
        assert mine == want


def test_whole_numbers_print_without_fraction(spark):
    shown = {(r.table_id, r.col, r.row_id): r.shown for r in C.decided_cells(spark.createDataFrame(rows(), CELLS)).collect()}
    assert [shown["c", 1, i] for i in range(2)] == ["1", "2"]
    assert [shown[None, 1, i] for i in range(2)] == ["3.0", "4.5"]
    assert [shown["a", 1, i] for i in range(4)] == ["1.0", "", None, "2.5"]


def test_hot_table_is_summed_up_before_the_shuffle(spark):
    cells = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("table_id"), F.col("id").alias("row_id"), F.lit(0).alias("col"), F.lit("1,2").alias("cell"))
    plan = C.column_decisions(cells)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert C.column_decisions(cells).filter("table_id = 'hot'").first().delimiter == ","


def test_empty_cells(spark):
    assert C.decided_cells(spark.createDataFrame([], CELLS)).count() == 0
