"""Null and type rules, order, positions, lists and records on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tablesteps.functions import values as V
from tablesteps.operators import positions as P
from tablesteps.operators import records as R
from tablesteps.operators import steps as S


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(0, "10", 1.0, "x"), (1, "9", None, "x"), (2, None, 3.0, "y"), (3, "abc", 4.5, None)]
    return spark.createDataFrame(rows, "id bigint, t string, n double, g string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("name, op, value, want", [
    ("t", "<", 10, [1]), ("t", "<", "9z", [0, 1]), ("t", "!=", "10", [1, 3]), ("n", ">=", 3, [2, 3]), ("t", "=", 9, [1]),
])
def test_compare_is_false_on_null(cells, name, op, value, want):
    assert ids(cells.filter(S.compare(cells, name, op, value))) == want
    both = S.any_of(S.compare(cells, name, op, value), ~S.compare(cells, name, op, value))
    assert ids(cells.filter(both)) == [0, 1, 2, 3]


def test_none_means_null_unless_spelled(spark, cells):
    assert ids(cells.filter(S.equals_or_none(cells, "t", "none"))) == [2]
    spelled = cells.unionByName(spark.createDataFrame([(4, "none", 1.0, "x")], cells.schema))
    assert ids(spelled.filter(S.equals_or_none(spelled, "t", "none"))) == [4]


def test_literal_lists():
    assert S.split_literals("'a, b', c, \"d\"") == ["a, b", "c", "d"]


def test_scalar_subqueries(cells):
    nothing = S.first_value(cells.filter("id > 99"), "n")
    assert ids(S.where_scalar(cells, "n", ">", nothing)) == []
    first = S.first_value(cells.filter("n is not null"), "n")
    assert ids(S.where_scalar(cells, "n", ">", first, offset=2)) == [3]


def test_sum_of_texts(cells):
    assert cells.agg(S.sum_coerced(cells, "t").alias("s")).first()["s"] == 19.0
    empty = cells.filter("id = 2")
    assert empty.agg(S.sum_coerced(empty, "t").alias("s")).first()["s"] == 0.0


def test_order_drops_nulls_and_flips_constants(cells):
    assert [r["id"] for r in S.ordered(cells, "t", "n").collect()] == [0, 3]
    same = cells.withColumn("k", F.lit(1))
    assert [r["id"] for r in S.ordered(same, "id", "k", desc=True).collect()] == [3, 2, 1, 0]
    assert [r["id"] for r in S.ordered(same, "id", "k").collect()] == [0, 1, 2, 3]


def test_grouped_predicates(cells):
    got = S.group_agg(
        cells, "g", S.group_contains(F.col("t"), "9").alias("has"), S.group_any_differs(F.col("t"), "10").alias("differs"),
        S.group_all(F.col("n"), ">", 0).alias("all"),
    )
    assert {r["g"]: tuple(r)[1:] for r in got.collect()} == {"x": (True, True, False), "y": (False, True, True)}


def test_intersect_keeps_duplicates_and_nulls(spark):
    left = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b")], "id int, v string")
    right = spark.createDataFrame([("a",), (None,), ("a",)], "v string")
    assert ids(S.intersect_rows(left, right, "v", spread_on="id")) == [0, 1, 2]


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_positions_with_one_hot_key(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(5000).select(
            F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 100).alias("k"), F.xxhash64("id").alias("h"), "id"
        )
        got = P.positions(rows, [F.col("h"), F.col("id")], keys=["k"]).toPandas()
        want = got.sort_values(["k", "h", "id"]).groupby("k").cumcount()
        assert len(got) == 5000 and (got["pos"] == want).all()
        whole = P.positions(rows, [F.col("id").desc()]).toPandas()
        assert (whole["pos"] == 4999 - whole["id"]).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_totals_over_slices(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("pos"), (F.col("id") % 5).alias("n"))
    got = P.running_total(rows.repartition(7), [F.col("pos")], ["k"], F.col("n"), "sum").toPandas().sort_values(["k", "pos"])
    assert len(got) == 3000 and (got.groupby("k")["n"].cumsum() == got["sum"]).all()


def test_lists_of_far_apart_ids_are_one_part(spark):
    rows = spark.range(20).select((F.col("id") % 2).alias("k"), (F.col("id") * 1_000_000).alias("id"), F.col("id").alias("v"))
    parts = P.chunked_lists(rows, ["k"], "id", "v").orderBy("k").collect()
    assert [(p["k"], p["part"], p["values"]) for p in parts] == [(k, 0, list(range(k, 20, 2))) for k in (0, 1)]


def test_small_sums_are_not_rounded(spark):
    rows = spark.createDataFrame([("t", i, [v], ["real"]) for i, v in enumerate(["0.0000001", "0.0000002"])], "table_id string, row_id bigint, cells array<string>, types array<string>")
    records = spark.createDataFrame([(1, "t", 0, R.SUM, []), (2, "t", 0, R.AVG, [])], "query_id bigint, table_id string, sel int, agg int, conds array<struct<col:int,op:int,val:string>>")
    got = {r["query_id"]: r["value"] for r in R.numbers(records, rows).collect()}
    assert got[1] == pytest.approx(3e-7) and got[2] == pytest.approx(1.5e-7)


def test_chunked_lists_stay_bounded_and_whole(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), "id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    parts = P.chunked_lists(rows, ["k"], "id", "v", size=64).orderBy("part").collect()
    assert max(len(p["values"]) for p in parts) <= 64
    assert [v for p in parts for v in p["values"]] == [i if i % 7 else None for i in range(1000)]


def test_column_conversions(spark, cells):
    number, text = V.numeric_or_text(cells, "t")
    assert [r[0] for r in cells.select(text).collect()] == ["10", "9", None, "abc"]
    clean = cells.filter("id < 3")
    number, text = V.numeric_or_text(clean, "t")
    assert [tuple(r) for r in clean.select(number, text).collect()] == [(10.0, None), (9.0, None), (None, None)]
    whole = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert [r[0] for r in whole.select(V.integral_text(whole, "x")).collect()] == ["1", "2"]
    mixed = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert [r[0] for r in mixed.select(V.integral_text(mixed, "x")).collect()] == ["1.0", None]


RECORD_ROWS = [("t", 0, ["Ann", "5"]), ("t", 1, ["Bob", "7"]), ("t", 2, ["ann!", "7"]), ("u", 0, ["12", "1"])]
RECORDS = [
    # query_id, table, sel, agg, conditions, answer
    (1, "t", 0, 0, [(0, 0, "ANN")], ["Ann"]),
    (2, "t", 0, 1, [], ["ann!"]),
    (3, "t", 1, 1, [], ["7.0"]),
    (4, "t", 1, 2, [], ["5.0"]),
    (5, "t", 0, 3, [(1, 1, "5")], ["2.0"]),
    (6, "t", 1, 4, [], ["19.0"]),
    (7, "t", 1, 5, [(1, 1, "5")], ["7.0"]),
    (8, "t", 0, 4, [], ["Ann", "Bob", "ann!"]),
    (9, "t", 0, 0, [(0, 0, "Zoe")], ["none"]),
    (10, "t", 0, 3, [(0, 0, "Zoe")], ["0.0"]),
    (11, "t", 0, 2, [(0, 0, "Zoe")], ["none"]),
    (12, "t", 0, 0, [(1, 1, "x")], ["none"]),
    (13, "u", 0, 0, [], ["12.0"]),
    (14, "u", 0, 4, [], ["12.0"]),
    (15, "t", 1, 0, [], ["5", "7", "7"]),
]


@pytest.fixture(scope="module")
def batch(spark):
    rows = spark.createDataFrame(RECORD_ROWS, "table_id string, row_id bigint, cells array<string>")
    rows = rows.withColumn("types", F.array(F.lit("text"), F.lit("real")))
    records = spark.createDataFrame(
        [r[:5] for r in RECORDS], "query_id bigint, table_id string, sel int, agg int, conds array<struct<col:int,op:int,val:string>>"
    )
    return records, rows


def test_record_answers(batch):
    records, rows = batch
    got = {}
    for r in R.answers(records, rows).orderBy("query_id", "row_id").collect():
        got.setdefault(r["query_id"], []).append(r["answer"])
    assert got == {r[0]: r[5] for r in RECORDS}
    texts = {r["query_id"]: r["answer"] for r in R.answer_texts(R.answers(records, rows)).collect()}
    assert texts == {r[0]: ", ".join(r[5]) for r in RECORDS}


def test_ties_and_type_errors(batch):
    records, rows = batch
    chosen = {r["query_id"]: r["extreme"]["row_id"] for r in R.extremes(records, rows).collect()}
    assert chosen[3] == 2 and chosen[4] == 0
    errors = {r["query_id"]: r["type_errors"] for r in R.type_errors(records, rows).collect()}
    assert errors[12] == 1 and errors[5] == 0


def test_record_text(spark, batch):
    texts = batch[0].select("query_id", R.record_text(F.col("agg"), F.col("sel"), F.col("conds")).alias("t"))
    got = {r["query_id"]: r["t"] for r in texts.collect()}
    assert got[1] == 'SELECT  col0 FROM table WHERE col0 = "ANN"' and got[2] == "SELECT MAX col0 FROM table"


def test_list_arithmetic(spark):
    rows = [
        (1, ["1", "2.5", None], ["2", "0", "3"]), (2, ["1", "x"], ["1", "1"]), (3, ["4", ""], ["2"]), (4, [], []), (5, None, ["1"]), (6, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    values = S.list_arithmetic("a", "b", d="-", q="/")
    got = df.select("id", F.posexplode_outer(values).alias("place", "v")).select("id", "place", "v.d", "v.q").orderBy("id", "place").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, -1.0, 0.5), (1, 1, 2.5, None), (1, 2, None, None), (2, 0, None, None), (2, 1, None, None),
        (3, 0, 2.0, 2.0), (3, 1, None, None), (4, None, None, None), (5, 0, None, None), (6, None, None, None),
    ]
