"""The predicate index against a loop over all records and rows."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesteps.operators import predicates as I
from tablesteps.operators import records as R

CONDS = "array<struct<col:int,op:int,val:string>>"
RECORD = f"query_id bigint, table_id string, sel int, agg int, conds {CONDS}"
ROW = "table_id string, row_id bigint, cells array<string>, types array<string>"
WORDS = ["ann", "Bob", "bob!", "bo", "b o", "", "Zoë", "ann lee", "12", "x-y", "é"]


def tokens(text):
    return re.findall(r"\w+|[^\w\s]+", text.lower())


def holds(cell, kind, op, val):
    if cell is None or val is None or op not in (0, 1, 2):
        return False
    if kind == "real":
        try:
            a, b = float(cell), float(val)
        except ValueError:
            return False
    else:
        a, b = tokens(cell), tokens(val)
    return a == b if op == 0 else a > b if op == 1 else a < b


def admitted(record, rows):
    _, table, _, _, conds = record
    if conds is None:
        return []
    return [
        r for r in rows
        if r[0] == table and all(c is not None and 0 <= c < len(r[2]) and holds(r[2][c], r[3][c], op, val) for c, op, val in conds)
    ]


def random_batch(seed, tables=3, n_rows=120, n_records=150):
    rng = random.Random(seed)

    def value():
        return rng.choice([None, str(rng.randrange(-5, 15)), f"{rng.randrange(9)}.5", "-0.0", "0", rng.choice(WORDS), rng.choice(WORDS)])

    rows = [
        (rng.choice("tuv"[:tables]), i, [value() for _ in range(3)], [rng.choice(["text", "real"]), "real", "text"]) for i in range(n_rows)
    ]
    rows += [("t", 1000 + i, ["ann", "7", "bob!"], ["text", "real", "text"]) for i in range(n_rows // 2)]  # a hot value
    records = []
    for i in range(n_records):
        conds = [(rng.choice([0, 1, 2, 2, 7]) if rng.random() < 0.1 else rng.randrange(3), rng.choice([0, 1, 2, 1, 2, 3]) if rng.random() < 0.1 else rng.randrange(3), value()) for _ in range(rng.randrange(4))]
        records.append((i, rng.choice("tuvw"), rng.randrange(3), rng.randrange(6), conds))
    records += [(5000, "t", 0, 0, None), (5001, "t", None, 3, []), (5002, "t", 9, 3, []), (5003, None, 0, 3, [])]
    return records, rows


@pytest.mark.parametrize("seed,edges", [(1, 64), (2, 2), (3, 1), (4, 64)])
def test_matching_rows(spark, monkeypatch, seed, edges):
    monkeypatch.setattr(I, "EDGES", edges)
    records, rows = random_batch(seed)
    got = R.matching_rows(spark.createDataFrame(records, RECORD), spark.createDataFrame(rows, ROW)).collect()
    want = [(r[0], row[1], row[2][r[2]] if r[2] is not None and r[2] < 3 else None) for r in records for row in admitted(r, rows)]
    assert sorted(((g.query_id, g.row_id, g.cell and g.cell.text) for g in got), key=str) == sorted(want, key=str)


def test_numbers_and_extremes(spark):
    records, rows = random_batch(9)
    made = [spark.createDataFrame(records, RECORD), spark.createDataFrame(rows, ROW)]
    counts = {r.query_id: r.rows for r in R.numbers(*made).collect()}
    assert counts == {r[0]: len(admitted(r, rows)) for r in records if r[3] not in (1, 2)}
    chosen = {r.query_id: r.extreme.row_id for r in R.extremes(*made).collect()}
    for r in records:
        held = admitted(r, rows)
        if r[3] in (1, 2):
            assert (r[0] in chosen) == bool(held)
        if r[3] in (1, 2) and r[2] == 2 and held:
            rank = [(row[2][2] is not None, (row[2][2] or "").encode(), row[1]) for row in held]
            assert chosen[r[0]] == (max(rank) if r[3] == 1 else min(rank))[2]


def test_lists_are_matched_once(spark):
    """Records that only differ in aggregate, column or order of conditions share one list."""
    conds = [(0, 0, "ann"), (1, 1, "3")]
    records = spark.createDataFrame([(i, "t", i % 3, i % 6, conds if i % 2 else conds[::-1]) for i in range(60)], RECORD)
    assert I.condition_lists(R._named(records), R._literal).count() == 1


def test_ranges_read_only_their_bins(spark):
    """Of 10,000 rows a narrow range meets those of its bin; a range beyond all cells meets none."""
    rows = spark.range(10_000).select(
        F.lit("t").alias("table_id"), F.col("id").alias("row_id"), F.array(F.col("id").cast("string"), F.concat(F.lit("row "), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("cells"),
        F.array(F.lit("real"), F.lit("text")).alias("types"),
    )
    conds = [[(0, 1, str(100 * i)), (0, 2, str(100 * i + 50))] for i in range(1, 40)] + [[(0, 1, "20000")], [(1, 1, "row 009990")]]
    records = spark.createDataFrame([(i, "t", 0, 3, c) for i, c in enumerate(conds)], RECORD)
    lists = I.condition_lists(R._named(records), R._literal)
    edges = I._edges(lists)
    keys, wanted = I._row_keys(R.typed_rows(rows), I._paths(lists, edges)), I._list_keys(lists, edges)
    met = keys.join(wanted, ["table_id", "path", "key"])
    # 39 ranges of 49 rows, each of which reads a few bins of 50 rows and more, where trying all pairs reads 410,000.
    assert met.count() < 20_000
    got = {r.query_id: r.rows for r in R.numbers(records, rows).collect()}
    assert got == {i: 49 for i in range(39)} | {39: 0, 40: 9}


def test_answers_scan_the_rows_once(spark, tmp_path):
    records, rows = random_batch(5)
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    plan = R.answers(spark.createDataFrame(records, RECORD), stored)._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in plan and "Relation [table_id" not in plan  # all that is left to do starts at the written cells


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab\x00\x01\x02é", min_size=1, max_size=3), max_size=3), min_size=2, max_size=8))
def test_token_keys_sort_like_lists(spark, lists):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>").select("i", I.token_key(F.col("t")).alias("k"))
    keys = {r.i: r.k.encode() for r in df.collect()}
    for i, a in enumerate(lists):
        for j, b in enumerate(lists):
            assert (keys[i] < keys[j]) == (a < b) and (keys[i] == keys[j]) == (a == b)


def test_lines_of_one_file_are_many_tasks(spark):
    rows = spark.range(0, 4000, 1, 1).select(
        F.lit(1).alias("table_id"), F.col("id").alias("row_id"), F.array(F.col("id").cast("string")).alias("cells"), F.array(F.lit("real")).alias("types")
    )
    records = spark.createDataFrame([(1, 1, 0, 0, [])], "query_id long, table_id int, sel int, agg int, conds array<struct<col:int,op:int,val:string>>")
    tasks = R.answers(records, rows).groupBy(F.col("row_id")).count().count(), R.selected_cells(R._named(records), rows).groupBy(F.spark_partition_id()).count().collect()
    assert tasks[0] == 4000 and max(r["count"] for r in tasks[1]) < 1000
