"""Golden cases and brute-force checks of normalisation and scores."""

import difflib
import random
import time
from difflib import SequenceMatcher

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesteps.catalog import QUERIES
from tablesteps.functions import scoring as S
from tablesteps.functions.matching import matched_characters, similarity
from tablesteps.operators import evaluation as E
from tablesteps.sources import results as R


GOLDEN = {
    "Paris[1]": "paris", "A (x) (y)": "a", '"Foo."': "foo", "Café  Noir": "cafe noir", "1990–91": "1990-91",
    "[note]": "[note]", "[1]": "", "Total*": "total", "a\n": "a", "[b [c]": "[b", "x (1)[2]* ": "x", "Ｆull ①": "full 1",
}


@pytest.mark.parametrize("text, want", GOLDEN.items())
def test_golden_normal_forms(text, want):
    assert S.normalize_text(text) == want


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aB1é ()[]\"'.*#–\n", max_size=14))
def test_properties_of_normal_forms(text):
    got = S.normalize_text(text)
    assert got == got.lower().strip() and "  " not in got and "\n" not in got and "–" not in got and "é" not in got
    assert S.normalize_text(f"  {text}\n") == got
    if text.strip() and got.isalnum():
        for note in ("[1]", "[see b]", "*", "†", " (c)"):
            assert S.normalize_text(got + note) == S.normalize_text(got + note + note) == got


def test_both_paths_on_columns(spark):
    texts = [*GOLDEN, " Plain  text. ", "a.b,c", "x+", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", S.normalize(F.col("t")).alias("n"), S.normalize_list(F.array("t", F.lit("Q  r"))).alias("l")).collect()
    for row in rows:
        want = GOLDEN.get(row["t"], {" Plain  text. ": "plain text", "a.b,c": "a.b,c", "x+": "x"}.get(row["t"]))
        assert row["n"] == want and row["l"] == [want, "q r"]


def test_plain_texts_need_no_python(spark, tables):
    got = {r["doc_id"]: r["answer"] for r in QUERIES["normalize_answer"](spark, SMALL).collect()}
    want = {r["doc_id"]: S.normalize_text(r["text"]) for r in tables.documents.select("doc_id", "text").collect()}
    assert got == want


def test_fuzzy_against_difflib(spark, tables):
    from tablesteps.catalog.scores import _pairs

    got = {r["id"]: r["fuzzy"] for r in QUERIES["score_fuzzy"](spark, SMALL).collect()}
    for row in _pairs(tables).collect():
        a, b = ", ".join(row["target"]).lower(), ", ".join(row["prediction"]).lower()
        assert got[row["id"]] == round(100 * difflib.SequenceMatcher(None, a, b).ratio())


@pytest.mark.parametrize("text, kind, number, ymd", [
    ("3", "N", 3.0, None), ("3.0", "N", 3.0, None), ("1,000", "S", None, None), ("2010-xx-xx", "N", 2010.0, None),
    ("xx-05-xx", "D", None, (-1, 5, -1)), ("2010-05-03", "D", None, (2010, 5, 3)), ("2010-13-01", "S", None, None),
    ("nan", "S", None, None), ("XXXX-05-03", "D", None, (-1, 5, 3)), ("xx-xx-xx", "S", None, None), ("a-b-c", "S", None, None),
])
def test_typed_value(spark, text, kind, number, ymd):
    df = spark.createDataFrame([(text,)], "t string")
    v = df.select(S.typed_value(F.col("t"), F.lower("t")).alias("v")).first()["v"]
    assert (v["kind"], v["num"]) == (kind, number)
    assert (ymd is None and v["y"] is None) or (v["y"], v["m"], v["d"]) == ymd


SCORES = [
    (["1", "1.0"], ["1"], True, True), (["a", "b"], ["b", "a"], True, True), (["a"], ["a", "b"], False, False),
    (["A (x)"], ["a"], True, True), (["5 kg"], ["5"], False, True), (["5 miles"], ["5"], False, False),
    (["5 years"], ["5"], False, False), (["10 weeks"], ["10"], False, True), (["2nd"], ["2"], False, True),
    (["$5,000"], ["5000"], False, True), (["yes"], ["1"], False, True), (["none"], ["f"], False, True), (["no"], ["0"], False, False),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(SCORES)], "i int, target array<string>, prediction array<string>")
    rows = E.scored(df).orderBy("i").collect()
    assert [(r["strict"], r["flexible"]) for r in rows] == [(s, f) for _, _, s, f in SCORES]
    assert all(r["flexible"] for r in rows if r["strict"])


def test_sane_units_can_be_passed(spark):
    df = spark.createDataFrame([(["5 miles"], ["5"])], "target array<string>, prediction array<string>")
    assert E.scored(df, units=["miles", "m"]).first()["flexible"]


@pytest.mark.parametrize("a, b, want", [("1, 2", "2.0, 1", True), ("a, a", "a", False), ("A", "a", True), ("a, b", "b, a", True)])
def test_multiset_is_symmetric(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(S.multiset(F.col("a"), F.col("b")).alias("x"), S.multiset(F.col("b"), F.col("a")).alias("y")).first()
    assert row["x"] == row["y"] == want


@pytest.mark.parametrize("text, want", [
    ("SUM > 1, 2", ["3"]), ("AVERAGE > 1, 2", ["1.5"]), ("COUNT > a, b", ["2"]), ("NONE > a", ["a"]), ("SUM > 5", ["5"]),
    ("SUM > a, 1", ["a", "1"]), ("x, y", ["x", "y"]), ("SUM > 1.5, 2", ["3.5"]),
])
def test_aggregate_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.eval_agg_text(F.col("t")).alias("r")).first()["r"] == want


@pytest.mark.parametrize("text, kind, cells", [
    ("1| 2", "int", ["1", "2"]), ("1.5| 2", "float", ["1.5", "2"]), ("007| 1", "text", ["007", "1"]), ("t| f", "bool", ["t", "f"]),
    ("1| none", "text", ["1", None]), ("a,, b| c", "lists", ["a,, b", "c"]), ("1,, 2| 3", "numbers", ["1,, 2", "3"]), ("", "empty", []),
])
def test_cells(spark, text, kind, cells):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(S.cell_list_kind(F.col("t")).alias("k"), S.cell_list(F.col("t")).alias("c")).first()
    assert (row["k"], row["c"]) == (kind, cells)


def test_checkpoint_curve_drops_test_rows(spark):
    df = spark.createDataFrame([("a/checkpoint-2000", 0.5), ("a/checkpoint-1000", 0.5), ("test_checkpoint-1000", 0.9)], "checkpoint string, flexible double")
    assert [r["step"] for r in E.checkpoint_curve(df).collect()] == [1000, 2000]
    assert E.best_checkpoint(df.limit(2)).first()["checkpoint"] == "a/checkpoint-1000"


def ratio(a, b):
    return round(100 * SequenceMatcher(None, a, b).ratio())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc d", max_size=80), st.text(alphabet="abc d", max_size=80))
def test_matching_blocks_of_random_texts(a, b):
    assert matched_characters(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    assert similarity(a, b) == ratio(a, b)


def test_matching_blocks_with_popular_characters():
    rng = random.Random(4)
    for size in (3, 40, 150, 400):
        signs = [chr(0x100 + i) for i in range(size)]
        for _ in range(12):
            a, b = ("".join(rng.choice(signs) for _ in range(rng.randrange(150, 600))) for _ in range(2))
            b = a[: len(a) // 2] + b + a[len(a) // 3 :] if rng.random() < 0.5 else b
            assert similarity(a, b) == ratio(a, b)


def test_long_texts_take_about_linear_time():
    rng = random.Random(5)
    signs = [chr(0x4E00 + i) for i in range(2000)]
    a = "".join(rng.choice(signs) for _ in range(100_000))
    b = a[:40_000] + "".join(rng.choice(signs) for _ in range(5000)) + a[42_000:]
    start = time.time()
    assert similarity(a, b) == round(100 * 2 * matched_characters(a, b) / (len(a) + len(b))) > 90
    assert time.time() - start < 60


def test_set_of_many_values(spark):
    items = [str(i % 30_000) for i in range(50_000)] + ["30000.0", "a", "A", None, "30000"]
    df = spark.createDataFrame([(items,)], "items array<string>").withColumn("n", S.normalize_list(F.col("items")))
    typed = df.select(S.typed_values(F.col("items"), F.col("n")).alias("v"))
    start = time.time()
    keys = typed.select(F.transform(S.as_set(F.col("v")), lambda v: v["key"]).alias("k")).first()["k"]
    assert time.time() - start < 60
    assert keys[:2] == ["N:0.0", "N:1.0"] and len(keys) == len(set(keys)) == 30_002


@pytest.mark.parametrize("cells, want", [
    ("1| 2", "[1,2]"), ("1.5| 2", "[1.5,2.0]"), ("007| 1", '["007","1"]'), ("t| f", "[true,false]"), ("1| none", '["1",null]'),
    ("a,, b| c", '[["a","b"],["c"]]'), ("1,, 2| 3", "[[1.0,2.0],[3.0]]"), ("", "[]"),
])
def test_cell_values(spark, cells, want):
    df = spark.createDataFrame([(cells,)], "c string")
    assert df.select(F.to_json(S.cell_values(F.col("c"))).alias("v")).first()["v"] == want


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame(
        [(f"run/checkpoint-{k}", ["a"], ["a" if k != 3 else "zz"], k != 3) for k in range(1, 5) for _ in range(3)],
        "checkpoint string, target array<string>, prediction array<string>, exact boolean",
    )
    assert R.finished(spark, folder).count() == 0
    run = R.score_open(rows, folder)
    assert [next(run), next(run)] == ["run/checkpoint-1", "run/checkpoint-2"]
    run.close()  # stopped in the middle
    left = tmp_path / "log" / "_temporary" / "0" / "_temporary" / "attempt_1"
    left.mkdir(parents=True)
    (left / "part-0.json").write_text('{"checkpoint": "half", "n"')  # what a lost job leaves
    assert list(R.score_open(rows, folder)) == ["run/checkpoint-3", "run/checkpoint-4"]
    # A fuzzy score of 0 is not finished.
    assert list(R.score_open(rows, folder)) == ["run/checkpoint-3"]
    got = {r["checkpoint"]: (r["n"], r["fuzzy"]) for r in R.finished(spark, folder).collect()}
    assert got == {f"run/checkpoint-{k}": (3, 0.0 if k == 3 else 100.0) for k in range(1, 5)}


def test_nested_answers_are_opened(spark):
    deep = "[" * 400 + '"x"' + "]" * 400
    cases = {
        '"a"': ["a"], "3": ["3"], "2.0e0": ["2.0"], "true": ["True"], "[null, [null]]": ["None"], "[]": [], '[["b"], [["a", 1]]]': ["b", "a", "1"],
        '[1, 1.0e0]': ["1", "1.0"], '[{"k": [1]}, 0]': ['{"k": [1]}', "0"], deep: ["x"], '["ü", ["ü"]]': ["ü"], None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = df.select("s", S.render_values(F.parse_json("s")).alias("r")).collect()
    assert {r.s: r.r for r in got} == cases


def test_scores_of_one_file_are_the_work_of_many_tasks(spark):
    rows = [(i, f"run/checkpoint-{i % 2}", [f"river {i}"], [f"rivers {i}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, checkpoint string, target array<string>, prediction array<string>").coalesce(1)
    tasks = E.scored(df).select(F.spark_partition_id().alias("task"), "fuzzy").groupBy("task").count().collect()
    assert len(tasks) > spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) < 100
