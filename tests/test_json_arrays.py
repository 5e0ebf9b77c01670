"""The reader of JSON arrays by byte ranges against the json module."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablesteps.sources.json_arrays import read_json_array, record_texts, save_json_array

SPLIT = "spark.sql.files.maxPartitionBytes"
NASTY = ['{"', '}', '\\"}', '\\\\', '"', '[{', '},{', 'line\nbreak', 'größe {', '']


@pytest.fixture
def small_ranges(spark):
    before, cost = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(SPLIT, "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "31")
    yield
    spark.conf.set(SPLIT, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def texts(spark, path):
    return sorted((json.loads(r.value) for r in record_texts(spark, str(path)).collect()), key=json.dumps)


def test_one_file_is_read_in_many_ranges(spark, tmp_path, small_ranges):
    records = [{"nt": f"{i}{NASTY[i % len(NASTY)]}", "in": [{"a": {"b": NASTY[(i + 3) % len(NASTY)] * (i % 40)}}]} for i in range(120)]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(records, ensure_ascii=False, indent=1))
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 20
    assert texts(spark, path) == sorted(records, key=json.dumps)
    path.write_text(json.dumps(records))
    schema = "nt string, `in` array<struct<a: struct<b: string>>>"
    ours = read_json_array(spark, str(path), schema)
    theirs = spark.read.schema(schema).json(str(path), multiLine=True)
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))


VALUE = st.recursive(
    st.text(alphabet='ab"\\{}[],:\né', max_size=12) | st.integers() | st.none(),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet='k"{}\\', max_size=3), v, max_size=3), max_leaves=8,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(alphabet='k"{}\\', max_size=3), VALUE, max_size=3), max_size=12), st.sampled_from([None, 1]))
def test_any_objects(spark, tmp_path, small_ranges, records, indent):
    path = tmp_path / "any.json"
    path.write_text(json.dumps(records, indent=indent))
    assert texts(spark, path) == sorted(records, key=json.dumps)


def test_several_files_other_elements_and_empty_ones(spark, tmp_path):
    for name, text in {"a": '[{"x": 1}, null, 3, {"x": 2}]', "b": "[]", "c": "", "d": '{"x": 4}\n{"x": {}}\n', "e": ' [ {} ] '}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert texts(spark, tmp_path) == sorted([{"x": 1}, {"x": 2}, {"x": 4}, {"x": {}}, {}], key=json.dumps)


def test_written_arrays_come_back(spark, tmp_path):
    rows = [(i, NASTY[i % len(NASTY)], None) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, s string, n string").repartition(3)
    save_json_array(df, str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(part.read_text()), list)
    assert sorted(map(tuple, read_json_array(spark, str(tmp_path / "out"), "i int, s string, n string").collect())) == rows
    save_json_array(df.filter("i < 0"), str(tmp_path / "none"))
    assert read_json_array(spark, str(tmp_path / "none"), "i int").count() == 0


def test_only_the_ends_of_ranges_are_sorted(spark, tmp_path, small_ranges):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"a": i, "in": {"b": "}"}} for i in range(200)]))
    found = record_texts(spark, str(path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "_quotes" not in "".join(line for line in plan.splitlines() if "Sort " in line)
    assert sorted(json.loads(r.value)["a"] for r in found.collect()) == list(range(200))
