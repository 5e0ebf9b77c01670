"""Golden cases of value parsing, derived columns and scalar functions."""

import pytest
from pyspark.sql import functions as F

from tablesteps.functions import derive as D
from tablesteps.functions import values as V


def one(spark, build, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    ("3", 3.0), (" 3.5 ", 3.5), ("+4", 4.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1d", None), ("2f", None),
    ("nan", None), ("inf", None), ("1e999", None), ("1,000", None), ("", None), (None, None), ("\t7 ", 7.0), ("-0", 0.0),
])
def test_num(spark, text, want):
    assert one(spark, V.num, text) == want


@pytest.mark.parametrize("text, want", [
    ("0", "int"), ("007", "text"), ("-5", "int"), ("0.5", "float"), ("-0.5", "float"), ("-05", "text"), ("0.0", "float"), ("x", "text"),
])
def test_kind(spark, text, want):
    assert one(spark, V.kind_of, text) == want


@pytest.mark.parametrize("text, want", [
    ("1,000.7", 1000.7), ("1,000", 1000.0), ("5,5556", 5.5556), ("12,345,6", 123456.0), ("0.0.0.1", 1.0),
    ("0,0,0,1", 1.0), ("abc", None),
])
def test_locale_float(spark, text, want):
    assert one(spark, V.locale_float, text) == want


@pytest.mark.parametrize("value", [0.0, 1.0, 1863.84, 1e7, 12345678.9, 1e15, 1e16, 1.5e22, 0.001, 0.0001234, 1e-5, 2.5e-10, -3.25e8, 1e100])
def test_float_text_is_shortest_form(spark, value):
    assert one(spark, V.float_text, value, "double") == repr(value)


@pytest.mark.parametrize("text, want", [("'a'", "a"), ('"a b"', "a b"), ("'a\"", "'a\""), ("'", ""), ("", ""), ("''", "")])
def test_unquote(spark, text, want):
    assert one(spark, V.unquote, text) == want


@pytest.mark.parametrize("text, want", [
    ("2000-03-01", 2451604.5), ("2000-01-01", 2451544.5), ("2000-1-1", 2451544.5), ("2000-13-01", None), ("2001-02-30", None), ("x", None),
])
def test_julianday(spark, text, want):
    assert one(spark, V.julianday, text) == want


def test_list_columns(spark):
    df = spark.createDataFrame([("a, b",), ("c",), ("a/b, c",), (None,)], "c string")
    got = [r["c_list"] for r in D.derive(df, ["c_list"]).collect()]
    assert got == [["a", "b"], ["c"], ["a", "b", "c"], []]
    numbers = D.derive(spark.createDataFrame([("9, 10",)], "c string"), ["c_list_maximum_number", "c_list_minimum_number"])
    assert tuple(numbers.first())[1:] == ("9", "10")


def test_delimiter_ties_and_other_marks(spark):
    df = spark.createDataFrame([("a-b-c",), ("d,e",)], "c string")
    assert [r["c_list"] for r in D.derive(df, ["c_list"]).collect()] == [["a", "b", "c"], ["d,e"]]
    tied = spark.createDataFrame([("a-b",), ("d,e",)], "c string")
    assert [r["c_list"] for r in D.derive(tied, ["c_list"]).collect()] == [["a-b"], ["d", "e"]]


@pytest.mark.parametrize("build, text, want", [
    (D.first_number, "about 12.5 km 3", 12.5),
    (D.max_years, "1990-1995, 2000", ["1995", "2000"]),
    (D.min_years, "1990-1995, 2000", ["1990", "2000"]),
    (D.max_years, "1990-now", ["1990"]),
    (D.max_years, None, [None]),
    (D.range_max, "3-10, 7", ["10", "7"]),
    (D.range_min, "3-10, 7", ["3", "7"]),
    (D.names, "Ann (US), Bob", ["Ann", "Bob"]),
    (D.names, "José Ñu (ES)", ["José Ñu"]),
    (D.year, "May 5, 1999", "1999"),
    (D.year, "19999", None),
    (D.month, "5 May 1999", "5"),
    (D.month, "Sat May", None),
    (D.address_parts, "a, b,c", ["a", "b,c"]),
    (D.clean_sql_text, "c1 is not null and c2 not null", "c1 is not null and c2 is not null"),
])
def test_derived(spark, build, text, want):
    assert one(spark, build, text) == want
