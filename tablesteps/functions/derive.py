"""Columns derived from free text: lists, numbers, years, months, names.

All functions are row-local. The list functions need one delimiter for the whole
column, which ``with_delimiter`` adds from a one-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import strip

# Candidate delimiters in order of preference, and month names.
DELIMITERS = [",", "-", "\n"]
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
YEAR = r"\b[0-9]{4}\b"


def address_parts(text: Column) -> Column:
    return F.split(text, ", ")


def with_delimiter(df: DataFrame, name: str, mark: str) -> DataFrame:
    """Add the delimiter that cuts the whole column into most parts; ties go to the earlier one."""
    totals = [
        F.coalesce(F.sum(F.size(F.split(F.col(name), sign))), F.lit(0)) for sign in DELIMITERS
    ]
    comma, dash, _ = totals
    best = (
        F.when(comma == F.greatest(*totals), F.lit(DELIMITERS[0]))
        .when(dash == F.greatest(*totals), F.lit(DELIMITERS[1]))
        .otherwise(F.lit(DELIMITERS[2]))
    )
    return df.withColumn(mark, df.filter(F.col(name).isNotNull()).agg(best).scalar())


def _parts(text: Column, mark: Column) -> Column:
    return F.transform(F.split(text, mark), strip)


def list_parts(text: Column, mark: Column) -> Column:
    """Trimmed parts, cut again at slashes, empty ones dropped; null gives an empty list."""
    pieces = F.flatten(F.transform(_parts(text, mark), lambda part: F.split(part, "/")))
    return F.coalesce(
        F.filter(pieces, lambda piece: piece != ""), F.array().cast("array<string>")
    )


def list_max_text(text: Column, mark: Column) -> Column:
    """Largest part in text order (so ``9`` beats ``10``)."""
    return F.array_max(_parts(text, mark))


def list_min_text(text: Column, mark: Column) -> Column:
    return F.array_min(_parts(text, mark))


def first_number(text: Column) -> Column:
    hit = F.regexp_extract(text, r"([0-9]+\.[0-9]+|[0-9]+)", 1)
    return F.nullif(hit, F.lit("")).try_cast("double")


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, YEAR, 0), F.lit(""))


def _per_range(text: Column, single, ends, pick) -> Column:
    def reduce_part(part: Column) -> Column:
        sides = F.split(part, "-")
        widest = pick(F.filter(F.transform(sides, ends), lambda v: v.isNotNull()))
        return F.when(F.size(sides) == 1, single(part)).otherwise(widest.cast("string"))

    missing = F.array(F.lit(None).cast("string"))
    return F.coalesce(F.transform(F.split(text, ", "), reduce_part), missing)


def max_years(text: Column) -> Column:
    """Latest year of every comma separated range; ranges are written with a dash."""
    return _per_range(text, year, lambda side: year(side).try_cast("int"), F.array_max)


def min_years(text: Column) -> Column:
    return _per_range(text, year, lambda side: year(side).try_cast("int"), F.array_min)


def range_max(text: Column) -> Column:
    """Larger end of every comma separated range; a part that is no range stays as it is."""
    return _per_range(text, lambda part: part, lambda side: strip(side).try_cast("bigint"), F.array_max)


def range_min(text: Column) -> Column:
    return _per_range(text, lambda part: part, lambda side: strip(side).try_cast("bigint"), F.array_min)


def names(text: Column) -> Column:
    """Word runs with a bracketed remark behind them removed."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)([\w\s°]+)(?:\s*\([^)]*\))?"), F.lit(1))
    return F.transform(runs, strip)


def month(text: Column) -> Column:
    """Month number as text when the first word is a month name."""
    table = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS) for v in (m, str(i + 1))])
    return F.try_element_at(table, F.lower(F.regexp_extract(text, "([a-zA-Z]+)", 1)))


def clean_sql_text(text: Column) -> Column:
    """Query text clean-up: null tests, the reference year, star, escaped quotes."""
    steps = [
        ("is not null", "not null"),
        ("not null", "is not null"),
        ("present_ref", "2014"),
        (" * ", " id "),
        ("\\'", " "),
    ]
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Column name suffixes. Longer suffixes come first because they contain shorter ones.
_SUFFIXES = {
    "_list_maximum_number": list_max_text,
    "_list_minimum_number": list_min_text,
    "_list_maximum_year": max_years,
    "_list_minimum_year": min_years,
    "_list_maximum": range_max,
    "_list_minimum": range_min,
    "_list_number": first_number,
    "_list_first": names,
    "_list_year": year,
    "_list_month": month,
    "_address": address_parts,
    "_list": list_parts,
}
_NEEDS_DELIMITER = {list_max_text, list_min_text, list_parts}


def derive(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Add the derived columns named ``<base><suffix>``; other names are left alone."""
    source, added, marks = df, {}, []
    for name in wanted:
        suffix = next((s for s in _SUFFIXES if name.endswith(s)), None)
        if suffix is None or name in df.columns:
            continue
        base, build = name[: -len(suffix)], _SUFFIXES[suffix]
        if build in _NEEDS_DELIMITER:
            mark = f"_mark_{base}"
            if mark not in marks:
                source, marks = with_delimiter(source, base, mark), [*marks, mark]
            added[name] = build(F.col(base), F.col(mark))
        else:
            added[name] = build(F.col(base))
    return source.withColumns(added).drop(*marks) if added else df
