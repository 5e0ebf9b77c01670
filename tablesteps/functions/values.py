"""Text to value conversion, null handling and scalar functions.

Every predicate built on these goes through ``null_false``: a comparison with a
null is false, never null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space when a text is stripped.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Decimal notation, and the spellings that stay text (leading zeros).
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
INTEGER = r"^(0|[+-]?[1-9][0-9]*)$"
PADDED = r"^(0[0-9]|-0([^.]|$))"
_BLANKS = f"[{SPACES}]*"
BOOL_WORDS = ["true", "false", "1", "0", "nan", "none"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def null_false(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def num(text: Column) -> Column:
    """Number in a text, or null. Words such as ``nan`` and forms such as ``1d`` are not numbers."""
    value = F.regexp_extract(text, f"^{_BLANKS}({NUMBER}){_BLANKS}$", 1).try_cast("double")
    # The remainder by infinity is the value itself, or NaN when the text overflows a double.
    # Written like this the text is evaluated once, however long its expression is.
    return F.nanvl(value % F.lit(float("inf")), F.lit(None).cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    """Column as number: text is parsed, numeric columns are only widened."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return num(F.col(name))
    return F.col(name).cast("double")


def is_integer_text(text: Column) -> Column:
    return null_false(strip(text).rlike(INTEGER))


def is_float_text(text: Column) -> Column:
    bare = strip(text)
    return null_false(bare.rlike(f"^{NUMBER}$") & ~bare.rlike(PADDED))


def is_bool_word(text: Column) -> Column:
    return F.coalesce(F.lower(text), F.lit("none")).isin(BOOL_WORDS)


def kind_of(text: Column) -> Column:
    """``int``, ``float`` or ``text``; numbers written with leading zeros are text."""
    return (
        F.when(is_integer_text(text), F.lit("int"))
        .when(is_float_text(text), F.lit("float"))
        .otherwise(F.lit("text"))
    )


def typed_literal(text: Column) -> Column:
    """Struct with the kind of a text and its integer, floating or text form."""
    bare = strip(text)
    whole = F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("bigint"))
    real = num(text)
    return F.struct(
        F.when(whole.isNotNull(), F.lit("int")).when(real.isNotNull(), F.lit("float"))
        .otherwise(F.lit("text")).alias("kind"),
        whole.alias("int_value"),
        real.alias("float_value"),
        F.when(real.isNull(), text).alias("text_value"),
    )


def unquote(text: Column) -> Column:
    """Drop one pair of equal quotes around the whole text."""
    head, tail = F.substring(text, 1, 1), F.right(text, F.lit(1))
    paired = (head == tail) & head.isin("'", '"')
    return F.when(paired, F.substring(text, F.lit(2), F.char_length(text) - 2)).otherwise(text)


def clean_quotes(df: DataFrame) -> DataFrame:
    """Apostrophes become blanks in every text column."""
    return df.select(
        *[
            F.replace(F.col(f.name), F.lit("'"), F.lit(" ")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def float_text(value: Column) -> Column:
    """Shortest decimal form: plain between 1e-4 and 1e16, otherwise ``1e+16`` style."""
    return let(F.struct(value.alias("v"), value.cast("string").alias("s")), _decimal_form)


def _decimal_form(number: Column) -> Column:
    plain, size = number["s"], F.abs(number["v"])

    def spread(decimal: str) -> Column:
        digits = F.regexp_replace(plain.try_cast(decimal).cast("string"), "0+$", "")
        return F.regexp_replace(digits, r"\.$", ".0")

    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    power = F.substring_index(plain, "E", -1).try_cast("int")
    exponent = F.concat(
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.format_string("%02d", F.abs(power))
    )
    return (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e7) & (size < 1e16), spread("decimal(38,18)"))
        .when((size >= 1e-4) & (size < 1e-3), spread("decimal(38,28)"))
        .otherwise(F.concat(mantissa, exponent))
    )


def integral_text(df: DataFrame, name: str) -> Column:
    """Column as text; when every value is a whole number all print without a fraction.

    One null or one fraction anywhere keeps the decimal form for all rows.
    """
    whole = F.coalesce(F.bool_and(null_false(F.col(name) == F.floor(F.col(name)))), F.lit(False))
    return F.when(df.agg(whole).scalar(), F.col(name).cast("bigint").cast("string")).otherwise(
        float_text(F.col(name).cast("double"))
    )


def numeric_or_text(df: DataFrame, name: str) -> tuple[Column, Column]:
    """All-or-nothing column conversion: (numbers or null, texts or null).

    Empty and null cells count as missing numbers; one other text keeps the whole column text.
    """
    cell = F.col(name)
    fits = cell.isNull() | (cell == "") | num(cell).isNotNull()
    clean = df.agg(F.coalesce(F.bool_and(fits), F.lit(True))).scalar()
    return F.when(clean, num(cell)), F.when(~clean, cell)


def locale_float(text: Column) -> Column:
    """Number in a text with thousands separators or a decimal comma, or null."""
    commas = F.size(F.split(text, ",")) - 1
    dots = F.size(F.split(text, r"\.")) - 1
    grouped = F.exists(F.split(text, ","), lambda part: F.char_length(part) == 3)
    no_commas = F.replace(text, F.lit(","), F.lit(""))
    return num(
        F.when((dots > 0) & (commas > 0), no_commas)
        .when((commas > 0) & grouped, no_commas)
        .when(commas == 1, F.replace(text, F.lit(","), F.lit(".")))
        .when(dots > 1, F.replace(text, F.lit("."), F.lit("")))
        .when(commas > 1, no_commas)
        .otherwise(text)
    )


def julianday(text: Column) -> Column:
    """Astronomical day number at midnight of a ``year-month-day`` text, null when it is no date."""
    shaped = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text)
    day = F.try_to_date(shaped, "yyyy-M-d")
    return F.datediff(day, F.lit("1970-01-01")).cast("double") + F.lit(2440587.5)


def compare_values(left: Column, op: str, right: Column) -> Column:
    """Comparison by symbol; null on either side is false."""
    result = {
        "=": lambda: left == right,
        "!=": lambda: left != right,
        "<": lambda: left < right,
        ">": lambda: left > right,
        "<=": lambda: left <= right,
        ">=": lambda: left >= right,
    }[op]()
    return null_false(result)
