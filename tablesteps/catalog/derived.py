"""Columns derived from free text."""

from pyspark.sql import functions as F

from ..functions import derive as D
from .registry import query

# Texts made from whole tables; the same expressions in both engines.
_LIST_SQL = """x AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'P' THEN NULL
              ELSE concat(o_orderpriority, ', ', o_custkey, '/', o_orderstatus, ',', strftime(o_orderdate, '%Y')) END AS c
  FROM orders)"""
_RANGE_SQL = """x AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'P' THEN NULL
              ELSE concat(strftime(o_orderdate, '%Y'), '-', CAST(year(o_orderdate) + o_custkey % 7 AS VARCHAR), ', in ', strftime(o_orderdate, '%Y')) END AS c,
         concat(o_custkey % 9 + 3, '-', o_custkey % 13, ', ', o_custkey) AS r
  FROM orders)"""


def _list_text(t):
    pieces = F.concat(
        "o_orderpriority", F.lit(", "), "o_custkey", F.lit("/"), "o_orderstatus", F.lit(","), F.year("o_orderdate")
    )
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", pieces).alias("c")
    )


def _range_text(t):
    first = F.year("o_orderdate").cast("string")
    last = (F.year("o_orderdate") + F.col("o_custkey") % 7).cast("string")
    years = F.concat(first, F.lit("-"), last, F.lit(", in "), first)
    cust = F.col("o_custkey")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", years).alias("c"),
        F.concat(cust % 9 + 3, F.lit("-"), cust % 13, F.lit(", "), cust).alias("r"),
    )


def _joined(items, name="answer"):
    return F.array_join(items, " | ", "<null>").alias(name)


@query("derive_address", "SELECT doc_id, CAST(len(string_split(text, ', ')) AS BIGINT) AS parts, array_to_string(string_split(text, ', '), ' | ') AS answer FROM documents")
def derive_address(t):
    parts = D.address_parts(F.col("text"))
    return t.documents.select("doc_id", F.size(parts).cast("bigint").alias("parts"), _joined(parts))


# Delimiter that gives most parts over the whole column; earlier ones win ties.
_DELIMITER_SQL = """d AS (
  SELECT CASE WHEN a >= b AND a >= n THEN ',' WHEN b >= n THEN '-' ELSE chr(10) END AS mark
  FROM (SELECT sum(len(string_split(c, ','))) AS a, sum(len(string_split(c, '-'))) AS b, sum(len(string_split(c, chr(10)))) AS n FROM x WHERE c IS NOT NULL))"""
_PIECES_SQL = "list_transform(string_split(c, (SELECT mark FROM d)), lambda p: trim(p))"


@query("derive_list", f"""
WITH {_LIST_SQL}, {_DELIMITER_SQL}
SELECT id, coalesce(array_to_string(list_filter(flatten(list_transform({_PIECES_SQL}, lambda q: string_split(q, '/'))), lambda s: s <> ''), ' | '), '') AS answer
FROM x""")
def derive_list(t):
    df = D.derive(_list_text(t), ["c_list"])
    return df.select("id", _joined("c_list"))


@query("derive_list_max_text", f"WITH {_LIST_SQL}, {_DELIMITER_SQL} SELECT id, list_max({_PIECES_SQL}) AS answer FROM x")
def derive_list_max_text(t):
    df = D.derive(_list_text(t), ["c_list_maximum_number"])
    return df.select("id", F.col("c_list_maximum_number").alias("answer"))


@query("derive_list_min_text", f"WITH {_LIST_SQL}, {_DELIMITER_SQL} SELECT id, list_min({_PIECES_SQL}) AS answer FROM x")
def derive_list_min_text(t):
    df = D.derive(_list_text(t), ["c_list_minimum_number"])
    return df.select("id", F.col("c_list_minimum_number").alias("answer"))


@query("derive_first_number", "SELECT page_id, try_cast(nullif(regexp_extract(html, '([0-9]+\\.[0-9]+|[0-9]+)', 1), '') AS DOUBLE) AS html_number, try_cast(nullif(regexp_extract(url, '([0-9]+\\.[0-9]+|[0-9]+)', 1), '') AS DOUBLE) AS url_number FROM pages")
def derive_first_number(t):
    df = D.derive(t.pages, ["html_list_number", "url_list_number"])
    return df.select(
        "page_id", F.col("html_list_number").alias("html_number"), F.col("url_list_number").alias("url_number")
    )


def _years_sql(pick):
    year = r"nullif(regexp_extract({0}, '\b[0-9]{{4}}\b'), '')"
    sides = f"list_filter(list_transform(string_split(p, '-'), lambda s: try_cast({year.format('s')} AS INTEGER)), lambda v: v IS NOT NULL)"
    return f"""
WITH {_RANGE_SQL}
SELECT id, CASE WHEN c IS NULL THEN '<null>' ELSE array_to_string(list_transform(string_split(c, ', '), lambda p:
  coalesce(CASE WHEN len(string_split(p, '-')) = 1 THEN {year.format('p')} ELSE CAST({pick}({sides}) AS VARCHAR) END, '<null>')), ' | ') END AS answer
FROM x"""


@query("derive_max_years", _years_sql("list_max"))
def derive_max_years(t):
    return D.derive(_range_text(t), ["c_list_maximum_year"]).select("id", _joined("c_list_maximum_year"))


@query("derive_min_years", _years_sql("list_min"))
def derive_min_years(t):
    return D.derive(_range_text(t), ["c_list_minimum_year"]).select("id", _joined("c_list_minimum_year"))


def _ends_sql(pick):
    sides = "list_transform(string_split(p, '-'), lambda s: try_cast(s AS BIGINT))"
    return f"""
WITH {_RANGE_SQL}
SELECT id, array_to_string(list_transform(string_split(r, ', '), lambda p:
  CASE WHEN len(string_split(p, '-')) = 1 THEN p ELSE CAST({pick}({sides}) AS VARCHAR) END), ' | ') AS answer
FROM x"""


@query("derive_range_max", _ends_sql("list_max"))
def derive_range_max(t):
    return D.derive(_range_text(t), ["r_list_maximum"]).select("id", _joined("r_list_maximum"))


@query("derive_range_min", _ends_sql("list_min"))
def derive_range_min(t):
    return D.derive(_range_text(t), ["r_list_minimum"]).select("id", _joined("r_list_minimum"))


@query("derive_names", r"""
WITH x AS (SELECT o_orderkey AS id, concat(o_orderpriority, ' (', o_custkey, '), Clerk ', o_custkey, '; ', o_orderstatus) AS c FROM orders)
SELECT id, array_to_string(list_transform(regexp_extract_all(c, '([0-9A-Za-z_\s°]+)(\s*\([^)]*\))?', 1), lambda s: trim(s)), ' | ') AS answer FROM x""")
def derive_names(t):
    text = F.concat(
        "o_orderpriority", F.lit(" ("), "o_custkey", F.lit("), Clerk "), "o_custkey", F.lit("; "), "o_orderstatus"
    )
    df = D.derive(t.orders.select(F.col("o_orderkey").alias("id"), text.alias("c")), ["c_list_first"])
    return df.select("id", _joined("c_list_first"))


_DATE_SQL = "x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%-d %B %Y') WHEN 'O' THEN strftime(o_orderdate, '%A %B %-d, %Y') ELSE strftime(o_orderdate, '%B 7') END AS c FROM orders)"


def _date_text(t):
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    text = (
        F.when(status == "F", F.date_format(day, "d MMMM yyyy"))
        .when(status == "O", F.date_format(day, "EEEE MMMM d, yyyy"))
        .otherwise(F.date_format(day, "MMMM '7'"))
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), text.alias("c"))


@query("derive_year", rf"WITH {_DATE_SQL} SELECT id, nullif(regexp_extract(c, '\b[0-9]{{4}}\b'), '') AS answer FROM x")
def derive_year(t):
    return D.derive(_date_text(t), ["c_list_year"]).select("id", F.col("c_list_year").alias("answer"))


@query("derive_month", f"""
WITH {_DATE_SQL},
m AS (SELECT unnest(range(1, 13)) AS n)
SELECT id, CAST((SELECT n FROM m WHERE lower(strftime(make_date(2000, CAST(n AS INTEGER), 1), '%B')) = lower(regexp_extract(c, '[a-zA-Z]+'))) AS VARCHAR) AS answer FROM x""")
def derive_month(t):
    return D.derive(_date_text(t), ["c_list_month"]).select("id", F.col("c_list_month").alias("answer"))


_SQL_TEXT = """x AS (SELECT o_orderkey AS id, concat('select * from w where c1 is not null and c2 > ', o_totalprice, ' and c3 not null and c4 < present_ref or c5 = ''', o_orderstatus, chr(92), '''s''') AS c FROM orders)"""


@query("clean_sql_text", f"""
WITH {_SQL_TEXT}
SELECT id, replace(replace(replace(replace(replace(c, 'is not null', 'not null'), 'not null', 'is not null'), 'present_ref', '2014'), ' * ', ' id '), concat(chr(92), ''''), ' ') AS answer FROM x""")
def clean_sql_text(t):
    text = F.concat(
        F.lit("select * from w where c1 is not null and c2 > "), "o_totalprice",
        F.lit(" and c3 not null and c4 < present_ref or c5 = '"), "o_orderstatus", F.lit("\\'s'"),
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), D.clean_sql_text(text).alias("answer"))
