"""Selection, comparison, arithmetic, ordering and set queries."""

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import steps as S
from .registry import num_sql, on_w, query

NUM_C6 = num_sql("c6")

# ---- scans and projections ----------------------------------------------------


@query("scan_table", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 7")
def scan_table(t):
    return t.customer.filter("c_nationkey = 7").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("project_agg0", on_w("SELECT id, c1 FROM w WHERE agg = 0"))
def project_agg0(t):
    return S.data_rows(t.w).select("id", "c1")


@query("project_all", on_w("SELECT id, c1 FROM w"))
def project_all(t):
    return t.w.select("id", "c1")


@query("project_pair", on_w("SELECT c1, c2 FROM w WHERE agg = 0"))
def project_pair(t):
    return S.data_rows(t.w).select("c1", "c2")


# ---- comparisons --------------------------------------------------------------


def _compare(name, column, op, value, sql):
    @query(name, on_w(f"SELECT id, {column} FROM w WHERE {sql}"))
    def build(t):
        return t.w.filter(S.compare(t.w, column, op, value)).select("id", column)


_compare("filter_eq", "c1", "=", "1-URGENT", "c1 = '1-URGENT'")
_compare("filter_neq", "c1", "!=", "1-URGENT", "c1 <> '1-URGENT'")
_compare("filter_lt", "c6", "<", 500, f"{NUM_C6} < 500")
_compare("filter_gt", "c2", ">", 250000, "c2 > 250000")
_compare("filter_lte", "c3", "<=", "1995-06-30", "c3 <= '1995-06-30'")
_compare("filter_gte", "c6", ">=", 700.5, f"{NUM_C6} >= 700.5")


@query("filter_eq_none", on_w("SELECT id, c2 FROM w WHERE CASE WHEN EXISTS (SELECT 1 FROM w WHERE c1 = 'none') THEN coalesce(c1 = 'none', false) ELSE c1 IS NULL END"))
def filter_eq_none(t):
    return t.w.filter(S.equals_or_none(t.w, "c1", "none")).select("id", "c2")


@query("filter_in", on_w("SELECT id, c1 FROM w WHERE c1 IN ('1-URGENT', '3-MEDIUM')"))
def filter_in(t):
    return t.w.filter(S.isin_text(t.w, "c1", "'1-URGENT', '3-MEDIUM'")).select("id", "c1")


@query("filter_is_null", on_w("SELECT id, c2 FROM w WHERE c1 IS NULL"))
def filter_is_null(t):
    return t.w.filter(F.col("c1").isNull()).select("id", "c2")


@query("filter_is_not_null", on_w("SELECT id, c1 FROM w WHERE c1 IS NOT NULL"))
def filter_is_not_null(t):
    return t.w.filter(F.col("c1").isNotNull()).select("id", "c1")


@query("filter_col_col", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > l_quantity")
def filter_col_col(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.filter(V.compare_values(F.col("l_linenumber"), ">", F.col("l_quantity")))


@query("filter_scalar_subquery", on_w("SELECT id, c2 FROM w WHERE c2 > (SELECT c2 FROM w WHERE c1 = '2-HIGH' ORDER BY id LIMIT 1)"))
def filter_scalar_subquery(t):
    sub = S.first_value(t.w.filter(S.compare(t.w, "c1", "=", "2-HIGH")), "c2")
    return S.where_scalar(t.w, "c2", ">", sub).select("id", "c2")


@query("filter_neighbor_row", on_w("SELECT id, c1, c2 FROM w WHERE id = (SELECT id FROM w ORDER BY c2 DESC, id LIMIT 1) + 1"))
def filter_neighbor_row(t):
    sub = t.w.agg(F.max_by("id", F.struct("c2", -F.col("id"))).alias("id"))
    return S.where_scalar(t.w, "id", "=", sub, offset=1).select("id", "c1", "c2")


@query("select_bool", on_w("SELECT id, coalesce(c2 > 200000, false) AS answer FROM w WHERE agg = 0"))
def select_bool(t):
    return S.data_rows(t.w).select("id", V.compare_values(F.lit(200000), "<", F.col("c2")).alias("answer"))


@query("compare_two_scalars", on_w("SELECT (SELECT max(c2) FROM w WHERE c5 = 'F') > (SELECT max(c2) FROM w WHERE c5 = 'O') AS answer"))
def compare_two_scalars(t):
    left = t.w.filter("c5 = 'F'").agg(F.max("c2").alias("v"))
    right = t.w.filter("c5 = 'O'").agg(F.max("c2").alias("v"))
    return S.scalar_pair(left, right, lambda a, b: V.compare_values(a, ">", b), "answer")


@query("filter_and", on_w("SELECT id FROM w WHERE c1 = '1-URGENT' AND c2 > 100000"))
def filter_and(t):
    return t.w.filter(S.all_of(S.compare(t.w, "c1", "=", "1-URGENT"), S.compare(t.w, "c2", ">", 100000))).select("id")


@query("filter_or", on_w("SELECT id FROM w WHERE c1 = '1-URGENT' OR c2 > 400000"))
def filter_or(t):
    return t.w.filter(S.any_of(S.compare(t.w, "c1", "=", "1-URGENT"), S.compare(t.w, "c2", ">", 400000))).select("id")


@query("filter_and_or", on_w("SELECT id FROM w WHERE (c1 = '1-URGENT' OR c1 IS NULL) AND (c2 > 300000 OR (c5 = 'F' AND c3 < '1997-01-01'))"))
def filter_and_or(t):
    w = t.w
    first = S.any_of(S.compare(w, "c1", "=", "1-URGENT"), F.col("c1").isNull())
    inner = S.all_of(S.compare(w, "c5", "=", "F"), S.compare(w, "c3", "<", "1997-01-01"))
    return w.filter(S.all_of(first, S.any_of(S.compare(w, "c2", ">", 300000), inner))).select("id")


@query("filter_abs", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE abs(l_partkey - l_suppkey) > 1000")
def filter_abs(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    return rows.filter(V.compare_values(F.abs(F.col("l_partkey") - F.col("l_suppkey")), ">", F.lit(1000)))


# ---- arithmetic and scalar functions ------------------------------------------


@query("arith_literal", on_w("""
SELECT id, round(c2 + 10, 2) AS plus_k, round(c2 - 10, 2) AS minus_k, round(10 - c2, 2) AS k_minus,
       round(c2 / 4, 6) AS over_k, round(CASE WHEN c4 = 0 THEN NULL ELSE 1000 / c4 END, 9) AS k_over
FROM w"""))
def arith_literal(t):
    c2, c4 = F.col("c2"), F.col("c4")
    return t.w.select(
        "id",
        F.round(c2 + 10, 2).alias("plus_k"),
        F.round(c2 - 10, 2).alias("minus_k"),
        F.round(10 - c2, 2).alias("k_minus"),
        F.round(F.try_divide(c2, F.lit(4)), 6).alias("over_k"),
        F.round(F.try_divide(F.lit(1000), c4), 9).alias("k_over"),
    )


@query("arith_columns", on_w(f"""
SELECT id, round(c2 - ({NUM_C6}), 2) AS difference, round(c2 + ({NUM_C6}), 2) AS total,
       round(CASE WHEN ({NUM_C6}) = 0 THEN NULL ELSE c2 / ({NUM_C6}) END, 6) AS ratio
FROM w"""))
def arith_columns(t):
    w = t.w
    return w.select(
        "id",
        F.round(S.add_columns(w, "c2", "-", "c6"), 2).alias("difference"),
        F.round(S.add_columns(w, "c2", "+", "c6"), 2).alias("total"),
        F.round(S.add_columns(w, "c2", "/", "c6"), 6).alias("ratio"),
    )


@query("arith_lists", on_w(f"""
WITH l AS (SELECT id, CASE WHEN c4 % 5 = 0 THEN [] WHEN c4 % 5 = 1 THEN [c6, '2', ''] ELSE [CAST(c4 AS VARCHAR), '7.5'] END AS a,
        CASE WHEN c4 % 7 = 0 THEN [] WHEN c4 % 7 = 1 THEN ['0', '4', '1'] ELSE [CAST(c4 % 3 AS VARCHAR), '2'] END AS b FROM w),
n AS (SELECT id, list_transform(a, lambda x: CASE WHEN len(list_filter(a, lambda y: y <> '' AND ({num_sql('y')}) IS NULL)) = 0 THEN {num_sql('x')} END) AS a,
        list_transform(b, lambda x: {num_sql('x')}) AS b FROM l),
p AS (SELECT id, a, b, unnest(CASE WHEN greatest(len(a), len(b)) = 0 THEN [NULL] ELSE range(greatest(len(a), len(b))) END) AS place FROM n)
SELECT id, CAST(place AS INTEGER) AS place, round(a[place + 1] - b[place + 1], 2) AS difference, round(a[place + 1] + b[place + 1], 2) AS total,
       round(CASE WHEN b[place + 1] <> 0 THEN a[place + 1] / b[place + 1] END, 6) AS ratio FROM p"""))
def arith_lists(t):
    c4 = F.col("c4")
    pairs = t.w.select(
        "id",
        F.when(c4 % 5 == 0, F.array().cast("array<string>")).when(c4 % 5 == 1, F.array("c6", F.lit("2"), F.lit("")))
        .otherwise(F.array(c4.cast("string"), F.lit("7.5"))).alias("a"),
        F.when(c4 % 7 == 0, F.array().cast("array<string>")).when(c4 % 7 == 1, F.array(*map(F.lit, "041")))
        .otherwise(F.array((c4 % 3).cast("string"), F.lit("2"))).alias("b"),
    )
    values = S.list_arithmetic("a", "b", difference="-", total="+", ratio="/")
    return pairs.select("id", F.posexplode_outer(values).alias("place", "v")).select(
        "id", "place", F.round("v.difference", 2).alias("difference"), F.round("v.total", 2).alias("total"), F.round("v.ratio", 6).alias("ratio")
    )


@query("arith_three", "SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount - l_tax, 2) AS answer FROM lineitem")
def arith_three(t):
    total = F.col("l_quantity") + F.col("l_discount") - F.col("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(total, 2).alias("answer"))


@query("diff_two_scalars", on_w("SELECT round((SELECT max(c2) FROM w WHERE c5 = 'F') - (SELECT max(c2) FROM w WHERE c5 = 'O'), 2) AS answer"))
def diff_two_scalars(t):
    left = t.w.filter("c5 = 'F'").agg(F.max("c2").alias("v"))
    right = t.w.filter("c5 = 'O'").agg(F.max("c2").alias("v"))
    return S.scalar_diff(left, right, "answer").select(F.round("answer", 2).alias("answer"))


@query("diff_with_empty_side", on_w("SELECT round(coalesce((SELECT max(c2) FROM w WHERE c5 = 'F'), 0) - coalesce((SELECT max(c2) FROM w WHERE c5 = 'missing'), 0), 2) AS answer"))
def diff_with_empty_side(t):
    left = t.w.filter("c5 = 'F'").agg(F.max("c2").alias("v"))
    right = S.first_value(t.w.filter("c5 = 'missing'"), "c2")
    return S.scalar_diff(left, right, "answer", empty=0).select(F.round("answer", 2).alias("answer"))


@query("abs_diff_two_scalars", on_w("SELECT round(abs((SELECT c2 FROM w WHERE c1 = '1-URGENT' ORDER BY id LIMIT 1) - (SELECT c2 FROM w WHERE c1 = '2-HIGH' ORDER BY id LIMIT 1)) + 1, 2) AS answer"))
def abs_diff_two_scalars(t):
    left = S.first_value(t.w.filter("c1 = '1-URGENT'"), "c2")
    right = S.first_value(t.w.filter("c1 = '2-HIGH'"), "c2")
    gap = S.scalar_diff(left, right, "answer", absolute=True, plus=1)
    return gap.select(F.round("answer", 2).alias("answer"))


@query("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS answer FROM customer")
def fn_abs(t):
    return t.customer.select("c_custkey", F.abs("c_acctbal").alias("answer"))


@query("fn_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS answer FROM documents")
def fn_length(t):
    return t.documents.select("doc_id", F.char_length("text").cast("bigint").alias("answer"))


@query("fn_julianday", """
WITH d AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
                          WHEN o_orderstatus = 'O' THEN concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate))
                          ELSE concat(year(o_orderdate), '-13-', day(o_orderdate)) END AS s
  FROM orders)
SELECT o_orderkey, date_diff('day', DATE '1970-01-01', try_strptime(s, '%Y-%m-%d')::DATE) + 2440587.5::DOUBLE AS answer FROM d""")
def fn_julianday(t):
    day = F.col("o_orderdate")
    loose = F.concat_ws("-", F.year(day), F.month(day), F.day(day))
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", loose)
        .otherwise(F.concat(F.year(day), F.lit("-13-"), F.day(day)))
    )
    return t.orders.select("o_orderkey", V.julianday(text).alias("answer"))


@query("fn_to_number", on_w(f"SELECT id, {NUM_C6} AS answer FROM w"))
def fn_to_number(t):
    return t.w.select("id", V.num(F.col("c6")).alias("answer"))


_KIND_SQL = r"""
WITH x AS (
  SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 1 THEN CAST(p_size AS VARCHAR)
    WHEN 2 THEN CAST(-p_size AS VARCHAR) WHEN 3 THEN concat('0.', CAST(p_size AS VARCHAR))
    WHEN 4 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS s
  FROM part)
SELECT p_partkey, s, CASE
    WHEN regexp_full_match(s, '(0|[+-]?[1-9][0-9]*)') THEN 'int'
    WHEN regexp_full_match(s, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND NOT regexp_matches(s, '^(0[0-9]|-0([^.]|$))') THEN 'float'
    ELSE 'text' END AS kind
FROM x"""


def _mixed_cells(t):
    size = F.col("p_size").cast("string")
    cell = (
        F.when(F.col("p_size") % 6 == 0, F.lpad(size, 3, "0"))
        .when(F.col("p_size") % 6 == 1, size)
        .when(F.col("p_size") % 6 == 2, (-F.col("p_size")).cast("string"))
        .when(F.col("p_size") % 6 == 3, F.concat(F.lit("0."), size))
        .when(F.col("p_size") % 6 == 4, F.col("p_name"))
        .otherwise(F.col("p_retailprice").cast("string"))
    )
    return t.part.select("p_partkey", cell.alias("s"))


@query("fn_numeric_kind", _KIND_SQL)
def fn_numeric_kind(t):
    return _mixed_cells(t).select("p_partkey", "s", V.kind_of(F.col("s")).alias("kind"))


@query("fn_typed_literal", _KIND_SQL.split("SELECT p_partkey, s, CASE")[0] + r"""
SELECT p_partkey,
       CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN try_cast(s AS BIGINT) END AS int_value,
       CASE WHEN regexp_full_match(s, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(s AS DOUBLE) END AS float_value,
       CASE WHEN NOT regexp_full_match(s, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN s END AS text_value
FROM x""")
def fn_typed_literal(t):
    typed = V.typed_literal(F.col("s"))
    return _mixed_cells(t).select(
        "p_partkey", *[typed[f].alias(f) for f in ("int_value", "float_value", "text_value")]
    )


@query("fn_is_bool_word", "SELECT conv_id, turn, lower(split_part(text, ' ', 1)) IN ('true','false','1','0','nan','none') AS first_is_bool, lower(role) IN ('true','false','1','0','nan','none') AS role_is_bool FROM conversations")
def fn_is_bool_word(t):
    return t.conversations.select(
        "conv_id",
        "turn",
        V.is_bool_word(F.split_part(F.col("text"), F.lit(" "), F.lit(1))).alias("first_is_bool"),
        V.is_bool_word(F.col("role")).alias("role_is_bool"),
    )


@query("fn_unquote", """
WITH x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat('''', p_name, '''') WHEN 1 THEN concat('"', p_name, '''') ELSE p_name END AS s FROM part)
SELECT p_partkey, CASE WHEN left(s, 1) = right(s, 1) AND left(s, 1) IN ('''', '"') THEN substr(s, 2, length(s) - 2) ELSE s END AS answer FROM x""")
def fn_unquote(t):
    name = F.col("p_name")
    text = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("'"), name, F.lit("'")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit('"'), name, F.lit("'")))
        .otherwise(name)
    )
    return t.part.select("p_partkey", V.unquote(text).alias("answer"))


@query("column_numeric_or_text", on_w(f"""
SELECT id, CASE WHEN (SELECT bool_and(c3 IS NULL OR c3 = '' OR ({num_sql('c3')}) IS NOT NULL) FROM w) THEN {num_sql('c3')} END AS c3_number,
       CASE WHEN NOT (SELECT bool_and(c3 IS NULL OR c3 = '' OR ({num_sql('c3')}) IS NOT NULL) FROM w) THEN c3 END AS c3_text,
       c4::DOUBLE AS c4_number, CAST(NULL AS VARCHAR) AS c4_text
FROM w"""))
def column_numeric_or_text(t):
    w = t.w.withColumn("c4", F.col("c4").cast("string"))
    c3, c4 = V.numeric_or_text(w, "c3"), V.numeric_or_text(w, "c4")
    return w.select(
        "id", c3[0].alias("c3_number"), c3[1].alias("c3_text"), c4[0].alias("c4_number"), c4[1].alias("c4_text")
    )


@query("fn_clean_quotes", "SELECT doc_id, replace(text, '''', ' ') AS text, replace(source, '''', ' ') AS source FROM documents")
def fn_clean_quotes(t):
    return V.clean_quotes(t.documents.select("doc_id", "text", "source"))


@query("fn_integral_cast", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(l_extendedprice AS VARCHAR) AS price FROM lineitem")
def fn_integral_cast(t):
    rows = t.lineitem
    return rows.select(
        "l_orderkey", "l_linenumber",
        V.integral_text(rows, "l_quantity").alias("quantity"),
        V.integral_text(rows, "l_extendedprice").alias("price"),
    )


# ---- order and limit ----------------------------------------------------------


@query("order_asc", on_w("SELECT id, c1, c3, row_number() OVER (ORDER BY c1, id) AS rank FROM w WHERE c1 IS NOT NULL AND c3 IS NOT NULL"))
def order_asc(t):
    return S.ranked(t.w.select("id", "c1", "c3"), "c3", "c1")


@query("order_desc", on_w("SELECT id, c2, row_number() OVER (ORDER BY c2 DESC, id) AS rank FROM w"))
def order_desc(t):
    return S.ranked(t.w.select("id", "c2"), "c2", "c2", desc=True)


@query("order_desc_constant", on_w("SELECT id, c5, row_number() OVER (ORDER BY id DESC) AS rank FROM w WHERE c5 = 'F'"))
def order_desc_constant(t):
    return S.ranked(t.w.filter("c5 = 'F'").select("id", "c5"), "c5", "c5", desc=True)


@query("order_by_group_agg", on_w("SELECT c4, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c4) AS rank FROM w GROUP BY c4"))
def order_by_group_agg(t):
    groups = S.group_agg(t.w, "c4", F.count(F.lit(1)).alias("n"))
    return S.ranked(groups, "c4", "n", desc=True, order_id="c4")


@query("order_by_expr", on_w("SELECT id, row_number() OVER (ORDER BY abs(c4 - id), id) AS rank FROM w"))
def order_by_expr(t):
    rows = t.w.select("id", F.abs(F.col("c4") - F.col("id")).alias("gap"))
    return S.ranked(rows, "id", "gap").select("id", "rank")


@query("limit_k", on_w("SELECT id, c1 FROM w ORDER BY id LIMIT 25"))
def limit_k(t):
    return S.top(t.w.select("id", "c1"), 25, F.col("id")).drop("rank")


@query("limit_exploded", on_w("SELECT c4, id, c2, row_number() OVER (ORDER BY c4, id) AS rank FROM w ORDER BY c4, id LIMIT 40"))
def limit_exploded(t):
    return S.top(t.w.select("c4", "id", "c2"), 40, F.col("c4"), F.col("id"))


@query("topk", on_w("SELECT id, c2, row_number() OVER (ORDER BY c2 DESC, id) AS rank FROM w ORDER BY c2 DESC, id LIMIT 10"))
def topk(t):
    return S.top(t.w.select("id", "c2"), 10, F.col("c2").desc(), F.col("id"))


@query("sample_cap", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def sample_cap(t):
    return t.documents.select("doc_id", "lang").orderBy("doc_id").limit(100)


@query("first_value", on_w("SELECT c2 FROM w WHERE c5 = 'O' ORDER BY id LIMIT 1"))
def first_value(t):
    return S.first_value(t.w.filter("c5 = 'O'"), "c2")


# ---- set operations -----------------------------------------------------------


@query("intersect_keep_dups", on_w("SELECT l.id, l.c1 FROM w l SEMI JOIN (SELECT DISTINCT c1 FROM w WHERE c2 > 490000) r ON l.c1 IS NOT DISTINCT FROM r.c1 WHERE l.c5 = 'F'"))
def intersect_keep_dups(t):
    left = t.w.filter("c5 = 'F'").select("id", "c1")
    return S.intersect_rows(left, t.w.filter("c2 > 490000").select("c1"), "c1", spread_on="id")


@query("array_keep_in", on_w("SELECT c4, id, c1 FROM w WHERE c4 IS NOT NULL AND c1 IN ('1-URGENT', '2-HIGH')"))
def array_keep_in(t):
    # A grouped intersect keeps the elements of each group's list: one row per kept element.
    kept = t.w.filter(S.all_of(F.col("c4").isNotNull(), F.col("c1").isin("1-URGENT", "2-HIGH")))
    return kept.select("c4", "id", "c1")


@query("group_intersect", on_w("""
SELECT c4, id, c1 FROM w l WHERE c5 = 'F'
AND EXISTS (SELECT 1 FROM w r WHERE r.c5 = 'O' AND r.c4 IS NOT DISTINCT FROM l.c4 AND r.c1 IS NOT DISTINCT FROM l.c1)"""))
def group_intersect(t):
    left = t.w.filter("c5 = 'F'").select("c4", "id", "c1")
    return S.group_intersect(left, t.w.filter("c5 = 'O'"), "c4", "c1")


@query("group_union", on_w("SELECT c4, c1 FROM w WHERE c5 = 'F' UNION SELECT c4, c6 FROM w WHERE c5 = 'O'"))
def group_union(t):
    right = t.w.filter("c5 = 'O'").select("c4", F.col("c6").alias("c1"))
    return S.group_union(t.w.filter("c5 = 'F'"), right, "c4", "c1")


@query("union_distinct", on_w("SELECT c1 AS v FROM w WHERE c5 = 'F' UNION SELECT c6 AS v FROM w WHERE c5 = 'O'"))
def union_distinct(t):
    left = t.w.filter("c5 = 'F'").select(F.col("c1").alias("v"))
    right = t.w.filter("c5 = 'O'").select(F.col("c6").alias("v"))
    return S.union_rows(left, right)


@query("array_union_groups", on_w("""
SELECT DISTINCT c4, c1 FROM w
UNION SELECT DISTINCT c4, unnest(['1-URGENT', '6-NEW']) AS c1 FROM w"""))
def array_union_groups(t):
    # Set union of each group's values with a fixed list: one row per (group, element).
    groups = t.w.select("c4").distinct()
    extra = groups.select("c4", F.explode(F.array(F.lit("1-URGENT"), F.lit("6-NEW"))).alias("c1"))
    return S.union_rows(t.w.select("c4", "c1"), extra)


@query("split_id_algebra", """
SELECT id FROM (
  (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  EXCEPT (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000))
INTERSECT SELECT o_custkey FROM orders""")
def split_id_algebra(t):
    customers, orders = t.customer, t.orders
    seen = [customers.filter("c_acctbal > 0"), customers.filter("c_mktsegment = 'BUILDING'")]
    trained = [orders.filter("o_orderstatus = 'P'"), orders.filter("o_totalprice > 490000")]
    ids = S.union_rows(*[d.select(F.col("c_custkey").alias("id")) for d in seen])
    used = S.union_rows(*[d.select(F.col("o_custkey").alias("id")) for d in trained])
    return S.without(ids, used).intersect(orders.select(F.col("o_custkey").alias("id")))


@query("concat_splits", "SELECT o_orderkey AS id, 'train' AS split FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'validation' FROM orders WHERE o_totalprice > 400000")
def concat_splits(t):
    def part(rows, label):
        return rows.select(F.col("o_orderkey").alias("id"), F.lit(label).alias("split"))

    train = part(t.orders.filter("o_orderstatus = 'F'"), "train")
    return train.unionByName(part(t.orders.filter("o_totalprice > 400000"), "validation"))


# ---- whole query shapes -------------------------------------------------------


@query("shape_filter_topk", on_w("SELECT id, c3, row_number() OVER (ORDER BY c3 DESC, id) AS rank FROM w WHERE agg = 0 AND c1 = '3-MEDIUM' ORDER BY c3 DESC, id LIMIT 5"))
def shape_filter_topk(t):
    rows = S.data_rows(t.w).filter(S.compare(t.w, "c1", "=", "3-MEDIUM")).select("id", "c3")
    return S.top(rows, 5, F.col("c3").desc(), F.col("id"))


@query("shape_group_topk", on_w("SELECT c4, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c4) AS rank FROM w WHERE c2 > 100000 GROUP BY c4 ORDER BY n DESC, c4 LIMIT 10"))
def shape_group_topk(t):
    groups = S.group_agg(t.w.filter(S.compare(t.w, "c2", ">", 100000)), "c4", F.count(F.lit(1)).alias("n"))
    return S.top(groups, 10, F.col("n").desc(), F.col("c4"))


@query("shape_group_having", on_w("SELECT c4, count(*) AS n FROM w WHERE c5 <> 'P' GROUP BY c4 HAVING count(*) > 12"))
def shape_group_having(t):
    groups = S.group_agg(t.w.filter(S.compare(t.w, "c5", "!=", "P")), "c4", F.count(F.lit(1)).alias("n"))
    return groups.filter("n > 12")


@query("shape_count_distinct", on_w("SELECT count(DISTINCT c4) AS answer FROM w WHERE c1 = '1-URGENT'"))
def shape_count_distinct(t):
    return t.w.filter(S.compare(t.w, "c1", "=", "1-URGENT")).agg(F.count_distinct("c4").alias("answer"))


@query("shape_subquery_topk", on_w("SELECT id, c2 FROM w WHERE c3 = (SELECT c3 FROM w WHERE c5 = 'O' ORDER BY c2 DESC, id LIMIT 1)"))
def shape_subquery_topk(t):
    sub = t.w.filter("c5 = 'O'").agg(F.max_by("c3", F.struct("c2", -F.col("id"))))
    return S.where_scalar(t.w, "c3", "=", sub).select("id", "c2")


@query("shape_subquery_and", on_w("SELECT id, c2 FROM w WHERE c2 > (SELECT c2 FROM w WHERE c1 = '1-URGENT' AND c5 = 'F' ORDER BY id LIMIT 1)"))
def shape_subquery_and(t):
    inner = t.w.filter(S.all_of(S.compare(t.w, "c1", "=", "1-URGENT"), S.compare(t.w, "c5", "=", "F")))
    return S.where_scalar(t.w, "c2", ">", S.first_value(inner, "c2")).select("id", "c2")


@query("shape_pair_ordered", on_w("SELECT c1, c2, row_number() OVER (ORDER BY c2, id) AS rank FROM w WHERE c1 IS NOT NULL"))
def shape_pair_ordered(t):
    return S.ranked(t.w.select("id", "c1", "c2"), "c1", "c2").drop("id")


@query("shape_agg_diff", on_w("SELECT round(max(c2) - min(c2), 2) AS answer FROM w WHERE agg = 0"))
def shape_agg_diff(t):
    return S.data_rows(t.w).agg(F.round(F.max("c2") - F.min("c2"), 2).alias("answer"))


@query("shape_union", on_w("SELECT c4 FROM w WHERE c1 = '1-URGENT' UNION SELECT c4 FROM w WHERE c2 > 450000"))
def shape_union(t):
    return S.union_rows(t.w.filter("c1 = '1-URGENT'").select("c4"), t.w.filter("c2 > 450000").select("c4"))


@query("shape_intersect", on_w("SELECT l.id, l.c4 FROM w l SEMI JOIN (SELECT DISTINCT c4 FROM w WHERE c2 > 450000) r ON l.c4 IS NOT DISTINCT FROM r.c4 WHERE l.c1 = '1-URGENT'"))
def shape_intersect(t):
    left = t.w.filter("c1 = '1-URGENT'").select("id", "c4")
    return S.intersect_rows(left, t.w.filter("c2 > 450000").select("c4"), "c4", spread_on="id")
