"""Structured query records answered in batches."""

from pyspark.sql import functions as F

from ..functions.values import locale_float
from ..operators import records as R
from .registry import num_sql, query

# The condition lists of the record batch, (column, operator, literal).
_CONDITIONS = [
    [],
    [(1, 0, "household")],
    [(2, 1, "5000")],
    [(1, 0, "BUILDING"), (2, 1, "1,000")],
    [(1, 0, "MACHINERY"), (2, 2, "5000.5")],
    [(0, 1, "Customer#000000100"), (2, 1, "9,990")],
    [(2, 1, "99999")],
]
# The column each aggregate code selects.
_SELECTED = [0, 2, 1, 0, 2, 2]


def _rows(t):
    """One table per nation, one row per customer, three cells."""
    rows = t.columns("customer", "c_nationkey", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return rows.select(
        F.col("c_nationkey").alias("table_id"),
        F.col("c_custkey").alias("row_id"),
        F.array("c_name", "c_mktsegment", F.col("c_acctbal").cast("string")).alias("cells"),
        F.array(F.lit("text"), F.lit("text"), F.lit("real")).alias("types"),
    )


def _records(t):
    """Every nation with every aggregate code and every condition list."""
    triples = "array<struct<col:int,op:int,val:string>>"

    def listed(conds):
        items = [F.struct(F.lit(c).alias("col"), F.lit(o).alias("op"), F.lit(v).alias("val")) for c, o, v in conds]
        return F.array(*items).cast(triples)

    agg = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("agg")
    choices = F.posexplode(F.array(*[listed(c) for c in _CONDITIONS])).alias("k", "conds")
    spread = t.nation.select(F.col("n_nationkey").alias("table_id"), agg).select("table_id", "agg", choices)
    sel = F.get(F.array(*[F.lit(s) for s in _SELECTED]), F.col("agg"))
    sel = F.when((F.col("agg") == 5) & (F.col("k") == 1), 1).when((F.col("agg") == 1) & (F.col("k") == 4), 0).otherwise(sel)
    query_id = (F.col("table_id") * 1000 + F.col("agg") * 10 + F.col("k")).cast("bigint")
    return spread.select(query_id.alias("query_id"), "table_id", sel.alias("sel"), "agg", "conds")


_BATCH_SQL = """
WITH s AS (
  SELECT CAST(n_nationkey * 1000 + agg * 10 + k AS BIGINT) AS query_id, n_nationkey AS table_id, CAST(agg AS INTEGER) AS agg, k,
         CASE WHEN agg = 5 AND k = 1 THEN 1 WHEN agg = 1 AND k = 4 THEN 0 ELSE [0, 2, 1, 0, 2, 2][agg + 1] END AS sel
  FROM nation, (SELECT unnest(range(6)) AS agg), (SELECT unnest(range(7)) AS k)),
m AS (
  SELECT s.query_id, s.agg, s.sel, c.c_custkey AS row_id,
         CASE s.sel WHEN 0 THEN c.c_name WHEN 1 THEN c.c_mktsegment ELSE CAST(c.c_acctbal AS VARCHAR) END AS cell,
         CASE s.sel WHEN 2 THEN c.c_acctbal END AS num
  FROM s JOIN customer c ON c.c_nationkey = s.table_id
  WHERE CASE s.k WHEN 0 THEN true
                 WHEN 1 THEN c.c_mktsegment = 'HOUSEHOLD'
                 WHEN 2 THEN c.c_acctbal > 5000
                 WHEN 3 THEN c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 1000
                 WHEN 4 THEN c.c_mktsegment = 'MACHINERY' AND c.c_acctbal < 5000.5
                 WHEN 5 THEN c.c_name > 'Customer#000000100' AND c.c_acctbal > 9990
                 ELSE false END)"""

_TOTALS_SQL = _BATCH_SQL + """,
g AS (SELECT query_id, count(*) AS n, bool_and(num IS NOT NULL) AS is_real, round(sum(num), 6) AS total, round(sum(num), 6) / count(*) AS mean,
             max(struct_pack(a := num, b := CASE WHEN sel <> 2 THEN cell END, r := row_id)) AS hi,
             min(struct_pack(a := num, b := CASE WHEN sel <> 2 THEN cell END, r := row_id)) AS lo
      FROM m GROUP BY query_id),
totals AS (
  SELECT s.query_id, s.agg, s.sel, coalesce(n, 0) AS n,
         CASE WHEN s.agg = 3 THEN CAST(coalesce(n, 0) AS DOUBLE) WHEN s.agg = 4 AND is_real THEN total WHEN s.agg = 5 AND is_real THEN mean END AS value,
         CASE WHEN s.agg = 1 THEN hi WHEN s.agg = 2 THEN lo END AS pick
  FROM s LEFT JOIN g ON s.query_id = g.query_id)"""

_ANSWERS_SQL = _TOTALS_SQL + """,
long_answers AS (
  SELECT query_id, CASE WHEN n > 0 THEN pick.r END AS row_id,
         CASE WHEN n = 0 AND agg <> 3 THEN 'none'
              WHEN value IS NOT NULL THEN CAST(value AS VARCHAR)
              WHEN sel = 2 THEN CAST(pick.a AS VARCHAR) ELSE pick.b END AS answer
  FROM totals WHERE (n = 0 AND agg <> 3) OR value IS NOT NULL OR agg IN (1, 2)
  UNION ALL
  SELECT m.query_id, m.row_id, m.cell
  FROM m JOIN totals ON m.query_id = totals.query_id
  WHERE totals.n > 0 AND totals.value IS NULL AND totals.agg NOT IN (1, 2))"""


@query("spec_conditions", """
SELECT o_orderkey AS query_id, CAST(i AS BIGINT) AS pos, CAST([0, 1, 2][i + 1] AS INTEGER) AS col,
       CAST([o_custkey % 3, 0, 1][i + 1] AS INTEGER) AS op, [o_orderpriority, o_orderstatus][i + 1] AS val
FROM orders, (SELECT unnest(range(2)) AS i)""")
def spec_conditions(t):
    triples = R.conditions(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        F.array(F.col("o_custkey") % 3, F.lit(0), F.lit(1)),
        F.array("o_orderpriority", "o_orderstatus"),
    )
    rows = t.orders.select(F.col("o_orderkey").alias("query_id"), F.posexplode(triples).alias("pos", "c"))
    return rows.select("query_id", F.col("pos").cast("bigint").alias("pos"), "c.col", "c.op", "c.val")


@query("spec_typed_cells", """
SELECT c_nationkey AS table_id, c_custkey AS row_id, CAST(0 AS INTEGER) AS col_id, 'text' AS kind, c_name AS text, CAST(NULL AS DOUBLE) AS num FROM customer
UNION ALL SELECT c_nationkey, c_custkey, 1, 'text', c_mktsegment, NULL FROM customer
UNION ALL SELECT c_nationkey, c_custkey, 2, 'real', CAST(c_acctbal AS VARCHAR), c_acctbal FROM customer""")
def spec_typed_cells(t):
    cells = R.typed_rows(_rows(t)).select("table_id", "row_id", F.posexplode("cells").alias("col_id", "c"))
    return cells.select("table_id", "row_id", "col_id", "c.kind", "c.text", "c.num")


_LOCALE_SQL = """x AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN format('{:,.2f}', o_totalprice)
           WHEN 'O' THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',')
           ELSE concat(o_custkey, '.', o_custkey % 7, '.5') END AS s
  FROM orders)"""


@query("fn_locale_float", f"""
WITH {_LOCALE_SQL},
y AS (SELECT o_orderkey, s, CASE
    WHEN contains(s, '.') AND contains(s, ',') THEN replace(s, ',', '')
    WHEN contains(s, ',') AND len(list_filter(string_split(s, ','), lambda p: length(p) = 3)) > 0 THEN replace(s, ',', '')
    WHEN len(string_split(s, ',')) = 2 THEN replace(s, ',', '.')
    WHEN len(string_split(s, '.')) > 2 THEN replace(s, '.', '')
    ELSE replace(s, ',', '') END AS bare FROM x)
SELECT o_orderkey, s, {num_sql('bare')} AS answer FROM y""")
def fn_locale_float(t):
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.format_number(price, 2))
        .when(F.col("o_orderstatus") == "O", F.replace(price.cast("string"), F.lit("."), F.lit(",")))
        .otherwise(F.concat(cust, F.lit("."), cust % 7, F.lit(".5")))
    )
    return t.orders.select("o_orderkey", text.alias("s")).select("o_orderkey", "s", locale_float(F.col("s")).alias("answer"))


@query("spec_text_match", r"""
WITH x AS (SELECT page_id, regexp_extract_all(lower(url), '([0-9A-Za-z_]+|[^0-9A-Za-z_\s]+)', 1) AS a,
                  regexp_extract_all('http://m.example.org/EN/5', '([0-9A-Za-z_]+|[^0-9A-Za-z_\s]+)', 1) AS b FROM pages)
SELECT page_id, array_to_string(a, ' ') AS tokens, a = list_transform(b, lambda s: lower(s)) AS eq, a > list_transform(b, lambda s: lower(s)) AS gt,
       a < list_transform(b, lambda s: lower(s)) AS lt FROM x""")
def spec_text_match(t):
    mine, other = R.match_tokens(F.col("url")), R.match_tokens(F.lit("http://m.example.org/EN/5"))
    return t.pages.select(
        "page_id", F.array_join(mine, " ").alias("tokens"),
        (mine == other).alias("eq"), (mine > other).alias("gt"), (mine < other).alias("lt"),
    )


@query("spec_matching_rows", _BATCH_SQL + " SELECT query_id, row_id FROM m")
def spec_matching_rows(t):
    return R.matching_rows(_records(t), _rows(t)).select("query_id", "row_id")


@query("spec_type_errors", """
WITH r AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END AS val FROM orders)
SELECT query_id, CAST(CASE WHEN try_cast(val AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS BIGINT) AS type_errors FROM r""")
def spec_type_errors(t):
    literal = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    conds = F.array(
        F.struct(F.lit(2).alias("col"), F.lit(1).alias("op"), literal.alias("val")),
        F.struct(F.lit(1).alias("col"), F.lit(0).alias("op"), F.lit("x").alias("val")),
    )
    nation = F.col("o_custkey") % 25
    records = t.orders.select(F.col("o_orderkey").alias("query_id"), nation.cast("int").alias("table_id"), conds.alias("conds"))
    return R.type_errors(records, _rows(t))


def _extremes(name, agg):
    @query(name, _TOTALS_SQL + f" SELECT query_id, pick.r AS row_id, CASE WHEN sel = 2 THEN CAST(pick.a AS VARCHAR) ELSE pick.b END AS answer FROM totals WHERE agg = {agg} AND n > 0")
    def build(t):
        chosen = R.extremes(_records(t).filter(F.col("agg") == agg), _rows(t))
        return chosen.select("query_id", "extreme.row_id", F.col("extreme.cell.text").alias("answer"))


_extremes("spec_argmax", R.MAX)
_extremes("spec_argmin", R.MIN)


@query("spec_aggregate", _TOTALS_SQL + " SELECT query_id, agg, n AS rows, value FROM totals WHERE agg >= 3")
def spec_aggregate(t):
    return R.numbers(_records(t).filter("agg >= 3"), _rows(t), digits=6)


@query("spec_answer_rows", _ANSWERS_SQL + " SELECT query_id, row_id, answer FROM long_answers")
def spec_answer_rows(t):
    return R.answers(_records(t), _rows(t), digits=6)


@query("spec_answers", _ANSWERS_SQL + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_id) - 1 AS place FROM long_answers)
SELECT query_id, place // 4096 AS part, string_agg(answer, ', ' ORDER BY place) AS answer
FROM placed GROUP BY query_id, place // 4096""")
def spec_answers(t):
    return R.answer_texts(R.answers(_records(t), _rows(t), digits=6))


def _order_records(t):
    """One record per order with up to two conditions."""
    triples = "array<struct<col:int,op:int,val:string>>"
    first = F.struct(F.lit(0).alias("col"), F.lit(0).alias("op"), F.col("o_orderpriority").alias("val"))
    second = F.struct(F.lit(2).alias("col"), F.lit(1).alias("op"), F.col("o_custkey").cast("string").alias("val"))
    conds = (
        F.when(F.col("o_orderstatus") == "F", F.array(first, second))
        .when(F.col("o_orderstatus") == "O", F.array(second))
        .otherwise(F.array().cast(triples))
    )
    return t.orders.select(
        F.col("o_orderkey").alias("query_id"),
        (F.col("o_custkey") % 3).cast("int").alias("sel"),
        (F.col("o_custkey") % 6).cast("int").alias("agg"),
        conds.alias("conds"),
        "o_orderstatus",
    )


@query("spec_to_text", """
SELECT o_orderkey AS query_id, concat('SELECT ', ['', 'MAX', 'MIN', 'COUNT', 'SUM', 'AVG'][o_custkey % 6 + 1], ' col', o_custkey % 3, ' FROM table',
  CASE o_orderstatus WHEN 'F' THEN concat(' WHERE col0 = "', o_orderpriority, '" AND col2 > "', o_custkey, '"')
                     WHEN 'O' THEN concat(' WHERE col2 > "', o_custkey, '"') ELSE '' END) AS text
FROM orders""")
def spec_to_text(t):
    text = R.record_text(F.col("agg"), F.col("sel"), F.col("conds"))
    return _order_records(t).select("query_id", text.alias("text"))


@query("spec_match_rate", """
SELECT o_orderstatus, count(*) AS n,
       round(avg(CASE WHEN o_custkey % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS any_order,
       round(avg(CASE WHEN o_custkey % 7 <> 0 AND o_orderstatus <> 'F' THEN 1.0 ELSE 0.0 END), 6) AS in_order
FROM orders GROUP BY o_orderstatus""")
def spec_match_rate(t):
    gold = _order_records(t)
    shouted = F.transform(
        F.reverse("conds"),
        lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), F.upper(c["val"]).alias("val")),
    )
    # Wrong guesses select another column.
    wrong = t.orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 7 == 0).alias("wrong"))
    guess = F.struct((F.col("sel") + F.col("wrong").cast("int")).alias("sel"), "agg", shouted.alias("conds"))
    pairs = gold.join(wrong, "query_id").select(
        "o_orderstatus", F.struct("sel", "agg", "conds").alias("gold"), guess.alias("guess")
    )

    def rate(in_order):
        return F.round(F.avg(R.same_record(F.col("gold"), F.col("guess"), in_order).cast("double")), 6)

    return pairs.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), rate(False).alias("any_order"), rate(True).alias("in_order")
    )
