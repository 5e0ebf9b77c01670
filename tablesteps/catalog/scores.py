"""Answer normalisation, scoring and roll-ups."""

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import evaluation as E
from ..session import scratch_folder
from ..sources.results import finished, score_open
from .registry import num_sql, query

# Targets and predictions for every part; the variant decides how the prediction differs.
_PAIRS_SQL = """pairs AS (
  SELECT p_partkey AS id, p_partkey % 7 AS variant,
         CASE p_partkey % 7 WHEN 3 THEN [CAST(p_size AS VARCHAR)] WHEN 4 THEN string_split(p_name, ' ') WHEN 5 THEN ['no'] ELSE [p_name] END AS target,
         CASE p_partkey % 7 WHEN 0 THEN [p_name] WHEN 1 THEN [upper(p_name)] WHEN 2 THEN [concat(p_name, '[1]')]
              WHEN 3 THEN [concat(p_size, ' kg')] WHEN 4 THEN list_reverse(string_split(p_name, ' ')) WHEN 5 THEN ['none']
              ELSE [p_brand] END AS prediction,
         concat('run/checkpoint-', (p_partkey % 4 + 1) * 1000) AS checkpoint
  FROM part)"""


def _pairs(t):
    variant, name = F.col("p_partkey") % 7, F.col("p_name")
    size = F.col("p_size").cast("string")
    words = F.split(name, " ")
    target = (
        F.when(variant == 3, F.array(size)).when(variant == 4, words).when(variant == 5, F.array(F.lit("no")))
        .otherwise(F.array(name))
    )
    prediction = (
        F.when(variant == 0, F.array(name))
        .when(variant == 1, F.array(F.upper(name)))
        .when(variant == 2, F.array(F.concat(name, F.lit("[1]"))))
        .when(variant == 3, F.array(F.concat(size, F.lit(" kg"))))
        .when(variant == 4, F.reverse(words))
        .when(variant == 5, F.array(F.lit("none")))
        .otherwise(F.array("p_brand"))
    )
    step = ((F.col("p_partkey") % 4 + 1) * 1000).cast("string")
    return t.columns("part", "p_partkey", "p_name", "p_brand", "p_size").select(
        F.col("p_partkey").alias("id"),
        target.alias("target"),
        prediction.alias("prediction"),
        F.concat(F.lit("run/checkpoint-"), step).alias("checkpoint"),
    )


def _bare_sql(text):
    for unit in S.UNITS:
        text = f"lower(trim(replace({text}, '{unit}', '')))"
    return text


_NORM = r"lower(trim(regexp_replace(x, '\[[0-9]+\]$', '')))"
_SETS = f"list_distinct(list_transform(target, lambda x: {_NORM})) AS ts, list_distinct(list_transform(prediction, lambda x: {_NORM})) AS ps"
_STRICT = "(len(ts) = len(ps) AND len(list_filter(ts, lambda v: NOT list_contains(ps, v))) = 0)"
_WORDS = "(['none','no','older','lower','less','below','false','f'])"
_FLEXIBLE = (
    f"(list_transform(target, lambda x: {_bare_sql('x')}) = list_transform(prediction, lambda x: {_bare_sql('x')})"
    f" OR (len(ts) = 1 AND len(ps) = 1 AND list_contains({_WORDS}, ts[1]) AND list_contains({_WORDS}, ps[1])) OR {_STRICT})"
)
_SCORED_SQL = f"""
WITH {_PAIRS_SQL}, sets AS (SELECT *, {_SETS} FROM pairs),
scored AS (SELECT id, checkpoint, {_STRICT} AS strict, {_FLEXIBLE} AS flexible,
                  array_to_string(target, ', ') = array_to_string(prediction, ', ') AS exact FROM sets)"""


@query("normalize_answer")
def normalize_answer(t):
    """Whole document texts in every language; checked against a brute-force loop in the tests."""
    return t.columns("documents", "doc_id", "text").select("doc_id", S.normalize(F.col("text")).alias("answer"))


@query("normalize_answer_ascii", """
WITH x AS (SELECT c_custkey, concat('  ', c_name, '  of   ', c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN '.' ELSE ' ' END) AS s FROM customer)
SELECT c_custkey, trim(regexp_replace(lower(regexp_replace(trim(regexp_replace(s, '#', ' ', 'g')), '\\.$', '')), ' +', ' ', 'g')) AS answer FROM x""")
def normalize_answer_ascii(t):
    end = F.when(F.col("c_nationkey") % 2 == 0, ".").otherwise(" ")
    text = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("  of   "), "c_mktsegment", end)
    return t.customer.select("c_custkey", S.normalize_plain(text).alias("answer"))


_VALUE_SQL = """x AS (
  SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN concat('xx-', strftime(o_orderdate, '%m-%d'))
     WHEN 2 THEN concat(year(o_orderdate), '-XX-xx') WHEN 3 THEN CAST(o_totalprice AS VARCHAR) WHEN 4 THEN concat(o_custkey, '.0')
     ELSE concat(year(o_orderdate), '-13-', o_orderpriority) END AS s FROM orders)"""


def _value_texts(t):
    variant, day = F.col("o_custkey") % 6, F.col("o_orderdate")
    text = (
        F.when(variant == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(variant == 1, F.concat(F.lit("xx-"), F.date_format(day, "MM-dd")))
        .when(variant == 2, F.concat(F.year(day), F.lit("-XX-xx")))
        .when(variant == 3, F.col("o_totalprice").cast("string"))
        .when(variant == 4, F.concat("o_custkey", F.lit(".0")))
        .otherwise(F.concat(F.year(day), F.lit("-13-"), "o_orderpriority"))
    )
    rows = t.columns("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return rows.select(F.col("o_orderkey").alias("id"), text.alias("s"))


@query("typed_value", f"""
WITH {_VALUE_SQL}, p AS (SELECT id, s, string_split(lower(s), '-') AS parts, {num_sql('s')} AS n FROM x),
q AS (SELECT *, len(parts) = 3 AS three,
        CASE WHEN parts[1] IN ('xx', 'xxxx') THEN -1 ELSE try_cast(parts[1] AS INTEGER) END AS yy,
        CASE WHEN parts[2] = 'xx' THEN -1 WHEN try_cast(parts[2] AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(parts[2] AS INTEGER) END AS mm,
        CASE WHEN parts[3] = 'xx' THEN -1 WHEN try_cast(parts[3] AS INTEGER) BETWEEN 1 AND 31 THEN try_cast(parts[3] AS INTEGER) END AS dd FROM p),
r AS (SELECT *, coalesce(n, CASE WHEN three AND yy > 0 AND mm = -1 AND dd = -1 THEN CAST(yy AS DOUBLE) END) AS num,
        coalesce(three AND yy IS NOT NULL AND mm IS NOT NULL AND dd IS NOT NULL, false) AS is_date FROM q)
SELECT id, CASE WHEN num IS NOT NULL THEN 'N' WHEN is_date THEN 'D' ELSE 'S' END AS kind, lower(s) AS norm, num,
       CASE WHEN num IS NULL AND is_date THEN yy END AS y, CASE WHEN num IS NULL AND is_date THEN mm END AS m,
       CASE WHEN num IS NULL AND is_date THEN dd END AS d FROM r""")
def typed_value(t):
    rows = _value_texts(t).withColumn("n", S.normalize_plain(F.col("s")))
    typed = rows.select("id", S.typed_value(F.col("s"), F.col("n")).alias("v"))
    return typed.select("id", "v.kind", "v.norm", "v.num", "v.y", "v.m", "v.d")


@query("typed_value_set", """
SELECT p_partkey AS id, CAST(CASE WHEN p_size = 1 THEN 2 ELSE 3 END AS BIGINT) AS n,
       CASE WHEN p_size = 1 THEN concat('N:1.0 | S:', p_name) ELSE concat('N:', CAST(p_size AS DOUBLE), ' | S:', p_name, ' | N:1.0') END AS keys
FROM part""")
def typed_value_set(t):
    size = F.col("p_size").cast("string")
    items = F.array(size, F.concat(size, F.lit(".0")), F.col("p_name"), F.upper("p_name"), F.lit("1"))
    rows = t.part.select(F.col("p_partkey").alias("id"), items.alias("items"))
    typed = rows.withColumn("n", S.normalize_list(F.col("items"))).select(
        "id", S.typed_values(F.col("items"), F.col("n")).alias("v")
    )
    unique = typed.select("id", S.as_set(F.col("v")).alias("v"))
    keys = F.array_join(F.transform("v", lambda v: v["key"]), " | ")
    return unique.select("id", F.size("v").cast("bigint").alias("n"), keys.alias("keys"))


@query("score_strict", _SCORED_SQL + " SELECT id, strict FROM scored")
def score_strict(t):
    return E.scored(_pairs(t)).select("id", "strict")


@query("score_flexible", _SCORED_SQL + " SELECT id, flexible FROM scored")
def score_flexible(t):
    return E.scored(_pairs(t)).select("id", "flexible")


# The blocks of a pair of short texts: of all places in both, the longest common run, the first one in the left and then
# in the right text, and so on left and right of it.
_FUZZY_SQL = f"""
WITH RECURSIVE {_PAIRS_SQL},
texts AS (SELECT id, checkpoint, lower(array_to_string(target, ', ')) AS a, lower(array_to_string(prediction, ', ')) AS b FROM pairs),
windows AS (
  SELECT id, a, b, CAST(0 AS BIGINT) AS size FROM texts WHERE a <> b
  UNION ALL
  SELECT id, unnest([a[1:i - 1], a[i + k:]]), unnest([b[1:j - 1], b[j + k:]]), unnest([k, 0])
  FROM (SELECT id, a, b, best.k AS k, -best.i AS i, -best.j AS j FROM (
    SELECT id, a, b, list_aggregate(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(
             list_filter(range(1, length(b) + 1), lambda j: a[i:i] = b[j:j]),
             lambda j: struct_pack(k := list_aggregate(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda n: a[i:i + n - 1] = b[j:j + n - 1]), 'max'), i := -i, j := -j)))), 'max') AS best
    FROM windows WHERE length(a) > 0 AND length(b) > 0) WHERE best IS NOT NULL)),
fuzzy AS (
  SELECT id, checkpoint, CAST(coalesce(round_even(any_value(100 * (CAST(2 AS DOUBLE) * size / (length(t.a) + length(t.b)))), 0), 100) AS INTEGER) AS fuzzy
  FROM texts t LEFT JOIN (SELECT id, sum(size) AS size FROM windows GROUP BY id) USING (id) GROUP BY id, checkpoint)"""


@query("score_fuzzy", _FUZZY_SQL + " SELECT id, fuzzy FROM fuzzy")
def score_fuzzy(t):
    return E.scored(_pairs(t)).select("id", "fuzzy")


@query("score_multiset", f"""
WITH {_PAIRS_SQL}
SELECT id, list_sort(string_split(lower(array_to_string(target, ', ')), ', ')) = list_sort(string_split(lower(array_to_string(prediction, ', ')), ', ')) AS multiset
FROM pairs""")
def score_multiset(t):
    return E.scored(_pairs(t)).select("id", "multiset")


@query("score_exact", _SCORED_SQL + " SELECT checkpoint, round(avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END), 6) AS exact FROM scored GROUP BY checkpoint")
def score_exact(t):
    same = F.array_join("target", ", ") == F.array_join("prediction", ", ")
    rows = _pairs(t).select("checkpoint", same.alias("exact"))
    return E.by_checkpoint(rows).select("checkpoint", F.round("exact", 6).alias("exact"))


def _results(t):
    same = F.array_join("target", ", ") == F.array_join("prediction", ", ")
    rows = E.scored(_pairs(t)).withColumn("exact", same)
    return E.by_checkpoint(rows.select("checkpoint", *E.METRICS))


_RESULTS_SQL = _FUZZY_SQL + _SCORED_SQL.removeprefix(f"\nWITH {_PAIRS_SQL}") + """,
results AS (SELECT s.checkpoint, count(*) AS n, avg(exact::INT) AS exact, avg(fuzzy) AS fuzzy, avg(strict::INT) AS strict, avg(flexible::INT) AS flexible
            FROM scored s JOIN fuzzy f ON s.id = f.id GROUP BY s.checkpoint)"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)


def _rounded():
    return [F.round(m, 6).alias(m) for m in E.METRICS]


@query("score_by_checkpoint", _RESULTS_SQL + f" SELECT checkpoint, n, {_ROUNDED} FROM results")
def score_by_checkpoint(t):
    return _results(t).select("checkpoint", "n", *_rounded())


@query("resume_results", _RESULTS_SQL + f" SELECT checkpoint, n, {_ROUNDED} FROM results")
def resume_results(t):
    """A run that is stopped after its first checkpoint, and one that goes on from its log."""
    folder = scratch_folder(t.spark, "results")
    rows = _pairs(t).withColumn("exact", F.array_join("target", ", ") == F.array_join("prediction", ", "))
    next(score_open(rows, folder))
    for _ in score_open(rows, folder):
        pass
    return finished(t.spark, folder).select("checkpoint", "n", *_rounded())


@query("best_checkpoint", _RESULTS_SQL + f" SELECT checkpoint, n, {_ROUNDED} FROM results ORDER BY results.flexible DESC, checkpoint LIMIT 1")
def best_checkpoint(t):
    return E.best_checkpoint(_results(t)).select("checkpoint", "n", *_rounded())


@query("checkpoint_curve", _RESULTS_SQL + f" SELECT CAST(split_part(checkpoint, '-', -1) AS BIGINT) AS step, {_ROUNDED} FROM results")
def checkpoint_curve(t):
    return E.checkpoint_curve(_results(t)).select("step", *_rounded())


_CELLS_SQL = """x AS (
  SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat(p_size, '| ', p_partkey) WHEN 1 THEN concat(p_size, '.5| 2')
    WHEN 2 THEN concat('00', p_size, '| 1') WHEN 3 THEN 't| f' WHEN 4 THEN concat(p_name, ',, ', p_brand, '| c')
    WHEN 5 THEN concat(p_size, '| none') WHEN 6 THEN concat(p_size, ',, 2| 3') ELSE '' END AS s FROM part)"""


@query("infer_cell_type", rf"""
WITH {_CELLS_SQL}, y AS (SELECT id, s, string_split(s, '| ') AS items, string_split(replace(s, '| ', ',, '), ',, ') AS parts FROM x),
z AS (SELECT id, s, items, parts,
   len(list_filter(items, lambda c: NOT regexp_full_match(c, '(0|[+-]?[1-9][0-9]*)'))) = 0 AS ints,
   len(list_filter(items, lambda c: NOT regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') OR regexp_matches(c, '^0[0-9]'))) = 0 AS floats,
   len(list_filter(items, lambda c: c NOT IN ('t', 'f'))) = 0 AS bools,
   contains(s, ',, ') AS nested,
   len(list_filter(parts, lambda c: NOT regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') OR regexp_matches(c, '^0[0-9]'))) = 0 AS numbers FROM y)
SELECT id, CASE WHEN trim(s) = '' THEN 'empty' WHEN ints THEN 'int' WHEN floats THEN 'float' WHEN bools THEN 'bool'
                WHEN nested AND numbers THEN 'numbers' WHEN nested THEN 'lists' ELSE 'text' END AS kind,
       CAST(CASE WHEN trim(s) = '' THEN 0 ELSE len(items) END AS BIGINT) AS n,
       CASE WHEN trim(s) = '' THEN '[]' WHEN ints THEN concat('[', array_to_string(items, ','), ']')
            WHEN floats THEN concat('[', array_to_string(list_transform(items, lambda c: CAST(CAST(c AS DOUBLE) AS VARCHAR)), ','), ']')
            WHEN bools THEN concat('[', array_to_string(list_transform(items, lambda c: CASE c WHEN 't' THEN 'true' ELSE 'false' END), ','), ']')
            WHEN nested AND numbers THEN concat('[', array_to_string(list_transform(items, lambda c: concat('[', array_to_string(list_transform(string_split(c, ',, '), lambda p: CAST(CAST(p AS DOUBLE) AS VARCHAR)), ','), ']')), ','), ']')
            WHEN nested THEN concat('[', array_to_string(list_transform(items, lambda c: concat('[', array_to_string(list_transform(string_split(c, ',, '), lambda p: concat('"', p, '"')), ','), ']')), ','), ']')
            ELSE concat('[', array_to_string(list_transform(items, lambda c: CASE c WHEN 'none' THEN 'null' ELSE concat('"', c, '"') END), ','), ']') END AS vals FROM z""")
def infer_cell_type(t):
    size, variant = F.col("p_size"), F.col("p_partkey") % 8
    text = (
        F.when(variant == 0, F.concat(size, F.lit("| "), "p_partkey"))
        .when(variant == 1, F.concat(size, F.lit(".5| 2")))
        .when(variant == 2, F.concat(F.lit("00"), size, F.lit("| 1")))
        .when(variant == 3, F.lit("t| f"))
        .when(variant == 4, F.concat("p_name", F.lit(",, "), "p_brand", F.lit("| c")))
        .when(variant == 5, F.concat(size, F.lit("| none")))
        .when(variant == 6, F.concat(size, F.lit(",, 2| 3")))
        .otherwise(F.lit(""))
    )
    cells = t.part.select(F.col("p_partkey").alias("id"), text.alias("s"))
    n = F.size(S.cell_list(F.col("s"))).cast("bigint")
    values = F.to_json(S.cell_values(F.col("s")))
    return cells.select("id", S.cell_list_kind(F.col("s")).alias("kind"), n.alias("n"), values.alias("vals"))


@query("render_answer", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = left(o_orderpriority, 1) OR o_custkey % 2 = 0 THEN o_orderstatus
       ELSE concat(o_orderstatus, ' | ', o_orderpriority) END AS answer FROM orders""")
def render_answer(t):
    items = F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderstatus", "o_orderstatus")).otherwise(
        F.array("o_orderstatus", "o_orderpriority")
    )
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.array_join(S.render_answer(items), " | ").alias("answer")
    )


@query("render_nested_answer", """
WITH r AS (SELECT o_orderkey AS id, CASE o_custkey % 6
   WHEN 0 THEN [CAST(o_custkey AS VARCHAR), concat(o_custkey, '.5'), o_orderstatus] WHEN 1 THEN ['True', 'False', 'None', o_orderpriority]
   WHEN 2 THEN [o_orderstatus] WHEN 3 THEN [] WHEN 4 THEN [concat(o_custkey, '.0')] ELSE ['1', 'True', '1'] END AS items FROM orders)
SELECT id, array_to_string(items, ' | ') AS answer, CAST(len(items) AS BIGINT) AS n FROM r""")
def render_nested_answer(t):
    """Answers as values, lists and lists of lists, as an executed plan gives them."""
    variant, cust = F.col("o_custkey") % 6, F.col("o_custkey")
    nested = (
        F.when(variant == 0, F.concat(F.lit("[["), cust, F.lit(", [["), cust, F.lit('.5]]], "'), "o_orderstatus", F.lit('"]')))
        .when(variant == 1, F.concat(F.lit('[true, [false, [null]], ["'), "o_orderpriority", F.lit('"]]')))
        .when(variant == 2, F.concat(F.lit('[["'), "o_orderstatus", F.lit('"], "'), "o_orderstatus", F.lit('"]')))
        .when(variant == 3, F.lit("[[], [[]]]"))
        .when(variant == 4, F.concat(cust, F.lit("e0")))
        .otherwise(F.lit("[1, [true, 1]]"))
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), S.render_values(F.parse_json(nested)).alias("items"))
    return rows.select("id", F.array_join("items", " | ").alias("answer"), F.size("items").cast("bigint").alias("n"))


@query("eval_agg_string", """
SELECT o_orderkey AS id, CASE o_custkey % 7
   WHEN 0 THEN CAST(o_custkey + 2 AS VARCHAR) WHEN 1 THEN CAST((o_custkey + 2) / 2 AS VARCHAR) WHEN 2 THEN '2'
   WHEN 3 THEN o_orderpriority WHEN 4 THEN concat(o_orderpriority, ' | ', 1) WHEN 5 THEN CAST(o_custkey AS VARCHAR)
   ELSE concat(o_orderstatus, ' | ', o_orderpriority) END AS answer FROM orders""")
def eval_agg_string(t):
    variant, cust = F.col("o_custkey") % 7, F.col("o_custkey").cast("string")
    text = (
        F.when(variant == 0, F.concat(F.lit("SUM > "), cust, F.lit(", 2")))
        .when(variant == 1, F.concat(F.lit("AVERAGE > "), cust, F.lit(", 2")))
        .when(variant == 2, F.concat(F.lit("COUNT > "), cust, F.lit(", b")))
        .when(variant == 3, F.concat(F.lit("NONE > "), "o_orderpriority"))
        .when(variant == 4, F.concat(F.lit("SUM > "), "o_orderpriority", F.lit(", 1")))
        .when(variant == 5, F.concat(F.lit("SUM > "), cust))
        .otherwise(F.concat("o_orderstatus", F.lit(", "), "o_orderpriority"))
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), text.alias("s"))
    return rows.select("id", F.array_join(S.eval_agg_text(F.col("s")), " | ").alias("answer"))


@query("accuracy_by_operator", """
WITH x AS (SELECT unnest(CASE o_orderpriority WHEN '1-URGENT' THEN ['P', 'C', 'S'] WHEN '2-HIGH' THEN ['P', 'GB', 'OB', 'L', 'A']
             WHEN '3-MEDIUM' THEN ['P', 'A', 'OP'] WHEN '4-NOT SPECIFIED' THEN ['P', 'GB', 'H', 'C', 'A'] ELSE ['P'] END) AS kind,
           o_totalprice > 100000 AS ok FROM orders)
SELECT kind, count(*) AS total, count(*) FILTER (WHERE NOT ok) AS wrong,
       round((1 - count(*) FILTER (WHERE NOT ok) / count(*)) * 100, 6) AS accuracy FROM x GROUP BY kind""")
def accuracy_by_operator(t):
    def kinds(*names):
        return F.array(*[F.lit(n) for n in names])

    priority = F.col("o_orderpriority")
    used = (
        F.when(priority == "1-URGENT", kinds("P", "C", "S", "C", "P"))
        .when(priority == "2-HIGH", kinds("P", "GB", "OB", "L", "A"))
        .when(priority == "3-MEDIUM", kinds("P", "A", "OP", "A"))
        .when(priority == "4-NOT SPECIFIED", kinds("P", "GB", "H", "C", "A"))
        .otherwise(kinds("P"))
    )
    rows = t.orders.select(used.alias("kinds"), (F.col("o_totalprice") > 100000).alias("flexible"))
    return E.accuracy_by_kind(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("results_equal", """
SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS equal FROM customer""")
def results_equal(t):
    balance = F.col("c_acctbal")
    variant = F.col("c_nationkey") % 4
    left = F.array(F.col("c_name"), balance.cast("string"))
    right = (
        F.when(variant == 0, left)
        .when(variant == 1, F.array(F.col("c_name"), F.round(balance + 0.000004, 6).cast("string")))
        .when(variant == 2, F.array(F.col("c_name"), (balance + 1).cast("string")))
        .otherwise(F.array(F.col("c_name")))
    )
    return t.customer.select(F.col("c_custkey").alias("id"), S.results_equal(left, right).alias("equal"))


@query("anti_join_done", """
SELECT c_custkey AS checkpoint FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') <> 0)""")
def anti_join_done(t):
    done = t.orders.groupBy(F.col("o_custkey").alias("checkpoint")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("fuzzy")
    )
    return E.to_redo(t.customer.select(F.col("c_custkey").alias("checkpoint")), done)
