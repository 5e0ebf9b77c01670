"""Corpus reading shapes, id joins, data set building, serialisation and permutation."""

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators.positions import positions
from ..session import scratch_folder
from ..sources import readers as R
from ..sources.json_arrays import save_json_array
from ..sources.writers import save_lines
from .registry import on_w, query

_SUBSETS = list(D.SUBSETS)


def _nation_rows(t):
    """Customers as one table per nation, with row positions from 0."""
    rows = t.customer.select(
        F.col("c_nationkey").alias("table_id"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal"
    )
    return positions(rows, [F.col("c_custkey")], keys=["table_id"])


_NATION_SQL = """r AS (
  SELECT c_nationkey AS table_id, c_custkey, c_name, c_mktsegment, c_acctbal,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)"""

# ---- reading shapes -----------------------------------------------------------


@query("corpus_sql_text", "SELECT o_orderkey AS id, concat('select c1 from w where c2 > ', o_totalprice, ' and c5 = ', o_orderstatus) AS sql FROM orders")
def corpus_sql_text(t):
    def token(kind, text):
        return F.array(F.lit(kind), text)

    tokens = F.array(
        *[token("Keyword", F.lit(w)) for w in "select c1 from w where c2 >".split()],
        token("Literal.Number", F.col("o_totalprice").cast("string")),
        *[token("Keyword", F.lit(w)) for w in "and c5 =".split()],
        token("Literal.String", F.col("o_orderstatus")),
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), R.sql_text(tokens).alias("sql"))


@query("corpus_json_array", r"""
SELECT concat('nt-', o_orderkey, ' {"\}', o_orderpriority) AS nt, concat('t', o_custkey) AS tbl,
       concat('select c1 from w where c5 = ', o_orderstatus, '} "', chr(10)) AS sql FROM orders""")
def corpus_json_array(t):
    """A corpus written as JSON arrays and read back by byte ranges."""
    folder = scratch_folder(t.spark, "corpus")
    words = [F.array(F.lit("Keyword"), F.lit(w)) for w in "select c1 from w where c5 =".split()]
    literal = F.array(F.lit("Literal.String"), F.concat("o_orderstatus", F.lit('} "\n')))
    save_json_array(t.orders.select(
        F.concat(F.lit("nt-"), "o_orderkey", F.lit(' {"\\}'), "o_orderpriority").alias("nt"),
        F.concat(F.lit("t"), "o_custkey").alias("tbl"), F.array(*words, literal).alias("sql"),
    ), folder)
    return R.read_corpus(t.spark, folder)


@query("tsv_targets", r"""
SELECT o_orderkey AS id, concat(o_orderpriority, chr(10), 'x') AS first, concat(o_orderstatus, '|', chr(92)) AS second,
       CAST(2 AS BIGINT) AS n, CAST(o_custkey AS VARCHAR) AS canon
FROM orders""")
def tsv_targets(t):
    raw = F.concat("o_orderpriority", F.lit("\\nx|"), "o_orderstatus", F.lit("\\p\\\\"))
    lines = t.orders.select(
        F.col("o_orderkey").alias("id"), raw.alias("targetValue"), F.col("o_custkey").cast("string").alias("targetCanon")
    )
    parsed = R.with_targets(lines)
    return parsed.select(
        "id", F.get("targetValue", F.lit(0)).alias("first"), F.get("targetValue", F.lit(1)).alias("second"),
        F.size("targetValue").cast("bigint").alias("n"), F.get("targetCanon", F.lit(0)).alias("canon"),
    )


_VIEW_SQL = "SELECT c4, count(*) AS n, max(c2) AS top, min(c1) AS first FROM w WHERE agg = 0 GROUP BY c4"


@query("sql_over_view", on_w(f"""
WITH a AS ({_VIEW_SQL})
SELECT c4, CAST(i AS INTEGER) AS place, CASE i WHEN 0 THEN CAST(c4 AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN CAST(top AS VARCHAR) ELSE first END AS cell
FROM a, (SELECT unnest(range(4)) AS i)"""))
def sql_over_view(t):
    return R.flat_cells(R.run_sql(t.w, _VIEW_SQL), "c4")


@query("table_explode_roundtrip", f"WITH {_NATION_SQL} SELECT table_id, pos, concat(c_name, ' | ', c_mktsegment, ' | ', c_acctbal) AS cells FROM r")
def table_explode_roundtrip(t):
    cells = F.array("c_name", "c_mktsegment", F.col("c_acctbal").cast("string"))
    nested = D.nest_rows(_nation_rows(t), ["table_id"], "pos", cells, size=256)
    rows = D.unnest_rows(nested, ["table_id"], size=256)
    return rows.select("table_id", "pos", F.array_join("cells", " | ").alias("cells"))


# ---- joins by id --------------------------------------------------------------


@query("semi_join_ids", "SELECT doc_id, source, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_ids(t):
    good = t.labels.filter("quality = 1")
    kept = D.keep_ids(t.documents, good, "doc_id")
    return kept.select("doc_id", "source", F.char_length("text").cast("bigint").alias("n"))


@query("attach_targets", """
WITH f AS (
  SELECT l_orderkey AS id, arg_max(struct_pack(a := l_returnflag, b := l_shipdate), struct_pack(a := l_linenumber, b := l_extendedprice, c := l_partkey)) AS r
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, o_orderpriority AS question, r.a AS lf_p, strftime(r.b, '%Y-%m-%d') AS lf_pc FROM orders JOIN f ON o_orderkey = id""")
def attach_targets(t):
    forms = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("lf_p"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("lf_pc"), "l_linenumber", "l_extendedprice", "l_partkey",
    )
    questions = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question"))
    attached = D.attach(questions, forms, order=["l_linenumber", "l_extendedprice", "l_partkey"])
    return attached.select("id", "question", "lf_p", "lf_pc")


@query("attach_sql", "SELECT o_orderkey AS id, c_nationkey AS tbl, concat('select ', c_mktsegment) AS sql FROM orders JOIN customer ON o_custkey = c_custkey")
def attach_sql(t):
    corpus = t.customer.select(
        F.col("c_custkey").alias("nt"), F.col("c_nationkey").alias("tbl"),
        F.concat(F.lit("select "), "c_mktsegment").alias("sql"),
    )
    questions = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("nt"))
    return D.attach(questions, corpus, "nt", order=["tbl", "sql"]).select("id", "tbl", "sql")


@query("map_header", """
WITH x AS (SELECT l_orderkey, l_linenumber, [l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)] AS h, ['c2_list', concat('c', l_linenumber), 'id', 'c1'] AS names FROM lineitem),
y AS (SELECT l_orderkey, h, unnest(names) AS name FROM x)
SELECT name, h[CAST(substr(split_part(name, '_', 1), 2) AS INTEGER)] AS header, count(*) AS n FROM y
WHERE name <> 'id' AND CAST(substr(split_part(name, '_', 1), 2) AS INTEGER) <= 3 GROUP BY ALL""")
def map_header(t):
    header = F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    names = F.array(F.lit("c2_list"), F.concat(F.lit("c"), "l_linenumber"), F.lit("id"), F.lit("c1"))
    pairs = t.lineitem.select(F.explode(D.map_header(header, names)).alias("e"))
    return pairs.groupBy("e.name", "e.header").agg(F.count(F.lit(1)).alias("n"))


# ---- corpus building ----------------------------------------------------------


def _checks(t):
    """Every order checked under every operator subset; some checks fail."""
    omegas = F.posexplode(F.array(*[F.lit(s) for s in _SUBSETS])).alias("i", "omega")
    spread = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", omegas)
    return spread.select("id", "omega", (F.col("o_custkey") % 50 != F.col("i")).alias("ok"))


_CHECKED_SQL = """checks AS (SELECT o_orderkey AS id, i, o_custkey % 50 <> i AS ok FROM orders, (SELECT unnest(range(8)) AS i)),
checked AS (SELECT id, bool_and(ok) AND count(DISTINCT i) = 8 AS kept FROM checks GROUP BY id)"""


@query("keep_all_forms_ok", f"WITH {_CHECKED_SQL} SELECT id FROM checked WHERE kept")
def keep_all_forms_ok(t):
    return D.checked_ids(_checks(t)).filter("kept").select("id")


@query("build_stats", f"WITH {_CHECKED_SQL} SELECT count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS errors FROM checked")
def build_stats(t):
    return D.build_stats(D.checked_ids(_checks(t)))


@query("pivot_forms", "SELECT o_orderkey AS id, " + ", ".join(
    f"concat(o_orderpriority, ' || {s} ', o_custkey, ' ||') AS lf_{s}" for s in _SUBSETS) + " FROM orders")
def pivot_forms(t):
    omega = F.explode(F.array(*[F.lit(s) for s in _SUBSETS])).alias("omega")
    spread = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_custkey", omega)
    text = F.concat("o_orderpriority", F.lit(" || "), "omega", F.lit(" "), "o_custkey", F.lit(" ||"))
    return D.wide_forms(spread.select("id", "omega", text.alias("text")))


_CAPS_SQL = "CASE omega " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.TOKEN_CAPS.items()) + " END"
_FORMS_SQL = """forms AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'train' ELSE 'validation' END AS split,
  [""" + ", ".join(f"'{s}'" for s in _SUBSETS) + "][CAST(doc_id % 8 AS INTEGER) + 1] AS omega FROM documents)"


@query("length_filter", f"WITH {_FORMS_SQL} SELECT doc_id, split, omega FROM forms WHERE split <> 'train' OR len(string_split(text, ' ')) <= {_CAPS_SQL}")
def length_filter(t):
    omega = F.get(F.array(*[F.lit(s) for s in _SUBSETS]), (F.col("doc_id") % 8).cast("int"))
    split = F.when(F.col("lang") == "en", "train").otherwise("validation")
    forms = t.documents.select("doc_id", "text", split.alias("split"), omega.alias("omega"))
    return D.length_filter(forms, "omega", "text").select("doc_id", "split", "omega")


@query("select_rename", "SELECT o_orderkey AS id, o_orderpriority AS question, o_orderstatus AS answers FROM orders")
def select_rename(t):
    wide = t.orders.withColumnsRenamed({"o_orderkey": "id", "o_orderpriority": "question", "o_orderstatus": "lf_p"})
    return D.select_rename(wide, "lf_p")


_SPLIT_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'validation' ELSE 'train' END"


@query("route_splits", f"""
WITH s AS (SELECT o_orderkey AS id, o_custkey, {_SPLIT_SQL} AS split FROM orders)
SELECT id, split FROM s WHERE split = 'test' OR id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def route_splits(t):
    split = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "test")
        .when(F.col("o_orderpriority") == "2-HIGH", "validation")
        .otherwise("train")
    )
    rows = t.orders.select(F.col("o_orderkey").alias("id"), split.alias("split"))
    ids = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return D.route_splits(rows, ids)


@query("stringify", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer")
def stringify(t):
    return D.stringify(t.customer)


@query("prepare_questions", "SELECT doc_id AS id, lower(text) AS question, concat(lang, ', ', source) AS answers FROM documents")
def prepare_questions(t):
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.array("lang", "source").alias("answers")
    )
    return D.prepare_questions(rows)


# ---- tables as text -----------------------------------------------------------


@query("serialize_table", f"""
WITH {_NATION_SQL}, lines AS (
  SELECT table_id, pos, concat(CASE WHEN pos = 0 THEN concat('who is in ', table_id, ' ? col : c_name | c_mktsegment | c_acctbal') ELSE '' END,
         ' row ', pos + 1, ' : ', c_name, ' | ', c_mktsegment, ' | ', c_acctbal) AS line FROM r)
SELECT table_id, pos // 1024 AS part, string_agg(line, '' ORDER BY pos) AS text FROM lines GROUP BY table_id, pos // 1024""")
def serialize_table(t):
    question = F.concat(F.lit("who is in "), F.col("table_id"), F.lit(" ?"))
    return D.serialize(_nation_rows(t), ["table_id"], "pos", question, ["c_name", "c_mktsegment", "c_acctbal"])


@query("recover_header", "SELECT o_orderkey AS id, concat(o_orderpriority, ';id;', o_orderstatus) AS header FROM orders")
def recover_header(t):
    text = F.concat(
        F.lit("how many ? col : "), "o_orderpriority", F.lit(" | id | "), "o_orderstatus",
        F.lit(" row 1 : "), "o_custkey", F.lit(" | 2 row 2 : a | b"),
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(D.header_of(text), ";").alias("header"))


@query("prefix_budget", """
WITH r AS (SELECT lang, doc_id, len(string_split(text, ' ')) + 4 AS tokens, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
s AS (SELECT lang, doc_id, pos, sum(tokens) OVER (PARTITION BY lang ORDER BY pos) + 12 AS used FROM r)
SELECT lang, doc_id, pos FROM s WHERE used <= 1024""")
def prefix_budget(t):
    rows = t.documents.select("lang", "doc_id", (D.token_count(F.col("text")) + 4).cast("bigint").alias("tokens"))
    placed = positions(rows, [F.col("doc_id")], keys=["lang"])
    return D.prefix_budget(placed, ["lang"], "pos", "tokens", F.lit(12)).select("lang", "doc_id", "pos")


# ---- permutation ----------------------------------------------------------------


def _drawn_sql(column, table="r"):
    """Where each row's value of a column moves to."""
    return f"""SELECT table_id, {column} AS value, pos AS origin,
  row_number() OVER (PARTITION BY table_id ORDER BY md5(concat_ws('|', '42', table_id, '{column}', pos)), pos) - 1 AS pos FROM {table}"""


@query("permute_column", f"""
WITH {_NATION_SQL}, d AS ({_drawn_sql("c_acctbal")})
SELECT r.table_id, r.pos, r.c_custkey, d.value AS c_acctbal FROM r JOIN d ON d.table_id = r.table_id AND d.pos = r.pos""")
def permute_column(t):
    rows = _nation_rows(t).select("table_id", "pos", "c_custkey", "c_acctbal")
    return D.permute(rows, ["table_id"], "pos", ["c_acctbal"])


@query("permute_table", f"""
WITH {_NATION_SQL}, z AS (SELECT table_id, floor(count(*) * 0.8) AS first FROM r GROUP BY table_id),
moving AS (SELECT r.* FROM r JOIN z ON z.table_id = r.table_id WHERE r.pos < z.first),
a AS ({_drawn_sql("c_name", "moving")}), b AS ({_drawn_sql("c_acctbal", "moving")})
SELECT r.table_id, r.pos, CASE WHEN a.pos IS NULL THEN r.c_name ELSE a.value END AS c_name, r.c_mktsegment,
       CASE WHEN b.pos IS NULL THEN r.c_acctbal ELSE b.value END AS c_acctbal
FROM r LEFT JOIN a ON a.table_id = r.table_id AND a.pos = r.pos LEFT JOIN b ON b.table_id = r.table_id AND b.pos = r.pos""")
def permute_table(t):
    """Two columns shuffled on their own among the rows that fit, the tail of each table fixed."""
    sizes = t.customer.groupBy(F.col("c_nationkey").alias("table_id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = _nation_rows(t).join(sizes, "table_id")
    shuffled = D.permute(rows, ["table_id"], "pos", ["c_name", "c_acctbal"], first=F.floor(F.col("_n") * 0.8))
    return shuffled.select("table_id", "pos", "c_name", "c_mktsegment", "c_acctbal")


@query("permuted_or_original", f"""
WITH {_NATION_SQL}, d AS ({_drawn_sql("c_acctbal")}),
m AS (SELECT r.table_id, r.pos, r.c_name, d.value AS c_acctbal FROM r JOIN d ON d.table_id = r.table_id AND d.pos = r.pos),
x AS (SELECT table_id, arg_max(c_name, struct_pack(a := c_acctbal, b := pos)) AS before FROM r GROUP BY table_id),
y AS (SELECT table_id, arg_max(c_name, struct_pack(a := c_acctbal, b := pos)) AS after FROM m GROUP BY table_id)
SELECT table_id, CASE WHEN before <> after THEN 'permuted' ELSE 'original' END AS kept, CASE WHEN before <> after THEN after ELSE before END AS answer
FROM x JOIN y USING (table_id)""")
def permuted_or_original(t):
    """Who has the largest balance per nation, before and after the balances are shuffled."""
    original = _nation_rows(t).select("table_id", "pos", "c_name", "c_acctbal")
    shuffled = D.permute(original, ["table_id"], "pos", ["c_acctbal"])

    def richest(rows, name):
        best = F.max_by("c_name", F.struct("c_acctbal", "pos"))
        return rows.groupBy("table_id").agg(F.array(best).alias(name))

    pairs = richest(original, "before").join(richest(shuffled, "after"), "table_id")
    judged = D.answer_changed(pairs)
    return judged.select(
        "table_id", F.when(F.col("changed"), "permuted").otherwise("original").alias("kept"),
        F.when(F.col("changed"), F.get("after", F.lit(0))).otherwise(F.get("before", F.lit(0))).alias("answer"),
    )


@query("lines_round_trip", "SELECT row_number() OVER (ORDER BY p_brand DESC, p_partkey) - 1 AS pos, p_name AS value FROM part")
def lines_round_trip(t):
    """Predictions written as lines in a given order and read back with their places."""
    folder = scratch_folder(t.spark, "lines")
    save_lines(t.part, "p_name", folder, order=[F.desc("p_brand"), F.col("p_partkey")])
    return R.read_lines(t.spark, folder)
