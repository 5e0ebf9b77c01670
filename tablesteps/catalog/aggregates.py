"""Aggregate, grouping and having queries."""

from pyspark.sql import functions as F

from ..operators import positions as P
from ..operators import steps as S
from .registry import num_sql, on_w, query

NUM_C6 = num_sql("c6")


def row_count(name):
    return F.count(F.lit(1)).alias(name)


def _single(name, sql, build):
    query(name, on_w(f"SELECT {sql} AS answer FROM w WHERE agg = 0"))(
        lambda t: S.data_rows(t.w).agg(build(t.w).alias("answer"))
    )


_single("agg_max", "max(c2)", lambda w: F.max("c2"))
_single("agg_min", "min(c1)", lambda w: F.min("c1"))
_single("agg_sum_coerced", f"coalesce(sum({NUM_C6}), 0.0)", lambda w: S.sum_coerced(w, "c6"))
_single("agg_avg", "round(avg(c2), 6)", lambda w: F.round(F.avg("c2"), 6))
_single("agg_count", "count(c1)", lambda w: F.count("c1"))
_single("count_star", "count(*)", lambda w: F.count("*"))
_single("count_distinct", "count(DISTINCT c1)", lambda w: F.count_distinct("c1"))


def _grouped(name, sql, aggregate):
    query(name, on_w(f"SELECT c1, {sql} FROM w WHERE c1 IS NOT NULL GROUP BY c1"))(
        lambda t: S.group_agg(t.w, "c1", aggregate().alias("answer"))
    )


_grouped("group_max", "max(c2) AS answer", lambda: F.max("c2"))
_grouped("group_min", "min(c3) AS answer", lambda: F.min("c3"))
_grouped("group_sum", "round(sum(c2), 2) AS answer", lambda: F.round(F.sum("c2"), 2))
_grouped("group_avg", "round(avg(c2), 6) AS answer", lambda: F.round(F.avg("c2"), 6))
_grouped("group_count", "count(*) AS answer", lambda: F.count("*"))
_grouped("group_count_distinct", "count(DISTINCT c4) AS answer", lambda: F.count_distinct("c4"))


@query("select_distinct", on_w("SELECT DISTINCT c1 FROM w WHERE c1 IS NOT NULL"))
def select_distinct(t):
    return S.distinct_values(t.w, "c1")


@query("count_subquery", on_w("SELECT count(*) AS answer FROM (SELECT c4 FROM w WHERE c2 > 100000 GROUP BY c4 HAVING count(*) > 5)"))
def count_subquery(t):
    groups = S.group_agg(t.w.filter("c2 > 100000"), "c4", row_count("n")).filter("n > 5")
    return groups.agg(F.count("*").alias("answer"))


@query("group_collect", on_w("""
SELECT c4, CAST(0 AS BIGINT) AS part, count(*) AS n, string_agg(coalesce(c1, 'none'), '| ' ORDER BY id) AS cells
FROM w WHERE c4 IS NOT NULL GROUP BY c4"""))
def group_collect(t):
    lists = P.chunked_lists(t.w.filter("c4 IS NOT NULL"), ["c4"], "id", "c1", size=4096)
    cells = F.array_join("values", "| ", "none")
    return lists.select("c4", "part", F.size("values").cast("bigint").alias("n"), cells.alias("cells"))


@query("group_by_array", "SELECT array_to_string(string_split(p_name, ' '), '| ') AS key, count(*) AS n, max(p_size) AS largest FROM part WHERE p_name IS NOT NULL GROUP BY string_split(p_name, ' ')")
def group_by_array(t):
    parts = t.part.select(F.split("p_name", " ").alias("words"), "p_size")
    groups = S.group_agg(parts, "words", row_count("n"), F.max("p_size").alias("largest"))
    return groups.select(F.array_join("words", "| ").alias("key"), "n", "largest")


@query("group_contains", on_w("SELECT c4, bool_or(coalesce(c1 = '1-URGENT', false)) AS answer FROM w GROUP BY c4"))
def group_contains(t):
    return S.group_agg(t.w, "c4", S.group_contains(F.col("c1"), "1-URGENT").alias("answer"))


@query("group_any_neq", on_w("SELECT c4, bool_or(c5 IS DISTINCT FROM 'F') AS answer FROM w GROUP BY c4"))
def group_any_neq(t):
    return S.group_agg(t.w, "c4", S.group_any_differs(F.col("c5"), "F").alias("answer"))


@query("group_all_cmp", on_w("SELECT c4, bool_and(coalesce(c2 > 50000, false)) AS all_gt, bool_and(coalesce(c2 <= 400000, false)) AS all_lte FROM w GROUP BY c4"))
def group_all_cmp(t):
    return S.group_agg(
        t.w, "c4",
        S.group_all(F.col("c2"), ">", 50000).alias("all_gt"),
        S.group_all(F.col("c2"), "<=", 400000).alias("all_lte"),
    )


@query("group_any_in", on_w("SELECT c4, bool_or(coalesce(c1 IN ('1-URGENT', '2-HIGH'), false)) AS answer FROM w GROUP BY c4"))
def group_any_in(t):
    return S.group_agg(t.w, "c4", S.group_any_in(F.col("c1"), ["1-URGENT", "2-HIGH"]).alias("answer"))


@query("having_count", on_w("SELECT c4, count(*) AS n FROM w GROUP BY c4 HAVING count(*) >= 10"))
def having_count(t):
    return S.group_agg(t.w, "c4", row_count("n")).filter("n >= 10")


@query("having_agg", on_w("SELECT c4, round(sum(c2), 2) AS total FROM w GROUP BY c4 HAVING sum(c2) > 3000000"))
def having_agg(t):
    return S.group_agg(t.w, "c4", F.round(F.sum("c2"), 2).alias("total")).filter("total > 3000000")


def _two_sided(t):
    return S.group_agg(t.w, "c4", row_count("n"), F.max("c2").alias("largest"))


@query("having_and", on_w("SELECT c4, count(*) AS n, max(c2) AS largest FROM w GROUP BY c4 HAVING count(*) > 8 AND max(c2) > 450000"))
def having_and(t):
    return _two_sided(t).filter(S.all_of(F.col("n") > 8, F.col("largest") > 450000))


@query("having_or", on_w("SELECT c4, count(*) AS n, max(c2) AS largest FROM w GROUP BY c4 HAVING count(*) > 15 OR max(c2) > 490000"))
def having_or(t):
    return _two_sided(t).filter(S.any_of(F.col("n") > 15, F.col("largest") > 490000))


@query("having_subquery", on_w("SELECT c4, count(*) AS n FROM w GROUP BY c4 HAVING count(*) > (SELECT count(*) FROM w WHERE c4 = (SELECT min(c4) FROM w))"))
def having_subquery(t):
    first = t.w.agg(F.min("c4"))
    bound = S.where_scalar(t.w, "c4", "=", first).agg(row_count("n"))
    return S.where_scalar(S.group_agg(t.w, "c4", row_count("n")), "n", ">", bound)
