"""Jobs over a plan corpus: one plan per order, its shape chosen by the order's priority."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators.datasets import SUBSETS
from ..plans import graph as G
from ..plans import text as X
from .registry import query

# Plan shapes. Nodes are (name, kind, parameter), edges (child, parent,
# place); {x} stands for a literal taken from the order.
_SHAPES = {
    "1-URGENT": (
        [("n1", "S", "where"), ("n2", "P", "c1"), ("n3", "C", "= {x}"), ("n4", "P", "c2")],
        [("n2", "n1", 0), ("n3", "n1", 1), ("n4", "n3", 0)],
    ),
    "2-HIGH": (
        [("n1", "L", "l 1"), ("n2", "OB", "ob desc"), ("n3", "GB", "gb"), ("n4", "A", "count"), ("n5", "P", "c1"), ("n6", "P", "c2")],
        [("n2", "n1", 0), ("n3", "n2", 0), ("n4", "n2", 1), ("n3", "n4", 0), ("n5", "n3", 0), ("n6", "n3", 1)],
    ),
    "3-MEDIUM": (
        [("n1", "A", "abs"), ("n2", "OP", "-"), ("n3", "A", "max"), ("n4", "A", "min"), ("n5", "P", "c3"), ("n6", "P", "c3")],
        [("n2", "n1", 0), ("n3", "n2", 0), ("n4", "n2", 1), ("n5", "n3", 0), ("n6", "n4", 0)],
    ),
    "4-NOT SPECIFIED": (
        [("n1", "H", "H"), ("n2", "GB", "gb"), ("n3", "C", "> {x}"), ("n4", "A", "count"),
         ("n5", "S", "where"), ("n6", "P", "c1"), ("n7", "C", "!= {x}"), ("n8", "P", "c4")],
        [("n2", "n1", 0), ("n3", "n1", 1), ("n4", "n3", 0), ("n2", "n4", 0), ("n5", "n2", 0), ("n6", "n2", 1),
         ("n6", "n5", 0), ("n7", "n5", 1), ("n8", "n7", 0)],
    ),
    "5-LOW": ([("n1", "P", "c1")], []),
}


def _by_shape(pick):
    """Array column with the struct literals of the order's shape."""
    arms = [(F.col("o_orderpriority") == p, pick(*shape)) for p, shape in _SHAPES.items()]
    chain = reduce(lambda acc, arm: acc.when(*arm), arms[1:], F.when(*arms[0]))
    return F.explode(chain)


def _struct(**fields):
    return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])


def _plans(t):
    """Node and edge tables of the corpus."""
    def node_items(nodes, _):
        return F.array(*[_struct(node=n, kind=k, parameter=p) for n, k, p in nodes])

    def edge_items(_, edges):
        items = F.array(*[_struct(edge=i, child=c, parent=p, place=s) for i, (c, p, s) in enumerate(edges)])
        return items if edges else F.array().cast("array<struct<edge:int,child:string,parent:string,place:int>>")

    rows = t.columns("orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    orders = rows.select(
        F.col("o_orderkey").alias("query_id"), "o_orderpriority", F.lower("o_orderstatus").alias("x"), "o_custkey"
    )
    spread = orders.select("query_id", "x", "o_custkey", _by_shape(node_items).alias("v"))
    parameter = F.replace("v.parameter", F.lit("{x}"), F.col("x"))
    nodes = spread.select("query_id", "v.node", "v.kind", parameter.alias("parameter"), "o_custkey")
    nodes = nodes.select(
        "query_id", "node", "kind", "parameter", F.concat("parameter", F.lit("| "), "o_custkey").alias("result")
    )
    edges = orders.select("query_id", _by_shape(edge_items).alias("v"))
    return nodes, edges.select("query_id", "v.edge", "v.child", "v.parent", "v.place")


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_PLANS_SQL = f"""node_shape(pr, node, kind, param) AS (VALUES {_values([(p, *n) for p, (ns, _) in _SHAPES.items() for n in ns])}),
edge_shape(pr, edge, child, parent, place) AS (VALUES {_values([(p, i, *e) for p, (_, es) in _SHAPES.items() for i, e in enumerate(es)])}),
nodes AS (SELECT o_orderkey AS query_id, node, kind, replace(param, '{{x}}', lower(o_orderstatus)) AS parameter,
                 concat(replace(param, '{{x}}', lower(o_orderstatus)), '| ', o_custkey) AS result
          FROM orders JOIN node_shape ON pr = o_orderpriority),
edges AS (SELECT o_orderkey AS query_id, edge, child, parent, place FROM orders JOIN edge_shape ON pr = o_orderpriority)"""
_CLOSURE_SQL = _PLANS_SQL + """,
closure AS (SELECT query_id, parent AS node, child AS descendant FROM edges
            UNION SELECT c.query_id, c.node, e.child FROM closure c JOIN edges e ON e.query_id = c.query_id AND e.parent = c.descendant)"""
_STATUS_SQL = _CLOSURE_SQL + f""",
omegas(omega, kinds) AS (VALUES {", ".join(f"('{n}', {ks})" for n, ks in SUBSETS.items())}),
own AS (SELECT query_id, node, node AS descendant FROM nodes UNION ALL SELECT query_id, node, descendant FROM closure),
done AS (SELECT o.query_id, o.node, w.omega, bool_and(list_contains(w.kinds, n.kind)) AS done
         FROM own o JOIN nodes n ON n.query_id = o.query_id AND n.node = o.descendant, omegas w GROUP BY ALL),
needed AS (SELECT e.query_id, e.child AS node, d.omega, bool_or(NOT d.done) AS needed
           FROM edges e JOIN done d ON d.query_id = e.query_id AND d.node = e.parent GROUP BY ALL),
status AS (SELECT d.query_id, d.node, d.omega, CASE WHEN NOT d.done THEN '0' WHEN coalesce(n.needed, true) THEN 'last' ELSE '1' END AS status
           FROM done d LEFT JOIN needed n ON n.query_id = d.query_id AND n.node = d.node AND n.omega = d.omega)"""
_PATHS_SQL = """
paths AS (SELECT query_id, node, '' AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.query_id = n.query_id AND e.child = n.node)
          UNION ALL SELECT p.query_id, e.child, concat(p.path, lpad(CAST(e.place AS VARCHAR), 4, '0')) FROM paths p JOIN edges e ON e.query_id = p.query_id AND e.parent = p.node)"""


def _sql(ctes, body):
    return f"WITH RECURSIVE {ctes}\n{body}"


@query("plan_roots", _sql(_PLANS_SQL, "SELECT query_id, node, kind FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.query_id = n.query_id AND e.child = n.node)"))
def plan_roots(t):
    return G.roots(*_plans(t)).select("query_id", "node", "kind")


@query("plan_leaves", _sql(_PLANS_SQL, "SELECT query_id, node, kind FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.query_id = n.query_id AND e.parent = n.node)"))
def plan_leaves(t):
    return G.leaves(*_plans(t)).select("query_id", "node", "kind")


@query("plan_consumers", _sql(_PLANS_SQL, "SELECT query_id, child AS node, arg_min(parent, edge) AS consumer FROM edges GROUP BY query_id, child"))
def plan_consumers(t):
    return G.first_consumers(_plans(t)[1])


@query("plan_descendants", _sql(_CLOSURE_SQL, "SELECT query_id, node, descendant FROM closure"))
def plan_descendants(t):
    return G.descendants(_plans(t)[1])


@query("plan_levels", _sql(_PLANS_SQL + """,
up AS (SELECT query_id, node, 0 AS level FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.query_id = n.query_id AND e.parent = n.node)
       UNION SELECT u.query_id, e.parent, u.level + 1 FROM up u JOIN edges e ON e.query_id = u.query_id AND e.child = u.node)""",
    "SELECT query_id, node, max(level) AS level FROM up GROUP BY query_id, node"))
def plan_levels(t):
    return G.levels(*_plans(t))


@query("plan_exec_status", _sql(_STATUS_SQL, "SELECT query_id, node, omega, status FROM status"))
def plan_exec_status(t):
    return G.exec_status(*_plans(t))


@query("plan_residual", _sql(_STATUS_SQL, "SELECT query_id, omega, count(*) FILTER (WHERE status <> '1') AS tokens FROM status GROUP BY ALL"))
def plan_residual(t):
    return G.residuals(*_plans(t))


@query("plan_merge_equal", _sql(_STATUS_SQL, """
SELECT s.query_id, s.omega, s.node, min(s.node) OVER (PARTITION BY s.query_id, s.omega, n.result) AS shared
FROM status s JOIN nodes n ON n.query_id = s.query_id AND n.node = s.node WHERE s.status = 'last'"""))
def plan_merge_equal(t):
    return G.merge_equal(*_plans(t))


@query("plan_shape_counts", _sql(_PLANS_SQL, """
SELECT c.kind AS child_kind, p.kind AS parent_kind, count(*) AS n FROM edges e
JOIN nodes c ON c.query_id = e.query_id AND c.node = e.child JOIN nodes p ON p.query_id = e.query_id AND p.node = e.parent GROUP BY ALL"""))
def plan_shape_counts(t):
    return G.shape_counts(*_plans(t))


def _miswired(t):
    """The corpus with a back edge in a plan of every third order and an edge from nowhere in every fifth."""
    nodes, edges = _plans(t)
    orders = t.orders.select(F.col("o_orderkey").alias("query_id"))

    def extra(every, child, parent):
        return orders.filter(F.col("query_id") % every == 0).select(
            "query_id", F.lit(90).alias("edge"), F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.lit(0).alias("place")
        )

    return nodes, edges.unionByName(extra(3, "n1", "n3")).unionByName(extra(5, None, "n1"))


_MISWIRED_SQL = _PLANS_SQL + """,
wired AS (SELECT * FROM edges UNION ALL SELECT o_orderkey, 90, 'n1', 'n3', 0 FROM orders WHERE o_orderkey % 3 = 0
          UNION ALL SELECT o_orderkey, 90, NULL, 'n1', 0 FROM orders WHERE o_orderkey % 5 = 0),
good AS (SELECT e.* FROM wired e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.query_id = e.query_id AND n.node = e.child)
         AND EXISTS (SELECT 1 FROM nodes n WHERE n.query_id = e.query_id AND n.node = e.parent)),
reach AS (SELECT query_id, parent AS node, child AS descendant FROM good
          UNION SELECT r.query_id, r.node, e.child FROM reach r JOIN good e ON e.query_id = r.query_id AND e.parent = r.descendant),
stuck AS (SELECT DISTINCT query_id, node FROM reach r WHERE EXISTS (
            SELECT 1 FROM reach c WHERE c.query_id = r.query_id AND c.node = c.descendant AND (c.node = r.node OR c.node = r.descendant)))"""


@query("plan_problems", _sql(_MISWIRED_SQL, """
SELECT query_id, 'cycle' AS problem, count(*) AS n FROM stuck GROUP BY query_id
UNION ALL SELECT w.query_id, 'dangling edge', count(*) FROM wired w
WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.query_id = w.query_id AND g.edge = w.edge AND g.child IS NOT DISTINCT FROM w.child AND g.parent IS NOT DISTINCT FROM w.parent)
GROUP BY w.query_id"""))
def plan_problems(t):
    return G.problems(*_miswired(t))


@query("plan_levels_miswired", _sql(_MISWIRED_SQL + """,
free AS (SELECT query_id, node FROM nodes EXCEPT SELECT query_id, node FROM stuck),
up AS (SELECT query_id, node, 0 AS level FROM free f WHERE NOT EXISTS (SELECT 1 FROM good e WHERE e.query_id = f.query_id AND e.parent = f.node)
       UNION SELECT u.query_id, e.parent, u.level + 1 FROM up u JOIN good e ON e.query_id = u.query_id AND e.child = u.node
             JOIN free f ON f.query_id = e.query_id AND f.node = e.parent)""", """
SELECT n.query_id, n.node, max(u.level) AS level FROM nodes n LEFT JOIN up u ON u.query_id = n.query_id AND u.node = n.node GROUP BY ALL"""))
def plan_levels_miswired(t):
    return G.levels(*_miswired(t))


# ---- texts --------------------------------------------------------------------

def _plain_sql(direction):
    return _sql(_STATUS_SQL + "," + _PATHS_SQL, f"""
SELECT s.query_id, s.omega, string_agg(concat(CASE s.status WHEN 'last' THEN n.result ELSE n.parameter END, ' ||'), '' ORDER BY p.path {direction}) AS text
FROM status s JOIN nodes n ON n.query_id = s.query_id AND n.node = s.node JOIN paths p ON p.query_id = s.query_id AND p.node = s.node
WHERE s.status <> '1' GROUP BY s.query_id, s.omega""")


@query("plan_text_preorder", _plain_sql("ASC"))
def plan_text_preorder(t):
    return X.to_text(*_plans(t), "preorder")


@query("plan_text_postorder", _plain_sql("DESC"))
def plan_text_postorder(t):
    return X.to_text(*_plans(t), "postorder")


def _alias_sql(pick, direction, results_first):
    halves = ["coalesce(results, '')", "coalesce(operators, '')"]
    text = "concat(" + ", '|', ".join(halves if results_first else halves[::-1]) + ")"
    return _sql(_STATUS_SQL + "," + _PATHS_SQL + f""",
visited AS (SELECT query_id, node, {pick}(path) AS path FROM paths GROUP BY ALL),
named AS (SELECT s.query_id, s.omega, s.node, s.status, n.parameter, n.result, v.path,
            CASE s.status WHEN 'last' THEN min(s.node) OVER (PARTITION BY s.query_id, s.omega, s.status, CASE s.status WHEN 'last' THEN n.result ELSE s.node END) ELSE s.node END AS name
          FROM status s JOIN nodes n ON n.query_id = s.query_id AND n.node = s.node JOIN visited v ON v.query_id = s.query_id AND v.node = s.node
          WHERE s.status <> '1'),
operands AS (SELECT e.query_id, c.omega, e.parent AS node, string_agg(c.name, ' ' ORDER BY e.place) AS names
             FROM edges e JOIN named c ON c.query_id = e.query_id AND c.node = e.child GROUP BY ALL),
lines AS (SELECT n.query_id, n.omega, n.name, n.status, {pick}(n.path) AS path, any_value(n.result) AS result,
            any_value(CASE n.status WHEN 'last' THEN concat(n.name, ' ', n.result, ' ||') ELSE concat(n.name, ' ', n.parameter, ' ', coalesce(o.names, ''), ' ||') END) AS line
          FROM named n LEFT JOIN operands o ON o.query_id = n.query_id AND o.omega = n.omega AND o.node = n.node GROUP BY n.query_id, n.omega, n.name, n.status),
texts AS (SELECT query_id, omega, string_agg(line, '' ORDER BY path {direction}) FILTER (WHERE status = 'last') AS results,
                 string_agg(line, '' ORDER BY path {direction}) FILTER (WHERE status = '0') AS operators, max(result) FILTER (WHERE status = 'last') AS only_result
          FROM lines GROUP BY query_id, omega)""",
        f"SELECT query_id, omega, CASE WHEN operators IS NULL THEN concat(only_result, ' ||') ELSE {text} END AS text FROM texts")


@query("plan_text_alias_start", _alias_sql("min", "ASC", True))
def plan_text_alias_start(t):
    return X.to_text(*_plans(t), "preorder", alias="start")


@query("plan_text_alias_end", _alias_sql("max", "DESC", False))
def plan_text_alias_end(t):
    return X.to_text(*_plans(t), "postorder", alias="end")


def _plan_texts(t):
    """Prefix texts written straight from the orders."""
    status = F.lower("o_orderstatus")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("where ||c1 ||= "), status, F.lit(" ||c2 ||")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("l 1 ||ob desc ||gb ||c1 ||c2 ||count ||gb ||c1 ||c2 ||"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("abs ||- ||max ||c3 ||- "), "o_custkey", F.lit(" ||c3 ||")))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("H ||"), "o_custkey", F.lit("| 2 ||> "), status, F.lit(" ||count ||gb ||c1 ||ob asc ||c1 ||c9 ||")))
        .otherwise(F.concat("o_custkey", F.lit(" ||")))
    )
    header = F.array(*[F.lit(c) for c in ("c1", "c2", "c3")])
    orders = t.columns("orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return orders.select(F.col("o_orderkey").alias("query_id"), text.alias("text"), header.alias("header"))


_TEXT_SQL = """texts AS (SELECT o_orderkey AS query_id, CASE o_orderpriority
   WHEN '1-URGENT' THEN concat('where ||c1 ||= ', lower(o_orderstatus), ' ||c2 ||')
   WHEN '2-HIGH' THEN 'l 1 ||ob desc ||gb ||c1 ||c2 ||count ||gb ||c1 ||c2 ||'
   WHEN '3-MEDIUM' THEN concat('abs ||- ||max ||c3 ||- ', o_custkey, ' ||c3 ||')
   WHEN '4-NOT SPECIFIED' THEN concat('H ||', o_custkey, '| 2 ||> ', lower(o_orderstatus), ' ||count ||gb ||c1 ||ob asc ||c1 ||c9 ||')
   ELSE concat(o_custkey, ' ||') END AS text FROM orders),
pieces AS (SELECT query_id, string_split(text, ' ||') AS parts FROM texts),
tokens AS (SELECT query_id, CAST(unnest(range(len(parts) - 1)) AS INTEGER) AS pos, unnest(parts[1:len(parts) - 1]) AS token FROM pieces),
kinds AS (SELECT query_id, pos, token, CASE
   WHEN token IN ('min','max','sum','avg','abs','julianday','count','distinct','length') THEN 'A1'
   WHEN token IN ('where','and','or') THEN 'S2' WHEN token IN ('+','-','/') THEN 'O2'
   WHEN (split_part(token, ' ', 1) IN ('+','-','/') OR split_part(token, ' ', -1) IN ('+','-','/')) AND NOT contains(token, '| ') THEN 'O1'
   WHEN token IN ('>','>=','<=','<','=','!=','in','is','intersect','union',',') THEN 'C2'
   WHEN (split_part(token, ' ', 1) IN ('>','>=','<=','<','=','!=','in','is','intersect','union',',')) AND NOT contains(token, '| ') THEN 'C1'
   WHEN regexp_full_match(token, 'l [0-9]+') THEN 'L1' WHEN token IN ('c1','c2','c3') THEN 'P0' WHEN token = 'gb' THEN 'G2'
   WHEN token IN ('ob ob','ob asc','ob desc') THEN 'B2' WHEN lower(token) = 'h' THEN 'H2' ELSE 'r0' END AS tag FROM tokens)"""


@query("plan_tokens", f"""
WITH {_TEXT_SQL}
SELECT query_id, pos, token, CASE left(tag, 1) WHEN 'O' THEN 'OP' WHEN 'G' THEN 'GB' WHEN 'B' THEN 'OB' WHEN 'r' THEN 'result' ELSE left(tag, 1) END AS kind,
       CAST(right(tag, 1) AS INTEGER) AS operands, CASE WHEN tag = 'H2' THEN 'h' WHEN token = 'ob ob' THEN 'ob' ELSE token END AS parameter
FROM kinds""")
def plan_tokens(t):
    return X.tokens(_plan_texts(t))


# A token's parent is the last earlier token whose subtree is not complete before it:
# the running sum of (operands - 1) tells where each subtree ends.
@query("plan_edges_from_text", f"""
WITH {_TEXT_SQL},
n AS (SELECT query_id, pos, CAST(right(tag, 1) AS INTEGER) AS k, sum(CAST(right(tag, 1) AS INTEGER) - 1) OVER (PARTITION BY query_id ORDER BY pos) AS s FROM kinds),
pairs AS (SELECT c.query_id, c.pos AS child, max(p.pos) AS parent FROM n c JOIN n p ON p.query_id = c.query_id AND p.pos < c.pos AND p.k > 0
          WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.query_id = c.query_id AND m.pos > p.pos AND m.pos < c.pos AND m.s < p.s - p.k + 1)
          GROUP BY c.query_id, c.pos)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY child) - 1 AS INTEGER) AS edge, concat('n', child + 1) AS child, concat('n', parent + 1) AS parent,
       CAST(row_number() OVER (PARTITION BY query_id, parent ORDER BY child) - 1 AS INTEGER) AS place FROM pairs""")
def plan_edges_from_text(t):
    return X.edges_from_text(_plan_texts(t))


@query("plan_edges_from_alias", """
WITH x AS (SELECT o_orderkey AS query_id, o_custkey AS c, o_orderstatus = 'F' AS f FROM orders)
SELECT query_id, 'n2' AS child, 'n1' AS parent, CAST(0 AS INTEGER) AS place FROM x UNION ALL SELECT query_id, 'n3', 'n1', 1 FROM x
UNION ALL SELECT query_id, concat('n', 4 + c), 'n3', 0 FROM x WHERE f""")
def plan_edges_from_alias(t):
    leaf = F.concat(F.lit("n"), (F.col("o_custkey") + 4).cast("string"))
    comparison = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("n3 = a "), leaf, F.lit(" "))).otherwise("n3 = a  ")
    text = F.concat(F.lit("N1 where N2 N3 ||"), comparison, F.lit("|||"), leaf, F.lit(" 1| 2 ||n2 x| y ||"))
    return X.edges_from_alias(t.orders.select(F.col("o_orderkey").alias("query_id"), text.alias("text")))


@query("render_cells", """
SELECT p_partkey AS id, lower(concat(p_name, '| ', CASE WHEN p_size > 25 THEN p_brand ELSE 'none' END)) AS cells,
       concat(CASE WHEN p_size > 10 THEN 't' ELSE 'f' END, '| ', CASE WHEN p_size > 20 THEN 't' ELSE 'f' END) AS flags,
       lower(concat(replace(p_name, ' ', ',, '), '| ', CASE WHEN p_size > 25 THEN concat(p_brand, ',, none') ELSE 'none' END)) AS groups
FROM part""")
def render_cells(t):
    big = F.col("p_size") > 25
    cells = F.array("p_name", F.when(big, F.col("p_brand")))
    groups = F.array(F.split("p_name", " "), F.when(big, F.array(F.col("p_brand"), F.lit(None).cast("string"))))
    flags = F.array(F.col("p_size") > 10, F.col("p_size") > 20)
    return t.part.select(
        F.col("p_partkey").alias("id"), X.render_cells(cells).alias("cells"),
        X.render_flags(flags).alias("flags"), X.render_groups(groups).alias("groups"),
    )
