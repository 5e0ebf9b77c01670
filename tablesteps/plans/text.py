"""Plan texts: token kinds, wiring texts into edges, and writing plans as texts.

A text is a sequence of tokens that end in `` ||``. In prefix texts a token's
operands follow it. Alias texts name their nodes and hold two sequences, one of
operators and one of finished results, with `` |||`` between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import let, null_false
from ..operators.datasets import SUBSETS
from .graph import Largest, Plan, Sorted, Text, per_plan

# The words of each operator kind.
COMPARISONS = [">", ">=", "<=", "<", "=", "!=", "in", "is", "intersect", "union", ","]
FUNCTIONS = ["min", "max", "sum", "avg", "abs", "julianday", "count", "distinct", "length"]
SELECTIONS = ["where", "and", "or"]
ARITHMETIC = ["+", "-", "/"]
ORDERINGS = ["ob ob", "ob asc", "ob desc"]

# ---- reading ------------------------------------------------------------------


def split_tokens(text: Column) -> Column:
    """Token texts; what follows the last separator is dropped."""
    return let(F.split(text, r" \|\|"), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))


def classify(token: Column, header: Column) -> Column:
    """Struct of kind, number of operands and parameter; a token of no kind is a result.

    The order of the tests matters: ``- 5`` is arithmetic before anything else,
    and a column name only counts when no operator has claimed the token.
    """
    words = F.split(token, " ")
    ends = F.array(F.get(words, F.lit(0)), F.element_at(words, -1))
    single = ~token.contains("| ")

    def claimed(symbols: Sequence[str]) -> Column:
        return F.arrays_overlap(ends, F.array(*[F.lit(s) for s in symbols])) & single

    def kind(name: str, operands: int, parameter: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), F.lit(operands).alias("operands"), parameter.alias("parameter"))

    return (
        F.when(token.isin(FUNCTIONS), kind("A", 1, token))
        .when(token.isin(SELECTIONS), kind("S", 2, token))
        .when(token.isin(ARITHMETIC), kind("OP", 2, token))
        .when(claimed(ARITHMETIC), kind("OP", 1, token))
        .when(token.isin(COMPARISONS), kind("C", 2, token))
        .when(claimed(COMPARISONS), kind("C", 1, token))
        .when(token.rlike(r"^l [0-9]+\z"), kind("L", 1, token))
        .when(null_false(F.array_contains(header, token)), kind("P", 0, token))
        .when(token == "gb", kind("GB", 2, token))
        .when(token == "ob ob", kind("OB", 2, F.lit("ob")))
        .when(token.isin(ORDERINGS), kind("OB", 2, token))
        .when(F.lower(token) == "h", kind("H", 2, F.lit("h")))
        .otherwise(kind("result", 0, token))
    )


def tokens(df: DataFrame, text: str = "text", header: str = "header") -> DataFrame:
    """One row per token: (query_id, pos, token, kind, operands, parameter)."""
    split = df.select("query_id", header, F.posexplode(split_tokens(F.col(text))).alias("pos", "token"))
    named = split.withColumn("_c", classify(F.col("token"), F.col(header)))
    return named.select("query_id", "pos", "token", "_c.kind", "_c.operands", "_c.parameter")


def edges_from_text(df: DataFrame, order: str = "preorder", text: str = "text", header: str = "header") -> DataFrame:
    """Edges of prefix (or reversed postfix) texts: (query_id, edge, child, parent, place).

    Nodes are named ``n1``, ``n2``, … in prefix order. A token opens a place for each of its operands and
    fills the place opened last, if any is open; without one it is a further root. A text is one cell, so it is wired in the
    task that reads it, linear in its tokens: nothing is shuffled, and a task holds the edges of one part of a batch.
    """
    parts = split_tokens(F.col(text))
    parts = F.reverse(parts) if order == "postorder" else parts
    counts = F.transform(parts, lambda t: classify(t, F.col(header))["operands"])
    kind = df.schema["query_id"].dataType.simpleString()
    return df.select("query_id", counts.alias("_counts")).mapInArrow(_wired, f"query_id {kind}, edge int, child string, parent string, place int")


_ROWS = 1 << 16  # edges after which a part of a batch ends, and the length of the table of names


def _wired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array([f"n{i + 1}" for i in range(_ROWS)])

    def name(at: list[int]) -> pa.Array:
        if max(at) < _ROWS:
            return names.take(pa.array(at, pa.int32()))
        return pa.array([f"n{i + 1}" for i in at])

    def ready(ids: pa.Array, rows: list[int], edges: list[int], children: list[int], parents: list[int], places: list[int]) -> pa.RecordBatch:
        columns = [
            ids.take(pa.array(rows, pa.int32())), pa.array(edges, pa.int32()), name(children), name(parents), pa.array(places, pa.int32())
        ]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "edge", "child", "parent", "place"])

    for batch in batches:
        ids, lists = batch.columns
        out: tuple[list[int], ...] = ([], [], [], [], [])
        for row in range(len(lists)):
            counts = lists[row].as_py()
            rows, edges, children, parents, places = out
            open_places: list[tuple[int, int]] = []
            edge = 0
            for child, count in enumerate(counts or ()):
                if open_places:
                    parent, place = open_places.pop()
                    rows.append(row)
                    edges.append(edge)
                    children.append(child)
                    parents.append(parent)
                    places.append(place)
                    edge += 1
                for place in reversed(range(count)):
                    open_places.append((child, place))
            if len(rows) >= _ROWS:
                yield ready(ids, *out)
                out = ([], [], [], [], [])
        if out[0]:
            yield ready(ids, *out)


def edges_from_alias(df: DataFrame, operands_first: bool = False, text: str = "text") -> DataFrame:
    """Edges of alias texts: in each operator the first name is the node, the others its operands."""
    halves = F.split(F.col(text), r" \|\|\|")
    half = F.get(halves, F.lit(1 if operands_first else 0))
    operators = F.split(half, r" \|\|")
    named = F.transform(operators, lambda o: F.regexp_extract_all(F.lower(o), F.lit("n[0-9]+"), F.lit(0)))
    lines = df.select("query_id", F.explode(named).alias("_names")).filter(F.size("_names") > 1)
    return lines.select(
        "query_id", F.get("_names", F.lit(0)).alias("parent"),
        F.posexplode(F.slice("_names", F.lit(2), F.size("_names") - 1)).alias("place", "child"),
    ).select("query_id", "child", "parent", "place")


# ---- writing ------------------------------------------------------------------


def render_cells(cells: Column) -> Column:
    """Flat result as text: values joined by ``| ``, missing ones spelled none."""
    return F.lower(F.array_join(cells, "| ", "none"))


def render_flags(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda f: F.when(f, F.lit("t")).otherwise(F.lit("f"))), "| ")


def render_groups(groups: Column) -> Column:
    """Grouped result as text: ``,, `` inside a group, a missing group spelled none."""
    inner = F.transform(groups, lambda g: F.array_join(g, ",, ", "none"))
    return F.lower(F.array_join(inner, "| ", "none"))


def _joined(parts: Iterable[str | int]) -> Text:
    """Neighbouring texts put together."""
    out: list[str | int] = []
    for own, run in groupby(parts, lambda p: isinstance(p, str)):
        out += ["".join(run)] if own else run
    return Text(tuple(out))


def _plain(plan: Plan, status: dict[str, str], preorder: bool) -> Text | Sorted:
    """A shared node is written once per use, so its text is put together once and used again."""
    written: dict[str, tuple[str | int, ...]] = {}
    for node in plan.order:
        _, _, parameter, result = plan.nodes[node]
        text = result if status[node] == "last" else parameter
        own = (text, " ||") if status[node] != "1" and text is not None else ()
        below = [written[c] for c in plan.operands[node]]
        whole = (own, *below) if preorder else (*below[::-1], own)
        written[node] = tuple(chain.from_iterable(whole))
    tops = [_joined(written[n]) for n in plan.order if not plan.consumers[n]]
    return tops[0] if len(tops) == 1 else Sorted(tuple(tops), not preorder)


def _aliased(plan: Plan, status: dict[str, str], preorder: bool, results_first: bool) -> Text | Largest:
    """A shared node, and nodes with equal results, are written once, at their first place."""
    shared = plan.shared(status)
    lines: dict[tuple[str, str], list[str | int]] = {}
    only: dict[int, None] = {}
    for node in plan.visits(preorder):
        if status[node] == "1":
            continue
        name = shared.get(node, node)
        _, _, parameter, result = plan.nodes[node]
        if status[node] == "last":
            if result is not None:
                only[result] = None
            parts = [name, result, "||"]
        else:
            held = sorted(
                (place or 0, shared.get(c, c)) for place, c in plan.places[node] if status[c] != "1"
            )
            parts = [name, parameter, " ".join(c for _, c in held), "||"]
        line = [x for p in parts if p is not None for x in (" ", p)]
        lines.setdefault((status[node], name), line[1:])
    operators = [x for (s, _), line in lines.items() if s == "0" for x in line]
    results = [x for (s, _), line in lines.items() if s == "last" for x in line]
    if not any(s == "0" for s, _ in lines):
        return Largest(tuple(only), " ||") if len(only) > 1 else _joined([*only, " ||"])
    return _joined([*results, "|", *operators] if results_first else [*operators, "|", *results])


def to_text(
    nodes: DataFrame, edges: DataFrame, order: str = "preorder", alias: str | None = None,
    subsets: Mapping[str, Sequence[str]] = SUBSETS,
) -> DataFrame:
    """Text of every plan under every operator subset: (query_id, omega, text).

    Finished nodes are silent, needed ones write their result, open ones their
    parameter. Plain texts write a shared node once per use; alias texts write it
    once, with the finished results in front (``alias='start'``) or behind
    (``alias='end'``). A plan with a cycle has the text null.
    """
    first = order == "preorder"

    def rows(plan: Plan) -> list[tuple]:
        if plan.cyclic:
            return [(omega, None) for omega in subsets]
        masks, out = plan.masks(), []
        for omega, kinds in subsets.items():
            status = plan.status(masks, kinds)
            out.append((omega, _plain(plan, status, first) if alias is None else _aliased(plan, status, first, alias == "start")))
        return out

    return per_plan(nodes, edges, "omega string, text string", rows, ["parameter", "result"])
