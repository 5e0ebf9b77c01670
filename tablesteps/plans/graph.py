"""Structure of many query plans at once, from node and edge tables.

  nodes  query_id, node STRING, kind STRING, parameter STRING, result STRING
  edges  query_id, edge INT, child STRING, parent STRING, place INT

``edge`` numbers a plan's edges, ``place`` is 0 for a parent's first operand and 1
for its second.

Jobs that follow edges gather each plan once: nodes and edges are dealt by query_id and
sorted, and a task holds one Arrow batch and one plan at a time, whatever its size. Plans are walked in
linear time, and plans wired alike only once per task: the walk sees parameters and results as
places, and what it gives is filled in for all such plans of a batch at once. An edge with a null end or an end
that is no node is left out of every walk; of a plan
with a cycle the walks return what does not depend on the cycle. ``problems`` lists both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import SUBSETS
from ..operators.evaluation import KINDS


def plan_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two plan tables. Both grow with the corpus, so neither side is ever broadcast."""
    return left.join(right.hint("merge"), list(keys), how)


# What a walk may write into a cell beside fixed values. A place is 2 * n for the parameter and 2 * n + 1 for the
# result of a plan's n-th row.


@dataclass(frozen=True)
class Text:
    """Texts and places, one after the other."""

    parts: tuple[str | int, ...]

    def read(self, value: Callable[[int], str]) -> str:
        return "".join(p if isinstance(p, str) else value(p) for p in self.parts)


@dataclass(frozen=True)
class Sorted:
    """Texts in order of what they read."""

    texts: tuple[Text, ...]
    reverse: bool

    def read(self, value: Callable[[int], str]) -> str:
        return "".join(sorted((t.read(value) for t in self.texts), reverse=self.reverse))


@dataclass(frozen=True)
class Largest:
    """The largest of several places, and a text behind it."""

    places: tuple[int, ...]
    end: str

    def read(self, value: Callable[[int], str]) -> str:
        return max(value(p) for p in self.places) + self.end


class Plan:
    """One plan: its nodes, and its edges as operands and consumers of each node."""

    def __init__(self, nodes: list[tuple], edges: list[tuple], named: bool):
        """``nodes`` as (node, kind, parameter, result), ``edges`` as (child, parent, place) in edge order.

        Parameters and results are places or None; nodes with equal results have the place of the first one.
        Without ``named`` the ends of the edges are the nodes.
        """
        if not named:
            nodes = [(n, None, None, None) for n in dict.fromkeys(x for e in edges for x in e[:2] if x is not None)]
        self.nodes = {n[0]: n for n in nodes}
        self.operands: dict[str, list[str]] = {n: [] for n in self.nodes}
        self.consumers: dict[str, list[str]] = {n: [] for n in self.nodes}
        self.places: dict[str, list[tuple[int, str]]] = {n: [] for n in self.nodes}
        self.dangling = 0
        for child, parent, place in edges:
            if child in self.nodes and parent in self.nodes:
                self.consumers[child].append(parent)
                self.places[parent].append((place, child))
            else:
                self.dangling += 1
        for parent, held in self.places.items():
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            self.operands[parent] = [child for _, child in held]
        # Operands before consumers; what is on a cycle or above one is never ready.
        waiting = {n: len(held) for n, held in self.operands.items()}
        self.order = [n for n, left in waiting.items() if not left]
        for node in self.order:
            for parent in self.consumers[node]:
                waiting[parent] -= 1
                if not waiting[parent]:
                    self.order.append(parent)
        self.cyclic = len(self.order) < len(self.nodes)

    def levels(self) -> dict[str, int | None]:
        """Longest path from a leaf; None for a node on or above a cycle."""
        level: dict[str, int | None] = dict.fromkeys(self.nodes)
        for node in self.order:
            level[node] = max((level[c] + 1 for c in self.operands[node]), default=0)
        return level

    def below(self, node: str) -> list[str]:
        """All nodes that can be reached from a node over its operands."""
        seen: dict[str, None] = {}
        stack = [node]
        while stack:
            for child in self.operands[stack.pop()]:
                if child not in seen:
                    seen[child] = None
                    stack.append(child)
        return list(seen)

    def masks(self) -> dict[str, int]:
        """One bit for the kind of a node and of each node below it; cycles do not matter."""
        mask = {n: 1 << (KINDS.index(x[1]) if x[1] in KINDS else len(KINDS)) for n, x in self.nodes.items()}
        ready = set(self.order)
        work = list(self.order) + [n for n in self.nodes if n not in ready]
        while work:
            changed = []
            for node in work:
                for parent in self.consumers[node]:
                    if mask[parent] | mask[node] != mask[parent]:
                        mask[parent] |= mask[node]
                        changed.append(parent)
            work = changed if self.cyclic else []
        return mask

    def status(self, masks: dict[str, int], kinds: Sequence[str]) -> dict[str, str]:
        """Per node ``0`` open, ``1`` done, ``last`` done and still needed."""
        missing = ~sum(1 << KINDS.index(k) for k in kinds)
        is_open = {n: bool(m & missing) for n, m in masks.items()}
        return {
            n: "0" if is_open[n] else "last" if not self.consumers[n] or any(is_open[p] for p in self.consumers[n]) else "1"
            for n in self.nodes
        }

    def shared(self, status: dict[str, str]) -> dict[str, str]:
        """For needed nodes, the smallest of the needed nodes with an equal result."""
        first: dict[int, str] = {}
        needed = sorted(n for n, s in status.items() if s == "last")
        return {n: first.setdefault(self.nodes[n][3], n) for n in needed if self.nodes[n][3] is not None}

    def visits(self, preorder: bool) -> list[str]:
        """Nodes by their first visit, a node before its operands; or by the reverse of their last visit."""
        roots = sorted(n for n in self.nodes if not self.consumers[n])
        out: dict[str, None] = {}
        if preorder:
            stack = roots[::-1]
            while stack:
                node = stack.pop()
                if node not in out:
                    out[node] = None
                    stack += reversed(self.operands[node])
            return list(out)
        entered = set()
        stack = [(n, False) for n in roots]
        while stack:
            node, left = stack.pop()
            if left:
                out.setdefault(node)
            elif node not in entered:
                entered.add(node)
                stack.append((node, True))
                stack += [(c, False) for c in self.operands[node]]
        return list(out)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_KEPT = 1 << 18  # rows and parts of texts of the walks that a task keeps
_FEW = 4  # plans wired alike that are filled in one by one
_FLUSH = 1 << 16


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Per value a number below the number of distinct values, and these; null is a value."""
    encoded = pc.dictionary_encode(column, null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def _starts(column: pa.Array) -> np.ndarray:
    """The first row of each plan."""
    codes, _ = _codes(column)
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


def _first_equal(column: pa.Array, plan: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per row the place within its plan of the first row with an equal value; -1 for null."""
    codes, values = _codes(column)
    _, first, at = np.unique(plan * len(values) + codes, return_index=True, return_inverse=True)
    return np.where(column.is_null().to_numpy(zero_copy_only=False), -1, first[at] - start)


class _Walks:
    """What ``rows_of`` gives for each way that plans are wired."""

    def __init__(self, rows_of: Callable[[Plan], list[tuple]], types: list[pa.DataType], named: bool):
        self.rows_of, self.types, self.named = rows_of, types, named
        self.kinds: dict[tuple, int] = {}  # of rows
        self.known: dict[bytes, tuple[int, list]] = {}
        self.held = 0

    def wired(self, key: bytes, rows: list[tuple]) -> tuple[int, list]:
        """The number of rows, and per column an array of fixed values or a list of cells."""
        nodes = [
            (a, b, None if no_text else 2 * i, None if first < 0 else 2 * first + 1)
            for i, (table, a, b, _, no_text, first) in enumerate(rows) if not table
        ]
        found = self.rows_of(Plan(nodes, [(a, b, place) for table, a, b, place, _, _ in rows if table], self.named))
        columns = [
            list(cells) if any(isinstance(c, (Text, Sorted, Largest)) for c in cells) else pa.array(cells, kind)
            for cells, kind in zip(zip(*found), self.types)
        ]
        self.held += len(found) + len(rows) + sum(len(c.parts) for cells in found for c in cells if isinstance(c, Text))
        self.known[key] = len(found), columns
        return len(found), columns

    def row_kinds(self, columns: dict[str, pa.Array], plan: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Per row the number of its kind, and per row a number into the kinds of this batch."""
        size = len(plan)
        fields = [_codes(columns[c]) for c in ("_table", "_a", "_b", "_place")]
        no_text = columns["_c"].is_null().to_numpy(zero_copy_only=False) if "_c" in columns else np.zeros(size, bool)
        fields.append((no_text.astype(np.int64), [False, True]))
        first = _first_equal(columns["_d"], plan, start) if "_d" in columns else np.full(size, -1)
        values, at = np.unique(first, return_inverse=True)
        fields.append((at, values.tolist()))
        code, width = np.zeros(size, np.int64), 1
        for at, values in fields:
            if width * len(values) >= 1 << 62:
                distinct, code = np.unique(code, return_inverse=True)
                width = len(distinct)
            code, width = code * len(values) + at, width * len(values)
        _, example, code = np.unique(code, return_index=True, return_inverse=True)
        kinds = [tuple(values[at[i]] for at, values in fields) for i in example.tolist()]
        return code, kinds

    def fill(self, batch: pa.Table) -> Iterator[list[pa.Array]]:
        """Columns of the rows of all plans in a batch that holds whole plans."""
        if self.held > _KEPT or len(self.kinds) > _KEPT:
            self.kinds, self.known, self.held = {}, {}, 0
        columns = {c: x.combine_chunks() for c, x in zip(batch.column_names, batch.columns)}
        ids = columns.pop("query_id")
        starts = _starts(ids)
        ends = np.append(starts[1:], len(ids))
        plan = np.repeat(np.arange(len(starts)), ends - starts)
        code, kinds = self.row_kinds(columns, plan, starts[plan])
        numbers = np.array([self.kinds.setdefault(k, len(self.kinds)) for k in kinds], np.int64)[code]
        alike: dict[bytes, list[int]] = {}
        for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            alike.setdefault(numbers[start:end].tobytes(), []).append(i)
        texts = [columns.get("_c"), columns.get("_d")]
        lists = cache(lambda of: texts[of].to_pylist())
        out: list[list[pa.Array]] = [[] for _ in range(len(self.types) + 1)]
        rows = 0
        for key, members in alike.items():
            at = members[0]
            count, cells = self.known.get(key) or self.wired(key, [kinds[k] for k in code[starts[at]:ends[at]].tolist()])
            if not count:
                continue
            first = starts[members]
            few = len(members) <= _FEW
            held: dict[int, pa.Array] = {}

            def place(p: int) -> pa.Array:
                if p not in held:
                    held[p] = texts[p % 2].take(pa.array(first + p // 2))
                return held[p]

            def filled(cell: str | int | None | Text | Sorted | Largest, kind: pa.DataType) -> pa.Array:
                if not isinstance(cell, (Text, Sorted, Largest)):
                    return pa.repeat(pa.scalar(cell, kind), len(members))
                if isinstance(cell, Text) and not few:
                    parts = [p if isinstance(p, str) else place(p) for p in cell.parts]
                    if any(not isinstance(p, str) for p in parts):
                        return pc.binary_join_element_wise(*parts, "").cast(kind)
                    return pa.repeat(pa.scalar("".join(parts), kind), len(members))
                return pa.array([cell.read(lambda p: lists(p % 2)[s + p // 2]) for s in first.tolist()], kind)

            out[0].append(ids.take(pa.array(np.tile(first, count))))
            places = np.repeat(np.arange(count), len(members))
            for column, made, kind in zip(cells, out[1:], self.types):
                if isinstance(column, list):
                    made.append(pa.concat_arrays([filled(cell, kind) for cell in column]))
                else:
                    made.append(column.take(pa.array(places)))
            rows += count * len(members)
            if rows >= _FLUSH:
                yield [pa.concat_arrays(x) for x in out]
                out, rows = [[] for _ in out], 0
        if rows:
            yield [pa.concat_arrays(x) for x in out]


def per_plan(
    nodes: DataFrame | None, edges: DataFrame, schema: str, rows_of: Callable[[Plan], list[tuple]], texts: Sequence[str] = ()
) -> DataFrame:
    """(query_id, *schema): the rows that ``rows_of`` gives for each plan, after one shuffle by query_id.

    ``rows_of`` is called once for plans that are wired alike: equal nodes and kinds, equal edges in edge order, the same
    nodes with equal results. ``texts`` names what it uses of ``parameter`` and ``result``; the rest is not shuffled.
    Without nodes a plan's nodes are the ends of its edges.
    """
    own = [(c, name) for c, name in (("_c", "parameter"), ("_d", "result")) if name in texts]
    held = edges.select(
        "query_id", F.lit(1).cast("byte").alias("_table"), F.col("edge").cast("long").alias("_edge"), F.col("child").alias("_a"),
        F.col("parent").alias("_b"), F.col("place").cast("long").alias("_place"), *[F.lit(None).cast("string").alias(c) for c, _ in own],
    )
    if nodes is not None:
        zero = F.lit(None).cast("long")
        held = held.unionAll(nodes.select("query_id", F.lit(0).cast("byte"), zero, "node", "kind", zero, *[name for _, name in own]))
    names = ["query_id", *(f.strip().split(" ")[0] for f in schema.split(","))]
    types = [_TYPES[f.strip().split(" ")[1]] for f in schema.split(",")]
    named = nodes is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = _Walks(rows_of, types, named)
        held: list[pa.RecordBatch] = []  # from the first row of the plan that may go on

        def filled() -> Iterator[pa.RecordBatch]:
            for columns in walks.fill(pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            last = int(_starts(ids)[-1])
            if last or held and held[-1].column(0)[-1].as_py() != ids[0].as_py():
                if last:
                    held.append(batch.slice(0, last))
                yield from filled()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from filled()

    dealt = held.repartition("query_id").sortWithinPartitions("query_id", "_table", "_edge").drop("_edge")
    return dealt.mapInArrow(run, f"query_id {edges.schema['query_id'].dataType.simpleString()}, {schema}")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no other node consumes."""
    used = edges.select("query_id", F.col("child").alias("node"))
    return plan_join(nodes, used, ["query_id", "node"], "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without operands."""
    fed = edges.select("query_id", F.col("parent").alias("node"))
    return plan_join(nodes, fed, ["query_id", "node"], "left_anti")


def first_consumers(edges: DataFrame) -> DataFrame:
    """Per node the consumer named by its earliest edge."""
    first = F.min_by("parent", "edge").alias("consumer")
    return edges.groupBy("query_id", F.col("child").alias("node")).agg(first)


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, problem, n): nodes on or above a cycle, and edges without a node at either end."""

    def rows(plan: Plan) -> list[tuple]:
        found = [("cycle", len(plan.nodes) - len(plan.order)), ("dangling edge", plan.dangling)]
        return [x for x in found if x[1]]

    return per_plan(nodes, edges, "problem string, n long", rows)


def descendants(edges: DataFrame) -> DataFrame:
    """All (node, descendant) pairs of every plan; a node on a cycle is its own descendant."""
    return per_plan(
        None, edges, "node string, descendant string", lambda plan: [(n, d) for n in plan.nodes for d in plan.below(n)]
    )


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node the length of its longest path from a leaf, null on and above a cycle."""
    return per_plan(nodes, edges, "node string, level int", lambda plan: list(plan.levels().items()))


def exec_status(
    nodes: DataFrame, edges: DataFrame, subsets: Mapping[str, Sequence[str]] = SUBSETS
) -> DataFrame:
    """Per node and operator subset: ``0`` open, ``1`` done, ``last`` done and still needed.

    A node is done when its own kind and those of all its descendants are in the
    subset; it is still needed when a consumer is open or it has no consumer.
    """

    def rows(plan: Plan) -> list[tuple]:
        masks = plan.masks()
        return [(n, omega, s) for omega, kinds in subsets.items() for n, s in plan.status(masks, kinds).items()]

    return per_plan(nodes, edges, "node string, omega string, status string", rows)


def residual(status: DataFrame) -> DataFrame:
    """Tokens left per plan and subset: open nodes and the results they still need."""
    return status.groupBy("query_id", "omega").agg(F.count_if(F.col("status") != "1").alias("tokens"))


def residuals(nodes: DataFrame, edges: DataFrame, subsets: Mapping[str, Sequence[str]] = SUBSETS) -> DataFrame:
    """``residual`` of the execution status, counted where a plan is walked."""

    def rows(plan: Plan) -> list[tuple]:
        masks = plan.masks() if plan.nodes else {}
        return [(omega, sum(s != "1" for s in plan.status(masks, kinds).values())) for omega, kinds in subsets.items() if masks]

    return per_plan(nodes, edges, "omega string, tokens long", rows)


def merge_equal(nodes: DataFrame, edges: DataFrame, subsets: Mapping[str, Sequence[str]] = SUBSETS) -> DataFrame:
    """Shared name for needed nodes of one plan and subset whose results are equal."""

    def rows(plan: Plan) -> list[tuple]:
        masks = plan.masks()
        return [
            (omega, n, name)
            for omega, kinds in subsets.items() for n, name in plan.shared(plan.status(masks, kinds)).items()
        ]

    return per_plan(nodes, edges, "omega string, node string, shared string", rows, ["result"])


def _kind_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select("query_id", "node", "kind")
    child = kinds.withColumnsRenamed({"node": "child", "kind": "child_kind"})
    parent = kinds.withColumnsRenamed({"node": "parent", "kind": "parent_kind"})
    return plan_join(plan_join(edges, child, ["query_id", "child"]), parent, ["query_id", "parent"])


def shape_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How often a node of one kind feeds a node of another."""
    return _kind_pairs(nodes, edges).groupBy("child_kind", "parent_kind").agg(F.count(F.lit(1)).alias("n"))
