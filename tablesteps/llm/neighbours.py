"""Approximate nearest neighbours by balanced posting lists.

1. Centroids: a bounded sample of unit vectors is halved along its main direction until every part
   is small; the parts, equal in size by construction, give the centroids.
2. Graph: each centroid is linked to its nearest ones. A best-first search over the graph, held in
   memory by every task, finds the centroids near a vector.
3. Posting lists: every vector goes to the list of its nearest centroid and, near a boundary, to further
   lists whose distance is within a ratio of the nearest one. Lists are dealt into parts of bounded size, and the
   queries that read a list into blocks, so a list that holds a third of all vectors is many tasks' work.
4. Search: a query reads the lists whose distance is within a ratio of its nearest centroid's. Each part keeps
   its best candidates, ties included, with their exact cosine; the best of all parts are the result.

Distances between unit vectors order them as their cosines do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

SAMPLE_ROWS = 16_384  # vectors that the centroids are learnt from, at most
LIST_ROWS = 64  # sampled vectors per centroid, about
LINKS = 24  # neighbours of a centroid in the graph
BEAM = 160  # centroids that a graph search keeps
REPLICAS, REPLICA_RATIO = 4, 1.08  # lists a vector is written to at most; distance ratio of the last
PROBE_RATIO = 1.35  # distance ratio of the last list that a query reads
PART_ROWS = 4096
QUERY_ROWS = 1024  # queries of a list that meet one of its parts in a task, about


def usable(vectors: list[list[float | None] | None]) -> np.ndarray:
    """Which vectors take part: not null, not zero, without null or non-finite components."""
    good = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            x = np.asarray(v, np.float64)
            good[i] = bool(np.isfinite(x).all() and x.any())
    return good


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither large nor small components are lost."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_centroids(sample: np.ndarray, list_rows: int = LIST_ROWS) -> np.ndarray:
    """Centroids of equal parts of the sample, found by halving it along its main direction."""
    found, parts = [], [np.arange(len(sample))]
    while parts:
        rows = parts.pop()
        x = sample[rows]
        centre = x.mean(0)
        spread = x - centre
        if len(rows) <= list_rows or not np.abs(spread).max() > 1e-9:
            found.append(centre if np.abs(centre).max() > 1e-9 else x[0])
            continue
        direction = spread[np.argmax((spread * spread).sum(1))]
        for _ in range(8):  # power steps towards the main direction
            direction = spread.T @ (spread @ direction)
            direction /= np.linalg.norm(direction)
        order = np.argsort(spread @ direction, kind="stable")
        half = len(rows) // 2
        parts += [rows[order[half:]], rows[order[:half]]]
    return np.unique(unit(np.stack(found)), axis=0)


class Graph:
    """Centroids with links to their nearest ones, searched best first from a few spread entries."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        width = min(LINKS, n - 1)
        links = []
        for start in range(0, n, 1024):
            near = self.centroids[start : start + 1024] @ self.centroids.T
            near[np.arange(len(near)), np.arange(start, start + len(near))] = -2
            links.append(np.argpartition(-near, max(0, width - 1), 1)[:, :width] if width else np.zeros((len(near), 0), int))
        nearest = np.concatenate(links)
        # A ring through all centroids and a long link each keep every centroid in reach.
        every = np.arange(n)
        self.links = np.c_[nearest, (every + 1) % n, (every + n // 2) % n].astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int32))

    def search(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) near each unit vector, nearest first, -1 where fewer are found.

        All vectors advance together: in a step each expands its nearest centroid not yet expanded,
        until all that it keeps are.
        """
        q, n = len(vectors), len(self.centroids)
        vectors = vectors.astype(np.float32)
        beam = min(beam, n)
        seen = np.zeros((q, n), bool)
        seen[:, self.entries] = True
        ids = np.full((q, beam + self.links.shape[1] + len(self.entries)), -1, np.int32)
        near = np.full(ids.shape, -np.inf, np.float32)
        done = np.zeros(ids.shape, bool)
        ids[:, : len(self.entries)] = self.entries
        near[:, : len(self.entries)] = vectors @ self.centroids[self.entries].T
        rows = np.arange(q)
        while len(rows):
            order = np.argsort(-near[rows], 1, kind="stable")
            ids[rows] = np.take_along_axis(ids[rows], order, 1)
            near[rows] = np.take_along_axis(near[rows], order, 1)
            done[rows] = np.take_along_axis(done[rows], order, 1)
            open_place = (ids[rows, :beam] >= 0) & ~done[rows, :beam]
            rows = rows[open_place.any(1)]
            if not len(rows):
                break
            at = np.argmax((ids[rows, :beam] >= 0) & ~done[rows, :beam], 1)
            done[rows, at] = True
            fresh = self.links[ids[rows, at]]
            known = seen[rows[:, None], fresh]
            # A link listed twice counts once.
            ordered = np.sort(fresh, 1)
            if (ordered[:, 1:] == ordered[:, :-1]).any():
                first = np.argsort(fresh, 1, kind="stable")
                again = np.zeros_like(known)
                same = np.take_along_axis(fresh, first, 1)
                np.put_along_axis(again, first[:, 1:], same[:, 1:] == same[:, :-1], 1)
                known |= again
            seen[rows[:, None], fresh] = True
            value = np.einsum("rld,rd->rl", self.centroids[fresh], vectors[rows])
            tail = slice(beam, beam + fresh.shape[1])
            ids[rows, tail] = np.where(known, -1, fresh)
            near[rows, tail] = np.where(known, -np.inf, value)
            done[rows, tail] = False
            ids[rows, tail.stop :] = -1
            near[rows, tail.stop :] = -np.inf
        distance = np.sqrt(np.maximum(0, 2 - 2 * near[:, :beam].astype(np.float64)))
        return ids[:, :beam], distance

    def lists(self, vectors: np.ndarray, ratio: float, most: int | None = None) -> list[np.ndarray]:
        """The lists of each vector: its nearest centroid's, and those within ``ratio`` times its distance."""
        out: list[np.ndarray] = []
        for start in range(0, len(vectors), 512):
            ids, distance = self.search(vectors[start : start + 512])
            good = (ids >= 0) & (distance <= ratio * distance[:, :1] + 1e-7)
            out += [i[g][:most] for i, g in zip(ids, good)]
        return out


def _listed(graph: Graph, every: int, dimension: int):
    """Rows (list, kind, id, vector): one per list of a vector, and one per list that a query reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            vectors = batch.column("embedding").to_pylist()
            good = usable(vectors)
            rows = [i for i in np.flatnonzero(good).tolist() if ids[i] is not None and len(vectors[i]) == dimension]
            if not rows:
                continue
            original = np.array([vectors[i] for i in rows], np.float64)
            scaled = unit(original)
            out = []
            for i, lists in zip(range(len(rows)), graph.lists(scaled, REPLICA_RATIO, REPLICAS)):
                out += [(int(k), 1, i) for k in lists]
            asked = [i for i, r in enumerate(rows) if ids[r] % every == 0]
            if asked:
                for i, lists in zip(asked, graph.lists(scaled[asked], PROBE_RATIO)):
                    out += [(int(k), 0, i) for k in lists]
            for start in range(0, len(out), 4096):
                some = out[start : start + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in some], pa.int32()),
                        pa.array([kind for _, kind, _ in some], pa.int32()),
                        pa.array([ids[rows[i]] for _, _, i in some], pa.int64()),
                        pa.array([original[i].tobytes() for _, _, i in some], pa.binary()),
                    ],
                    ["list", "kind", "id", "vector"],
                )

    return run


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision; equal rows get equal values."""
    products = (vectors * query).sum(1)
    return products / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _searched(k: int):
    """The k best candidates of each query of a block in a part; rows come sorted by (list, part, block, kind), queries first.

    A query met again with the same vector is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, held, best = None, [], set(), {}

        def flush():
            rows = [(q, int(v), float(s)) for (q, _), (ids, scores) in zip(queries, best.values()) for v, s in zip(ids, scores)]
            if rows:
                query, vec, score = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

        for batch in batches:
            lists, parts, blocks, kinds, ids = (batch.column(i).to_numpy() for i in range(5))
            vectors = batch.column(5)
            change = (lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])
            bounds = np.r_[0, np.flatnonzero(change) + 1, len(ids)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b == a:
                    continue
                if (lists[a], parts[a], blocks[a]) != at:
                    yield from flush()
                    at, queries, held, best = (lists[a], parts[a], blocks[a]), [], set(), {}
                x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in vectors[a:b]])
                if kinds[a] == 0:
                    for query, vector in zip(ids[a:b].tolist(), x):
                        if (query, vector.tobytes()) not in held:
                            held.add((query, vector.tobytes()))
                            queries.append((query, vector))
                    continue
                if not queries:
                    continue
                near = unit(np.stack([v for _, v in queries])) @ unit(x).T
                for row, (query, vector) in enumerate(queries):
                    other = np.flatnonzero(ids[a:b] != query)
                    if len(other) > k:  # the product rounds; keep all that it can not tell from the last
                        least = np.partition(near[row, other], len(other) - k)[len(other) - k]
                        other = other[near[row, other] >= least - 1e-9]
                    found_ids, found = ids[a:b][other], cosines(vector, x[other])
                    if row in best:
                        found_ids, found = np.r_[best[row][0], found_ids], np.r_[best[row][1], found]
                    keep = _best(found_ids, found, k)
                    best[row] = (found_ids[keep], found[keep])
        yield from flush()

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each vec_id divisible by ``every``.

    Nearness is the cosine of the original vectors in double precision, ties going to the smaller vec_id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without a vec_id and vectors of another length than most (the smaller one on a tie). Rows that repeat a
    vec_id are one vector, their largest score counts; a vector is no candidate of its own id. A query without candidates has no row.
    Other columns are not read. The sample for the centroids is the ``SAMPLE_ROWS`` rows with the smallest
    hash of vec_id; every vector is indexed.
    """
    vectors = vectors.select("vec_id", "embedding")
    sizes = vectors.where("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count()
    common = sizes.orderBy(F.col("count").desc(), "n").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dimension = common["n"]
    order = F.xxhash64("vec_id")
    sample = vectors.where((F.size("embedding") == dimension) & F.col("vec_id").isNotNull()).orderBy(order, "vec_id").limit(SAMPLE_ROWS)
    rows = [r["embedding"] for r in sample.collect()]
    rows = [v for v, good in zip(rows, usable(rows)) if good]
    if not rows:
        return empty
    graph = Graph(learn_centroids(unit(np.array(rows, np.float64))))

    listed = durable(vectors.mapInArrow(_listed(graph, every, dimension), "list int, kind int, id long, vector binary"))
    parts, blocks = (F.ceil(F.count_if(F.col("kind") == kind) / rows).cast("int") for kind, rows in ((1, PART_ROWS), (0, QUERY_ROWS)))
    sizes = listed.groupBy("list").agg(parts.alias("parts"), blocks.alias("blocks")).where("parts > 0 and blocks > 0")
    dealt = listed.join(F.broadcast(sizes), "list")  # at most one row per centroid

    def places(kind: int, count: str, *content: str):
        """One place by content for rows of ``kind``, every place for the others."""
        own = F.array(F.pmod(F.xxhash64(*content), F.col(count)).cast("int"))
        return F.explode(F.when(F.col("kind") == kind, own).otherwise(F.sequence(F.lit(0), F.col(count) - 1)))

    # By id and vector, as many vectors may have one id.
    dealt = dealt.select("*", places(1, "parts", "id", "vector").alias("part"))
    dealt = dealt.select("list", "part", places(0, "blocks", "id", "vector").alias("block"), "kind", "id", "vector")
    found = (
        dealt.repartition("list", "part", "block").sortWithinPartitions("list", "part", "block", "kind", "id")
        .mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
