"""N-gram Jaccard join: documents linked by the share of word shingles they have in common.

The documents are rows of a sparse 0/1 matrix with one column per distinct shingle; the
product of the matrix with its transpose holds the size of every intersection. The job
multiplies only blocks that can hold a link:

1. Rows with equal sets are one row from here on (copies are never paired).
2. Two rows at or above the threshold differ in at most ``d`` columns, and ``d`` follows from
   their sizes. The columns are dealt by hash into more than ``d`` groups, so two linked rows
   agree entirely on at least one group, and mostly on many: of the groups a row fills, all but
   ``d`` are equal in a linked row. Rows that share fewer are never multiplied. This is exact: no
   row, partner or group is capped.
3. Rows that share a group with the same smallest partner form a block of bounded size. For each
   row and block, the groups shared are counted; rows with enough of them go into the
   product of their own block with that one. Each pair of blocks is multiplied in a task, a range of columns at a time.
   Overlap counts accumulate, and a pair leaves once its count plus the columns still to come
   is below the bound from its sizes. A block pair returns a spanning forest of its links,
   so the output is linear in the rows even where all of them are linked.
4. Links between blocks are joined to components by alternating star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .files import release
from .textbytes import U64, mix, shingles, slices

BLOCK_ROWS = 768  # rows of a block at most
BLOCK_CELLS = 1 << 18  # set cells of a block, on average at most
COLUMNS = 4096  # columns multiplied at a time
NOTE_SIZE, NOTE_NEED = 36, 12  # places of a set's size and of the count it needs in a note
SIZE_STEP = 1.3  # a size class ends at this many times the end of the class before


def set_key(cells: np.ndarray) -> int:
    """A 64-bit key of a set of shingle hashes."""
    total = mix(cells + U64(0x1234567)).sum(keepdims=True) + U64(len(cells))
    return int(mix(total).view(np.int64)[0])


class Classes:
    """Size classes and the number of column groups in each, for a threshold in per cent."""

    def __init__(self, percent: int):
        if not 60 <= percent <= 100:  # below, the columns of a small set may not outnumber the differences
            raise ValueError("the threshold has to be 60 to 100 per cent")
        self.percent, self.ends, self.groups = percent, [0, 1], [1, 1]

    def reach(self, size: int) -> range:
        """The classes of all partners that are at least as large as a set of ``size``."""
        largest = size * 100 // self.percent
        while self.ends[-1] < largest:
            below = self.ends[-1]
            end = max(below + 1, int(below * SIZE_STEP))
            differ = 2 * end * (100 - self.percent) // (100 + self.percent)
            spare = 0
            if differ:  # some groups may be empty in a row; leave room for a usual number of them
                least = (below + 1) * self.percent / 100
                for _ in range(8):
                    n = differ + 1 + spare
                    empty = n * math.exp(-least / n)
                    spare = math.ceil(empty + 2 * math.sqrt(empty))
            self.ends.append(end)
            self.groups.append(differ + 1 + spare)
        low = int(np.searchsorted(self.ends, size))
        return range(low, int(np.searchsorted(self.ends, largest)) + 1)

    def signatures(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One hash per class in reach and non-empty column group of a set, and a number for each.

        The number holds the size of the set, the least count of equal hashes that a linked set of this class
        shares with it, and a tag of class and seed, within which they are counted.

        If the set fills no more groups than it may differ in from a partner, they might agree on
        empty groups alone, so the columns are dealt again under the next seed as well. Of two
        linked sets, the one that stops first has filled enough groups under its last seed, and the other has
        signatures under that seed too.
        """
        found, notes = [], []
        content = mix(cells + U64(0x9D2C5680))
        size = len(cells)
        for c in self.reach(size):
            groups = self.groups[c]
            partner = min(self.ends[c], size * 100 // self.percent)
            differ = (size + partner) * (100 - self.percent) // (100 + self.percent)
            seed = 0
            while True:
                dealt = (mix(cells ^ U64(0xA0761D6478BD642F * (seed + 1) % (1 << 64))) >> U64(32)) * U64(groups) >> U64(32)
                order = np.argsort(dealt, kind="stable")
                dealt = dealt[order]
                first = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]])
                sums = np.add.reduceat(content[order], first)
                tag = U64((c << 48) + (seed << 32)) + dealt[first]
                found.append(mix(sums ^ mix(tag + U64(0x632BE59BD9B4E019))))
                need = max(1, len(first) - differ)
                note = (size << NOTE_SIZE) | (need << NOTE_NEED) | ((16 * c + seed) % (1 << NOTE_NEED))
                notes.append(np.full(len(first), note, np.int64))
                if len(first) > differ:
                    break
                seed += 1
        return np.concatenate(found), np.concatenate(notes)


def _keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for _, _, texts in slices(batch.column("text")):
                for cells in shingles(texts, words):
                    sizes.append(len(cells))
                    keys.append(set_key(cells) if len(cells) else None)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                [*batch.schema.names[:-1], "n_shingles", "set_key"],
            )

    return run


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signature_rows(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(percent), set()
        for batch in batches:
            for _, _, texts in slices(batch.column("text")):
                sigs, notes, members = [], [], []
                for cells in shingles(texts, words):
                    if len(cells) and (key := set_key(cells)) not in seen:
                        if len(seen) >= 1 << 20:  # bounded; a copy met again only repeats its rows
                            seen.clear()
                        seen.add(key)
                        for found, into in zip(classes.signatures(cells), (sigs, notes)):
                            into.append(found)
                        members.append(key)
                if sigs:
                    counts = [len(s) for s in sigs]
                    yield pa.RecordBatch.from_arrays(
                        [
                            _signed(np.concatenate(sigs)),
                            pa.array(np.repeat(np.array(members, np.int64), counts)),
                            pa.array(np.concatenate(notes)),
                        ],
                        ["sig", "member", "note"],
                    )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, member), those whose sig has two members or more, with its first member.

    Only the first and the last row of the open run are kept between batches.
    """
    carry = None  # sig, first member, its note, last member, whether the first row is out
    for batch in batches:
        sig, member, note = (batch.column(i).to_numpy() for i in range(3))
        if carry is not None:
            sig, member, note = np.r_[carry[0], sig], np.r_[carry[1], member], np.r_[carry[2], note]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])] if len(sig) else np.zeros(0, bool)
        if carry is not None:  # the last member of the batch before, met again
            fresh[1:] &= ~((sig[1:] == carry[0]) & (member[1:] <= carry[3]))
        sig, member, note = sig[fresh], member[fresh], note[fresh]
        if not len(sig):
            continue
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        lengths = np.diff(np.r_[first, len(sig)])
        shared = np.repeat(lengths > 1, lengths)
        pivot = np.repeat(member[first], lengths)
        was_out = carry is not None and carry[4]
        same_run = carry is not None and sig[-1] == carry[0]
        out = (same_run and was_out) or lengths[-1] > 1
        last = max(int(member[-1]), carry[3]) if same_run else int(member[-1])
        state = (sig[first[-1]], member[first[-1]], note[first[-1]], last, out)
        if was_out and sig[0] == carry[0]:
            shared[0] = False
        carry = state
        if shared.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[shared]) for x in (sig, member, note, pivot)], ["sig", "member", "note", "pivot"]
            )


def _cells(words: int):
    """Sets of the candidates; a text that shares the id and hash of a candidate but not its set is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("member").to_numpy()
            for row, _, texts in slices(batch.column("text")):
                rows, cells = [], []
                for i, c in enumerate(shingles(texts, words), row):
                    if len(c) and set_key(c) == want[i]:
                        rows.append(i)
                        cells.append(c.tobytes())
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("member").take(taken), pa.array(cells, pa.binary())], ["member", "cells"]
                )

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows of ``left`` and ``right`` are linked, by the blocked product of their cells."""
    n, m = (np.array([len(c) for c in side], np.int64) for side in (left, right))
    total = n[:, None] + m[None, :]
    # |A and B| >= t |A or B|  <=>  (100 + t) |A and B| >= t (|A| + |B|)
    need = -(-total * percent // (100 + percent))
    alive = np.minimum(n[:, None], m[None, :]) >= need
    count = np.zeros(total.shape, np.float32)
    flat = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(k)), k) for k in (n, m)]
    common = np.intersect1d(flat[0], flat[1])
    places = []
    for side in range(2):
        place = np.minimum(np.searchsorted(common, flat[side]), max(0, len(common) - 1))
        hit = common[place] == flat[side] if len(common) else np.zeros(len(place), bool)
        places.append((rows[side][hit], place[hit]))
    left_to_come, right_to_come = (np.bincount(r, minlength=len(k)) for (r, _), k in zip(places, (n, m)))
    alive &= np.minimum(left_to_come[:, None], right_to_come[None, :]) >= need
    for start in range(0, len(common), COLUMNS):
        if not alive.any():
            break
        sides = []
        for (r, p), k, to_come in zip(places, (n, m), (left_to_come, right_to_come)):
            inside = (p >= start) & (p < start + COLUMNS)
            cell = np.zeros((len(k), min(COLUMNS, len(common) - start)), np.float32)
            cell[r[inside], p[inside] - start] = 1
            to_come -= np.bincount(r[inside], minlength=len(k))
            sides.append(cell)
        open_rows, open_columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        count[np.ix_(open_rows, open_columns)] += sides[0][open_rows] @ sides[1][open_columns].T
        alive &= count + np.minimum(left_to_come[:, None], right_to_come[None, :]) >= need
    return alive & (count >= need)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (member, root) that join the same rows as the links do, at most one per row."""
    a, b = [], []
    rows_left, columns_left = np.ones(len(left), bool), np.ones(len(right), bool)
    for start in np.flatnonzero(linked.any(1)):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        root, frontier = int(left[start]), np.array([start])
        while len(frontier):
            columns = np.flatnonzero(linked[frontier].any(0) & columns_left)
            columns_left[columns] = False
            frontier = np.flatnonzero(linked[:, columns].any(1) & rows_left)
            rows_left[frontier] = False
            for x in (*right[columns].tolist(), *left[frontier].tolist()):
                if x != root:
                    a.append(x)
                    b.append(root)
    return a, b


def _multiply(percent: int):
    """Links of each pair of blocks; rows come sorted by (one, other, side)."""

    def links(group: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        for side, member, cells in group:
            sides[side][member] = np.frombuffer(cells, U64)
        left, right = sides[0], sides[1] or sides[0]
        if not left or not right or (left is right and len(left) < 2):
            return None
        linked = _overlaps(list(left.values()), list(right.values()), percent)
        a, b = _forest(linked, np.array(list(left)), np.array(list(right)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            for one, other, side, member, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if (one, other) != at:
                    if group and (found := links(group)) is not None:
                        yield found
                    at, group = (one, other), []
                group.append((side, member, cells))
        if group and (found := links(group)) is not None:
            yield found

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of ``edges`` but the smallest of its component, with that smallest node.

    Large-star and small-star steps in turn; a node's neighbours are never gathered. The result
    of each step is written to the checkpoint folder. Self-loops and repeated edges do no harm.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a")
        now = durable(
            small.select("b", "low").where("b <> low").toDF("a", "b").union(lowest.toDF("a", "b")).distinct()
        )
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            return now
        state = after


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """Component of every document: (doc_id, *carry, n_shingles, set_key, component_key, component_id).

    Words are runs of anything but space and 0x09-0x0D, with A-Z lower-cased. Two documents are
    linked when their distinct ``words``-word shingles have a Jaccard similarity of ``percent``
    per cent or more; ``component_id`` is the smallest doc_id reachable over links, and
    ``component_key`` is equal for the documents of a component alone.

    A null or empty text, or one without words, has no shingles, both keys null, is linked with
    nothing and is its own component. Repeated rows and repeated ids are rows of their own. A null
    doc_id counts for a component only if all ids in it are null. Of other columns only those in
    ``carry`` are read; an empty table gives an empty result.
    """
    content = "_" * (1 + max(map(len, carry), default=0)) + "text"  # longer than the names in ``carry``
    docs = docs.select("doc_id", *carry, F.xxhash64("text").alias(content), "text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]]
    keyed = durable(docs.mapInArrow(_keys(words), ", ".join([*kept, "n_shingles long", "set_key long"])))
    # A set's text is read from one row, named by id and text hash: of many texts under one id only that one is read.
    sets = keyed.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").alias("id"), F.col(content).alias("text"))).alias("row")
    )

    rows = docs.select("text").mapInArrow(_signature_rows(words, percent), "sig long, member long, note long")
    shared = durable(
        rows.repartition("sig").sortWithinPartitions("sig", "member").mapInArrow(
            _shared, "sig long, member long, note long, pivot long"
        )
    )
    release(docs.sparkSession)  # the signatures are the largest shuffle of all
    size = F.shiftright("note", NOTE_SIZE)
    labels = shared.groupBy("member").agg(F.min("pivot").alias("label"), F.min(size).alias("size"))
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_CELLS))
    large = labels.groupBy("label").agg(chunks.alias("chunks")).where("chunks > 1")
    chunk = F.pmod(F.xxhash64("member"), F.coalesce("chunks", F.lit(1)))
    blocks = durable(labels.join(large, "label", "left").select("member", F.xxhash64("label", chunk).alias("block")))

    # Per row, block and tag the number of equal groups; its own block counts if another row has the group.
    held = shared.select("sig", "member", "note").join(blocks, "member")
    touched = held.groupBy("sig", F.col("block").alias("with")).agg(F.count(F.lit(1)).alias("n"))
    need = F.shiftright(F.col("note"), NOTE_NEED).bitwiseAND(F.lit((1 << (NOTE_SIZE - NOTE_NEED)) - 1))
    chosen = durable(
        held.join(touched, "sig").where("block <> with OR n > 1")
        .groupBy("member", "block", "with", "note").agg(F.count(F.lit(1)).alias("equal")).where(F.col("equal") >= need)
        .select("member", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"),
                F.when(F.col("block") > F.col("with"), 1).otherwise(0).alias("side"))
        .distinct()
    )
    # A product needs two rows, and of two blocks one row of each.
    products = (
        chosen.groupBy("one", "other").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("a"), F.max("side").alias("b"))
        .where("n > 1 AND (one = other OR a <> b)").select("one", "other")
    )
    work = durable(chosen.join(products, ["one", "other"]))
    release(docs.sparkSession)
    named = work.select("member").distinct().join(sets, F.col("member") == F.col("set_key"))
    named = named.select("member", F.col("row.id").alias("_id"), F.col("row.text").alias("_hash"))
    filled = (
        docs.select("doc_id", content, "text").join(named, (F.col(content) == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("member", "text").mapInArrow(_cells(words), "member long, cells binary")
        .groupBy("member").agg(F.first("cells").alias("cells"))  # wholly equal rows have equal cells
    )
    links = (
        work.join(filled, "member").select("one", "other", "side", "member", "cells")
        .repartition("one", "other").sortWithinPartitions("one", "other", "side", "member")
        .mapInArrow(_multiply(percent), "a long, b long")
    )
    roots = components(links)

    # Smallest id of each component; a component of one set has no row in ``roots``.
    linked = roots.union(roots.select("b", "b").distinct()).toDF("set_key", "root")
    least = linked.join(sets, "set_key").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("set_key", "root", "component_id")
    final = durable(
        sets.join(named, "set_key", "left").select(
            F.col("set_key").alias("_set"),
            F.coalesce("root", "set_key").alias("component_key"),
            F.coalesce("component_id", "first_id").alias("component_id"),
        )
    )
    release(docs.sparkSession)
    return keyed.join(final, F.col("set_key") == F.col("_set"), "left").select(
        "doc_id", *carry, "n_shingles", "set_key", "component_key", F.coalesce("component_id", "doc_id").alias("component_id")
    )
