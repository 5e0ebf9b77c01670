"""Near-copies by HyperMinHash: sets of word shingles sketched by compressed minima.

Every bucket of a sketch has a hash function of its own (with one function split over buckets, those of short
texts would stay empty). Of the smallest hash of a set a bucket keeps the count of leading zeros and the ten bits that
follow the first one: a register of 16 bits. Two sets with the same minimum have the same register, so bands of
registers find every pair that bands of whole minima would find.

1. Rows with equal sets are one row from here on.
2. Sketches are cut into 32 bands of 5 registers. Two sets at 85 per cent agree on some band but for a chance of
   (1 - 0.85^5)^32, about 1 in 100 million.
3. Sets that share a band with the same smallest set form blocks of bounded size, with that set in each. Within a block and then between blocks, whole sketches are
   compared: the share of equal registers, less what two sets of these sizes agree on by accident, estimates the
   Jaccard similarity. Pairs so far below the threshold that a linked pair would be once in a billion are left.
4. The others are verified on their full sets of shingles, unless links found before join them already.
   Blocks are only compared with each other for bands whose sets are not all joined after the first step, so a
   group of near-copies costs a pass over its rows, not over its pairs.
5. Links are joined to components by alternating star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .files import new_folder
from .jaccard import components, set_key
from .keybits import marked, packed_bits, unpacked_bits
from .textbytes import U64, mix, shingles, slices

BANDS, BAND_ROWS = 32, 5
REGISTERS = BANDS * BAND_ROWS
MANTISSA_BITS = 10
MISS = 1e-9  # chance that the estimate leaves out a pair right at the threshold
BLOCK_ROWS = 1024  # rows of a block at most
BLOCK_CELLS = 1 << 20  # shingles of a block, on average at most

_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def minima(cells: np.ndarray) -> np.ndarray:
    """The smallest hash of a set in every bucket."""
    least = np.full(REGISTERS, ~U64(0))
    for start in range(0, len(cells), 512):
        part = cells[start : start + 512]
        np.minimum(least, (_FACTORS[:, None] * part[None, :]).min(1), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one of each minimum, as 16-bit numbers."""
    x, zeros = least.copy(), np.zeros(least.shape, np.uint16)
    for step in (32, 16, 8, 4, 2, 1):
        small = x >> U64(64 - step) == 0
        x[small] <<= U64(step)
        zeros[small] += step
    mantissa = (x >> U64(63 - MANTISSA_BITS)) & U64((1 << MANTISSA_BITS) - 1)
    return (zeros << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each sketch."""
    parts = sketches.reshape(len(sketches), BANDS, BAND_ROWS).astype(U64)
    key = np.zeros(parts.shape[:2], U64) + np.arange(1, BANDS + 1, dtype=U64)
    for i in range(BAND_ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that a bucket of two sets of n and m elements with nothing in common has equal registers.

    Minima are about exponential with rates n and m; a register is a range of values, all ranges
    with the same count of leading zeros having the same width.
    """
    upper = 0.5 ** np.arange(64)
    width = upper / 2 / (1 << MANTISSA_BITS)
    total = (n + m)[..., None].astype(float)
    octave = np.exp(-total * upper / 2) - np.exp(-total * upper)
    return (octave * width).sum(-1) * n * m / (n + m)


def least_count(percent: int) -> int:
    """Equal registers that a pair at ``percent`` has but for a chance of MISS."""
    share, tail = percent / 100, 0.0
    for count in range(REGISTERS + 1):
        tail += math.comb(REGISTERS, count) * share**count * (1 - share) ** (REGISTERS - count)
        if tail > MISS:
            return count
    return REGISTERS


class Block:
    """Rows of one side of a comparison."""

    def __init__(self, rows: list[tuple]):
        """Rows of (member, size, root, sketch, ...)."""
        self.members = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.roots = np.array([r[2] for r in rows], np.int64)
        self.sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
        self.texts = [r[4] for r in rows] if rows and len(rows[0]) > 4 else None


def candidate_pairs(left: Block, right: Block, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal registers) of the pairs of different components whose estimate does not rule out a link."""
    need = least_count(percent)
    found = []
    for start in range(0, len(left.members), 32):
        part = slice(start, start + 32)
        n, m = left.sizes[part, None], right.sizes[None, :]
        equal = (left.sketches[part, None, :] == right.sketches[None, :, :]).sum(-1)
        open_pair = (equal >= need) & (left.roots[part, None] != right.roots[None, :])
        open_pair &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        if left is right:
            open_pair &= np.arange(len(left.members))[part, None] < np.arange(len(right.members))[None, :]
        i, j = np.nonzero(open_pair)
        if len(i):
            chance = accidental(n[i, 0], m[0, j])
            estimate = (equal[i, j] / REGISTERS - chance) / (1 - chance)
            good = estimate * REGISTERS > need - 1
            found.append((i[good] + start, j[good], equal[i, j][good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def verified_links(left: Block, right: Block, words: int, percent: int) -> list[tuple[int, int]]:
    """Links of two blocks on full sets; a pair that links found before join is passed over."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    cells: dict[int, np.ndarray] = {}

    def cells_of(block: Block, i: int) -> np.ndarray:
        member = block.members[i]
        if member not in cells:
            _, _, texts = next(slices(pa.array([block.texts[i]], pa.string())))
            cells[member] = next(shingles(texts, words))
        return cells[member]

    i, j, equal = candidate_pairs(left, right, percent)
    links = []
    for p in np.argsort(-equal, kind="stable").tolist():
        a, b = int(i[p]), int(j[p])
        one, other = top(int(left.roots[a])), top(int(right.roots[b]))
        if one == other:
            continue
        x, y = cells_of(left, a), cells_of(right, b)
        if len(x) > len(y):
            x, y = y, x
        place = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int(np.count_nonzero(y[place] == x))
        if 100 * common >= percent * (len(x) + len(y) - common):
            links.append((left.members[a], right.members[b]))
            parent[one] = other
    return links


def _sketched(words: int):
    """(doc_id, content, n_shingles, set_key, sketch); the sketch of a set met before may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row, end, texts in slices(batch.column("text")):
                sizes, keys, least, fresh = [], [], [], []
                for cells in shingles(texts, words):
                    sizes.append(len(cells))
                    keys.append(set_key(cells) if len(cells) else None)
                    fresh.append(len(cells) > 0 and keys[-1] not in seen)
                    if fresh[-1]:
                        if len(seen) >= 1 << 20:  # bounded; a set met again is only sketched again
                            seen.clear()
                        seen.add(keys[-1])
                        least.append(minima(cells))
                sketches = iter(registers(np.array(least)) if least else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(row, end - row) for i in range(2)], pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.int64()), pa.array([next(sketches).tobytes() if f else None for f in fresh], pa.binary()),
                    ],
                    ["doc_id", "content", "n_shingles", "set_key", "sketch"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(band_keys(sketches).reshape(-1).view(np.int64)),
                    pa.array(np.repeat(batch.column("set_key").to_numpy(), BANDS)),
                ],
                ["band", "member"],
            )


def _marked(packed: bytes):
    """Rows whose content hash is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unpacked_bits(packed)
        for batch in batches:
            hashed = batch.column("content").to_numpy().view(U64)
            yield batch.filter(pa.array(marked(wanted, hashed)))

    return run


def _by_pair(batches: Iterator[pa.RecordBatch], answer: Callable) -> Iterator[pa.RecordBatch]:
    """What ``answer(one, other, left, right)`` yields for each pair of blocks of rows sorted by (one, other, side)."""

    def done(at, group):
        if at is None:
            return
        left = Block([r for side, *r in group if side == 0])
        right = left if at[0] == at[1] else Block([r for side, *r in group if side == 1])
        if left.members and right.members and (left is not right or len(left.members) > 1):
            yield from answer(*at, left, right)

    at, group = None, []
    for batch in batches:
        for one, other, side, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (one, other) != at:
                yield from done(at, group)
                at, group = (one, other), []
            group.append((side, *row))
    yield from done(at, group)


def _compared(percent: int):
    def answer(one, other, left, right):
        i, j, _ = candidate_pairs(left, right, percent)
        if left is right:
            sides = [(0, left, np.union1d(i, j))]
        else:
            sides = [(0, left, np.unique(i)), (1, right, np.unique(j))]
        for side, block, rows in sides:
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one] * len(rows), pa.int64()), pa.array([other] * len(rows), pa.int64()),
                        pa.array([side] * len(rows), pa.int32()), pa.array([block.members[r] for r in rows], pa.int64()),
                    ],
                    ["one", "other", "side", "member"],
                )

    return lambda batches: _by_pair(batches, answer)


def _verified(words: int, percent: int):
    def answer(one, other, left, right):
        links = verified_links(left, right, words, percent)
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lambda batches: _by_pair(batches, answer)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """Component of every document: (doc_id, n_shingles, component_id, kept).

    Words are runs of anything but space and 0x09-0x0D, with A-Z lower-cased. Two documents are linked when their distinct ``words``-word shingles
    have a Jaccard similarity of ``percent`` per cent or more, confirmed on full sets; a text with fewer words is one
    shingle. ``component_id`` is the smallest doc_id reachable over links; ``kept`` tells whether that is the document's own.

    A null or empty text, or one without words, has no shingles, is linked with nothing and kept. Repeated rows
    and ids are rows of their own, and those with the smallest id are all kept. A null doc_id counts for a component only if all ids
    in it are null. Other columns than ``doc_id`` and ``text`` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    home = new_folder(spark, "near-duplicates")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}")

    docs = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = written(
        docs.mapInArrow(_sketched(words), f"doc_id {kind}, content long, n_shingles long, set_key long, sketch binary"), "keyed"
    )
    sets = written(
        keyed.where("set_key is not null").groupBy(F.col("set_key").alias("member")).agg(
            F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").alias("id"), "content")).alias("row"),
            F.first("n_shingles").alias("size"), F.first("sketch", ignorenulls=True).alias("sketch"),
        ),
        "sets",
    )
    bands = sets.select(F.col("member").alias("set_key"), "sketch").mapInArrow(_bands, "band long, member long")
    pivots = bands.groupBy("band").agg(F.min("member").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(bands.join(pivots.select("band", "pivot"), "band"), "shared")

    labels = shared.groupBy("member").agg(F.min("pivot").alias("label")).join(sets.select("member", "size"), "member")
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_CELLS))
    large = labels.groupBy("label").agg(chunks.alias("chunks")).where("chunks > 1")
    chunk = F.pmod(F.xxhash64("member"), F.coalesce("chunks", F.lit(1)))
    blocks = written(labels.join(large, "label", "left").select("member", "label", F.xxhash64("label", chunk).alias("block")), "blocks")

    def links(pairs: DataFrame, rows: DataFrame, step: str) -> DataFrame:
        """Verified links of (one, other, side, member); ``rows`` has the root of each member so far."""

        def dealt(df: DataFrame, *columns: str) -> DataFrame:
            return df.select("one", "other", "side", "member", "size", "root", "sketch", *columns).repartition(
                "one", "other").sortWithinPartitions("one", "other", "side", "member")

        close = written(
            dealt(pairs.join(rows, "member")).mapInArrow(_compared(percent), "one long, other long, side int, member long"), f"close-{step}"
        )
        named = written(close.select("member").distinct().join(sets.select("member", "row.*"), "member"), f"named-{step}")
        texts = docs.mapInArrow(_marked(packed_bits(named, "content")), docs.schema).alias("t").join(
            named.select("member", F.col("id").alias("_id"), F.col("content").alias("_content")),
            (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_id")),
        ).groupBy("member").agg(F.first("text").alias("text"))  # wholly equal rows have one text
        return written(
            dealt(close.join(rows, "member").join(texts, "member"), "text").mapInArrow(_verified(words, percent), "a long, b long"), f"links-{step}"
        )

    # Within blocks; the smallest set of a label is in each of its blocks.
    within = blocks.select("block", "member").union(blocks.select("block", "label")).distinct()
    alone = within.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    within = within.join(alone, "block").select(F.col("block").alias("one"), F.col("block").alias("other"), F.lit(0).alias("side"), "member")
    rows = sets.select("member", "size", "sketch")
    first = links(within, rows.withColumn("root", F.col("member")), "within")

    # Between blocks, for bands that still hold sets of several components.
    roots = components(first).toDF("member", "root")
    rooted = rows.join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
    held = shared.select("band", "member").join(blocks.select("member", "block"), "member").join(rooted.select("member", "root"), "member")
    split = held.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    held = written(held.join(split, "band"), "held")
    touched = held.groupBy("band", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    left, right = (touched.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high")]) for side in "ab")
    joined = "low_a = high_a AND low_b = high_b AND low_a = low_b"
    pairs = written(
        left.join(right, "band").where(f"block_a < block_b AND NOT ({joined})").select(F.col("block_a").alias("one"), F.col("block_b").alias("other")).distinct(),
        "pairs",
    )
    members = held.select("block", "member").distinct()
    sides = [pairs.join(members, F.col(name) == F.col("block")).select("one", "other", F.lit(side).alias("side"), "member") for side, name in enumerate(("one", "other"))]
    between = sides[0].union(sides[1])
    second = links(between, rooted, "between")

    roots = components(first.union(second))
    linked = roots.union(roots.select("b", "b").distinct()).toDF("member", "root")
    least = linked.join(sets.select("member", "first_id"), "member").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("member", "component_id")
    final = durable(
        sets.join(named, "member", "left").select(F.col("member").alias("_set"), F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return keyed.join(final, F.col("set_key") == F.col("_set"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
