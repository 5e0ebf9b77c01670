"""Packing: token sequences of bounded length, by best-fit decreasing.

A document's ids are cut into full windows as long as they last; a full window is a sequence of
its own. What is left of each document goes, longest first, into the open window with the least
room that still holds it, found by a segment tree over the remaining capacities. Nothing is
shuffled: a task packs the documents it reads, in parts of ``PART_IDS`` ids, so memory is bounded.
At the end of a part, windows with more than ``max_gap`` ids of room are filled up with cuts from
the emptiest windows; what then remains open is cut into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoder import encoder
from .tokens import text_groups

PART_IDS = 1 << 23


class RoomTree:
    """A segment tree over capacities 0..size that finds the smallest room of at least a length."""

    def __init__(self, size: int):
        self._leaves = 1 << size.bit_length()
        self._counts = [0] * (2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self._windows[room].append(window)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._counts[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the tightest room for ``length``."""
        counts, node = self._counts, length + self._leaves
        while not counts[node]:  # up to the first subtree on the right that has a window
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node *= 2
            if not counts[node]:
                node += 1
        room = node - self._leaves
        self._count(room, -1)
        return room, self._windows[room].pop()


def pack(lengths: list[int], capacity: int, max_gap: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start in the item, length) that hold every id of every item once."""
    sequences, rest = [], []
    for item, length in enumerate(lengths):
        full = length // capacity * capacity
        sequences += [[(item, at, capacity)] for at in range(0, full, capacity)]
        if length > full:
            rest.append((length - full, item, full))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, windows, used = RoomTree(capacity), [], []
    for length, item, start in rest:
        room, window = tree.take(length) or (capacity, len(windows))
        if window == len(windows):
            windows.append([])
            used.append(0)
        windows[window].append((item, start, length))
        used[window] += length
        if room > length:
            tree.add(room - length, window)
    # Windows with much room, fullest first: cuts from the emptiest fill up the fullest.
    wide = sorted((w for w in range(len(windows)) if capacity - used[w] > max_gap), key=lambda w: (-used[w], w))
    open_windows = set(wide)
    sequences += [pieces for w, pieces in enumerate(windows) if w not in open_windows]
    low, high = 0, len(wide) - 1
    while low < high:
        giver, taker = windows[wide[high]], windows[wide[low]]
        room = capacity - used[wide[low]]
        while room and giver:
            item, start, length = giver.pop()
            part = min(room, length)
            taker.append((item, start, part))
            if part < length:
                giver.append((item, start + part, length - part))
            room -= part
            used[wide[high]] -= part
        used[wide[low]] = capacity - room
        if not room:
            sequences.append(taker)
            low += 1
        if not giver:
            high -= 1
    if low == high and windows[wide[low]]:
        sequences += _by_powers_of_two(windows[wide[low]])
    return sequences


def _by_powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same ids in sequences of decreasing power-of-two lengths."""
    left, out = list(reversed(pieces)), []
    total = sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        sequence = []
        while room:
            item, start, length = left.pop()
            part = min(room, length)
            sequence.append((item, start, part))
            if part < length:
                left.append((item, start + part, length - part))
            room -= part
        if sequence:
            out.append(sequence)
    return out


def _packed(tokenizer: str, end_id: int, capacity: int, max_gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        ids, docs, size = [], [], 0

        def part() -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id
            lengths = [len(d) // 4 for d in docs]
            rows = []
            for pieces in pack(lengths, capacity, max_gap):
                offset = 0
                for item, start, length in pieces:
                    rows.append((item, start, length, sequence_id, offset))
                    offset += length
                sequence_id += 1
            for at in range(0, len(rows), 5000):
                some = rows[at : at + 5000]
                item, start, length, sequence, offset = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in item], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([docs[i][4 * s : 4 * (s + n)] for i, s, n in zip(item, start, length)], pa.binary()),
                        pa.array([lengths[i] for i in item], pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, group in text_groups(batch.column("text").to_pylist()):
                ids += doc_ids[first : first + len(group)]
                for encoded in encode(group):
                    docs.append(encoded + end)
                    size += len(encoded) // 4 + 1
                if size >= PART_IDS:
                    yield from part()
                    ids, docs, size = [], [], 0
        if docs:
            yield from part()

    return run


def packed_sequences(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, max_gap: int = 8
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids, each document closed by ``end_id``.

    One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence, gapless from 0. A null or empty text
    is the end id alone; repeated rows and ids and null ids are packed as documents of their own;
    other columns are not read; an empty table has no piece.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _packed(tokenizer, end_id, capacity, max_gap),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
