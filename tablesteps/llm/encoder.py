"""Ids of many texts by the tokenizers library, each distinct piece encoded once.

A text is cut at blanks where the tokenizer itself always starts anew. Pieces are found, hashed and made distinct in
numpy, a slice of texts at a time; pieces not met before go to the library, and the ids of a slice are gathered
from a table of pieces. Pieces are compared by 64-bit hashes. The table lives as long as the Python worker and
starts again from empty at ``TABLE_PIECES`` pieces or ``TABLE_IDS`` ids. Texts that may not be cut go to the library whole: those
that hold an added token and, where the tokenizer keeps blanks, those with other than single ones.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from .textbytes import U64, Texts, mix, slices

TABLE_PIECES = 1 << 20
TABLE_IDS = 1 << 23
RECENT = 1 << 15  # pieces that wait to be sorted into the table
LOOKUP_TEXTS = 1000

# Blanks that are not single, and any white space of Unicode but space and line feed (with the
# separators 0x1C-0x1F, which only means that some more texts are encoded whole).
_RUNS = ("  ", "\n\n", " \n", "\n ")
_ENDS = (" ", "\n")
_OTHER_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECE = np.ones(256, bool)
_PIECE[[0x20, 0x0A]] = False
_TAIL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,!?;:"]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_FIRST, _SPACE, _LINE = 0, 1, 2  # what stands before a piece

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for the life of the process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _drops_blanks(made: dict) -> bool:
    """Whether the tokenizer drops white space before it looks for pieces."""
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] for s in steps)


class _Pieces:
    """Sorted keys with the place of their ids in a pool."""

    def __init__(self):
        self.keys, self.starts, self.sizes = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its place) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[place] == keys, place


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's for the whole text."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self._tokenizer = tokenizers.Tokenizer.from_file(path)
        self._drops_blanks = _drops_blanks(made)
        self._added = [t["content"] for t in made.get("added_tokens") or []]
        self._bar = " \x01 " if self._drops_blanks else "\n"
        self._bar_ids, self._line = self._whole(self._bar), self._whole("\n")
        self._empty()

    def _empty(self) -> None:
        self._known, self._recent = _Pieces(), _Pieces()
        self._pool, self._used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        # The fast form leaves out the places of the tokens in the text.
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _is_cut(self, text: str) -> bool:
        if any(t in text for t in self._added):
            return False
        if self._drops_blanks or not text:
            return True
        return not (any(x in text for x in _RUNS) or text[:1] in _ENDS or text[-1:] in _ENDS or _OTHER_BLANK.search(text))

    def _encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many of each piece): many pieces in one text, parted by a sign that has one id of its own."""
        flat, sizes, bar = [], [], self._bar.encode()
        for start in range(0, len(pieces), LOOKUP_TEXTS):
            part = pieces[start : start + LOOKUP_TEXTS]
            ids = self._whole(bar.join(part).decode()) if len(self._bar_ids) == 1 else np.zeros(0, np.uint32)
            bars = ids == self._bar_ids[0]
            at = np.flatnonzero(bars)
            if len(self._bar_ids) == 1 and len(at) == len(part) - 1:
                flat.append(ids[~bars])
                sizes.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
            else:
                found = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)]
                flat += found
                sizes.append(np.array([len(x) for x in found], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, pieces: list[bytes], after_line: np.ndarray) -> None:
        """Encode pieces and add them to the table. A line feed stands alone, and what follows it is encoded as if it came first."""
        ids, sizes = self._encode_all(pieces)
        if after_line.any():
            starts = (np.cumsum(sizes) - sizes)[after_line]
            ids = np.insert(ids, np.repeat(starts, len(self._line)), np.tile(self._line, len(starts)))
            sizes = sizes + after_line * len(self._line)
        if self._used + len(ids) > len(self._pool):
            grown = np.zeros(max(2 * len(self._pool), self._used + len(ids)), np.uint32)
            grown[: self._used] = self._pool[: self._used]
            self._pool = grown
        self._pool[self._used : self._used + len(ids)] = ids
        self._recent.add(keys, self._used + np.cumsum(sizes) - sizes, sizes)
        self._used += len(ids)
        if len(self._recent.keys) > RECENT:
            self._known.add(self._recent.keys, self._recent.starts, self._recent.sizes)
            self._recent = _Pieces()

    def _slice(self, texts: Texts) -> list[bytes]:
        data = texts.data
        starts, ends, bounds = texts.runs(_PIECE)
        if not len(starts):
            return [b""] * texts.size
        before = np.full(len(starts), _FIRST)
        if not self._drops_blanks:
            before = np.where(data[np.maximum(starts - 1, 0)] == 0x0A, _LINE, _SPACE)
            before[bounds[:-1][bounds[:-1] < bounds[1:]]] = _FIRST
        else:  # the library lowers all letters; those of pieces of ASCII alone can be lowered here
            other = np.r_[0, np.cumsum(data > 0x7F)]
            plain = other[starts] == other[ends]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts[plain]] += 1
            inside[ends[plain]] -= 1
            data = np.where(np.cumsum(inside[:-1]) > 0, _LOWER[data], data)
        # A sign that ends a piece after an ASCII letter is a piece of its own.
        tailed = (ends - starts > 1) & _TAIL[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]]
        tails = ends[tailed] - 1
        ends = ends - tailed
        order = np.argsort(np.r_[starts, tails], kind="stable")
        starts, ends = np.r_[starts, tails][order], np.r_[ends, tails + 1][order]
        before = np.r_[before, np.full(len(tails), _FIRST)][order]
        bounds = np.searchsorted(starts, texts.offsets)

        keys = mix(Texts(data, texts.offsets).hashes(starts, ends) + before.astype(U64) * U64(0xA0761D6478BD642F))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._known.keys) + len(distinct) > TABLE_PIECES or self._used > TABLE_IDS:
            self._empty()
        fresh = np.flatnonzero(~self._known.find(distinct)[0] & ~self._recent.find(distinct)[0])
        if len(fresh):
            raw, at = data.tobytes(), first[fresh]
            begin = starts[at] - (before[at] == _SPACE)  # the blank before a piece belongs to it
            pieces = [raw[s:e] for s, e in zip(begin.tolist(), ends[at].tolist())]
            self._learn(distinct[fresh], pieces, before[at] == _LINE)
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for table in (self._known, self._recent):
            hit, place = table.find(distinct)
            begin[hit], size[hit] = table.starts[place[hit]], table.sizes[place[hit]]
        begin, size = begin[which], size[which]
        upto = np.r_[0, np.cumsum(size)]
        ids = self._pool[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])].astype("<u4")
        edges = upto[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, done = [i for i, t in enumerate(texts) if self._is_cut(t)], 0
        whole = set(range(len(texts))).difference(cut)
        out = [self._whole(t).astype("<u4").tobytes() if i in whole else b"" for i, t in enumerate(texts)]
        for _, _, part in slices(pa.array([texts[i] for i in cut], pa.large_string())):
            for ids in self._slice(part):
                out[cut[done]] = ids
                done += 1
        return out
