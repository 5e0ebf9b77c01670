"""Matching-block similarity of two texts in near-linear time.

The similarity is the one of Python's ``difflib``: the longest common run of characters is a block, then the same on both
sides of it; of equally long runs the first in the left text counts, then the first in the right one. Characters that make up
more than one per cent of a right text of 200 and more do not start a run, but runs grow over them.

Short pairs are left to ``difflib``, whose search of a run takes time in the product of the lengths. For the others a
suffix automaton of the right part is built in time linear in its length and the left part is read through it once. A
state knows where its texts end first, so the run found is the same.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

SHORT = 1 << 14  # product of the lengths up to which difflib is as fast


class _Automaton:
    """All runs of the wanted characters in text[start:end]."""

    def __init__(self, text: str, start: int, end: int, popular: set[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [-1]
        last = 0
        for place in range(start, end):
            c = text[place]
            last = 0 if c in popular else self._extended(last, c, place)

    def _state(self, following: dict[str, int], length: int, ends: int, link: int = 0) -> int:
        self.next.append(following)
        self.length.append(length)
        self.ends.append(ends)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: str) -> int:
        """The state of the longest text of ``p`` followed by ``c`` alone, apart from the longer ones it shares a state with."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        made = self._state(dict(self.next[q]), self.length[p] + 1, self.ends[q], self.link[q])
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _extended(self, last: int, c: str, place: int) -> int:
        if c in self.next[last]:  # a run met before, from a popular character on
            return self._split(last, c)
        made = self._state({}, self.length[last] + 1, place)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        self.link[made] = 0 if p < 0 else self._split(p, c)
        return made

    def longest(self, text: str, start: int, end: int) -> tuple[int, int, int]:
        """(place in text, place in the automaton's text, length) of the longest common run; length 0 if there is none."""
        state = length = 0
        best = (start, -1, 0)
        following, link, lengths = self.next, self.link, self.length
        for place in range(start, end):
            c = text[place]
            while state and c not in following[state]:
                state = link[state]
                length = lengths[state]
            if c in following[state]:
                state = following[state][c]
                length += 1
                if length > best[2]:
                    best = (place + 1 - length, self.ends[state] + 1 - length, length)
        return best


def matched_characters(a: str, b: str) -> int:
    """How many characters the matching blocks of two texts hold."""
    popular: set[str] = set()
    if len(b) >= 200:
        popular = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1}
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        i, j, size = _Automaton(b, b_from, b_to, popular).longest(a, a_from, a_to)
        if not size:
            i, j = a_from, b_from
        while i > a_from and j > b_from and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_to and j + size < b_to and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if a_from < i and b_from < j:
                todo.append((a_from, i, b_from, j))
            if i + size < a_to and j + size < b_to:
                todo.append((i + size, a_to, j + size, b_to))
    return total


def similarity(a: str, b: str) -> int:
    """Similarity 0 to 100, rounded half to even."""
    if len(a) * len(b) <= SHORT:
        return round(100 * SequenceMatcher(None, a, b).ratio())
    return round(100 * (2.0 * matched_characters(a, b) / (len(a) + len(b))))
