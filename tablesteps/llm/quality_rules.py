"""Quality rules: plain counts of a text, and how far its histograms are from its language.

The reference of a language has two histograms over all of its documents: shares of character
classes, and shares of its common words (each at least ``COMMON_SHARE`` of all words) with the rest in
one bin. A text is compared by Jensen-Shannon distance (0 to 1) with the reference of its language, or with the
nearest one if it has none. Histograms of few observations are far from any reference by chance, so
each comparison has a least length and an allowance that shrinks with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, Texts, mix, slices

COMMON_SHARE = 0.004  # so a language has 250 common words at most
LEAST_CHARS, LEAST_WORDS = 200, 50
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.20, 0.24  # of an endless text
CLASS_ALLOWANCE, WORD_ALLOWANCE = 20.0, 7.0  # added to the squares of these, per character or word
LEAST_WORDS_KEPT, MOST_REPEAT_PERCENT = 50, 50

_CLASSES = 8
_CLASS = np.full(256, 5, np.int64)  # other ASCII signs
_CLASS[:0x20] = _CLASS[0x7F] = 6  # control
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 4
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[0x80:] = 7  # not ASCII, counted at the first byte
_CLASS[0x80:0xC0] = _CLASSES
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = _CLASS == 3
_PLACE = mix(np.arange(7, 10, dtype=U64)) | U64(1)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def class_counts(texts: Texts) -> np.ndarray:
    """Code points of each character class, one row per text."""
    classes = _CLASS[texts.data]
    return np.stack([_sums(classes == c, texts.offsets) for c in range(_CLASSES)], 1)


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offsets = texts.data, texts.offsets
    starts, ends, bounds = texts.words()
    hashed = texts.hashes(starts, ends)
    windows = sum((hashed[j : len(hashed) - 2 + j] * _PLACE[j] for j in range(3)), np.zeros(max(0, len(hashed) - 2), U64))
    repeats = np.zeros(texts.size, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b - a > 3:
            _, inverse, counts = np.unique(windows[a : b - 2], return_inverse=True, return_counts=True)
            if len(counts) < b - a - 2:
                again = counts[inverse] > 1
                covered = np.zeros(b - a, bool)
                for j in range(3):
                    covered[j : j + len(again)] |= again
                repeats[i] = covered.sum()
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_BLANK[data], out=filled[1:])
    line_starts, line_ends, line_bounds = texts.lines()
    worded = filled[line_ends] > filled[line_starts]
    lines = texts.hashes(line_starts, line_ends)
    equal_lines = np.zeros(texts.size, np.int64)
    for i, (a, b) in enumerate(zip(line_bounds[:-1].tolist(), line_bounds[1:].tolist())):
        if b - a > 1:
            own = lines[a:b][worded[a:b]]
            equal_lines[i] = len(own) - len(np.unique(own))
    return {
        "n_words": np.diff(bounds).astype(np.int64),
        "word_chars": _sums(((data & 0xC0) != 0x80) & ~_BLANK[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": equal_lines,
        "n_repeat_words": repeats,
    }


def _lower_words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    lowered = texts.lowered()
    starts, ends, bounds = lowered.words()
    return lowered.hashes(starts, ends).view(np.int64), bounds


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that make up ``COMMON_SHARE`` of the words of a language in some slice of texts.

    A word with that share of all words has it in at least one slice, so none is missed.
    """
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        languages = np.array([x if x is not None else "" for x in batch.column("lang").to_pylist()], object)
        known = ~np.array(batch.column("lang").is_null())
        for first, end, texts in slices(batch.column("text")):
            words, bounds = _lower_words(texts)
            of = np.repeat(languages[first:end], np.diff(bounds))
            named = np.repeat(known[first:end], np.diff(bounds))
            out = []
            for language in set(of[named].tolist()):
                found, counts = np.unique(words[(of == language) & named], return_counts=True)
                often = found[counts >= COMMON_SHARE * counts.sum()]
                out += [(language, w) for w in often.tolist() if (language, w) not in seen]
            seen.update(out)
            if out:
                lang, word = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.int64())], ["lang", "word"])


def _histograms(candidates: dict[str, np.ndarray]):
    """Counts of the candidate words, all words (key -1 - classes) and character classes (keys -1..) per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of: dict[str, np.ndarray] = {}
        classes_of: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for first, end, texts in slices(batch.column("text")):
                words, bounds = _lower_words(texts)
                classes = class_counts(texts)
                own = np.array([x if x is not None else "" for x in languages[first:end]], object)
                known = np.array([x is not None for x in languages[first:end]], bool)
                for language in set(own[known].tolist()):
                    rows = known & (own == language)
                    mine = words[np.repeat(rows, np.diff(bounds))]
                    names = candidates.get(language, np.zeros(0, np.int64))
                    total = words_of.setdefault(language, np.zeros(len(names) + 1, np.int64))
                    if len(names):
                        at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                        hit = names[at] == mine
                        total[:-1] += np.bincount(at[hit], minlength=len(names))
                    total[-1] += len(mine)
                    classes_of.setdefault(language, np.zeros(_CLASSES, np.int64))[:] += classes[rows].sum(0)
        for language, counts in words_of.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language], pa.string()),
                    pa.array([counts.tolist()], pa.list_(pa.int64())),
                    pa.array([classes_of[language].tolist()], pa.list_(pa.int64())),
                ],
                ["lang", "words", "classes"],
            )

    return run


class Reference:
    """Common words (sorted hashes) with their shares and the rest's, and shares of character classes."""

    def __init__(self, names: np.ndarray, words: np.ndarray, classes: np.ndarray):
        self.names, self.words, self.classes = names, words, classes


def learn_references(docs: DataFrame) -> dict[str, Reference]:
    """One reference per language, from all of its documents.

    What reaches the driver is one row of at most a few hundred counts per language. Languages are few by
    nature; a language without a word or a character has no reference.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    names: dict[str, list[int]] = {}
    for row in rows.mapInArrow(_frequent, "lang string, word long").distinct().collect():
        names.setdefault(row["lang"], []).append(row["word"])
    candidates = {k: np.sort(np.array(v, np.int64)) for k, v in names.items()}
    counted = rows.mapInArrow(_histograms(candidates), "lang string, words array<long>, classes array<long>")
    places = counted.select("lang", F.posexplode("words").alias("at", "n"), F.lit("w").alias("kind")).union(
        counted.select("lang", F.posexplode("classes").alias("at", "n"), F.lit("c"))
    )
    totals: dict[tuple[str, str], dict[int, int]] = {}
    for row in places.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).collect():
        totals.setdefault((row["lang"], row["kind"]), {})[row["at"]] = row["n"]
    found = {}
    for language in sorted({k for k, _ in totals}):
        words = np.array([n for _, n in sorted(totals[language, "w"].items())], np.float64)
        classes = np.array([n for _, n in sorted(totals[language, "c"].items())], np.float64)
        if words[-1] and classes.sum():
            own = candidates.get(language, np.zeros(0, np.int64))
            often = words[:-1] >= COMMON_SHARE * words[-1]
            shares = words[:-1][often] / words[-1]
            found[language] = Reference(own[often], np.r_[shares, max(0.0, 1 - shares.sum())], classes / classes.sum())
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of each row of ``p`` to ``q``."""
    middle = (p + q) / 2

    def gain(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / middle), 0).sum(-1)

    return np.sqrt(np.clip((gain(p) + gain(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(texts: Texts, reference: Reference) -> tuple[np.ndarray, np.ndarray]:
    """(class distance, word distance) of each text; 0 for a text without characters or words."""
    classes = class_counts(texts)
    chars = classes.sum(1)
    words, bounds = _lower_words(texts)
    n = np.diff(bounds)
    counts = np.zeros((texts.size, len(reference.names) + 1))
    if len(reference.names) and len(words):
        at = np.minimum(np.searchsorted(reference.names, words), len(reference.names) - 1)
        hit = reference.names[at] == words
        rows = np.repeat(np.arange(texts.size), n)[hit]
        flat = np.bincount(rows * counts.shape[1] + at[hit], minlength=counts.size)
        counts += flat.reshape(counts.shape)
    counts[:, -1] = n - counts.sum(1)
    by_class = js_distance(classes / np.maximum(1, chars)[:, None], reference.classes)
    by_word = js_distance(counts / np.maximum(1, n)[:, None], reference.words)
    return np.where(chars > 0, by_class, 0.0), np.where(n > 0, by_word, 0.0)


def _judged(references: dict[str, Reference]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            languages = batch.column("lang").to_pylist()
            parts: dict[str, list[np.ndarray]] = {}
            for first, end, texts in slices(column):
                found = base_counts(texts)
                chars = class_counts(texts).sum(1)
                own = languages[first:end]
                best_class, best_word = (np.full(texts.size, np.inf) for _ in range(2))
                fits = np.zeros(texts.size, bool)
                for language, reference in references.items():
                    rows = np.array([x == language or x not in references for x in own], bool)
                    if not rows.any():
                        continue
                    by_class, by_word = distances(texts, reference)
                    good = (chars < LEAST_CHARS) | (
                        by_class**2 <= MOST_CLASS_DISTANCE**2 + CLASS_ALLOWANCE / np.maximum(1, chars)
                    )
                    good &= (found["n_words"] < LEAST_WORDS) | (
                        by_word**2 <= MOST_WORD_DISTANCE**2 + WORD_ALLOWANCE / np.maximum(1, found["n_words"])
                    )
                    fits |= rows & good
                    nearer = rows & (by_class + by_word < best_class + best_word)
                    best_class[nearer], best_word[nearer] = by_class[nearer], by_word[nearer]
                if not references:
                    fits[:] = True
                failed = (found["n_words"] < LEAST_WORDS_KEPT) | (
                    100 * found["n_repeat_words"] > MOST_REPEAT_PERCENT * found["n_words"]
                )
                found |= {
                    "base_failed": failed,
                    "kept": ~failed & fits,
                    "class_distance": np.where(np.isfinite(best_class), best_class, 0.0),
                    "word_distance": np.where(np.isfinite(best_word), best_word, 0.0),
                }
                for name, values in found.items():
                    parts.setdefault(name, []).append(values)
            if parts:
                rest = [batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *(pa.array(np.concatenate(x)) for x in parts.values())], [*batch.schema.names, *parts]
                )

    return run


_ADDED = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "class_distance": "double", "word_distance": "double",
}


def judge(docs: DataFrame, references: dict[str, Reference] | None = None) -> DataFrame:
    """Add the counts, both distances, base_failed and kept to every row.

    Words are runs of anything but space and 0x09-0x0D; a null text has none, is base_failed and not kept.
    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows.
    kept: not base_failed, and both distances within bounds where the text is long enough for them. A row
    whose language is null or has no reference passes if it fits one of all references. Repeated rows are
    judged alike; other columns pass through, and added names replace equal ones. An empty table gives an empty result.
    """
    docs = docs.drop(*_ADDED)
    references = learn_references(docs) if references is None else references
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = ", ".join(f"{k} {v}" for k, v in _ADDED.items())
    return docs.mapInArrow(_judged(references), f"{schema}, {added}")
