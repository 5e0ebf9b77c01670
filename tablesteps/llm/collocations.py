"""Phrase collocations by dynamic itemset counting.

The documents are dealt once into a few shards, which are scanned in a cycle. Every scan counts phrases of
all lengths that are active at that time: single words from the first scan on, and a longer phrase as soon as both its
subphrases (all words but the last, all words but the first) have reached the threshold in the scans so
far. A phrase is counted for one full cycle from the scan that activates it, so its count is exact wherever
it started, and lengths overlap: pairs are counted while words are, triples while pairs are.

Tasks learn what is active from a table of fixed size: a cell holds the first scan at which some subphrase
that hashes into it was active. All tasks of a scan read the same table and a cell never changes once it is set, so a
phrase has one activation time everywhere. Phrases that share a cell are activated earlier than they need to be:
that costs work, never a count. A frequent phrase has frequent subphrases and is always activated.

Phrases are counted under 64-bit keys of language and words; texts are looked up at the end, for frequent
phrases alone. Counts that are still open are written after each scan, so a lost executor costs one scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .files import new_folder, remove
from .keybits import BITS, marked, packed_bits, places, places_of, unpacked_bits
from .textbytes import U64, Texts, mix, slices

MOST_WORDS = 5
SHARDS = 4  # scans in a cycle
SHARES, NAMING = 1024, (0, 1, 4, 16, 64, 256, 1024)  # shares of a shard, and which of them are looked through together for names
#: Rows next to each other get shares far apart (an odd step, about the golden section of SHARES), so a run of copies is met early.
STRIDE = 633
NEVER = 255
#: Exact: products of counts may pass 64 bits.
SCORE = "(CAST(a AS DECIMAL(19, 0)) * 1000 * n) DIV (CAST(l AS DECIMAL(19, 0)) * r)"
BUFFER_KEYS = 1 << 21  # keys a task counts at a time

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]] = True
_WORD = ~_BREAKS
_WORD[[0x20, 0x09]] = False
_STEP = U64(0x9FB21C651E98DF25)


def _language_key(lang: str | None) -> int:
    """A 64-bit key of a language; null counts as ``und``."""
    data = np.frombuffer((lang if lang is not None else "und").encode(), np.uint8)
    texts = Texts(data, np.array([0, len(data)]))
    return int(texts.hashes(np.array([0]), np.array([len(data)]))[0])


class Phrases:
    """Words of a slice of texts with the keys of all phrases that start at each."""

    def __init__(self, texts: Texts, languages: np.ndarray):
        """``languages`` holds a key per text."""
        self.texts = texts = texts.lowered()
        self.starts, self.ends, bounds = texts.runs(_WORD)
        self.counts = np.diff(bounds)
        self.words = mix(texts.hashes(self.starts, self.ends) ^ np.repeat(languages, self.counts))
        pieces = np.cumsum(_BREAKS[texts.data])[self.starts] + np.repeat(np.arange(texts.size), self.counts)
        # How many words are left in the piece, a word itself included.
        last = np.flatnonzero(np.r_[pieces[1:] != pieces[:-1], True]) if len(pieces) else np.zeros(0, np.int64)
        self.left = last[np.searchsorted(last, np.arange(len(pieces)))] - np.arange(len(pieces)) + 1

    def keys(self, most: int = MOST_WORDS) -> Iterator[tuple[int, np.ndarray]]:
        """(length, key of the phrase of that length at each word); places where a piece ends earlier have keys of no use."""
        key = self.words
        yield 1, key
        for length in range(2, most + 1):
            if len(key) < 2:
                return
            key = mix((key[:-1] ^ U64(length)) * _STEP + self.words[length - 1 :])
            yield length, key


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Phrases, np.ndarray, list]]:
    """(phrases, language key of each text, language of each text) of the slices of (lang, text) batches."""
    known: dict[str | None, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs) - known.keys():
            known[lang] = _language_key(lang)
        keys = np.array([known[lang] for lang in langs], U64)
        for row, end, texts in slices(batch.column("text")):
            yield Phrases(texts, keys[row:end]), keys[row:end], langs[row:end]


def _counts(packed: bytes, scan: int, shards: int):
    """Counts of the phrases that are active in a scan: (len, key, start, n); len 0 counts all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = np.frombuffer(zlib.decompress(packed), np.uint8)
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def flush():
            for (length, start), parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), length, np.int8)), pa.array(keys.view(np.int64)),
                        pa.array(np.full(len(keys), start, np.int32)), pa.array(n),
                    ],
                    ["len", "key", "start", "n"],
                )
            held.clear()

        for phrases, languages, _ in _by_language(batches):
            if scan < shards:
                held.setdefault((0, 0), []).append(np.repeat(languages, phrases.counts))
                held.setdefault((1, 0), []).append(phrases.words)
                size += 2 * len(phrases.words)
            before = None
            for length, key in phrases.keys():
                if length > 1:
                    starts = np.maximum(before[:-1], before[1:])
                    open_now = (starts <= scan) & (scan < starts.astype(np.int32) + shards) & (phrases.left[: len(key)] >= length)
                    for start in np.unique(starts[open_now]).tolist():
                        chosen = key[open_now & (starts == start)]
                        held.setdefault((length, start), []).append(chosen)
                        size += len(chosen)
                before = active[places(key)] if length < MOST_WORDS else None
            if size >= BUFFER_KEYS:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _names(packed: bytes):
    """(key, lang, phrase) of the distinct phrases of two words and more whose keys are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = unpacked_bits(packed)
        seen = np.zeros(0, U64)
        for phrases, _, langs in _by_language(batches):
            text_of = np.repeat(np.arange(len(langs)), phrases.counts)
            data = phrases.texts.data.tobytes()
            found, names, spoken = [], [], []
            for length, key in phrases.keys():
                if length == 1:
                    continue
                hits = np.flatnonzero(marked(wanted, key) & (phrases.left[: len(key)] >= length))
                keys, first = np.unique(key[hits], return_index=True)
                fresh = ~np.isin(keys, seen)
                found.append(keys[fresh])
                for i in hits[first[fresh]].tolist():
                    ends = range(i, i + length)
                    names.append(b" ".join(data[phrases.starts[j] : phrases.ends[j]] for j in ends).decode())
                    lang = langs[text_of[i]]
                    spoken.append("und" if lang is None else lang)
            keys = np.concatenate(found) if found else np.zeros(0, U64)
            if len(seen) > 1 << 20:  # bounded; a phrase met again only repeats its row
                seen = np.zeros(0, U64)
            seen = np.union1d(seen, keys)
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(spoken, pa.string()), pa.array(names, pa.string())],
                    ["key", "lang", "phrase"],
                )

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the keys of all shorter phrases within a phrase, as (first word, words, key), and the key of its language."""
    for batch in batches:
        parts, spoken = [], []
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            language = _language_key(lang)
            data = np.frombuffer(phrase.encode(), np.uint8)
            phrases = Phrases(Texts(data, np.array([0, len(data)])), np.array([language], U64))
            size = len(phrases.words)
            parts.append([
                {"at": at, "words": length, "key": int(k)}
                for length, key in phrases.keys(size - 1)
                for at, k in enumerate(key.view(np.int64).tolist())
            ])
            spoken.append(int(np.array([language], U64).view(np.int64)[0]))
        kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("key", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(spoken, pa.int64()), pa.array(parts, kind)],
            [*batch.schema.names, "language", "parts"],
        )


def frequent_phrases(docs: DataFrame, least: int = 100, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(counts, texts): (len, key, n) of every phrase and word found ``least`` times or more and, under len 0, the
    number of words of each language; and the written shards.

    Scans go on until a full cycle has passed since the last subphrase became active: about two passes over the data,
    and ``MOST_WORDS`` passes at most.
    """
    spark = docs.sparkSession
    home = new_folder(spark, "collocations")
    # Rows are dealt in turn, so copies of a text do not meet in one shard.
    turn = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = docs.select("lang", "text", turn.alias("turn"))
    dealt = dealt.select("lang", "text", F.expr(f"cast(turn % {SHARES} * {STRIDE} % {SHARES} as int)").alias("share"), (F.col("turn") % shards).cast("int").alias("shard"))
    dealt.write.partitionBy("shard").parquet(f"{home}/texts")
    texts = spark.read.schema("lang string, text string, share int, shard int").parquet(f"{home}/texts")

    active = np.full(1 << BITS, NEVER, np.uint8)
    scan, stop, still_open, found = 0, shards, None, []
    while scan < stop:
        counts = texts.where(F.col("shard") == scan % shards).select("lang", "text").mapInArrow(
            _counts(zlib.compress(active.tobytes(), 1), scan, shards), "len byte, key long, start int, n long"
        ).withColumn("old", F.lit(0).cast("long"))
        if still_open is not None:
            counts = counts.union(still_open)
        total = counts.groupBy("len", "key", "start").agg(F.sum("n").alias("n"), F.sum("old").alias("old"))
        ended = F.col("start") + (shards - 1) == scan
        kept = total.where(~ended | (F.col("n") >= least) | (F.col("len") == 0)).withColumn("ended", ended)
        kept.write.partitionBy("ended").parquet(f"{home}/scan-{scan}")
        if scan:
            remove(f"{home}/scan-{scan - 1}/ended=false")
        state = spark.read.schema("len byte, key long, start int, n long, old long, ended boolean").parquet(f"{home}/scan-{scan}")
        risen = state.where((F.col("len") > 0) & (F.col("len") < MOST_WORDS) & (F.col("n") >= least) & (F.col("old") < least))
        cells = places_of(risen, "key")
        fresh = cells[active[cells] == NEVER]
        active[fresh] = scan + 1
        if len(fresh):
            stop = scan + 1 + shards
        found.append(state.where("ended").select("len", "key", "n"))
        still_open = state.where("NOT ended").select("len", "key", "start", "n", F.col("n").alias("old"))
        scan += 1
    reduce(DataFrame.union, found).write.parquet(f"{home}/counts")
    return spark.read.schema("len byte, key long, n long").parquet(f"{home}/counts"), texts


def _named(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds lang and phrase to rows of (key, a).

    Texts are looked through by growing shares, each for the keys that those before did not name: most phrases are met in
    the first share, so few tasks name the same phrase.
    """
    spark, home = keys.sparkSession, new_folder(keys.sparkSession, "names")
    schema = "key long, a long, name struct<lang:string,phrase:string>"
    for step, (low, high) in enumerate(zip(NAMING, NAMING[1:])):
        share = texts.where((F.col("share") >= low) & (F.col("share") < high)).select("lang", "text")
        found = share.mapInArrow(_names(packed_bits(keys, "key")), "key long, lang string, phrase string")
        found = found.groupBy("key").agg(F.min(F.struct("lang", "phrase")).alias("name"))
        keys.join(found, "key", "left").select("key", "a", "name").write.parquet(f"{home}/step={step}")
        keys = spark.read.schema(schema).parquet(f"{home}/step={step}").where("name IS NULL").select("key", "a")
    return spark.read.schema(schema).parquet(home).where("name IS NOT NULL").select("key", "a", "name.lang", "name.phrase")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, shards: int = SHARDS) -> DataFrame:
    """The highest-scoring phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts have A-Z lower-cased and are cut into pieces at ``.,;:!?`` and 0x0A-0x0D; words are what blanks and tabs leave
    of a piece. A candidate is a phrase of 2 to 5 words found ``a >= least`` times in its language, overlaps
    included. Cut after its first k words it has l = count of the first part and r = count of the
    rest, and scores floor(1000 a n / (l r)), n being the words of the language; its lowest-scoring cut counts,
    the first of equal ones. Candidates within a longer candidate of at least the same count are
    dropped. The first ``most`` of a language by score, a (both descending) and phrase (bytes, ascending) stay.

    A null language counts as ``und``; a null or empty text, and one without words, has no phrases. Repeated rows and ids count
    each time. Only ``lang`` and ``text`` are read; an empty table gives an empty result.
    """
    counts, texts = frequent_phrases(docs, least, shards)
    candidates = counts.where("len > 1").select("key", F.col("n").alias("a"))
    named = durable(
        _named(candidates, texts).mapInArrow(
            _parts, "key long, a long, lang string, phrase string, language long, parts array<struct<at:int,words:int,key:long>>"
        )
    )
    covered = named.select("a", F.explode("parts").alias("p")).where("p.words > 1").groupBy(F.col("p.key").alias("key")).agg(F.max("a").alias("most"))
    stays = named.join(covered, "key", "left").where("most IS NULL OR most < a").select("key", "a", "lang", "phrase", "language", "parts")

    size = F.aggregate("parts", F.lit(0), lambda n, p: F.greatest(n, p["at"] + p["words"]))
    heads = F.filter("parts", lambda p: p["at"] == 0)
    tails = F.filter("parts", lambda p: p["at"] + p["words"] == F.col("size"))
    cut = stays.withColumn("size", size).select(
        "key", "a", "lang", "phrase", "language", F.explode(F.transform(heads, lambda h: F.struct(
            h["words"].alias("k"), h["key"].alias("head"), F.filter(tails, lambda t: t["at"] == h["words"])[0]["key"].alias("tail")
        ))).alias("cut"),
    ).select("*", "cut.*")
    parts = counts.where("len > 0")
    cut = (
        cut.join(parts.select(F.col("key").alias("head"), F.col("n").alias("l")), "head")
        .join(parts.select(F.col("key").alias("tail"), F.col("n").alias("r")), "tail")
        .join(counts.where("len = 0").select(F.col("key").alias("language"), "n"), "language")
    )
    score = F.expr(SCORE)
    best = cut.withColumn("score", score).groupBy("key").agg(
        F.min_by(F.struct("lang", "phrase", "a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")
    ).select("b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
