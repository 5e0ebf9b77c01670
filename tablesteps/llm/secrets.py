"""Secret scans over a trigram inverted index, in DataFrame functions only.

1. From each rule's pattern the job derives a Boolean query over lower-cased trigrams: an OR of
   ANDs that holds for every text with a match. A pattern without mandatory trigrams has no query.
2. The index lists, for each trigram that some query asks for, the documents that contain it.
3. Postings are intersected per document, and a document is a candidate of the rules whose query holds.
4. Candidates are verified with the pattern itself. Rules without a query scan every text.

The index is case-folded, so it may name a candidate too many but never one too few. Patterns are
written in the part of the syntax that Java and Python read alike, without look-around.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import let
from .files import new_folder
from .names import free_prefix

_MOST_STRINGS = 64  # strings that an exactly known stretch of a pattern may stand for
_MASK_BITS = 62
PART = 128  # matches of a text that are put together at a time


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    # A run is one match, so asking for its least length gives the matches that are not dropped.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    # One run of characters, as Java matches a repeated group by recursion, which ends on a long text.
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("repo_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# ---- trigram queries -------------------------------------------------------------

# A query is a set of conjunctions, each a set of trigrams; the empty conjunction always holds.
Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _or(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(c for c in both if not any(d < c for d in both))


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x in a for y in b)
    if len(both) > _MOST_STRINGS:  # either side alone is weaker, so it still names every match
        return min((a, b), key=len)
    return frozenset(c for c in both if not any(d < c for d in both))


def _of_strings(strings: Sequence[str]) -> Query:
    """Holds for every text that contains one of the strings."""
    found: Query = frozenset()
    for s in strings:
        found = _or(found, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return found or _ANY


def _strings_of(items) -> list[str] | None:
    """The characters of a class, lower-cased, if they are few."""
    out = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < _MOST_STRINGS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return sorted(out) if len(out) <= 8 else None


def _analyse(parsed) -> tuple[list[str] | None, Query]:
    """(all strings the pattern can match, if few; a query that holds for each of its matches)."""
    whole: list[str] | None = [""]  # of all so far
    run, query = [""], _ANY  # of the last exactly known stretch; of the stretches before

    def close():
        nonlocal run, query
        query, run = _and(query, _of_strings(run)), [""]

    for op, value in parsed:
        name, exact, inner = str(op), None, _ANY
        again = False  # more of the same may follow
        if name == "LITERAL":
            exact = [chr(value).lower()]
        elif name == "IN":
            exact = _strings_of(value)
        elif name == "SUBPATTERN":
            exact, inner = _analyse(value[-1])
        elif name == "BRANCH":
            parts = [_analyse(p) for p in value[1]]
            inner = frozenset()
            for _, q in parts:
                inner = _or(inner, q)
            if all(e is not None for e, _ in parts):
                exact = sorted({s for e, _ in parts for s in e})
        elif name == "MAX_REPEAT":
            least, most, body = value
            exact, inner = _analyse(body)
            if least == 0:
                exact = sorted({"", *exact}) if most == 1 and exact is not None else None
                inner = _ANY
            elif most != 1:
                again = True
        elif name not in ("ANY", "NOT_LITERAL", "AT", "CATEGORY"):
            raise ValueError(f"pattern with {name}")
        if name == "AT":
            continue
        joined = None if exact is None else sorted({a + b for a, b in product(run, exact)})
        if joined is None or len(joined) > _MOST_STRINGS:
            close()
            query = _and(query, inner)
            whole = None
            if exact is not None and len(exact) <= _MOST_STRINGS:
                run = exact
        else:
            run = joined
            whole = None if whole is None else sorted({a + b for a, b in product(whole, exact)})
            if whole is not None and len(whole) > _MOST_STRINGS:
                whole = None
        if again:
            close()
            whole = None
    close()
    return whole, query


def trigram_query(pattern: str) -> Query | None:
    """An OR of ANDs of lower-cased trigrams that every match of ``pattern`` contains; None if there is none."""
    _, query = _analyse(re._parser.parse(pattern))
    return None if frozenset() in query else query


# ---- index and scan --------------------------------------------------------------


def build_index(docs: DataFrame, trigrams: Sequence[str], folder: str) -> DataFrame:
    """Write and reread the postings (trigram, doc_id) of the given trigrams.

    A trigram is listed once for each row that contains it. The pattern looks ahead, so that trigrams that overlap are all
    found in one pass over the text.
    """
    look = "(?=(" + "|".join(re.escape(t) for t in trigrams) + "))"
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(look), 1))
    postings = docs.where("text is not null").select("doc_id", F.explode(held).alias("trigram"))
    postings.select("trigram", "doc_id").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def candidates(postings: DataFrame, trigrams: Sequence[str], queries: dict[int, Query]) -> DataFrame:
    """(candidate, rules): documents for which some query holds, with one bit per rule.

    The lists are intersected in one aggregate per document: a bit per trigram, summed up on the map side.
    """
    place = F.create_map(*[F.lit(x) for i, t in enumerate(trigrams) for x in (t, i)])[F.col("trigram")]
    words = range(-(-len(trigrams) // _MASK_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(_place % {_MASK_BITS} AS INT))")
    masks = postings.withColumn("_place", place).groupBy(F.col("doc_id").alias("candidate")).agg(
        *[F.bit_or(F.when(F.floor(F.col("_place") / _MASK_BITS) == w, bit).otherwise(0)).alias(f"_m{w}") for w in words]
    )
    rules = F.lit(0).cast("long")
    for rule, query in queries.items():
        holds = F.lit(False)
        for conjunction in sorted(query, key=sorted):
            inside = F.lit(True)
            for w in words:
                need = sum(1 << (i % _MASK_BITS) for i, t in enumerate(trigrams) if t in conjunction and i // _MASK_BITS == w)
                inside &= F.col(f"_m{w}").bitwiseAND(F.lit(need).cast("long")) == need
            holds |= inside
        rules = rules + F.when(holds, F.lit(1 << rule)).otherwise(0)
    return masks.select("candidate", rules.alias("rules")).where("rules <> 0")


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Matches of a rule as (start, place, end, kind) in code points, from the stretches between and within them."""
    pattern = F.lit(rule.pattern)
    steps = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, 0).alias("hit"),
        F.regexp_extract_all(text, pattern, rule.group).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        good = x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least)
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(good, F.concat(state["found"], F.array(span)))
        return F.struct(F.coalesce(end, start).alias("at"), found.otherwise(state["found"]).alias("found"))

    def spans_of(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"])

    def size(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))

    def whole(parts: Column) -> Column:
        starts = _running(F.transform(parts, size), lambda a, b: a + b)
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), spans_of))

    return let(_in_parts(steps), whole)


def _in_parts(items: Column) -> Column:
    """An array as arrays of PART items: what is put together item by item stays short, so long arrays take linear time."""

    def cut(x: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(x) - 1) / PART)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * PART + 1, F.lit(PART)))

    return let(items, cut)


def _running(values: Column, add) -> Column:
    """0 and what each value makes of the result before it."""
    start = F.array(F.lit(0))
    return F.aggregate(values, start, lambda done, v: F.concat(done, F.array(add(F.element_at(done, -1), F.coalesce(v, F.lit(0))))))


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Add ``secrets`` to every row: an array of (start, place, end, kind), by start and then by rule.

    Matches are leftmost and do not overlap within a kind; ``place`` is the rule's number. Spans count code points, the end
    is exclusive. A null or empty text has an empty array. Rows that repeat an id (null too) share candidates
    and are verified one by one. Other columns pass through; an equal name is replaced.
    """
    docs = docs.drop("secrets")
    x = free_prefix(docs.columns)
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    text = F.coalesce("text", F.lit(""))
    if queries:
        postings = build_index(docs.select("doc_id", "text"), trigrams, new_folder(docs.sparkSession, "trigrams"))
        # Written, so that the join knows its size and broadcasts it only below Spark's threshold.
        folder = new_folder(docs.sparkSession, "candidates")
        candidates(postings, trigrams, queries).write.parquet(folder)
        named = docs.sparkSession.read.parquet(folder).toDF(x + "id", x + "rules")
        rows = docs.join(named, F.col("doc_id").eqNullSafe(F.col(x + "id")), "left")
    else:
        rows = docs.withColumn(x + "rules", F.lit(0).cast("long"))
    found = []
    for i, rule in enumerate(rules):
        if i in queries:
            asked = F.col(x + "rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        else:
            asked = text.rlike(rule.pattern)
        spans = _spans(text, rule, i)
        found.append(F.when(asked, spans).otherwise(F.array()))
    return rows.withColumn("secrets", F.array_sort(F.concat(*found))).select(*docs.columns, "secrets")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""

    def masked(part: Column, base: Column, reached: Column) -> Column:
        # Places are counted in the stretch of text of this part alone.
        stretch = F.substring(text, base + 1, reached - base)

        def step(s: Column, x: Column) -> Column:
            gap = F.substring(s["stretch"], s["at"] - base + 1, x["start"] - s["at"])
            out = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap, F.lit(mark)))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["stretch"].alias("stretch"), out.alias("out"))

        start = F.struct(base.alias("at"), stretch.alias("stretch"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(part, start, step, lambda s: F.array_join(s["out"], ""))

    def whole(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.array_max(F.transform(p, lambda x: x["end"])))
        # How far the spans before each part reach, and all of them.
        return let(_running(ends, F.greatest), lambda reached: F.concat(
            F.array_join(F.transform(
                F.arrays_zip(parts.alias("part"), reached.alias("base"), F.slice(reached, F.lit(2), F.size(parts)).alias("reached")),
                lambda z: F.when(z["part"].isNotNull(), masked(z["part"], z["base"], z["reached"])),
            ), ""),
            F.substring(text, F.element_at(reached, -1) + 1, F.length(text) - F.element_at(reached, -1)),
        ))

    return F.when(F.size(spans) > 0, let(_in_parts(spans), whole)).otherwise(text)
