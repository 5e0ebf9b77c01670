"""Building of filtered, pivoted, trimmed, permuted and serialised question data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .evaluation import with_typed_sets
from .positions import part_of, positions, running_total

# Operator subsets, from projections only to all kinds, and the
# longest target text in tokens that training accepts for each.
SUBSETS = {
    "p": ["P"],
    "pc": ["P", "C"],
    "pcs": ["P", "C", "S"],
    "pcsgbh": ["P", "C", "S", "GB", "H"],
    "pcsgbhob": ["P", "C", "S", "GB", "H", "OB"],
    "pcsgbhoba": ["P", "C", "S", "GB", "H", "OB", "A"],
    "pcsgbhobaop": ["P", "C", "S", "GB", "H", "OB", "A", "OP"],
    "pcsgbhobaopl": ["P", "C", "S", "GB", "H", "OB", "A", "OP", "L"],
}
TOKEN_CAPS = {
    "p": 1024, "pc": 1024, "pcs": 512, "pcsgbh": 512,
    "pcsgbhob": 512, "pcsgbhoba": 512, "pcsgbhobaop": 512, "pcsgbhobaopl": 128,
}
TABLE_BUDGET = 1024

# ---- joins by id --------------------------------------------------------------


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def last_per_id(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per id: the last one in ``order``."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(row).select(key, "_row.*")


def attach(df: DataFrame, forms: DataFrame, key: str = "id", *, order: Sequence[str]) -> DataFrame:
    """Add the columns of ``forms`` by id; when an id occurs twice its last row in ``order`` counts."""
    return df.join(last_per_id(forms, key, order), key)


def map_header(header: Column, names: Column) -> Column:
    """Display header of each ``cN`` or ``cN_suffix`` name; other names are left out."""

    def entry(name: Column) -> Column:
        place = F.regexp_extract(name, r"^c([0-9]+)(_.*)?$", 1).try_cast("int")
        return F.struct(name.alias("name"), F.get(header, place - 1).alias("header"))

    return F.filter(F.transform(names, entry), lambda e: e["header"].isNotNull())


# ---- filters and splits -------------------------------------------------------


def checked_ids(checks: DataFrame) -> DataFrame:
    """Per id whether each operator subset reproduced the answer: (id, kept)."""
    bits = F.create_map(*[F.lit(v) for i, name in enumerate(SUBSETS) for v in (name, 1 << i)])
    passed = F.when(F.col("ok"), F.try_element_at(bits, F.col("omega"))).otherwise(0)
    per_id = checks.groupBy("id").agg(
        F.bit_or(F.coalesce(passed, F.lit(0))).alias("_passed"),
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("_all"),
    )
    complete = F.col("_passed") == (1 << len(SUBSETS)) - 1
    return per_id.select("id", (F.col("_all") & complete).alias("kept"))


def build_stats(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("errors"))


def wide_forms(forms: DataFrame) -> DataFrame:
    """One ``lf_<subset>`` column per operator subset from (id, omega, text)."""
    pivoted = forms.groupBy("id").pivot("omega", list(SUBSETS)).agg(F.max("text"))
    return pivoted.select("id", *[F.col(s).alias(f"lf_{s}") for s in SUBSETS])


def route_splits(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Training and validation keep the listed ids, the test split keeps everything."""
    test = F.col("split") == "test"
    return keep_ids(df.filter(~test), ids, key).unionByName(df.filter(test))


def token_count(text: Column) -> Column:
    return F.size(F.split(text, " "))


def fits(omega: Column, text: Column, tokens=token_count) -> Column:
    """The text is within its subset's cap; pass another ``tokens`` for a real tokenizer."""
    caps = F.create_map(*[F.lit(v) for pair in TOKEN_CAPS.items() for v in pair])
    return F.coalesce(tokens(text) <= F.try_element_at(caps, omega), F.lit(False))


def length_filter(df: DataFrame, omega: str, text: str, tokens=token_count) -> DataFrame:
    """Drop training rows that are too long; other splits are not touched."""
    return df.filter((F.col("split") != "train") | fits(F.col(omega), F.col(text), tokens))


def select_rename(df: DataFrame, target: str) -> DataFrame:
    return df.select("id", "question", F.col(target).alias("answers"))


def stringify(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def prepare_questions(df: DataFrame) -> DataFrame:
    """Lower-case questions; a list of answers becomes one text."""
    return df.withColumns({"question": F.lower("question"), "answers": F.array_join("answers", ", ")})


def random_example(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(1)


# ---- tables as text and as nested rows ----------------------------------------


def nest_rows(df: DataFrame, keys: Sequence[str], pos: str, cells: Column, size: int = 1024) -> DataFrame:
    """Rows of a table as nested lists of at most ``size`` rows: (keys, part, rows).

    ``pos`` counts a table's rows from 0, so no part can hold more than ``size``.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), cells.alias("cells"))))
    parts = df.groupBy(*keys, part_of(pos, size).alias("part")).agg(ordered.alias("rows"))
    return parts.withColumn("rows", F.transform("rows", lambda r: r["cells"]))


def unnest_rows(nested: DataFrame, keys: Sequence[str], size: int = 1024) -> DataFrame:
    """Nested lists back to one row per table row: (keys, pos, cells)."""
    rows = nested.select(*keys, "part", F.posexplode("rows").alias("_i", "cells"))
    return rows.select(*keys, (F.col("part") * size + F.col("_i")).alias("pos"), "cells")


def serialize(
    df: DataFrame, keys: Sequence[str], pos: str, question: Column, header: Sequence[str], size: int = 1024
) -> DataFrame:
    """Tables as ``question col : a | b row 1 : x | y`` texts: (keys, part, text).

    A table's whole text is its parts joined in ``part`` order; a part covers at
    most ``size`` rows and only part 0 carries question and header.
    """
    cells = F.array_join(F.array(*[F.col(c).cast("string") for c in header]), " | ", "")
    line = F.concat(F.lit(" row "), (F.col(pos) + 1).cast("string"), F.lit(" : "), cells)
    head = F.concat(question, F.lit(" col : " + " | ".join(header)))
    lined = df.select(*keys, F.col(pos).alias("_pos"), F.when(F.col(pos) == 0, F.concat(head, line)).otherwise(line).alias("_line"))
    lines = F.array_sort(F.collect_list(F.struct("_pos", "_line")))
    texts = lined.groupBy(*keys, part_of("_pos", size).alias("part")).agg(lines.alias("_lines"))
    return texts.select(*keys, "part", F.array_join(F.transform("_lines", lambda x: x["_line"]), "").alias("text"))


def header_of(text: Column) -> Column:
    """Column names of a serialised table."""
    after = F.get(F.split(text, " col : "), F.lit(1))
    names = F.split(F.get(F.split(after, " row 1 : "), F.lit(0)), r" \|")
    return F.transform(names, lambda n: F.btrim(n))


def prefix_budget(
    df: DataFrame, keys: Sequence[str], pos: str, tokens: str, head_tokens: Column, budget: int = TABLE_BUDGET
) -> DataFrame:
    """Longest prefix of every table whose rows, header and question fit the token budget.

    A row without tokens, or with a null or negative count, costs nothing and is kept as long as the rows
    before it fit.
    """
    cost = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0))
    used = running_total(df, [F.col(pos)], keys, cost, "_used")
    return used.filter(F.col("_used") + head_tokens <= budget).drop("_used")


# ---- permutation --------------------------------------------------------------


def permute(
    df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], seed: int = 42, first: Column | None = None
) -> DataFrame:
    """Shuffle each named column among the first rows of its table, each on its own.

    Rows from position ``first`` on keep their values. The order comes from an md5 of seed, table, column and
    position, so copies of a table are shuffled alike, in any engine. Only positions are shuffled; a value of any
    type is then fetched from the position it comes from.
    """
    moving = df.filter(F.col(pos) < first) if first is not None else df
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    long = moving.select(*keys, F.col(pos).alias("_from"), names)
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("column"), F.col("_from").cast("string")]
    drawn = positions(long, [F.md5(F.concat_ws("|", *parts)), F.col("_from")], keys=[*keys, "column"], name="_to")
    out = df.join(
        drawn.groupBy(*keys, F.col("_to").alias(pos)).agg(
            *[F.max(F.when(F.col("column") == c, F.col("_from"))).alias(f"_from_{c}") for c in columns]
        ),
        [*keys, pos], "left",
    )
    for c in columns:
        source = df.select(*keys, F.col(pos).alias(f"_from_{c}"), F.col(c).alias(f"_new_{c}"))
        out = out.join(source, [*keys, f"_from_{c}"], "left")
    return out.select(*[
        F.when(F.col(f"_from_{c}").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def answer_changed(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Add ``changed``; a missing new answer leaves the original in place."""
    sets = with_typed_sets(pairs.withColumn("_after", F.coalesce(after, before)), before, "_after")
    same = S.flexible(F.col("_after"), F.col(before), F.col("_predicted"), F.col("_target"))
    return sets.withColumn("changed", ~same).drop("_target", "_predicted", "_after")
