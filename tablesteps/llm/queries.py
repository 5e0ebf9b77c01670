"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .cotrain import learn, score
from .hyperminhash import near_duplicates
from .jaccard import link_components
from .langid import held_out, predict, train
from .lexical import ranked_search
from .mixing import mix
from .neighbours import nearest
from .packing import packed_sequences
from .quality_rules import judge
from .secrets import BASE_RULES, MORE_RULES, scan, span_text
from .tokens import encode_store
from .warc import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register a function of some tables under a name, with its SQL equivalent."""

    def keep(build):
        def run(spark, folder):
            return build(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables.split()])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return keep


_LINKS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op5_ngram_jaccard_join", "documents", _LINKS_SQL)
def op5(documents):
    return link_components(documents, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op1_token_id_store", "documents")
def op1(documents):
    read = encode_store(documents, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query("op8_best_fit_packing", "documents")
def op8(documents):
    pieces = packed_sequences(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


_SIZES_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS most,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER o AS nth,
         ((SELECT sum(source_size) FROM sources) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size,
         least(weight * (SELECT arg_min(level, nth) FROM levels WHERE weight * level <= most), CAST(most AS DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * ((CASE WHEN middle / target < 1 THEN 1 ELSE 0 END)
                  + (CASE WHEN (middle + source_size) / target < 1 THEN 1 ELSE 0 END)
                  + (CASE WHEN (middle + 2 * source_size) / target < 1 THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM placed
"""


@query("op3_curriculum_mix", "documents", _SIZES_SQL)
def op3(documents):
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_language_id", "documents")
def op4(documents):
    model = train(documents.where(~held_out()))
    return predict(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


_WARC_SQL = """
WITH hashed AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
keepers AS (SELECT hex, max(page_id) AS keeper FROM hashed GROUP BY hex),
digits AS (
  SELECT hex, keeper, list_transform(range(8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT)) AS fives
  FROM keepers),
named AS (
  SELECT hex, keeper, array_to_string(list_transform(fives, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 32768), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 1024) % 32, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // 32) % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v % 32, 1)), '') AS digest
  FROM digits)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM hashed JOIN named USING (hex)
"""


@query("op6_warc_round_trip", "pages", _WARC_SQL)
def op6(pages):
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_quality_rules", "documents")
def op7(documents):
    return judge(documents.select("doc_id", "lang", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


def _secrets_sql() -> str:
    """The same rules over text split at their matches; the place of a match is the length of all before it."""
    parts = []
    for place, rule in enumerate(BASE_RULES + MORE_RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, i,
         CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS first,
         length(hits[i]) AS size, length(kept[i]) >= {rule.least} AS good
  FROM (SELECT doc_id, gaps, hits, kept, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits,
                     regexp_extract_all(text, '{pattern}', {rule.group}) AS kept
              FROM documents WHERE regexp_matches(text, '{pattern}')))""")
    return f"""
WITH found AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE good),
spans AS (SELECT doc_id, place, kind, first, kind || ':' || first || ':' || (first + size) AS span FROM found),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY first, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY first, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


@query("op10_secret_scan", "documents", _secrets_sql())
def op10(documents):
    found = scan(documents.select("doc_id", "text"))
    kinds = F.col("secrets")

    def count(kind):
        return F.size(F.filter(kinds, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(kinds, lambda s: s["place"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(kinds).alias("spans"),
    )


@query("op9_nearest_neighbours", "embeddings")
def op9(embeddings):
    return nearest(embeddings)


@query("op2_co_trained_quality", "documents labels")
def op2(documents, labels):
    return score(documents, learn(documents, labels)).select("doc_id", "text_score", "meta_score", "score", "kept")


_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
windows AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size),
totals AS (SELECT lang, count(*) AS n FROM windows WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS a FROM windows GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM f WHERE size > 1),
covered AS (
  SELECT DISTINCT x.lang, x.phrase FROM candidates x JOIN candidates y
  ON x.lang = y.lang AND y.size > x.size AND y.a >= x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS head, array_to_string(p[k + 1:], ' ') AS tail
  FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(range(1, size)) AS k FROM candidates ANTI JOIN covered USING (lang, phrase))),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT lang, phrase, unnest(arg_min(struct_pack(a, l, r, n, score), struct_pack(score, k))) FROM scored GROUP BY lang, phrase)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM best)
WHERE rank <= 2000
"""


@query("op11_phrase_collocations", "documents", _PHRASES_SQL)
def op11(documents):
    return collocations(documents)


_RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS nth,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
tf AS (SELECT doc_id, nth, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, nth, w, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM df, totals),
impacts AS (
  SELECT doc_id, nth, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS impact
  FROM tf JOIN weights USING (term), totals),
scored AS (SELECT item_id, doc_id, nth, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)
WHERE rank <= 10
"""


@query("op12_ranked_search", "documents benchmark", _RANKED_SQL)
def op12(documents, benchmark):
    return ranked_search(documents, benchmark)


_NEAR_SQL = (
    _LINKS_SQL.replace("len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])",
                       "len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))")
    .replace(">= 90 *", ">= 85 *")
    .replace("min(other) AS component_id", "min(other) AS component_id, r.doc_id = min(other) AS kept")
)


@query("op13_hyperminhash_near_dedup", "documents", _NEAR_SQL)
def op13(documents):
    return near_duplicates(documents)
