"""Chunking strategies over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import chunks as C
from sheafline.functions.text import words
from sheafline.operators import sentences as S
from sheafline.operators import web
from sheafline.operators.rows import explode_rows
from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query


def _chunks(spark, sf, chunks):
    rows = web.chunk_rows(V.texts(spark, sf), chunks, ["doc_id"])
    return rows.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


def _windows_sql(size: int, starts: str) -> str:
    return f"""
        WITH w AS (SELECT doc_id, text, {Q.word_list('text')} AS w FROM documents),
        s AS (SELECT doc_id, text, w, CASE WHEN len(w) <= {size} THEN [0] ELSE {starts} END AS s FROM w)
        SELECT doc_id, unnest(range(len(s))) AS chunk_idx,
          unnest(CASE WHEN len(w) <= {size} THEN [text]
                 ELSE list_transform(s, lambda i: array_to_string(w[i + 1 : i + {size}], ' ')) END) AS text
        FROM s"""


@query(
    "chunk_regex",
    f"""SELECT doc_id, unnest(range(len(c))) AS chunk_idx, unnest(c) AS text
        FROM (SELECT doc_id, {Q.sentence_list('text')} AS c FROM documents)""",
)
def chunk_regex(spark, sf):
    return _chunks(spark, sf, C.chunk_regex(F.col("text")))


@query(
    "chunk_regex_chain",
    """SELECT doc_id, unnest(range(len(c))) AS chunk_idx, unnest(c) AS text
       FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)),
                                    lambda p: string_split(p, ', '))) AS c FROM documents)""",
)
def chunk_regex_chain(spark, sf):
    return _chunks(spark, sf, C.chunk_regex(F.col("text"), [r"\n", r", "]))


@query(
    "chunk_sliding",
    _windows_sql(
        100,
        "range(0, len(w) - 99, 50) || "
        "CASE WHEN (len(w) - 100) % 50 = 0 THEN [] ELSE [len(w) - 100] END",
    ),
)
def chunk_sliding(spark, sf):
    return _chunks(spark, sf, C.chunk_sliding(F.col("text")))


@query(
    "chunk_fixed",
    f"""WITH w AS (SELECT doc_id, {Q.word_list('text')} AS w FROM documents)
        SELECT doc_id, unnest(range(len(c))) AS chunk_idx, unnest(c) AS text FROM (
          SELECT doc_id, list_transform(range(0, len(w), 100),
                   lambda i: array_to_string(w[i + 1 : i + 100], ' ')) AS c FROM w)""",
)
def chunk_fixed(spark, sf):
    return _chunks(spark, sf, C.chunk_fixed(F.col("text")))


@query("chunk_overlap", _windows_sql(1000, "range(0, len(w) - 100, 900)"))
def chunk_overlap(spark, sf):
    return _chunks(spark, sf, C.chunk_overlap(F.col("text")))


@query("chunk_token_window", _windows_sql(2000, "range(0, len(w) - 200, 1800)"))
def chunk_token_window(spark, sf):
    return _chunks(spark, sf, C.chunk_token_window(F.col("text")))


_SHORT = " OR ".join(
    f"(lang = '{lang}' AND regexp_matches(w[i], '(?i)(^|[^\\pL])({'|'.join(short)})\\.$'))"
    for lang, short in C.ABBREVIATIONS.items()
)


@query(
    "chunk_sentences",
    f"""WITH w AS (SELECT doc_id, lang, {Q.word_list('text')} AS w FROM documents),
        e AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w)
                OR (regexp_matches(w[i], '[.!?…][")\\]»”’'']*$') AND NOT coalesce({_SHORT}, false))) AS e
              FROM w)
        SELECT doc_id, unnest(range(len(e))) AS chunk_idx,
               unnest(list_transform(range(1, len(e) + 1), lambda k: array_to_string(
                 w[CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END : e[k]], ' '))) AS text FROM e""",
)
def chunk_sentences(spark, sf):
    """Sentences, with their blanks squeezed for the comparison."""
    rows = _chunks(spark, sf, C.chunk_sentences(F.col("text"), F.col("lang")))
    return rows.withColumn("text", F.array_join(words(F.col("text")), " "))


_LEARNED = f"""
    tok AS (
      SELECT coalesce(lang, '') AS lang, {Q.fold("regexp_replace(w, '^[\\pP\\pS]+|(?:[^\\PP.]|\\pS)+$', '', 'g')")} AS w
      FROM (SELECT lang, unnest({Q.word_list('text')}) AS w FROM documents)),
    types AS (
      SELECT lang, regexp_replace(w, '\\.+$', '') AS word, count(*) FILTER (ends_with(w, '.')) AS with_stop,
             count(*) FILTER (NOT ends_with(w, '.')) AS without
      FROM tok WHERE regexp_matches(regexp_replace(w, '\\.+$', ''), '^[\\pL.]*\\pL$') GROUP BY ALL),
    whole AS (SELECT lang, sum(with_stop) / sum(with_stop + without) AS share FROM types GROUP BY lang),
    scored AS (
      SELECT lang, word, with_stop, without,
             2 * (with_stop * ln(0.99) + without * ln(1 - 0.99) - with_stop * ln(share) - without * ln(1 - share))
             * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
             * pow(length(replace(word, '.', ''))::DOUBLE, -without) AS score
      FROM types JOIN whole USING (lang) WHERE with_stop > 0 AND share < 1),
    learned AS (SELECT * FROM scored WHERE score >= 0.3)"""


@query("learn_abbreviations", f"WITH {_LEARNED} SELECT * FROM learned")
def learn_abbreviations(spark, sf):
    return S.learn_abbreviations(V.texts(spark, sf))


@query(
    "chunk_sentences_learned",
    f"""WITH {_LEARNED},
        w AS (SELECT doc_id, coalesce(lang, '') AS lang, {Q.word_list('text')} AS w FROM documents),
        u AS (SELECT doc_id, lang, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x, len(w) AS n FROM w),
        e AS (SELECT doc_id, list(i ORDER BY i) AS e FROM (
                SELECT u.doc_id, u.i, u.n, regexp_matches(x, '[.!?…][")\\]»”’'']*$')
                  AND NOT (ends_with(x, '.') AND l.word IS NOT NULL) AS stops
                FROM u LEFT JOIN learned l ON l.lang = u.lang AND l.word =
                  {Q.fold("regexp_replace(regexp_replace(x, '^[\\pP\\pS]+', ''), '\\.+$', '')")})
              WHERE stops OR i = n GROUP BY doc_id)
        SELECT doc_id, unnest(range(len(e))) AS chunk_idx,
               unnest(list_transform(range(1, len(e) + 1), lambda k: array_to_string(
                 w[CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END : e[k]], ' '))) AS text
        FROM e JOIN w USING (doc_id)""",
)
def chunk_sentences_learned(spark, sf):
    """Sentences by the abbreviations that the documents themselves show, with their blanks squeezed."""
    docs = V.texts(spark, sf)
    learned = S.learn_abbreviations(docs)
    rows = S.split_sentences(docs, learned)
    rows = explode_rows(rows, ["doc_id"], F.col("sentences"), "chunk_idx", "text")
    return rows.select(
        "doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.array_join(words(F.col("text")), " ").alias("text")
    )


@query(
    "chunk_topics",
    f"""
    WITH s AS (SELECT doc_id, unnest(range(len(c))) AS pos, unnest(c) AS sentence
               FROM (SELECT doc_id, {Q.sentence_list('text')} AS c FROM documents)),
    t AS (SELECT doc_id, pos // 3 AS blk, unnest({Q.word_list('lower(sentence)')}) AS term FROM s),
    c AS (SELECT doc_id, blk, term, count(*) AS n FROM t GROUP BY ALL),
    norms AS (SELECT doc_id, blk, sum(n * n) AS nn FROM c GROUP BY ALL),
    dots AS (SELECT a.doc_id, a.blk, sum(a.n * b.n) AS dot FROM c a JOIN c b
             ON a.doc_id = b.doc_id AND a.blk + 1 = b.blk AND a.term = b.term GROUP BY ALL),
    gaps AS (SELECT l.doc_id, l.blk AS gap,
               CAST(coalesce(d.dot, 0) AS DOUBLE) / sqrt(CAST(l.nn * r.nn AS DOUBLE)) AS cos
             FROM norms l JOIN norms r ON l.doc_id = r.doc_id AND l.blk + 1 = r.blk
             LEFT JOIN dots d ON d.doc_id = l.doc_id AND d.blk = l.blk),
    low AS (SELECT *, lag(cos) OVER w AS before, lead(cos) OVER w AS after FROM gaps
            WINDOW w AS (PARTITION BY doc_id ORDER BY gap)),
    cuts AS (SELECT doc_id, (gap + 1) * 3 AS pos, 1 AS cut FROM low WHERE cos < before AND cos < after),
    seg AS (SELECT s.doc_id, s.pos, s.sentence,
              CAST(sum(coalesce(cut, 0)) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS BIGINT) AS segment
            FROM s LEFT JOIN cuts ON s.doc_id = cuts.doc_id AND s.pos = cuts.pos)
    SELECT doc_id, segment, CAST(count(*) AS BIGINT) AS sentences,
           string_agg(sentence, ' ' ORDER BY pos) AS chunk FROM seg GROUP BY doc_id, segment""",
)
def chunk_topics(spark, sf):
    rows = explode_rows(
        V.texts(spark, sf), ["doc_id"], C.topic_segments(F.col("text")), "segment", "c"
    )
    return rows.select(
        "doc_id",
        F.col("segment").cast("bigint").alias("segment"),
        F.col("c.sentences").cast("bigint").alias("sentences"),
        F.col("c.chunk").alias("chunk"),
    )
