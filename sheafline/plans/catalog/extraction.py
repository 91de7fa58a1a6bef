"""Labelled extraction and user extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import extraction as E
from sheafline.operators import induction as I
from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query
from sheafline.session import cut


def _found(spark, sf):
    return E.extract_labels(V.texts(spark, sf), V.LABEL_PATTERNS, ["doc_id"])


@query(
    "extract_labels",
    f"""WITH {Q.extractions()} SELECT doc_id, extraction_class, nth, extraction_text FROM found""",
)
def extract_labels(spark, sf):
    return _found(spark, sf).select(
        "doc_id", "extraction_class", F.col("nth").cast("bigint").alias("nth"), "extraction_text"
    )


@query(
    "extract_terms",
    f"""WITH w AS (SELECT doc_id, {Q.bare_words('text')} AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(w || list_transform(range(1, len(w)),
                lambda i: w[i] || ' ' || w[i + 1])) AS extraction_text FROM w),
        b AS (SELECT {Q.bare_words('text')} AS w FROM benchmark),
        t AS (SELECT DISTINCT 'opening' AS extraction_class, w[1] || ' ' || w[2] AS extraction_text
              FROM b WHERE len(w) > 1
              UNION SELECT 'closing', w[-1] FROM b)
        SELECT doc_id, extraction_class, extraction_text FROM g JOIN t USING (extraction_text)""",
)
def extract_terms(spark, sf):
    """Value list: first two words and last word of each benchmark text."""
    b = V.table(spark, sf, "benchmark").select(E.term_words(F.col("text")).alias("w"))
    opening = b.filter(F.size("w") > 1).select(
        F.lit("opening").alias("label"), F.array_join(F.slice("w", 1, 2), " ").alias("value")
    )
    closing = b.select(F.lit("closing").alias("label"), F.element_at("w", -1).alias("value"))
    return E.extract_terms(V.texts(spark, sf), opening.union(closing), ["doc_id"])


@query(
    "extract_terms_long",
    f"""WITH b AS (SELECT DISTINCT array_to_string({Q.bare_words('text')}[3:7], ' ') AS extraction_text
                   FROM benchmark),
        d AS (SELECT doc_id, ' ' || array_to_string({Q.bare_words('text')}, ' ') || ' ' AS t FROM documents)
        SELECT doc_id, 'five' AS extraction_class, extraction_text
        FROM d JOIN b ON contains(t, ' ' || extraction_text || ' ')""",
)
def extract_terms_long(spark, sf):
    """Five words of each benchmark text, listed as example rows with other case and marks."""
    b = V.table(spark, sf, "benchmark").select(
        F.slice(E.term_words(F.col("text")), 3, 5).alias("w")
    )
    marked = F.concat(F.lit("("), F.upper(F.array_join("w", ", ")), F.lit(")."))
    examples = b.select(
        F.array(F.struct(F.lit("five").alias("label"), marked.alias("value"))).alias("extractions")
    )
    return E.extract_terms(V.texts(spark, sf), E.example_terms(examples), ["doc_id"])


@query(
    "extract_terms_places",
    f"""WITH {Q.placed_words('documents', 'doc_id')},
        g AS (SELECT *, folded AS one, folded || ' ' || lead(folded) OVER d || ' ' || lead(folded, 2) OVER d AS three,
                     lead("end", 2) OVER d AS end_of_three
              FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
        b AS (SELECT {Q.bare_words('text')} AS w FROM benchmark),
        t AS (SELECT DISTINCT array_to_string(w[2 : 4], ' ') AS three FROM b WHERE len(w) > 3),
        o AS (SELECT DISTINCT w[-1] AS one FROM b WHERE len(w) > 0)
        SELECT doc_id, 'three' AS extraction_class, three AS extraction_text, start, end_of_three AS "end"
        FROM g JOIN t USING (three)
        UNION ALL SELECT doc_id, 'last', one, start, "end" FROM g JOIN o USING (one)""",
)
def extract_terms_places(spark, sf):
    """Every place of the second to fourth word, and of the last word, of each benchmark text."""
    w = E.term_words(F.col("text"))
    b = V.table(spark, sf, "benchmark").select(w.alias("w"))
    three = b.filter(F.size("w") > 3).select(F.lit("three").alias("label"), F.array_join(F.slice("w", 2, 3), " ").alias("value"))
    last = b.filter(F.size("w") > 0).select(F.lit("last").alias("label"), F.element_at("w", -1).alias("value"))
    found = E.extract_terms(V.texts(spark, sf), three.union(last), ["doc_id"], places=True)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query(
    "induce_patterns",
    f"""WITH {Q.INDUCED}
        SELECT label, kind, "left", shape, "right", n::INTEGER AS n, support, total, precision FROM induced""",
)
def induce_patterns(spark, sf):
    """Patterns of the labels, learned from half of the documents."""
    return I.induce_patterns(V.labelled_examples(spark, sf))


@query(
    "extract_by_patterns",
    f"""WITH {Q.INDUCED}
        SELECT doc_id, label AS extraction_class, value AS extraction_text, start, "end",
               max(precision) AS precision
        FROM pats JOIN induced USING (kind, "left", shape, "right", n) GROUP BY ALL""",
)
def extract_by_patterns(spark, sf):
    """What the learned patterns find in all documents."""
    patterns = cut(I.induce_patterns(V.labelled_examples(spark, sf)))
    found = I.extract_by_patterns(V.texts(spark, sf), patterns, ["doc_id"])
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query(
    "ground_spans",
    f"""WITH {Q.extractions()}, v AS (
          SELECT *, CASE WHEN doc_id % 4 = 0 THEN upper(extraction_text) || '!' ELSE extraction_text END
                    AS value FROM found)
        , placed AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN nullif(instr(text, value), 0) - 1
                                  ELSE place END AS p FROM v)
        SELECT doc_id, extraction_class, nth, value AS extraction_text,
               CAST(p AS BIGINT) AS start, CAST(p + length(value) AS BIGINT) AS "end" FROM placed""",
)
def ground_spans(spark, sf):
    """Every fourth document's values are altered, so that they do not stand in the text."""
    value = F.when(
        F.col("doc_id") % 4 == 0, F.concat(F.upper("extraction_text"), F.lit("!"))
    ).otherwise(F.col("extraction_text"))
    spans = E.ground_spans(_found(spark, sf).withColumn("extraction_text", value))
    return spans.select(
        "doc_id",
        "extraction_class",
        F.col("nth").cast("bigint").alias("nth"),
        "extraction_text",
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
    )


@query(
    "example_check",
    f"""WITH {Q.EXAMPLES}, p AS (
          SELECT *, CASE WHEN doc_id % 3 = 1 THEN [l10, 'first', 'last']
                         WHEN doc_id % 11 = 5 THEN ['first', l10, 'last', 'last']
                         ELSE ['first', l10, 'last'] END AS got FROM examples)
        SELECT doc_id, chunk_idx, concat_ws('|',
          CASE WHEN l10 = 'Tenth' THEN 'extra label' END,
          CASE WHEN l10 = 'Tenth' THEN 'missing label' END,
          CASE WHEN len(list_distinct(got)) < len(got) THEN 'repeated label' END,
          CASE WHEN got <> ['first', 'tenth', 'last'] THEN 'label order' END,
          CASE WHEN NOT (contains(text, v10)) THEN 'ungrounded value' END,
          CASE WHEN n NOT BETWEEN 40 AND 80 THEN 'length' END) AS problems FROM p""",
)
def example_check(spark, sf):
    labels = F.array(F.lit("first"), F.lit("tenth"), F.lit("last"))
    return E.example_check(V.examples(spark, sf), labels).select(
        "doc_id",
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.array_join("problems", "|").alias("problems"),
    )


@query(
    "pivot_records",
    f"""WITH {Q.extractions()}
        SELECT doc_id, {', '.join(f"arg_min(extraction_text, nth) FILTER (extraction_class = '{c}') AS {c}" for c in Q.LABELS_SQL)}
        FROM found GROUP BY doc_id""",
)
def pivot_records(spark, sf):
    return E.pivot_records(_found(spark, sf), list(V.LABEL_PATTERNS), "doc_id", ["nth"])


@query(
    "register_extractor",
    f"""SELECT doc_id, len(regexp_extract_all({Q.norm('text')} || ' ' || text, '[A-Z]')) AS capitals,
               len(regexp_extract_all(text, '[A-Z]')) > 50 AS many FROM documents""",
)
def register_extractor(spark, sf):
    """A user function between column hooks, with its state built per task."""

    def build():
        import re

        return re.compile("[A-Z]")

    def count_capitals(batch, pattern):
        counts = batch["text"].str.count(pattern).astype("int64")
        return batch.assign(capitals=counts)[["doc_id", "capitals"]]

    E.register_extractor(
        E.Extractor(
            name="capitals",
            fn=count_capitals,
            schema="doc_id bigint, capitals bigint",
            pre={"text": F.coalesce("text", F.lit(""))},
            post={"many": F.col("capitals") > 50},
            setup=build,
        )
    )
    docs = V.texts(spark, sf).select("doc_id", "text")
    return E.apply_extractor(docs, "capitals")
