"""One query for each operator of this package, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafline.llm import (
    bktree,
    bpe,
    cascade,
    crf,
    dedup,
    masked_lm,
    maxscore,
    packing,
    pii,
    pu,
    spans,
    trie,
    weak,
)
from sheafline.llm.common import cut, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(documents(spark, sf_dir), digest=True).drop("row_key")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(documents(spark, sf_dir))


def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return masked_lm.train_and_score(docs)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeated(documents(spark, sf_dir)).drop("row_key")


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.rule_report(documents(spark, sf_dir))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pu.score(docs, pu.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return crf.predict(docs, crf.fit(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bktree.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", bktree.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = maxscore.build_index(documents(spark, sf_dir))
    return maxscore.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), s AS (
  SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM t
), p AS (
  SELECT doc_id, r, n, term, count(*) AS tf
  FROM (SELECT doc_id, r, len(words) AS n, unnest(words) AS term FROM t)
  GROUP BY doc_id, r, n, term
), d AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, s GROUP BY term
), q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT DISTINCT item_id, text FROM benchmark) b, unnest(regexp_extract_all(
         translate(coalesce(b.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term)
  GROUP BY item_id, term
), f AS (
  SELECT item_id, doc_id, r,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT
           AS score
  FROM q JOIN d USING (term) JOIN p USING (term), s
  GROUP BY item_id, doc_id, r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank
  FROM f WHERE score > 0
) WHERE rank <= 20
"""


def op12_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return weak.score(docs, weak.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = """
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), v AS (
  -- the reduction is CRC-32 of the decimal id: -1 stands for one shift
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(conv_id::VARCHAR, ''), x -> [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           (a, x) -> CASE WHEN x >= 0 THEN xor(a, x)
                          WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT)
                          ELSE a >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM c)
), r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d
  FROM (
    SELECT v.conv_id, b.i, b.role, b.text FROM v JOIN c b ON b.conv_id = v.base AND b.i <= v.h
    UNION ALL
    SELECT v.conv_id, v.h + o.i, o.role, o.text FROM v JOIN c o ON o.conv_id = v.conv_id AND o.i > v.h
  )
), p AS (
  SELECT conv_id, d, strlen(text) AS bytes,
         sha256(string_agg(sha256(role) || sha256(text), '')
                OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS id
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM v
), n AS (
  SELECT d, id, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY d, id
), up AS (
  SELECT n.d, n.id, a.d AS up_d, a.id AS up_id, n.n_convs, n.bytes
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d
), k AS (
  SELECT up_d AS d, up_id AS id, count(*) AS n_children FROM up WHERE d = up_d + 1 GROUP BY ALL
), s AS (
  SELECT up.up_d AS d, up.up_id AS id, count(*) FILTER (k.id IS NULL) AS n_leaves,
         sum((up.n_convs - 1) * up.bytes)::BIGINT AS saved_tokens
  FROM up LEFT JOIN k ON k.d = up.d AND k.id = up.id GROUP BY ALL
), e AS (
  SELECT d, id, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max(d) AS d, arg_max(id, d) AS id FROM p GROUP BY conv_id) GROUP BY d, id
)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (d, id) LEFT JOIN k USING (d, id) LEFT JOIN e USING (d, id)
LEFT JOIN up ON up.d = n.d AND up.id = n.id AND up.up_d = n.d - 1
LEFT JOIN n m ON m.d = up.up_d AND m.id = up.up_id
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pack,
        op2_exact_dedup,
        op3_bpe,
        op4_masked_lm,
        op5_sentence_spans,
        op6_rule_cascade,
        op7_pu_quality,
        op8_personal_data,
        op9_language_crf,
        op10_simhash,
        op11_maxscore,
        op12_weak_toxicity,
        op13_prefix_trie,
    )
}

#: The other queries are tested against brute force, an exact round trip or held-out labels.
CHECKS: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op11_maxscore": OP11_SQL, "op13_prefix_trie": OP13_SQL}
