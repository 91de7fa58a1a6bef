"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import html as H
from sheafline.functions import text as X
from sheafline.functions import urls as U
from sheafline.functions.chunks import chunk_regex
from sheafline.operators import requirements as R
from sheafline.operators import web
from sheafline.operators.dedupe import content_groups, dedupe_exact
from sheafline.operators.extraction import to_extraction_struct
from sheafline.operators.rows import explode_rows
from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query


@query(
    "normalize_text",
    f"""SELECT doc_id, {Q.norm('text')} AS norm,
        CASE WHEN n_chars % 2 = 0 THEN '' ELSE CAST(n_chars % 2 AS VARCHAR) END AS parity,
        CASE WHEN lang = 'en' THEN 'true' ELSE '' END AS english FROM documents""",
)
def normalize_text(spark, sf):
    docs = V.texts(spark, sf).select(
        "doc_id",
        F.col("text").alias("norm"),
        (F.col("n_chars") % 2).alias("parity"),
        (F.col("lang") == "en").alias("english"),
    )
    for name in ("norm", "parity", "english"):
        docs = X.normalize_column(docs, name)
    return docs


def _prompts(spark, sf):
    """Conversation turns as prompt lists: each sentence is one sub-prompt."""
    return V.texts(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.transform(
            chunk_regex(F.col("text")),
            lambda s: F.struct(s.alias("query"), F.col("role").alias("reasoning")),
        ).alias("queries"),
    )


@query(
    "query_list",
    f"""SELECT conv_id, turn, unnest(range(len(q))) AS pos, unnest(q) AS query
        FROM (SELECT conv_id, turn, {Q.sentence_list('text')} AS q FROM conversations)""",
)
def query_list(spark, sf):
    rows = explode_rows(
        _prompts(spark, sf), ["conv_id", "turn"], R.query_list(F.col("queries")), "pos", "query"
    )
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "feature_names",
    f"""WITH {Q.FEATURE_SETS}
        SELECT set_id, string_agg(name, ',' ORDER BY o) AS names FROM feature_rows GROUP BY set_id""",
)
def feature_names(spark, sf):
    return V.feature_sets(spark, sf).select(
        "set_id", F.array_join(R.feature_names(F.col("features")), ",").alias("names")
    )


@query(
    "prompt_render",
    """SELECT doc_id, 'In {' || lang || '} from ' || source || ', quality '
              || coalesce(CAST(quality AS VARCHAR), 'None') || ': ' || text AS prompt
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def prompt_render(spark, sf):
    docs = V.texts(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
    template = "In {{{lang}}} from {source}, quality {quality}: {text}"
    return docs.select("doc_id", X.prompt_render(template, docs.columns).alias("prompt"))


@query(
    "url_origin",
    f"""SELECT page_id, {Q.origin('url')} AS origin, {Q.tail('url')} AS tail FROM pages""",
)
def url_origin(spark, sf):
    url = F.col("url")
    return V.pages(spark, sf).select(
        "page_id", U.url_origin(url).alias("origin"), U.url_tail(url).alias("tail")
    )


@query(
    "main_content",
    f"""SELECT page_id, {Q.to_blocks(Q.selected('html'))} AS blocks,
               {Q.to_flat(Q.selected('html'))} AS flat FROM pages""",
)
def main_content(spark, sf):
    html = F.col("html")
    return V.pages(spark, sf).select(
        "page_id",
        H.main_content(html, "blocks").alias("blocks"),
        H.main_content(html, "flat").alias("flat"),
    )


_NO_ARTICLE = "CASE WHEN page_id % 3 = 0 THEN replace(html, '<article', '<div') ELSE html END"


@query(
    "best_text",
    f"""SELECT page_id, {Q.page_text('h')} AS text
        FROM (SELECT page_id, {_NO_ARTICLE} AS h FROM pages)""",
)
def best_text(spark, sf):
    pages = V.pages(spark, sf).withColumn("html", F.expr(_NO_ARTICLE))
    return web.with_text(pages).select("page_id", "text")


_MIXED_LINKS = "replace(html, 'href=\"/t', 'href=\"http://other.example.org/t')"


@query(
    "external_link_filter",
    f"""WITH l AS (SELECT page_id, url, unnest(range(len(m))) AS pos, unnest(m) AS href
          FROM (SELECT page_id, url,
                 regexp_extract_all({_MIXED_LINKS}, '<a href="([^"]*)"', 1) AS m FROM pages))
        SELECT page_id, pos, {Q.origin('url')} || href AS link FROM l
        WHERE NOT starts_with(href, 'http')""",
)
def external_link_filter(spark, sf):
    pages = V.pages(spark, sf).withColumn("html", F.expr(_MIXED_LINKS))
    return web.external_link_filter(web.links(pages)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "link"
    )


@query(
    "robots_allowed",
    f"""WITH {Q.ROBOTS}, {Q.allowed('pages')}
        SELECT page_id, pages.url FROM pages JOIN decided USING (url) WHERE allowed""",
)
def robots_allowed(spark, sf):
    urls = V.pages(spark, sf).select("page_id", "url")
    return web.robots_allowed(
        urls, V.robots_status(spark, sf), V.robots_rules(spark, sf), V.AGENT
    )


@query(
    "requirement_gaps",
    f"""WITH {Q.REQUIREMENTS}, g AS (
          SELECT req_id,
            CASE WHEN trim(coalesce(replace(time_start, chr(9), ' '), '')) = ''
                 THEN 'Provide the start of the time span.' END AS a,
            CASE WHEN trim(coalesce(time_end, '')) = ''
                 THEN 'Provide the end of the time span.' END AS b,
            CASE WHEN trim(coalesce(area_value, '')) = ''
                 THEN 'Provide the explicit area name (e.g. ''Ho Chi Minh City'').' END AS c
          FROM requirements)
        SELECT req_id, concat_ws('|', a, b, c) AS questions,
               a IS NULL AND b IS NULL AND c IS NULL AS is_complete FROM g""",
)
def requirement_gaps(spark, sf):
    return R.requirement_gaps(V.requirements(spark, sf)).select(
        "req_id", F.array_join("questions", "|").alias("questions"), "is_complete"
    )


@query(
    "requirement_check",
    f"""WITH {Q.REQUIREMENTS}
        SELECT req_id, coalesce(scope, 'local') AS scope, coalesce(topic, 'natural') AS topic,
          nullif(concat_ws(';', CASE WHEN scope NOT IN ('global', 'local')
                                     THEN 'scope:' || scope END,
                           CASE WHEN extra_keys THEN 'unknown:colour,size' END), '') AS violation
        FROM requirements""",
)
def requirement_check(spark, sf):
    return R.requirement_check(V.requirements(spark, sf)).select(
        "req_id", "scope", "topic", "violation"
    )


@query(
    "requirement_parse",
    """SELECT c_custkey AS req_id, c_name AS area_value,
         CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS topic,
         CASE WHEN c_custkey % 4 = 0 THEN 'colour' ELSE '' END AS unknown_keys
       FROM customer""",
)
def requirement_parse(spark, sf):
    k = F.col("c_custkey")
    payload = F.to_json(
        F.struct(
            F.col("c_name").alias("area_value"),
            F.when(k % 3 == 0, F.col("c_mktsegment")).alias("topic"),
            F.when(k % 4 == 0, F.lit("red")).alias("colour"),
        )
    )
    raw = V.table(spark, sf, "customer").select(k.alias("req_id"), payload.alias("payload"))
    return R.requirement_parse(raw, "payload").select(
        "req_id", "area_value", "topic", F.array_join("unknown_keys", ",").alias("unknown_keys")
    )


@query(
    "requirement_filter",
    f"""WITH {Q.PRICE_FACTS}
        , asked AS (
          SELECT n_nationkey * 8 + kind AS req_id, area, price, kind, ts FROM price_facts,
            (VALUES (0), (1), (2)) AS v(kind)
          UNION ALL
          SELECT n.n_nationkey * 8 + 3 + k.k, f.area, price, 3 + k.k, ts
          FROM price_facts f, nation n, (VALUES (0), (1)) AS k(k) WHERE n.n_nationkey < 2)
        SELECT CAST(req_id AS BIGINT) AS req_id, area, CAST(count(*) AS BIGINT) AS facts,
               CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM asked
        WHERE CASE kind WHEN 2 THEN ts < TIMESTAMP '1995-07-01'
                        WHEN 3 THEN true
                        WHEN 4 THEN ts >= TIMESTAMP '1997-03-05' AND ts < TIMESTAMP '1997-04-01'
                        ELSE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-01-01' END
        GROUP BY ALL""",
)
def requirement_filter(spark, sf):
    """Bounds by day, year and month, open, blank and unreadable ones, and both scopes."""
    kept = R.requirement_filter(V.price_facts(spark, sf), V.price_requests(spark, sf))
    return kept.groupBy("req_id", "area").agg(
        F.count("*").alias("facts"),
        F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"),
    )


@query(
    "to_extraction_struct",
    f"""WITH {Q.EXAMPLES}, p AS (
          SELECT doc_id, chunk_idx,
            CASE WHEN doc_id % 3 = 1 THEN [[l10, v10], ['first', v1], ['last', vl]]
                 WHEN doc_id % 11 = 5 THEN [['first', v1], [l10, v10], ['last', vl], ['last', vl]]
                 ELSE [['first', v1], [l10, v10], ['last', vl]] END AS e FROM examples)
        SELECT doc_id, chunk_idx, unnest(range(len(e))) AS pos,
               unnest(list_transform(e, lambda x: x[1])) AS extraction_class,
               unnest(list_transform(e, lambda x: x[2])) AS extraction_text FROM p""",
)
def to_extraction_structs(spark, sf):
    rows = explode_rows(
        V.examples(spark, sf),
        ["doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx")],
        to_extraction_struct(F.col("extractions")),
        "pos",
        "e",
    )
    return rows.select("doc_id", "chunk_idx", F.col("pos").cast("bigint").alias("pos"), "e.*")


@query(
    "chunk_rows",
    f"""SELECT page_id, url, unnest(range(len(c))) AS chunk_idx, unnest(c) AS text
        FROM (SELECT page_id, url, {Q.sentence_list(Q.page_text('html'))} AS c FROM pages)""",
)
def chunk_rows(spark, sf):
    rows = web.chunk_rows(
        V.page_text(spark, sf), chunk_regex(F.col("text")), ["page_id", "url"]
    )
    return rows.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


@query(
    "failed_split",
    """SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error,
              CASE WHEN page_id % 7 = 0 THEN 'dead' ELSE 'good' END AS branch FROM pages""",
)
def failed_split(spark, sf):
    results = V.pages(spark, sf).select(
        "page_id", "url", F.when(F.col("page_id") % 7 == 0, "timeout").alias("error")
    )
    good, dead = web.failed_split(results)
    return good.withColumn("branch", F.lit("good")).unionByName(
        dead.withColumn("branch", F.lit("dead")), allowMissingColumns=True
    )


@query(
    "row_sha256",
    """SELECT doc_id, sha256('{"about":{"lang":"' || lang || '","source":"' || source || '"},"counts":{"chars":'
              || n_chars || ',"id":' || doc_id || '}}') AS row_hash FROM documents""",
)
def row_sha256(spark, sf):
    """Struct fields and map entries that stand in another order than their keys'."""
    docs = V.texts(spark, sf)
    nested = docs.select(
        "doc_id",
        F.create_map(F.lit("id"), F.col("doc_id"), F.lit("chars"), F.col("n_chars")).alias("counts"),
        F.struct("source", "lang").alias("about"),
    )
    return nested.select("doc_id", X.row_sha256(nested, "counts", "about").alias("row_hash"))


@query(
    "content_sha256",
    """SELECT doc_id, sha256(text) AS text_hash,
              sha256(json_object('doc_id', doc_id, 'lang', lang, 'source', source)) AS row_hash
       FROM documents""",
)
def content_sha256(spark, sf):
    return V.texts(spark, sf).select(
        "doc_id",
        X.content_sha256("text").alias("text_hash"),
        X.content_sha256("source", "lang", "doc_id").alias("row_hash"),
    )


@query(
    "dedupe_exact",
    f"""SELECT doc_id, lang, source, n_chars FROM documents
        QUALIFY row_number() OVER (PARTITION BY {Q.norm('text')} ORDER BY doc_id) = 1""",
)
def dedupe_exact_rows(spark, sf):
    return dedupe_exact(V.texts(spark, sf), "text", "doc_id").drop("text")


@query(
    "content_groups",
    f"""SELECT sha256({Q.norm('text')}) AS content_hash, min(doc_id) AS doc_id,
               CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1""",
)
def copies_of_texts(spark, sf):
    return content_groups(V.texts(spark, sf), "text", "doc_id")


@query(
    "json_repair",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def json_repair(spark, sf):
    broken = F.translate("props", '"', "'")
    parsed = X.parse_json(broken, "k bigint", repair=True)
    return V.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query(
    "split_names",
    """SELECT s_suppkey, unnest(range(len(n))) AS pos, unnest(n) AS name FROM (
         SELECT s_suppkey, ['brave', lower(s_name), 'exa'] AS n FROM supplier)""",
)
def split_names(spark, sf):
    listed = F.concat(F.lit(" Brave ,, "), "s_name", F.lit(" ,EXA,"))
    rows = explode_rows(
        V.table(spark, sf, "supplier"), ["s_suppkey"], X.split_names_col(listed), "pos", "name"
    )
    return rows.withColumn("pos", F.col("pos").cast("bigint"))
