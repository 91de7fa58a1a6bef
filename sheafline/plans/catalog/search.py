"""Search results, robots rules, links and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import ranking, search, web
from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query


@query(
    "robots_join",
    f"""WITH {Q.ROBOTS}, {Q.allowed('pages')}
        SELECT page_id, pages.url, allowed FROM pages JOIN decided USING (url)""",
)
def robots_join(spark, sf):
    urls = V.pages(spark, sf).select("page_id", "url")
    return web.robots_join(urls, V.robots_status(spark, sf), V.robots_rules(spark, sf), V.AGENT)


@query(
    "robots_join_by_prefix",
    f"""WITH {Q.ROBOTS}, {Q.allowed('pages')}
        SELECT page_id, pages.url, allowed FROM pages JOIN decided USING (url)""",
)
def robots_join_by_prefix(spark, sf):
    """The same through the path for origins with very many rules."""
    urls = V.pages(spark, sf).select("page_id", "url")
    return web.robots_join(
        urls, V.robots_status(spark, sf), V.robots_rules(spark, sf), V.AGENT, array_limit=2
    )


@query(
    "page_result_join",
    """SELECT u.page_id, u.url, r.result_id, r.html_chars
       FROM pages u JOIN (SELECT url, min(page_id) AS result_id,
                            arg_min(length(html), page_id) AS html_chars
                          FROM pages GROUP BY url) r ON u.url = r.url""",
)
def page_result_join(spark, sf):
    urls = V.pages(spark, sf).select("page_id", "url")
    results = V.pages(spark, sf).select(
        "url",
        F.col("page_id").alias("result_id"),
        F.length("html").cast("bigint").alias("html_chars"),
    )
    return web.page_result_join(urls, results, "result_id")


@query(
    "union_providers",
    """SELECT page_id, url, 'brave' AS provider FROM pages
       UNION ALL SELECT page_id, url, 'searx' FROM pages""",
)
def union_providers(spark, sf):
    hits = V.pages(spark, sf).select("page_id", "url")
    brave = hits.withColumn("provider", F.lit("brave"))
    searx = hits.withColumnRenamed("url", "link").withColumn("provider", F.lit("searx"))
    return search.union_providers([brave, searx]).select("page_id", "url", "provider")


@query(
    "first_nonempty_provider",
    f"""WITH {Q.SEARCH_RESULTS}, f AS (
          SELECT *, min(provider_order) OVER (PARTITION BY query) AS first_order,
            row_number() OVER (PARTITION BY query, provider_order ORDER BY rank, url) AS rn
          FROM search_results)
        SELECT query, provider, provider_order, rank, url FROM f
        WHERE provider_order = first_order AND rn <= 4""",
)
def first_nonempty_provider(spark, sf):
    return search.first_nonempty_provider(V.search_results(spark, sf), 4)


def _top_k_sql(k: int) -> str:
    return f"""WITH {Q.SEARCH_RESULTS}, {Q.ROBOTS}, {Q.allowed('search_results')},
        ok AS (SELECT s.* FROM search_results s JOIN decided USING (url) WHERE allowed),
        top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, url) AS rn FROM ok)
        SELECT query, url, min(rank) AS rank FROM top WHERE rn <= {k} GROUP BY query, url"""


def _top_k(spark, sf, k):
    checked = web.robots_join(
        V.search_results(spark, sf),
        V.robots_status(spark, sf),
        V.robots_rules(spark, sf),
        V.AGENT,
    )
    return search.top_k_urls(checked, k).select("query", "url", "rank")


@query("top_k_urls", _top_k_sql(3))
def top_k_urls(spark, sf):
    return _top_k(spark, sf, 3)


@query("top_k_configured", _top_k_sql(4))
def top_k_configured(spark, sf):
    return _top_k(spark, sf, 4)


@query("top_k_beyond_map_limit", _top_k_sql(1200))
def top_k_beyond_map_limit(spark, sf):
    return _top_k(spark, sf, 1200)


@query(
    "dedupe_keep_first",
    f"""WITH {Q.SEARCH_RESULTS}
        SELECT url, min(rank) AS rank, arg_min(query, rank * 4 + provider_order) AS query
        FROM search_results GROUP BY url""",
)
def dedupe_keep_first(spark, sf):
    first = ranking.dedupe_keep_first(
        V.search_results(spark, sf), "url", ["rank", "provider_order"]
    )
    return first.select("url", "rank", "query")


# facet_type, facet_order, term
_FACETS = [("format", 1, "download csv"), ("format", 2, "filetype:json"), ("source", 3, "site:gov")]


@query(
    "query_expand",
    f"""WITH facets AS (
          SELECT * FROM (VALUES {', '.join(f"('{t}', {o}, '{w}')" for t, o, w in _FACETS)})
            AS v(facet_type, facet_order, term)
          UNION ALL SELECT DISTINCT 'entity', 4, lower(c_mktsegment) FROM customer
          UNION ALL SELECT 'region', 5, lower(n_name) FROM nation),
        f AS (SELECT *, row_number() OVER (ORDER BY facet_order, term) - 1 AS pos FROM facets)
        SELECT p_partkey, p_name AS topic, pos, facet_type, p_name || ' ' || term AS query
        FROM part, f WHERE pos < 12""",
)
def query_expand(spark, sf):
    topics = V.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("topic"))
    fixed = spark.createDataFrame(_FACETS, "facet_type string, facet_order int, term string")
    entities = V.table(spark, sf, "customer").select(
        F.lit("entity"), F.lit(4), F.lower("c_mktsegment")
    )
    regions = V.table(spark, sf, "nation").select(F.lit("region"), F.lit(5), F.lower("n_name"))
    facets = fixed.union(entities.distinct()).union(regions)
    out = search.query_expand(topics, facets, 12)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@query(
    "links",
    f"""SELECT page_id, unnest(range(len(m))) AS pos, unnest(m) AS href,
               {Q.origin('url')} || unnest(m) AS link
        FROM (SELECT page_id, url, {_HREFS} AS m FROM pages)""",
)
def links(spark, sf):
    return web.links(V.pages(spark, sf)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "link"
    )


def _with_images(spark, sf):
    """Pages whose anchors are turned into images; every fifth lost its src."""
    html = F.replace(F.col("html"), F.lit("<a href="), F.lit("<img src="))
    html = F.when(
        F.col("page_id") % 5 == 0, F.replace(html, F.lit("<img src="), F.lit("<img alt="))
    ).otherwise(F.replace(html, F.lit('src="/t'), F.lit('src="pics/t.x/')))
    return V.pages(spark, sf).withColumn("html", html)


@query(
    "image_manifest",
    f"""WITH l AS (SELECT page_id, url, unnest(range(len(m))) AS pos, unnest(m) AS href
                   FROM (SELECT page_id, url, {_HREFS} AS m FROM pages WHERE page_id % 5 <> 0)),
        a AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/t')
                THEN regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || 'pics/t.x/' || substr(href, 3)
                ELSE {Q.origin('url')} || href END AS image_url FROM l),
        e AS (SELECT *, regexp_extract(image_url, '[^/.][^/]*?(\\.[^./]*)$', 1) AS x FROM a)
        SELECT page_id, pos, image_url,
               sha256(image_url) || CASE WHEN x = '' THEN '.jpg' ELSE x END AS file_name FROM e""",
)
def image_manifest(spark, sf):
    return web.image_manifest(_with_images(spark, sf)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "image_url", "file_name"
    )


@query(
    "images_limit",
    f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN ''
               ELSE array_to_string(list_transform({_HREFS}[1:3],
                 lambda h: CASE WHEN starts_with(h, '/t') THEN 'pics/t.x/' || substr(h, 3) ELSE h END),
                 ' ') END AS images FROM pages""",
)
def images_limit(spark, sf):
    return web.images_limit(_with_images(spark, sf), 3).select(
        "page_id", F.array_join("images", " ").alias("images")
    )
