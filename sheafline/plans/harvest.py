"""Whole jobs: from hits to records, and from pages to text per site."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sheafline.functions import urls as U
from sheafline.functions.chunks import chunk_regex
from sheafline.operators import extraction, search, tables, web
from sheafline.session import cut


def text_per_host(
    pages: DataFrame, chunk: Callable[[Column], Column] = chunk_regex
) -> DataFrame:
    """Pages, chunks and their mean length per host.

    A page folds to two numbers in its own row, so only one short row per host
    and map task is shuffled and no chunk is ever exploded.
    """
    sized = web.with_text(pages).select(
        U.url_host(F.col("url")).alias("host"), chunk(F.col("text")).alias("c")
    )
    per_page = sized.select(
        "host",
        F.size("c").alias("n"),
        F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"),
    )
    return per_page.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("chunks"),
        (F.sum("chars") / F.sum("n")).alias("mean_chunk_chars"),
    )


def harvest_chunks(
    results: DataFrame,
    status: DataFrame,
    rules: DataFrame,
    pages: DataFrame,
    agent: str,
    k: int = 3,
    chunk: Callable[[Column], Column] = chunk_regex,
) -> DataFrame:
    """Hits to chunks: the first provider with hits, robots, top k, stored
    pages, main text, chunks. A url asked for by several queries is cut once
    per query, as each of them harvests it. The chosen urls, at most ``k`` per
    query, are fixed before pages are read."""
    hits = search.first_nonempty_provider(results, k)
    chosen = cut(
        search.top_k_urls(web.robots_join(hits, status, rules, agent), k).select(
            "query", "rank", "url"
        )
    )
    fetched = web.page_result_join(
        chosen,
        pages.select("page_id", "url", "html"),
        "page_id",
        web.with_text,
    )
    return web.chunk_rows(fetched, chunk(F.col("text")), ["query", "rank", "page_id", "url"])


def harvest_records(
    chunks: DataFrame,
    patterns: Mapping[str, str | extraction.LabelPattern],
    features: Sequence[tables.Feature],
    key: Sequence[str],
) -> DataFrame:
    """Chunks to the target table: labelled spans that stand in the text, one
    row per key, typed, one row per primary key."""
    found = extraction.ground_spans(
        extraction.extract_labels(chunks, patterns, [*key, "chunk_idx"])
    ).filter(F.col("start").isNotNull())
    return tables.target_assembly(
        found, features, key, ["chunk_idx", "nth"], [F.col(k).desc() for k in key]
    )
