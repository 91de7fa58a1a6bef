"""Search results: provider fallback, ranking, query expansion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from sheafline.functions.text import split_names
from sheafline.operators.ranking import SALT_FROM, dedupe_keep_first, first_n

# The provider names a request may list.
PROVIDERS = ("searx", "brave", "exa", "tavily")


def provider_order(names: str | Sequence[str]) -> list[str]:
    """Provider names in the order they are tried; unknown ones are refused."""
    wanted = split_names(names) if isinstance(names, str) else list(names)
    for name in wanted:
        if name not in PROVIDERS:
            raise ValueError(f"no search provider is called {name!r}; there are {sorted(PROVIDERS)}")
    return wanted


def union_providers(results: Sequence[DataFrame]) -> DataFrame:
    """All providers' rows; a result's address is ``url``, else ``link``."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    if "link" not in both.columns:
        return both
    if "url" not in both.columns:
        return both.withColumnRenamed("link", "url")
    return both.withColumn("url", F.coalesce("url", "link")).drop("link")


def first_nonempty_provider(results: DataFrame, k: int = 3) -> DataFrame:
    """Per query, the first ``k`` results of the first provider that has any.

    Ordered by provider and rank, those are the leading rows of the query that
    still belong to its first provider, so one limited window is enough.
    """
    order = W.partitionBy("query").orderBy("provider_order", "rank", "url")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    if k > SALT_FROM:  # trim per provider first, where keys can be salted
        results = first_n(results, ["query", "provider_order"], [F.col("rank"), F.col("url")], k)
    return (
        results.withColumn("_rn", F.row_number().over(order))
        .withColumn("_first", F.first("provider_order").over(running))
        .filter(F.col("_rn") <= k)
        .filter(F.col("provider_order") == F.col("_first"))
        .drop("_rn", "_first")
    )


def top_k_urls(results: DataFrame, k: int = 3) -> DataFrame:
    """Allowed results, then the first ``k`` by rank, then repeats dropped.

    The order of the three steps is part of the meaning: fewer than ``k`` rows
    may remain. Rows carry ``allowed`` from the robots check; without that
    column all are allowed.
    """
    if "allowed" in results.columns:
        results = results.filter("allowed").drop("allowed")
    top = first_n(results, ["query"], [F.col("rank"), F.col("url")], k)
    return dedupe_keep_first(top, ["query", "url"], "rank")


def query_expand(
    topics: DataFrame, facets: DataFrame, n: int, order: Sequence[str] = ("facet_order", "term")
) -> DataFrame:
    """The first ``n`` short queries of each topic: topic text and one facet.

    Facets apply to every topic, so only the first ``n`` of them can ever be
    used; those travel as one array value and no cross join is planned.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    first = facets.orderBy(*order).limit(n)
    row = F.struct(*dict.fromkeys([*order, "facet_type", "term"]))
    packed = first.agg(F.sort_array(F.collect_list(row)).alias("f")).scalar()
    return topics.select("*", F.posexplode(packed).alias("pos", "facet")).select(
        *topics.columns,
        F.col("pos"),
        F.col("facet.facet_type").alias("facet_type"),
        F.concat_ws(" ", F.col("topic"), F.col("facet.term")).alias("query"),
    )
