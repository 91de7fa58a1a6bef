"""Pages, links, images and the robots rules that gate them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sheafline.functions import html as H
from sheafline.functions import urls as U
from sheafline.operators.ranking import dedupe_keep_first, first_n
from sheafline.operators.rows import explode_rows, maybe_among

# An origin's first rules travel as an array; those behind are met by a join.
RULE_ARRAY_LIMIT = 400


def _status_verdict(status: Column) -> Column:
    """Verdict the robots.txt response alone gives; null: look at the rules.

    So does an origin whose response is not known but whose rules are; one
    without either is allowed."""
    return (
        F.when(status.isin(401, 403), F.lit(False))
        .when(status.between(400, 499), F.lit(True))
        .when(status >= 500, F.lit(False))
    )


def _addressed_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Rules of the groups that name ``agent``, and of ``*``.

    An empty path that is not allowed means allow all.
    """
    token = F.lit(agent.split("/")[0].lower())
    name = F.lower(F.col("agent"))
    star = F.col("agent") == "*"
    return rules.filter(star | token.contains(name)).select(
        "origin",
        star.alias("star"),
        name.alias("grp"),
        F.col("position").cast("bigint").alias("position"),
        (F.col("allow") | (F.col("path") == "")).alias("allow"),
        U.percent_decode(F.col("path")).alias("path"),
    )


def _rule_heads(addressed: DataFrame, limit: int) -> DataFrame:
    """One row per origin: its group, the group's first rules in order, and
    whether there are more than ``limit`` rows. The group is the first that
    names the agent, else ``*``; the map side keeps limit + 1 rows an origin."""
    head = first_n(addressed, ["origin"], [F.col("star"), F.col("position")], limit + 1)
    row = F.struct("star", "position", "grp", "allow", "path")
    folded = head.groupBy("origin").agg(F.sort_array(F.collect_list(row)).alias("r"))
    grp = F.element_at("r", 1)["grp"]
    return folded.select(
        "origin",
        grp.alias("grp"),
        F.filter("r", lambda r: r["grp"] == grp).alias("rules"),
        (F.size("r") > limit).alias("more"),
    )


def robots_join(
    urls: DataFrame,
    status: DataFrame,
    rules: DataFrame,
    agent: str,
    array_limit: int = RULE_ARRAY_LIMIT,
) -> DataFrame:
    """Add ``allowed`` to ``urls`` (column ``url``) from its origin's rules.

    The first rule by position whose path starts the url's path decides; no
    match allows. An origin's first ``array_limit`` rules travel to its urls
    as one sorted array, so a url stays one row, and a match among them is
    final. Only urls that found none, at an origin that has more rules, go on
    to an equi-join on the prefixes that can occur, which has no limit. Both
    parts are always planned, so the answer is the same whatever the rules
    are when it runs; without such an origin the second one is empty. AQE splits an origin
    that holds many urls, as the other side has one row for it.
    """
    addressed = _addressed_rules(rules, agent)
    heads = _rule_heads(addressed, array_limit)
    policy = (
        status.groupBy("origin")
        .agg(F.max("status").alias("status"))
        .join(heads.drop("grp"), "origin", "full")
        .select(
            F.col("origin").alias("_o"),
            _status_verdict(F.col("status")).alias("_verdict"),
            F.col("rules").alias("_rules"),
            F.coalesce("more", F.lit(False)).alias("_more"),
        )
    )
    placed = urls.withColumn("_o", U.url_origin(F.col("url"))).withColumn(
        "_tail", U.percent_decode(U.url_tail(F.col("url")))
    )
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("_tail"), r["path"])), F.lit(0))

    def judged(some: DataFrame) -> DataFrame:
        return some.join(policy, "_o", "left").select(
            *urls.columns,
            "_o",
            "_tail",
            F.coalesce("_verdict", first["allow"]).alias("allowed"),
            F.coalesce("_more", F.lit(False)).alias("_more"),
        )

    open_question = F.col("allowed").isNull() & F.col("_more")
    settled = judged(placed).filter(~open_question).select(
        *urls.columns, F.coalesce("allowed", F.lit(True)).alias("allowed")
    )

    crowded = heads.filter("more").select("origin", "grp")
    at = crowded.select(F.col("origin").alias("_o"))
    asked = (
        judged(placed.join(at, "_o", "left_semi"))
        .filter(open_question)
        .select(*urls.columns, "_o", "_tail")
    )
    rest = (
        addressed.join(crowded, ["origin", "grp"])
        .groupBy(F.col("origin").alias("_o"), "path")
        .agg(F.min(F.struct("position", "allow")).alias("m"))
    )
    lengths = rest.groupBy("_o").agg(
        F.collect_set(F.length("path")).alias("lengths")  # bounded by the longest path
    )
    decided = (
        asked.select("_o", "_tail")
        .distinct()
        .join(lengths, "_o")
        .select("_o", "_tail", F.explode("lengths").alias("len"))
        .filter(F.col("len") <= F.length("_tail"))
        .select("_o", "_tail", F.substring("_tail", F.lit(1), F.col("len")).alias("path"))
        .join(rest, ["_o", "path"])
        .groupBy("_o", "_tail")
        .agg(F.min("m").alias("m"))
    )
    answered = asked.join(decided, ["_o", "_tail"], "left").select(
        *urls.columns, F.coalesce("m.allow", F.lit(True)).alias("allowed")
    )
    return settled.unionByName(answered)


def robots_allowed(
    urls: DataFrame, status: DataFrame, rules: DataFrame, agent: str, **options
) -> DataFrame:
    """Urls the agent may fetch."""
    return robots_join(urls, status, rules, agent, **options).filter("allowed").drop("allowed")


def page_result_join(
    urls: DataFrame,
    results: DataFrame,
    order: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pair each requested url with its fetch result, by url.

    A url fetched more than once counts with its first result in ``order``,
    so a repeated request never multiplies with repeated results. That result
    is found on (url, ``order``) alone. Wide rows then pass a bitmap of fixed
    size over the chosen ones before they move, so a result nobody asked for
    is left where it is scanned; ``prepare`` works on each remaining result
    once, however many requests share it.
    """
    wanted = urls.select("url").distinct()
    chosen = (
        results.select("url", order).join(wanted, "url", "left_semi")
        .groupBy("url").agg(F.min(order).alias(order))
    )
    likely = maybe_among(results, ["url", order], chosen)
    # no left semi join: Catalyst moves those below the bitmap, so that every row is shuffled
    met = likely.join(chosen, ["url", order]).select(*results.columns)
    first = dedupe_keep_first(met, "url", order)
    return urls.join(first if prepare is None else prepare(first), "url")


def failed_split(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) by the presence of an error."""
    return results.filter(F.col(error).isNull()).drop(error), results.filter(
        F.col(error).isNotNull()
    )


def with_text(pages: DataFrame, form: str = "blocks") -> DataFrame:
    """Pages with ``text`` in place of ``html``."""
    return pages.withColumn("text", H.page_text(F.col("html"), form)).drop("html")


def chunk_rows(df: DataFrame, chunks: Column, keep: Sequence[str]) -> DataFrame:
    """One row per chunk, each with its page's columns."""
    return explode_rows(df, keep, chunks, "chunk_idx", "text")


def links(pages: DataFrame) -> DataFrame:
    """Links of each page, made absolute, in page order."""
    found = explode_rows(pages, ["page_id", "url"], H.link_targets(F.col("html")), "pos", "href")
    return found.select(
        "page_id", "url", "pos", "href", U.url_join(F.col("url"), F.col("href")).alias("link")
    )


def external_link_filter(found: DataFrame) -> DataFrame:
    """Links that stay on the page's host."""
    return found.filter(U.url_host(F.col("link")) == U.url_host(F.col("url")))


def images_limit(pages: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` images of each page."""
    return pages.select(
        "page_id", "url", F.slice(H.image_sources(F.col("html")), 1, n).alias("images")
    )


def image_manifest(pages: DataFrame, n: int | None = None) -> DataFrame:
    """One row per image: absolute url, extension, stable file name."""
    sources = H.image_sources(F.col("html"))
    if n is not None:
        sources = F.slice(sources, 1, n)
    found = explode_rows(pages, ["page_id", "url"], sources, "pos", "src")
    full = found.withColumn("image_url", U.url_join(F.col("url"), F.col("src")))
    # as in os.path.splitext: the last dot of the last segment, not a leading one
    ext = F.regexp_extract(U.url_path(F.col("image_url")), r"[^/.][^/]*?(\.[^./]*)$", 1)
    return full.withColumn("ext", F.when(ext == "", F.lit(".jpg")).otherwise(ext)).withColumn(
        "file_name", F.concat(F.sha2(F.col("image_url"), 256), F.col("ext"))
    )
