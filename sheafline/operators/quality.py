"""Metrics, goals, guards, coverage and page scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sheafline.functions import html as H
from sheafline.functions.chunks import chunk_regex
from sheafline.functions.compare import COMPARATORS, compare
from sheafline.functions.text import normalize_text, strip, words
from sheafline.operators.rows import explode_rows


def metric_join(
    wanted: DataFrame, metrics: DataFrame, default: float, on: Sequence[str] = ("name",)
) -> DataFrame:
    """Each goal or guard with its metric's ``value``, or ``default``."""
    joined = wanted.join(metrics.select(*on, "value"), list(on), "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(float(default))))


def evaluate_goals(
    goals: DataFrame, metrics: DataFrame, on: Sequence[str] = ("name",)
) -> DataFrame:
    """Goals with ``met`` and ``goal_remain``. A missing metric counts as -inf,
    so a ``<=`` goal without its metric is met."""
    return (
        metric_join(goals, metrics, float("-inf"), on)
        .withColumn("op", F.coalesce("op", F.lit(">=")))
        .withColumn("met", compare(F.col("value"), F.col("op"), F.col("target")))
        .withColumn("goal_remain", ~F.col("met"))
    )


def evaluate_guards(
    guards: DataFrame, metrics: DataFrame, on: Sequence[str] = ("name",)
) -> DataFrame:
    """Guards with ``holds`` and ``guard_remain``, which lists those that hold.
    A missing metric counts as +inf."""
    return (
        metric_join(guards, metrics, float("inf"), on)
        .withColumn("op", F.coalesce("op", F.lit("<=")))
        .withColumn("holds", compare(F.col("value"), F.col("op"), F.col("limit")))
        .withColumn("guard_remain", F.col("holds"))
    )


def metric_spec_check(specs: DataFrame) -> DataFrame:
    """Add ``violation``: a benchmark needs comparator and target, the
    comparator must be known, and a text target only allows ``==``."""
    has_target = F.col("target_num").isNotNull() | F.col("target_str").isNotNull()
    has_op = F.col("comparator").isNotNull()
    return specs.withColumn(
        "violation",
        F.when(has_target != has_op, F.lit("comparator and target go together"))
        .when(has_op & ~F.col("comparator").isin(*COMPARATORS), F.lit("unknown comparator"))
        .when(
            F.col("target_str").isNotNull() & (F.col("comparator") != "=="),
            F.lit("text target needs =="),
        ),
    )


def metric_pass(
    specs: DataFrame, metrics: DataFrame, on: Sequence[str] = ("name",)
) -> DataFrame:
    """Add ``violation`` and ``passed`` (null: no benchmark, no value, or a
    spec that is not valid). Metrics hold ``value`` and ``value_str``."""
    joined = metric_spec_check(specs).join(
        metrics.select(*on, "value", "value_str"), list(on), "left"
    )
    usable = F.col("violation").isNull() & F.col("comparator").isNotNull()
    return joined.withColumn(
        "passed",
        F.when(
            usable & F.col("target_num").isNotNull() & F.col("value").isNotNull(),
            compare(F.col("value"), F.col("comparator"), F.col("target_num")),
        ).when(
            usable & F.col("target_str").isNotNull(), F.col("value_str") == F.col("target_str")
        ),
    )


def duplicate_names(specs: DataFrame, name: str = "name") -> DataFrame:
    """Names declared more than once."""
    return specs.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def goal_prompt_check(prompts: DataFrame) -> DataFrame:
    """Add ``problems`` to goal prompts (``description``, ``success_metrics``, ``priority``).

    A description has at least 15 characters once trimmed, there is at least
    one metric and no name twice, and a priority, where given, is 1 to 10.
    """
    names = F.transform("success_metrics", lambda m: m["name"])
    many = F.coalesce(F.size("success_metrics"), F.lit(0))
    checks = [
        (F.coalesce(F.length(strip(F.col("description"))), F.lit(0)) < 15, "short description"),
        (many < 1, "no metric"),
        ((many > 0) & (F.size(F.array_distinct(names)) < many), "repeated metric"),
        (~F.col("priority").between(1, 10), "priority"),
    ]
    return prompts.withColumn(
        "problems", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    )


def coverage_rate(
    got: DataFrame, expected: DataFrame, key: str, by: Sequence[str] = ()
) -> DataFrame:
    """Share of the expected keys that were harvested, in percent."""
    have = got.select(key).distinct().withColumn("_got", F.lit(1))
    return (
        expected.select(key, *by)
        .distinct()
        .join(have, key, "left")
        .groupBy(*by)
        .agg(
            F.count("*").alias("expected"),
            F.count("_got").alias("got"),
            (F.lit(100.0) * F.count("_got") / F.count("*")).alias("coverage_rate"),
        )
    )


def missing_vs_index(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Rows of the official index that were not harvested."""
    return expected.join(got.select(key).distinct(), key, "left_anti")


def quality_scores(
    pages: DataFrame, key: str = "page_id", chunk: Callable[[Column], Column] = chunk_regex
) -> DataFrame:
    """Per page: words, share of repeated chunks, share of text inside links,
    and the mean of ``least(words/200, 1)``, ``1 - dup`` and ``1 - link``.

    Everything is known from the page's own row, so nothing is shuffled.
    """
    html = F.col("html")
    parts = H.page_parts(html)
    texts = explode_rows(pages, [key], F.array(parts), "_pos", "p").select(
        key,
        F.col("p.text").alias("text"),
        F.length("p.raw").alias("raw_chars"),
        F.length("p.links").alias("link_chars"),
    )
    counted = texts.select(
        key,
        F.size(words(F.col("text"))).alias("words"),
        F.transform(chunk(F.col("text")), lambda c: normalize_text(c)).alias("pieces"),
        "raw_chars",
        "link_chars",
    )
    shares = counted.select(
        key,
        "words",
        F.size("pieces").alias("chunks"),
        (1 - F.size(F.array_distinct("pieces")) / F.size("pieces")).alias("dup_share"),
        F.least(
            F.col("link_chars") / F.greatest(F.col("raw_chars"), F.lit(1)), F.lit(1.0)
        ).alias("link_share"),
    )
    return shares.withColumn(
        "score",
        (
            F.least(F.col("words") / 200, F.lit(1.0))
            + (1 - F.col("dup_share"))
            + (1 - F.col("link_share"))
        )
        / 3,
    )


def metric_by_period(
    facts: DataFrame, measure: str, by: Sequence[str] = ("area",), unit: str = "day"
) -> DataFrame:
    """Mean of the measure per period and area."""
    return (
        facts.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period"), *by)
        .agg(F.avg(measure).alias("mean_value"), F.count(measure).alias("n"))
    )


def metric_partials(
    facts: DataFrame, measure: str, by: Sequence[str] = ("area",), unit: str = "day"
) -> DataFrame:
    """``period``, ``by``, ``total`` and ``n`` of the measure: what ``metric_by_period`` needs of some facts,
    and can be added to that of others. Whole-number measures stay exact."""
    return facts.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period"), *by).agg(
        F.sum(measure).alias("total"), F.count(measure).alias("n")
    )


def means_of_partials(partials: DataFrame) -> DataFrame:
    """The rows of ``metric_by_period`` from added-up partials."""
    rest = [c for c in partials.columns if c not in ("total", "n")]
    return partials.select(*rest, (F.col("total") / F.col("n")).alias("mean_value"), "n")
