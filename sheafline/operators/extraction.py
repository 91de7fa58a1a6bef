"""Labelled extraction, grounding, and the pivot into records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheafline.functions.text import let, words
from sheafline.functions.tokens import bare_words, fold, grams, plain_words, word_starts
from sheafline.operators.rows import explode_rows, maybe_among


def to_extraction_struct(pairs: Column) -> Column:
    """``{label, value}`` pairs as ``{extraction_class, extraction_text}``."""
    return F.transform(
        pairs,
        lambda e: F.struct(
            e["label"].alias("extraction_class"), e["value"].alias("extraction_text")
        ),
    )


@dataclass(frozen=True)
class LabelPattern:
    """A label's regular expression, and a literal that every match contains:
    texts without the literal are not searched."""

    regex: str
    needs: str | None = None


def _found(text: Column, pattern: str | LabelPattern) -> Column:
    """{start, value} of every match, in order. Starts are the lengths of the
    pieces between matches and of the matches before, so they are the matches' own."""
    if isinstance(pattern, str):
        pattern = LabelPattern(pattern)
    values = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    pieces = F.split(text, pattern.regex, -1)

    def placed(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, i))
            value = F.get(v, i)
            return F.struct(
                (start + F.length(value)).alias("at"),
                F.concat(
                    acc["out"], F.array(F.struct(start.alias("start"), value.alias("value")))
                ).alias("out"),
            )

        begin = F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,value:string>>").alias("out"),
        )
        indices = F.sequence(F.lit(0), F.size(v) - 1)
        return F.when(F.size(v) > 0, F.aggregate(indices, begin, step, lambda acc: acc["out"]))

    found = let(values, placed)
    return found if pattern.needs is None else F.when(text.contains(pattern.needs), found)


def extract_labels(
    chunks: DataFrame,
    patterns: Mapping[str, str | LabelPattern],
    keep: Sequence[str],
    text: str = "text",
) -> DataFrame:
    """Every match of each label's pattern: one row per match, with ``nth``
    counting a label's matches inside its text and ``start`` (0-based) its place.

    Patterns are configuration, so they enter the plan as literals and each is
    compiled once; only matching texts produce rows.
    """
    per_label = F.array(
        *[
            F.struct(
                F.lit(label).alias("extraction_class"),
                _found(F.col(text), pattern).alias("found"),
            )
            for label, pattern in patterns.items()
        ]
    )
    labelled = chunks.select(*keep, text, F.explode(per_label).alias("e"))
    rows = explode_rows(
        labelled,
        [*keep, text, F.col("e.extraction_class").alias("extraction_class")],
        F.col("e.found"),
        "nth",
        "_e",
    )
    return rows.withColumns(
        {"extraction_text": F.col("_e.value"), "start": F.col("_e.start")}
    ).drop("_e")


def term_words(text: Column) -> Column:
    """Case-folded words without the punctuation around them."""
    return bare_words(text)


def example_terms(examples: DataFrame) -> DataFrame:
    """The ``label``, ``value`` list that example rows (``extractions``) spell out, for
    ``extract_terms``: extraction steered by examples."""
    pair = F.explode("extractions").alias("e")
    rows = examples.select(pair).select(
        F.col("e.label").alias("label"), F.col("e.value").alias("value")
    )
    return rows.filter(F.size(term_words(F.col("value"))) > 0).distinct()


def extract_terms(
    chunks: DataFrame,
    terms: DataFrame,
    keep: Sequence[str],
    text: str = "text",
    places: bool = False,
) -> DataFrame:
    """Word sequences of the text listed in ``terms`` (``label``, ``value``).

    Gives ``keep``, ``extraction_class`` and ``extraction_text`` (the term as it is compared), once for
    each text; with ``places`` a row for each place, with its ``start`` and ``end`` (code points, end
    exclusive). Case and the punctuation around words do not count. Sequences are as long as the
    list's own, which its values tell while the query runs, so no listed term is too long.

    The list can be of any size: a bitmap of its hashes, of fixed size, stops sequences
    in no list before anything is shuffled; the others meet the list by an equi-join.
    """
    listed = terms.select(
        F.col("label").alias("extraction_class"), term_words(F.col("value")).alias("w")
    ).filter(F.size("w") > 0)
    sizes = listed.agg(F.sort_array(F.collect_set(F.size("w"))).alias("n"))  # few lengths
    # each step is a projection of its own, so that nothing is made twice
    tokens = chunks.select(*keep, F.col(text).alias("_text"), sizes.scalar().alias("_sizes"))
    if places:
        tokens = tokens.withColumns({"_w": plain_words(F.col("_text")), "_at": word_starts(F.col("_text"))})
        tokens = tokens.withColumn("_joined", fold(F.array_join("_w", " ")))
    else:
        tokens = tokens.withColumn("_joined", F.array_join(term_words(F.col("_text")), " "))
    more = ["_w", "_at"] if places else []
    tokens = tokens.select(*keep, *more, "_joined", F.explode("_sizes").alias("_n"))
    seen = grams(F.col("_joined"), F.col("_n"))
    # repeats inside a text are folded
    tokens = tokens.withColumn("_seen", seen if places else F.array_distinct(seen))
    values = listed.select(
        "extraction_class", F.array_join("w", " ").alias("extraction_text")
    ).distinct()
    last = F.col("_pos") + F.col("_n") - 1
    end = F.get("_at", last) + F.length(F.get("_w", last))
    place = {"start": F.get("_at", F.col("_pos")), "end": end} if places else {}
    rows = explode_rows(tokens, [*keep, *more, "_n"], F.col("_seen"), "_pos", "extraction_text").select(
        *keep, "extraction_text", *[c.alias(name) for name, c in place.items()]
    )
    return maybe_among(rows, ["extraction_text"], values).join(values, "extraction_text").select(
        *keep, "extraction_class", "extraction_text", *place
    )


def ground_spans(extractions: DataFrame, text: str = "text") -> DataFrame:
    """Add ``start`` (0-based) and ``end``; null where the text lacks the value.

    A ``start`` from the extraction counts if the value stands there, so each
    of several equal values keeps its own place; else the first place counts.
    """
    value = F.col("extraction_text")
    found = F.nullif(F.instr(F.col(text), value), F.lit(0)) - 1
    if "start" in extractions.columns:
        own = F.col("start")
        found = F.when(F.substring(text, own + 1, F.length(value)) == value, own).otherwise(found)
    return extractions.withColumn("start", found).withColumn(
        "end", F.col("start") + F.length("extraction_text")
    )


def example_check(
    examples: DataFrame, labels: Column, low: int = 40, high: int = 80
) -> DataFrame:
    """Add ``problems`` to few-shot examples (``text``, ``extractions``).

    Labels must equal the request in order and number, every value must stand
    in the text, the text must have 40-80 words and no string a line break.
    """
    pairs = F.col("extractions")
    got = F.transform(pairs, lambda e: e["label"])
    values = F.transform(pairs, lambda e: e["value"])
    size = F.size(words(F.col("text")))
    breaks = F.col("text").rlike(r"[\r\n]") | F.exists(values, lambda v: v.rlike(r"[\r\n]"))
    checks = [
        (F.size(F.array_except(got, labels)) > 0, "extra label"),
        (F.size(F.array_except(labels, got)) > 0, "missing label"),
        (F.size(F.array_distinct(got)) < F.size(got), "repeated label"),
        (got != labels, "label order"),
        (F.exists(values, lambda v: ~F.contains(F.col("text"), v)), "ungrounded value"),
        (~size.between(low, high), "length"),
        (breaks, "line break"),
    ]
    return examples.withColumn(
        "problems", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    )


def pivot_records(
    extractions: DataFrame,
    features: Sequence[str],
    key: str | Sequence[str],
    position: Sequence[str] = ("start",),
) -> DataFrame:
    """One row per document with a column per feature: the label's first value
    by position. The feature list is given, so no pass finds the columns."""
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(*[F.col(p) for p in position])
    return extractions.groupBy(*keys).agg(
        *[
            F.min_by(
                "extraction_text", F.when(F.col("extraction_class") == name, order)
            ).alias(name)
            for name in features
        ]
    )


@dataclass(frozen=True)
class Extractor:
    """A user's own extraction function.

    ``fn(batch, state)`` maps a pandas batch to a pandas batch of ``schema``;
    ``setup()`` builds ``state`` once per worker process, before its first batch,
    and the process keeps it for later tasks of the same extractor.
    ``pre`` and ``post`` are column expressions applied around it, and a plain
    pair of hooks without ``fn`` is allowed.
    """

    name: str
    fn: Callable[[pd.DataFrame, Any], pd.DataFrame] | None = None
    schema: T.StructType | str | None = None
    pre: Mapping[str, Column] = field(default_factory=dict)
    post: Mapping[str, Column] = field(default_factory=dict)
    setup: Callable[[], Any] | None = None


_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(extractor: Extractor) -> Extractor:
    """Keep an extractor under its name; it needs a function or a post hook."""
    if extractor.fn is None and not extractor.post:
        raise ValueError("an extractor needs a function or a post hook")
    if extractor.fn is not None and extractor.schema is None:
        raise ValueError("an extractor function needs an output schema")
    _EXTRACTORS[extractor.name] = extractor
    return extractor


def apply_extractor(df: DataFrame, extractor: Extractor | str) -> DataFrame:
    """Run an extractor over all rows, batch by batch in the tasks."""
    if isinstance(extractor, str):
        if extractor not in _EXTRACTORS:
            raise KeyError(f"Extractor '{extractor}' is not registered")
        extractor = _EXTRACTORS[extractor]
    if extractor.pre:
        df = df.withColumns(dict(extractor.pre))
    if extractor.fn is not None:
        fn, setup, token = extractor.fn, extractor.setup, uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import builtins  # the one module that every task of a process shares

            states = builtins.__dict__.setdefault("_extractor_states", {})
            if setup and token not in states:
                states.clear()  # a process keeps the state of one extractor
                states[token] = setup()
            state = states.get(token)
            for batch in batches:
                yield fn(batch, state)

        df = df.mapInPandas(run, extractor.schema)
    if extractor.post:
        df = df.withColumns(dict(extractor.post))
    return df
