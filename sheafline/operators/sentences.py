"""Abbreviations learned from a corpus, and sentences that do not end at them.

A word is an abbreviation if its full stop belongs to it: it hardly ever stands without one. For
each language and word (type) the full stops behind it are counted on Spark, and the decision is made
per type (Kiss and Strunk 2006): the likelihood ratio of "a stop nearly always follows" against "a stop follows
as often as behind any word", weakened for long words and for each place without a stop, and
strengthened by stops inside. Nothing is known beforehand about a language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sheafline.functions.chunks import chunk_sentences
from sheafline.functions.text import words
from sheafline.functions.tokens import fold

#: Share of places with a full stop that an abbreviation is taken to have.
ALWAYS = 0.99
#: Least score of an abbreviation.
SCORE = 0.3
#: Stands for a missing language.
NO_LANG = ""


def stop_word(word: Column) -> Column:
    """A blank-separated word, folded, without the marks before it, and those behind it except full stops."""
    bare = F.regexp_replace(word, r"^[\p{P}\p{S}]+|(?:[^\P{P}.]|\p{S})+$", "")
    return fold(bare)


def type_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``word``, ``with_stop`` and ``without``: how often each word of letters stands before
    a full stop, and how often not."""
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.explode(words(F.col(text))).alias("w")
    ).withColumn("w", stop_word(F.col("w")))
    stop = F.col("w").endswith(".")
    kept = rows.select("lang", stop.alias("stop"), F.regexp_replace("w", r"\.+$", "").alias("word"))
    # letters and inner stops only
    kept = kept.filter(F.col("word").rlike(r"^[\p{L}.]*\p{L}$"))
    return kept.groupBy("lang", "word").agg(
        F.sum(F.col("stop").cast("long")).alias("with_stop"), F.sum((~F.col("stop")).cast("long")).alias("without")
    )


def learn_abbreviations(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``word``, ``with_stop``, ``without`` and ``score`` of the abbreviations of each language;
    rows without a language count as one of their own (``NO_LANG``)."""
    counts = type_counts(docs, text, lang)
    # one row for each language
    whole = counts.groupBy("lang").agg(
        F.sum("with_stop").alias("_stops"), F.sum(F.col("with_stop") + F.col("without")).alias("_all")
    )
    k, n = F.col("with_stop"), F.col("with_stop") + F.col("without")
    share = F.col("_stops") / F.col("_all")
    usual = k * F.log(share) + (n - k) * F.log(1 - share)
    always = k * math.log(ALWAYS) + (n - k) * math.log(1 - ALWAYS)
    letters = F.length(F.replace("word", F.lit(".")))
    inner = F.length("word") - letters
    weight = F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("without"))
    scored = (
        counts.filter("with_stop > 0")
        .join(whole, "lang")
        # where every word has a stop, it tells nothing
        .filter("_stops < _all")
        .withColumn("score", 2 * (always - usual) * weight)
    )
    return scored.filter(F.col("score") >= SCORE).select("lang", "word", "with_stop", "without", "score")


def abbreviation_lists(learned: DataFrame) -> DataFrame:
    """``lang`` and ``abbreviations``, a row for each language."""
    return learned.groupBy("lang").agg(F.sort_array(F.collect_set("word")).alias("abbreviations"))


def split_sentences(docs: DataFrame, learned: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``sentences`` to each row: ``chunk_sentences`` with the abbreviations of its language, none if
    the language has none."""
    lists = abbreviation_lists(learned).withColumnRenamed("lang", "_lang")
    own = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG))
    short = F.coalesce("abbreviations", F.array().cast("array<string>"))
    # a row for each language; the texts stay where they are, and no language's come together
    joined = docs.withColumn("_lang", own).join(F.broadcast(lists), "_lang", "left")
    return joined.withColumn("sentences", chunk_sentences(F.col(text), short=short)).select(*docs.columns, "sentences")
