"""Patterns of labelled values, learned from example rows.

An example is a text and the values in it that carry a label. Around each place of a value stand
the word before it, the words' own shapes (runs of capitals, letters and digits) or forms (the same with
the lengths of the runs), and the word behind it. These are generalised into patterns of the kinds in ``KINDS``, from narrow to wide. A pattern's
support is the number of places with its label that it matches, its precision their share among
all places in the example texts that it matches. Patterns of enough support and precision are kept, but
for those that a wider one with the same label covers.

Sequences are of the lengths that the examples' values have. A sequence leaves its text's row only if a bitmap
of the patterns lets it through; counting and matching are equi-joins behind that. Words are
blank-separated, without the marks at their ends; context is compared case-folded, and values of examples
are found in their text by folded words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sheafline.functions.tokens import bare_words, fold, form, grams, plain_words, shape, word_starts
from sheafline.operators.rows import explode_rows, maybe_among
from sheafline.session import cut

#: What a pattern fixes: the word before, the shapes of the value's words, the word behind.
KINDS = {
    "both": (True, True, True),
    "left": (True, True, False),
    "right": (False, True, True),
    "slot": (True, False, True),
    "shape": (False, True, False),
    "form": (False, True, False),
}
#: Kinds that match whatever the key matches.
WIDER = {"both": ("left", "right", "slot", "shape"), "left": ("shape",), "right": ("shape",), "form": ("shape",)}
KEY = ["kind", "left", "shape", "right", "n"]
#: Stand for the word before the first and behind the last.
BEGIN, END = "^", "$"


def _sequences(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``at`` {start, end, value, folded, left, shape, form, right, n} of all sequences of
    ``_sizes`` words of ``_text``."""
    # each step is a projection of its own, so that nothing is made twice; folding and shapes change
    # no blank, so they are made of a text's words together
    rows = rows.select(
        *keep, "_sizes", plain_words(F.col("_text")).alias("_w"), word_starts(F.col("_text")).alias("_at")
    )
    rows = rows.withColumn("_joined", F.array_join("_w", " "))
    made = {"value": F.col("_joined"), "folded": fold("_joined"), "shape": shape("_joined"), "form": form("_joined")}
    rows = rows.select(
        *keep, "_w", "_at", *[c.alias(name) for name, c in made.items()], F.explode("_sizes").alias("_n")
    )
    rows = rows.select(
        *keep, "_w", "_at", "_n", F.split("folded", " ").alias("_context"),
        *[grams(F.col(name), F.col("_n")).alias(f"_{name}") for name in made],
    )
    beside = ["_w", "_at", "_n", "_context", *[f"_{name}" for name in made]]
    rows = explode_rows(rows, [*keep, *beside], F.col("_value"), "_i", "value")
    i, n, last = F.col("_i"), F.col("_n"), F.col("_i") + F.col("_n") - 1
    at = F.struct(
        F.get("_at", i).alias("start"),
        (F.get("_at", last) + F.length(F.get("_w", last))).alias("end"),
        "value",
        F.get("_folded", i).alias("folded"),
        F.coalesce(F.get("_context", i - 1), F.lit(BEGIN)).alias("left"),
        F.get("_shape", i).alias("shape"),
        F.get("_form", i).alias("form"),
        F.coalesce(F.get("_context", i + n), F.lit(END)).alias("right"),
        n.alias("n"),
    )
    return rows.select(*keep, at.alias("at"))


def _patterns(at: Column) -> Column:
    """The patterns of all kinds that fit a sequence."""
    return F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                *[
                    (at["form" if (kind, name) == ("form", "shape") else name] if used else F.lit("")).alias(name)
                    for name, used in zip(("left", "shape", "right"), uses)
                ],
                at["n"].alias("n"),
            )
            for kind, uses in KINDS.items()
        ]
    )


def _labelled(examples: DataFrame) -> DataFrame:
    """``_text``, ``_pairs`` ({label, folded value}) and ``_sizes`` (lengths of all values) of examples."""
    pairs = F.transform(
        "extractions",
        lambda e: F.struct(e["label"].alias("label"), F.array_join(bare_words(e["value"]), " ").alias("folded")),
    )
    rows = examples.select(
        F.col("text").alias("_text"), F.filter(pairs, lambda p: p["folded"] != "").alias("_pairs")
    )
    size = F.size(F.split("p.folded", " "))
    sizes = rows.select(F.explode("_pairs").alias("p")).agg(F.sort_array(F.collect_set(size)).alias("n"))
    return rows.withColumn("_sizes", sizes.scalar())  # few lengths


def induce_patterns(
    examples: DataFrame, support: int = 3, precision: float = 0.9
) -> DataFrame:
    """``label``, the pattern (``KEY``), ``support``, ``total`` (places it matches) and ``precision``,
    learned from ``examples`` (``text``, ``extractions`` with ``label`` and ``value``)."""
    rows = _labelled(examples)
    labels = lambda at: F.array_distinct(
        F.transform(F.filter("_pairs", lambda p: p["folded"] == at["folded"]), lambda p: p["label"])
    )
    places = _sequences(rows, ["_pairs"])
    marked = _sequences(rows.filter(F.size("_pairs") > 0), ["_pairs"])
    marked = marked.select(F.explode(labels(F.col("at"))).alias("label"), "at")
    found = marked.select("label", F.inline(_patterns(F.col("at")))).groupBy("label", *KEY)
    found = cut(found.agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support))
    met = places.select(F.inline(_patterns(F.col("at"))))
    total = (
        maybe_among(met, KEY, found.select(KEY))
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("total"))
    )
    kept = cut(
        found.join(total, KEY)
        .withColumn("precision", F.col("support") / F.col("total"))
        .filter(F.col("precision") >= precision)
    )
    wider = F.create_map(*[x for k, w in WIDER.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    uses = {name: F.create_map(*[x for k, u in KINDS.items() for x in (F.lit(k), F.lit(u[i]))])
            for i, name in enumerate(("left", "shape", "right"))}
    covers = kept.select("label", *KEY)
    narrow = kept.select("label", *[F.col(k).alias(f"_{k}") for k in KEY], F.explode(wider[F.col("kind")]).alias("kind"))
    narrow = narrow.select(
        "label", *[f"_{k}" for k in KEY], "kind",
        *[
            # the shape of a form is that of its words
            F.when(uses[name][F.col("kind")], shape(F.col("_shape")) if name == "shape" else F.col(f"_{name}"))
            .otherwise("").alias(name)
            for name in uses
        ],
        F.col("_n").alias("n"),
    )
    covered = narrow.join(covers, ["label", *KEY]).select("label", *[F.col(f"_{k}").alias(k) for k in KEY]).distinct()
    return kept.join(covered, ["label", *KEY], "left_anti").select(
        "label", *KEY, "support", "total", "precision"
    )


def extract_by_patterns(
    chunks: DataFrame, patterns: DataFrame, keep: Sequence[str], text: str = "text"
) -> DataFrame:
    """Sequences that a pattern of ``induce_patterns`` matches: ``keep``, ``extraction_class``,
    ``extraction_text`` (its words, joined by blanks), ``start``, ``end`` (code points, end exclusive) and
    the best ``precision``."""
    sizes = patterns.agg(F.sort_array(F.collect_set("n")).alias("n"))  # few lengths
    rows = chunks.select(*keep, F.col(text).alias("_text"), sizes.scalar().alias("_sizes"))
    places = _sequences(rows, keep)
    fits = places.select(
        *keep, F.col("at.value").alias("extraction_text"), "at.start", "at.end", F.inline(_patterns(F.col("at")))
    )
    listed = patterns.select(F.col("label").alias("extraction_class"), *KEY, "precision")
    return (
        maybe_among(fits, KEY, listed.select(KEY))
        .join(listed, KEY)
        .groupBy(*keep, "extraction_class", "extraction_text", "start", "end")
        .agg(F.max("precision").alias("precision"))
    )
