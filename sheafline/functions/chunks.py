"""Chunking: text column in, array of chunk texts out. No shuffle."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import WS, let, words
from .tokens import fold

# Fixed value: the configured sentence pattern. Splits on blanks after . ? !
# but not after initials (A.B.) or two-letter titles (Mr.).
SENTENCE = r"(?<![A-Z]\.[A-Z]\.)(?<![A-Z][a-z]\.)(?<=[.?!])\s+"


def unicode_blanks(pattern: str) -> str:
    r"""The pattern with \s and \S over all blanks; the JVM's own know ASCII only."""

    def meant(m: re.Match) -> str:
        return {r"\s": WS, r"\S": "[^" + WS[1:]}.get(m[0], m[0])

    return re.sub(r"\\.", meant, pattern, flags=re.DOTALL)


def chunk_regex(text: Column, patterns: Sequence[str] = (SENTENCE,)) -> Column:
    """Apply each pattern in turn to every piece."""
    patterns = [unicode_blanks(p) for p in patterns]

    def split_each(pieces: Column, pattern: str) -> Column:
        return F.flatten(F.transform(pieces, lambda p: F.split(p, pattern)))

    if not patterns:
        return F.array(text)
    first, *rest = patterns
    return reduce(split_each, rest, F.split(text, first))


def _windows(text: Column, size: int, starts: Callable[[Column], Column]) -> Column:
    """Word windows at ``starts(n_words)``; a text that fits stays as it is."""

    def cut(tokens: Column) -> Column:
        n = F.size(tokens)
        return F.when(n <= size, F.array(text)).otherwise(
            F.transform(starts(n), lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), " "))
        )

    return let(words(text), cut)


def chunk_sliding(text: Column, window: int = 100, step: int = 50) -> Column:
    """Windows every ``step`` words, plus one over the last words."""
    return _windows(
        text,
        window,
        lambda n: F.array_distinct(
            F.concat(F.sequence(F.lit(0), n - window, F.lit(step)), F.array(n - window))
        ),
    )


def chunk_fixed(text: Column, size: int = 100) -> Column:
    """Disjoint blocks of ``size`` words; no words, no blocks."""
    return let(
        words(text),
        lambda tokens: F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.size(tokens), F.lit(size)),
                lambda s: F.array_join(F.slice(tokens, s, F.lit(size)), " "),
            )
        ),
    )


def chunk_overlap(text: Column, window: int = 1000, overlap: int = 100) -> Column:
    """Windows sharing ``overlap`` words; the first to reach the end is last."""
    step = window - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")
    return _windows(
        text,
        window,
        lambda n: F.sequence(
            F.lit(0), (F.ceil((n - window) / F.lit(step)) * step).cast("int"), F.lit(step)
        ),
    )


def chunk_token_window(text: Column, threshold: int = 2000, overlap_rate: float = 0.1) -> Column:
    """Windows for model input, overlapping by a share of their size."""
    return chunk_overlap(text, threshold, math.floor(threshold * overlap_rate))


#: Words whose full stop does not end a sentence, by language.
ABBREVIATIONS = {
    "en": ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "no"),
    "de": ("dr", "prof", "nr", "bzw", "usw", "ca", "vgl", "str"),
    "fr": ("m", "mm", "mme", "dr", "etc", "av"),
    "es": ("sr", "sra", "dr", "dra", "etc", "av"),
}

def _sentence_pattern(short: Sequence[str]) -> str:
    """Blanks behind a sentence end that is not a short word's full stop."""
    words_ = "".join(rf"(?<!(?i:(?<![\p{{L}}]){w}\.))" for w in short)
    return rf"(?<=[.!?\u2026\u3002\uFF01\uFF1F][\"'\u201D\u2019\u00BB)\]]{{0,3}}){words_}{WS}+"


def chunk_sentences(
    text: Column, lang: Column | None = None, short: Column | None = None
) -> Column:
    """Sentences with their punctuation, split at the blanks behind . ! ? … and their
    full-width forms, with closing quotes and brackets.

    A full stop behind one of the words ``short`` (folded, without their stop) does not count; see
    ``operators.sentences`` for those of a corpus. Without them those of the language's
    ``ABBREVIATIONS`` do not; without a language, or with one that has no list, those of none do.
    """
    plain = _sentence_pattern(())
    if short is not None:
        return let(short, lambda s: _joined_at(text, plain, s))
    if lang is None:
        return F.split(text, plain)
    out = F.split(text, plain)
    for name, listed in ABBREVIATIONS.items():
        out = F.when(lang == name, F.split(text, _sentence_pattern(listed))).otherwise(out)
    return out


def _joined_at(text: Column, pattern: str, short: Column) -> Column:
    """Pieces between the matches of ``pattern``, joined again by the blanks there where a piece
    ends in one of ``short``."""

    def goes_on(piece: Column) -> Column:
        tail = F.substring_index(piece, " ", -1)  # so that the pattern runs over few characters
        last = F.regexp_extract(tail, rf"([^{WS[1:]}+)\.$", 1)
        last = fold(F.regexp_replace(last, r"^[\p{P}\p{S}]+", ""))
        return piece.endswith(".") & F.array_contains(short, F.regexp_replace(last, r"\.+$", ""))

    def with_blanks(pieces: Column, blanks: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.size(pieces)),
            lambda i: (i == F.size(pieces)) | ~goes_on(F.get(pieces, i - 1)),
        )

        def sentence(e: Column, end: Column, at: Column) -> Column:
            first = F.coalesce(F.get(e, at - 1), F.lit(0))
            some = F.sequence(first, end - 1)
            parts = F.transform(
                some,
                lambda i: F.concat(F.get(pieces, i), F.when(i < end - 1, F.get(blanks, i)).otherwise("")),
            )
            return F.array_join(parts, "")

        return let(ends, lambda e: F.transform(e, lambda end, at: sentence(e, end, at)))

    blanks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.split(text, pattern), lambda p: let(blanks, lambda b: with_blanks(p, b)))


def _square(sorted_words: Column) -> Column:
    """Sum of squared word counts of a sorted word array: the nth of equal
    words adds 2n - 1."""
    start = F.struct(
        F.lit("").alias("word"), F.lit(0).alias("nth"), F.lit(0).cast("bigint").alias("total")
    )

    def step(seen: Column, w: Column) -> Column:
        nth = F.when(w == seen["word"], seen["nth"] + 1).otherwise(F.lit(1))
        return F.struct(
            w.alias("word"), nth.alias("nth"), (seen["total"] + 2 * nth - 1).alias("total")
        )

    return F.aggregate(sorted_words, start, step, lambda s: s["total"])


def _common(a: Column, b: Column) -> Column:
    """Product of the word counts of two word arrays, summed over the words: one walk
    over both, sorted together."""

    def tagged(words: Column, side: int) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))

    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit("").alias("w"), zero.alias("a"), zero.alias("b"), zero.alias("total")
    )

    def step(seen: Column, x: Column) -> Column:
        same = x["w"] == seen["w"]
        left = F.when(same, seen["a"]).otherwise(zero) + F.when(x["side"] == 0, 1).otherwise(0)
        right = F.when(same, seen["b"]).otherwise(zero) + F.when(x["side"] == 1, 1).otherwise(0)
        # all of a word's left ones come first, so each right one meets every left one
        met = F.when(x["side"] == 1, F.when(same, seen["a"]).otherwise(zero)).otherwise(zero)
        return F.struct(
            x["w"].alias("w"), left.alias("a"), right.alias("b"), (seen["total"] + met).alias("total")
        )

    both = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    return F.aggregate(both, start, step, lambda s: s["total"])


def _cuts(sentences: Column, block: int) -> Column:
    """Sentence positions where a new segment starts, without the first."""

    def blocks_of(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(block)),
            lambda i: F.sort_array(
                words(F.lower(F.array_join(F.slice(s, i + 1, F.lit(block)), " ")))
            ),
        )

    def gaps_of(blocks: Column) -> Column:
        weighed = F.transform(
            blocks, lambda b: F.struct(b.alias("w"), _square(b).alias("norm"))
        )

        def between(b: Column) -> Column:
            gaps = F.transform(
                F.slice(b, 1, F.size(b) - 1),
                lambda left, i: let(
                    F.get(b, i + 1),
                    lambda right: F.struct(
                        i.alias("gap"),
                        F.when(
                            (left["norm"] > 0) & (right["norm"] > 0),
                            _common(left["w"], right["w"])
                            / F.sqrt(left["norm"] * right["norm"]),
                        ).alias("cos"),
                    ),
                ),
            )
            return F.filter(gaps, lambda g: g["cos"].isNotNull())

        return F.when(F.size(blocks) > 1, let(weighed, between))

    def lows(g: Column) -> Column:
        low = F.filter(
            g,
            lambda x, i: (x["cos"] < F.get(g, i - 1)["cos"]) & (x["cos"] < F.get(g, i + 1)["cos"]),
        )
        return F.transform(low, lambda x: (x["gap"] + 1) * block)

    found = let(let(blocks_of(sentences), gaps_of), lows)
    return F.coalesce(found, F.array().cast("array<int>"))


def topic_segments(text: Column, block: int = 3) -> Column:
    """Runs of sentences about one topic, as {sentences, chunk} (Hearst 1997).

    Blocks of ``block`` sentences are compared with the next block by the
    cosine of their word counts; a gap less similar than both its neighbours
    starts a new segment. Only neighbouring blocks of one text are compared,
    so all of it happens inside the text's row and nothing is shuffled.
    """

    def segments(s: Column) -> Column:
        def bounded(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda start, i: let(
                    F.coalesce(F.get(starts, i + 1), F.size(s)) - start,
                    lambda n: F.struct(
                        n.alias("sentences"),
                        F.array_join(F.slice(s, start + 1, n), " ").alias("chunk"),
                    ),
                ),
            )

        return let(F.concat(F.array(F.lit(0)), _cuts(s, block)), bounded)

    return let(chunk_regex(text), segments)


def chunk_topics(text: Column, block: int = 3) -> Column:
    """The texts of ``topic_segments``."""
    return F.transform(topic_segments(text, block), lambda c: c["chunk"])


# The configured names of the strategies.
CHUNKERS = {
    "sliding": chunk_sliding,
    "fixed": chunk_fixed,
    "regex": chunk_regex,
    "nlp_sentence": chunk_sentences,
    "topic_segmentation": chunk_topics,
    "overlapping_window": chunk_overlap,
    "token_window": chunk_token_window,
}


def chunker(strategy: str = "sliding", **params) -> Callable[[Column], Column]:
    """A chunking strategy by its configured name."""
    if strategy not in CHUNKERS:
        raise ValueError(f"no chunking strategy is called {strategy!r}; there are {sorted(CHUNKERS)}")
    return lambda text: CHUNKERS[strategy](text, **params)
