"""Words of a text without the marks around them, folded or with their places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sheafline.functions.text import let

#: Punctuation and symbols, which at the ends of a word do not belong to it.
_MARK = r"[\p{P}\p{S}]"
#: What is neither a blank (``WS``, which holds all of \p{Z}) nor a mark; letters are told first.
_PLAIN = r"[\p{L}\p{N}\p{M}[\p{C}&&[^\x09-\x0D\x1C-\x1F\x85]]]"
#: A word from its first character that is no such mark to its last one; nothing is tried twice.
BARE = rf"{_PLAIN}++(?:{_MARK}++{_PLAIN}++)*+"
#: Words whose lengths are summed in one go when places are found.
STRIDE = 32


def fold(text: Column) -> Column:
    """Case folded, so that texts that agree in upper case agree (``ß`` and ``SS``)."""
    # Catalyst takes lower(upper(x)) for lower(x); the empty string keeps it from that
    return F.lower(F.concat(F.upper(text), F.lit("")))


def plain_words(text: Column) -> Column:
    """Words without the marks around them, as they stand; words of marks only are left out."""
    return F.regexp_extract_all(text, F.lit(BARE), F.lit(0))


def bare_words(text: Column) -> Column:
    """Folded words without the marks around them; words of marks only are left out."""
    return plain_words(fold(text))


def grams(joined: Column, n: Column) -> Column:
    """All sequences of n words, in order, of words joined by one blank each."""
    # a match is one word; the sequence from there on is looked at ahead
    ahead = F.concat(F.lit("(?=([^ ]++"), F.repeat(F.lit(" [^ ]++"), n - 1), F.lit("))[^ ]++ ?"))
    return F.regexp_extract_all(joined, ahead, F.lit(1))


def shape(word: Column) -> Column:
    """Runs of capitals as A, of other letters as a, of digits as 9; the rest as it stands."""
    out = F.regexp_replace(word, r"\p{N}+", "9")
    out = F.regexp_replace(out, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")
    return F.regexp_replace(out, r"\p{Lu}+", "A")


def form(word: Column) -> Column:
    """``shape`` with a letter for each character of a run, so that lengths count."""
    out = F.regexp_replace(word, r"\p{N}", "9")
    out = F.regexp_replace(out, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]", "a")
    return F.regexp_replace(out, r"\p{Lu}", "A")


def _starts(sizes: Column) -> Column:
    """Sums of the elements before each one. Strides are summed first, so that the cost grows with
    the number of elements."""

    def sums(x: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            x,
            begin,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def strides(x: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(STRIDE))
        parts = F.transform(steps, lambda s: F.slice(x, s + 1, F.lit(STRIDE)))
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n))
        based = lambda b: F.flatten(F.zip_with(parts, b, sums))
        return let(sums(totals, F.lit(0)), based)

    return let(sizes, strides)


def word_starts(text: Column) -> Column:
    """Where each of ``plain_words`` begins, in code points."""

    def within(found: Column, gaps: Column) -> Column:
        before = F.slice(gaps, 1, F.size(found))
        sizes = F.zip_with(before, found, lambda g, w: F.length(g) + F.length(w))
        return F.zip_with(_starts(sizes), before, lambda at, g: at + F.length(g))

    gaps = F.split(text, BARE, -1)
    return let(gaps, lambda g: let(plain_words(text), lambda found: within(found, g)))


def placed_words(text: Column) -> Column:
    """{word, start, end} of ``plain_words``, in code points (end exclusive)."""

    def ends(w: Column, at: Column) -> Column:
        return F.struct(w.alias("word"), at.alias("start"), (at + F.length(w)).alias("end"))

    return F.zip_with(plain_words(text), word_starts(text), ends)
