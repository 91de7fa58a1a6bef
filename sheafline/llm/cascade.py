"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a sample; rules then run in the order of
rejections per unit of cost, each only on what the ones before let through. A
text is kept if no rule rejects it, so the order never changes a verdict, only the work.

Statistics of a text are made when the first rule asks for them and shared by the
rules behind it.

Null and empty texts have no words and fail the base rule. Repeated rows get the same
verdict. No documents give no rows. Extra columns are never read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from sheafline.llm.common import keyed_texts, map_texts

SYMBOLS = "#*$%&|<>"
#: Texts on which cost and selectivity are measured.
SAMPLE_ROWS = 512


class Stats:
    """Figures of one text, each made on first use."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8").split()  # at \x20 and \x09-\x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        count = self.text.count
        return len(self.text) - sum(map(count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        covered, upto = 0, 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def capitals(self) -> int:
        return sum(map(str.isupper, self.text))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that has to go."""

    name: str
    rejects: Callable[[Stats], bool]


def base_failed(s: Stats) -> bool:
    return s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words


#: Shares are of words, of lines with a word or of letters, as named.
RULES = (
    Rule("base", base_failed),
    Rule("symbols", lambda s: 10 * s.n_symbols > 3 * s.n_words),
    Rule("short_words", lambda s: s.word_chars < 2 * s.n_words),
    Rule("long_words", lambda s: s.word_chars > 20 * s.n_words),
    Rule("repeated_lines", lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("capitals", lambda s: 2 * s.capitals > s.letters),
    Rule("letters", lambda s: 2 * s.letters < s.word_chars),
)


def cascade_order(sample: list[str], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second on ``sample``; those that reject nothing come last,
    cheapest first. Ties keep the given order."""
    rated = []
    for i, rule in enumerate(rules):
        took, rejected = 1e-9, 0
        for text in sample:
            stats = Stats(text)
            start = time.perf_counter()
            rejected += bool(rule.rejects(stats))
            took += time.perf_counter() - start
        rated.append((-rejected / took, took, i, rule))
    return [r[-1] for r in sorted(rated, key=lambda r: r[:3])]


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``rows`` whole texts. They decide the order of the rules, never a verdict."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return [r["text"] for r in texts.limit(rows).collect()]


def verdict(stats: Stats, ordered: list[Rule]) -> bool:
    """True if no rule rejects; stops at the first that does."""
    return not any(rule.rejects(stats) for rule in ordered)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``kept`` for each row, rules in measured order."""
    ordered = [r.name for r in cascade_order(sample_texts(docs), rules)]
    by_name = {r.name: r for r in rules}

    def run(texts: list[str]) -> dict[str, list]:
        order = [by_name[n] for n in ordered]
        return {"kept": [verdict(Stats(t), order) for t in texts]}

    return map_texts(keyed_texts(docs), run, "doc_id long, kept boolean", ["doc_id"])


def rule_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``apply_rules`` with the base figures of every text."""
    ordered = [r.name for r in cascade_order(sample_texts(docs), rules)]
    by_name = {r.name: r for r in rules}
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(texts: list[str]) -> dict[str, list]:
        order = [by_name[n] for n in ordered]
        out: dict[str, list] = {f: [] for f in (*figures, "base_failed", "kept")}
        for text in texts:
            stats = Stats(text)
            out["kept"].append(verdict(stats, order))
            out["base_failed"].append(base_failed(stats))
            for f in figures:
                out[f].append(getattr(stats, f))
        return out

    schema = ", ".join(
        ["doc_id long", *(f"{f} long" for f in figures), "base_failed boolean", "kept boolean"]
    )
    return map_texts(keyed_texts(docs), run, schema, ["doc_id"])
