"""Repeated passages, found as sliding spans of sentences.

A text is cut into sentences, at sentence ends and line breaks, and each of these again behind
pairs of words whose hash meets a condition, or after ``UNIT_WORDS`` words; the parts count as
sentences. Such cuts depend on the words there only, so a passage is cut alike wherever it
stands in a sentence. Letters of scripts without blanks are words of their own. From every sentence on, the shortest run of at
least ``MIN_UNITS`` sentences and ``MIN_WORDS`` words is a span; its 128-bit hash is made of its words'
hashes, from running sums over the text, so it ignores how blanks are written. Equal spans are joined over
the whole corpus. All but the first in the order (doc_id, place) are repeated, and sentences that any of
these covers are removed.

First only one half of the hashes is shuffled and counted. Spans whose half occurs once are kept out
of the join by a bitmap of fixed size; the others are made again and stored with their places, from which
the first place of each is found, folded within the tasks, and joined. A span's end follows from its text, so only
its first sentence is sent.

Null texts count as empty and keep nothing. A null doc_id sorts last; rows with equal
ids are ordered as they are stored. No documents give no rows. Extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.common import cut, keyed_texts, scratch_path, slices
from sheafline.operators.rows import maybe_among

UNIT_WORDS = 20
MIN_UNITS = 2
MIN_WORDS = 30
#: Bits of the filter for repeated hashes: 16 MB at most.
FILTER_BITS = 1 << 27
_SENTENCE = re.compile(r"[^\n]+")
#: Behind one in so many pairs of words a sentence is cut.
CUT = 4
MEMO_WORDS = 200_000
_STOP = re.compile(r"[.!?。！？]+[\"')\]]*(?=\s|\Z)|[。！？]+[\"')\]」』”’）]*")
#: Scripts that are written without blanks.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_DENSE}]|[^\\s{_DENSE}]+")
#: In texts without these, words are what stands between blanks and sentences end with one.
_WIDE = re.compile(f"[{_DENSE}。！？]")
_LAST = re.compile(r"[.!?]+[\"')\]]*\Z")
_ENDS = frozenset(".!?\"')]")
#: No character above this is a blank.
_BLANKS = np.array([chr(i).isspace() for i in range(0x3002)])
_KNOWN: dict[str, int] = {}


def _code(word: str) -> int:
    code = _KNOWN.get(word)
    if code is None:
        if len(_KNOWN) > MEMO_WORDS:
            _KNOWN.clear()
        code = _KNOWN[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return code


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each part of a sentence; between them there are only blanks."""
    out = []
    for line in _SENTENCE.finditer(text):
        at, stop = line.start(), line.end()
        ends = [m.end() for m in _STOP.finditer(text, at, stop)]
        if not ends or ends[-1] < stop:
            ends.append(stop)
        for end in ends:
            part: list[str] = []
            before = start = stop_ = 0
            for m in _WORD.finditer(text, at, end):
                if not part:
                    start = m.start()
                part.append(m[0])
                stop_ = m.end()
                code = _code(m[0])
                # the high bits of a product, which depend on both words
                if len(part) == UNIT_WORDS or ((before * 31 + code) * 2654435761 >> 20 & 0xFFF) % CUT == 0:
                    out.append((start, stop_, part))
                    part = []
                before = code
            if part:
                out.append((start, stop_, part))
            at = end
    return out


def runs(cut_up: list[tuple[int, int, list[str]]]) -> list[tuple[int, int]]:
    """(first, last + 1) of the shortest span from each sentence on that is long enough."""
    many = [0]
    for _, _, words in cut_up:
        many.append(many[-1] + len(words))
    out, end, n = [], 0, len(cut_up)
    for first in range(n):
        end = max(end, first + MIN_UNITS)
        while end <= n and many[end] - many[first] < MIN_WORDS:
            end += 1
        if end > n:
            break
        out.append((first, end))
    return out


class _Numbers(dict):
    """Word -> number, given at the first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """What is known of each word: its code, whether a sentence ends with it, and its 128-bit hash."""

    #: Odd numbers whose powers weigh the hashes of a text's words.
    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self):
        self.clear()
        self.powers = [np.ones(1, np.uint64) for _ in range(4)]

    def clear(self) -> None:
        self.known = _Numbers()
        self.codes, self.last = np.empty(1024, np.uint64), np.empty(1024, bool)
        self.hashes = np.empty((2, 1024), np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        """The number of each word; numbers hold until the next call."""
        if len(self.known) > MEMO_WORDS:
            self.clear()
        known = self.known
        at = len(known)
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        to = len(known)
        if to > at:
            new = list(islice(reversed(known), to - at))[::-1]
            if to > len(self.codes):
                more = np.arange(2 * to) % len(self.codes)  # those behind are not read before they are set
                self.codes, self.last, self.hashes = self.codes[more], self.last[more], self.hashes[:, more]
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            self.codes[at:to] = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))
            self.last[at:to] = [w[-1] in _ENDS and _LAST.search(w) is not None for w in new]
            digests = b"".join(map(xxhash.xxh3_128_digest, raw))
            self.hashes[:, at:to] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        return numbers

    def weights(self, n: int) -> list[np.ndarray]:
        """For each half the powers of its factor up to n and those of the factor's inverse."""
        if len(self.powers[0]) <= n:
            one = np.ones(1, np.uint64)
            bases = [f for x in self.FACTORS for f in (x, pow(x, -1, 1 << 64))]
            self.powers = [np.concatenate([one, np.cumprod(np.full(2 * n, f, np.uint64))]) for f in bases]
        return self.powers


def bounds(text: str, own: Words) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the text's words, and how many stand before each of ``units`` and in all."""
    if not text.isascii() and _WIDE.search(text):
        parts = [words for _, _, words in units(text)]
        numbers = own.of([w for words in parts for w in words])
        return numbers, np.cumsum([0, *map(len, parts)])
    words: list[str] = []
    lines = []
    for line in text.split("\n"):
        words += line.split()
        lines.append(len(words) - 1)
    numbers = own.of(words)
    if not words:
        return numbers, np.zeros(1, np.int64)
    code, last = own.codes[numbers], own.last[numbers]
    last[[i for i in lines if i >= 0]] = True
    before = np.zeros_like(code)
    before[1:] = np.where(last[:-1], 0, code[:-1])
    chosen = ((before * np.uint64(31) + code) * np.uint64(2654435761) >> np.uint64(20) & np.uint64(0xFFF)) % np.uint64(CUT) == 0
    many = np.concatenate([[0], np.flatnonzero(chosen | last) + 1])
    long_ = np.flatnonzero(np.diff(many) > UNIT_WORDS)
    if len(long_):
        more = [np.arange(many[i] + UNIT_WORDS, many[i + 1], UNIT_WORDS) for i in long_]
        many = np.sort(np.concatenate([many, *more]))
    return numbers, many


def ends_of_runs(many: np.ndarray) -> np.ndarray:
    """``runs`` by how many words stand before each sentence: the last + 1 from each first on."""
    first = np.arange(len(many))
    end = np.maximum(np.searchsorted(many, many + MIN_WORDS), first + MIN_UNITS)
    return end[end < len(many)]


def hashed_spans(text: str, own: Words, parts: int = 2) -> np.ndarray:
    """The first ``parts`` halves of the hash of the span from each first sentence on."""
    numbers, many = bounds(text, own)
    end = ends_of_runs(many)
    out = np.empty((parts, len(end)), np.uint64)
    if not len(end):
        return out
    start, stop = many[: len(end)], many[end]
    powers = own.weights(len(numbers))
    for i in range(parts):
        sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(own.hashes[i][numbers] * powers[2 * i][: len(numbers)], out=sums[1:])
        made = (sums[stop] - sums[start]) * powers[2 * i + 1][start] + (stop - start).astype(np.uint64)
        made ^= made >> np.uint64(32)
        made *= np.uint64(Words.FACTORS[1 - i])
        out[i] = made ^ (made >> np.uint64(29))
    return out


def halves(docs: DataFrame) -> DataFrame:
    """``h1`` of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words()
        for batch in batches:
            for part in slices(batch):
                made = [hashed_spans(t, own, 1)[0] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], names=["h1"])

    return keyed_texts(docs).select("text").mapInArrow(run, "h1 long")


def all_spans(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, ``first``, ``h1``, ``h2`` of every span."""
    names = ["row_key", "doc_id", "first", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words()
        for batch in batches:
            for part in slices(batch):
                made = [hashed_spans(t, own) for t in part.column("text").to_pylist()]
                size = [m.shape[1] for m in made]
                row = pa.array(np.repeat(np.arange(len(made)), size))
                first = np.concatenate([np.arange(n, dtype=np.int32) for n in size])
                columns = [*(part.column(c).take(row) for c in names[:2]), pa.array(first)]
                columns += [pa.array(x.view(np.int64)) for x in np.concatenate(made, axis=1)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row_key long, doc_id long, first int, h1 long, h2 long"
    return keyed_texts(docs).mapInArrow(run, schema)


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "first")


def repeated(docs: DataFrame) -> DataFrame:
    """``row_key`` and ``cover``: the sorted first sentences of the spans that are not the first."""
    again = cut(halves(docs).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    likely = maybe_among(all_spans(docs), ["h1"], again, FILTER_BITS)  # 4096 rows of 4 KB at most
    path = scratch_path(docs.sparkSession, "spans")
    likely.write.parquet(path)  # read for the first places and for the join
    likely = docs.sparkSession.read.parquet(path)
    groups = (
        likely.groupBy("h1", "h2").agg(F.min(_order()).alias("lead"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("h1", "h2", "lead")
    )
    return (
        likely.join(groups, ["h1", "h2"])
        .filter(_order() != F.col("lead"))
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list("first")).alias("cover"))
    )


def places(text: str, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``units`` starts and ends, by ``many`` as in ``bounds``."""
    if not text.isascii() and _WIDE.search(text):
        cut_up = units(text)
        return np.array([u[0] for u in cut_up]), np.array([u[1] for u in cut_up])
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.ones(len(letters) + 2, bool)
    blank[1:-1] = _BLANKS[np.minimum(letters, len(_BLANKS) - 1)]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    stops = np.flatnonzero(~blank[:-1] & blank[1:])
    return starts[many[:-1]], stops[many[1:] - 1]


def remove(text: str, cover: np.ndarray, own: Words) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the sentences of the spans that start at those of ``cover``, the stretches
    removed, and their words.

    A stretch reaches from its first sentence to its last; the blanks behind it go too.
    """
    if not len(cover):
        return text, [], 0
    _, many = bounds(text, own)
    begin, stop = places(text, many)
    stretches: list[list[int]] = []
    words, upto = 0, 0
    for first, last in zip(cover.tolist(), ends_of_runs(many)[cover].tolist()):
        first = max(first, upto)
        if first >= last:
            continue
        words += int(many[last] - many[first])
        start, end = int(begin[first]), int(stop[last - 1])
        if stretches and first == upto:
            stretches[-1][1] = end
        else:
            stretches.append([start, end])
        upto = last
    kept, done = [], 0
    for start, end in stretches:
        kept.append(text[done:start])
        done = end
        while done < len(text) and text[done].isspace():
            done += 1
    kept.append(text[done:])
    return "".join(kept), [(a, b) for a, b in stretches], words


def drop_repeated(docs: DataFrame) -> DataFrame:
    """For each row ``row_key``, ``doc_id``, ``text`` without repeated passages, ``removed``
    (stretches of the old text, in code points) and ``removed_words``."""
    rows = keyed_texts(docs).join(repeated(docs), "row_key", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words()
        for df in parts:
            texts, gone, words = [], [], []
            for text, cover in zip(df["text"], df["cover"]):
                text, stretches, n = remove(text, () if cover is None else np.asarray(cover), own)
                texts.append(text)
                gone.append([{"start": a, "end": b} for a, b in stretches])
                words.append(n)
            yield pd.DataFrame(
                {"row_key": df["row_key"], "doc_id": df["doc_id"].astype("Int64"), "text": texts,
                 "removed": gone, "removed_words": words}
            )

    schema = (
        "row_key long, doc_id long, text string, removed array<struct<start:int,`end`:int>>, "
        "removed_words long"
    )
    return rows.mapInPandas(run, schema)
