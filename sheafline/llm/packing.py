"""Packing of tokenised documents into windows of fixed length.

Every document is its token ids and one end id. Full windows are cut off its
front; what remains, shorter than a window, is packed whole where possible:

1. The histogram of remaining lengths is counted over all documents.
2. All combinations of at most ``depth`` lengths that fill a window exactly are
   enumerated. Non-negative least squares gives how often each should be used
   so that together they take up the histogram; the counts are rounded, most
   used first, never beyond the documents there are.
3. Residual documents follow one another, longest first, each into the
   window at hand; one that crosses its end is cut there.

So only the very last residual window is padded. Histogram and solution are bounded
by the window, whatever the input; documents are matched to their slots by their
place in an order by length, which is numbered range by range, so that a length
shared by a third of all rows is spread over many tasks.

Null texts count as empty: one piece with the end id alone. Repeated rows are packed
each on its own. No documents give no pieces.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sheafline.llm.bpe import Memo, byte_symbols, tokenizer_path
from sheafline.llm.common import cut, keyed_texts, map_texts, scratch_path

WINDOW = 2048
DEPTH = 3
END_ID = 1


class LibraryEncoder:
    """Ids as the tokenizers library gives them, each different chunk asked for once.

    Word-level tokenizers never merge across U+0020, which this one makes of line feeds too, so a
    text is cut there and unknown chunks go to the library together. A chunk of Latin letters with marks
    behind them or none is a word that normalising only lowers, and a run of marks: the library's
    model is asked for the word directly, and the marks are known after a while.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.dtype = Tokenizer.from_file(path), dtype
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.symbols = dict(enumerate(byte_symbols()))
        self.memo, self.stems, self.tails = Memo(), Memo(), Memo()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single lower-case words of letters."""
        out, ask, code = [], self.model.tokenize, self.code
        for w in words:
            if not w.isascii():
                w = w.encode("utf-8").decode("latin-1").translate(self.symbols)
            out.append(array(code, [t.id for t in ask(w)]).tobytes())
        return out

    def _ask(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks, normalised and split by the library."""
        found = self.library.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype=self.dtype)
        word = np.array(found.word_ids, dtype=np.int64)
        ends = np.searchsorted(word, np.arange(len(chunks)), side="right").tolist()
        width, raw = ids.itemsize, ids.tobytes()
        return [raw[a * width : b * width] for a, b in zip([0, *ends], ends)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        plain, stems, tails, rest = [], [], [], []
        for i, c in enumerate(chunks):
            stem = c.rstrip(punctuation)
            if stem.isalpha() and (stem.isascii() or max(stem) < "ƀ" and "İ" not in stem):
                plain.append(i)
                stems.append(stem.lower())
                tails.append(c[len(stem) :])
            else:
                rest.append(i)
        out: list[bytes] = [b""] * len(chunks)
        known = self.stems.fill(stems, self._words)
        behind = self.tails.fill(tails, self._ask)
        for i, stem, tail in zip(plain, stems, tails):
            out[i] = known[stem] + behind[tail]
        if rest:
            for i, ids in zip(rest, self._ask([chunks[i] for i in rest])):
                out[i] = ids
        return out

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")  # normalising makes one of the other
        known = self.memo.fill(chunks, self._chunks)
        return b"".join(map(known.__getitem__, chunks))


@lru_cache(maxsize=2)
def _library(path: str, dtype: str) -> LibraryEncoder:
    return LibraryEncoder(path, dtype)


def id_type(path: str) -> str:
    """The narrowest little-endian type for the tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``row_key``, ``doc_id``, ``n`` and ``ids`` (packed as ``id_type``) with the end id."""
    dtype = id_type(path)

    def run(texts: list[str]) -> dict[str, list]:
        bpe, end = _library(path, dtype), np.array([end_id], dtype=dtype).tobytes()
        ids = [bpe.encode(t) + end for t in texts]
        return {"ids": ids, "n": [len(x) // len(end) for x in ids]}

    schema = "row_key long, doc_id long, n long, ids binary"
    return map_texts(keyed_texts(docs), run, schema, ["row_key", "doc_id"])


def combinations(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """Rows of ``depth`` indices into ``lengths`` (sorted, distinct) whose lengths
    fill ``window``; unused places hold -1."""
    at = np.full(window + 1, -1, dtype=np.int64)
    at[lengths] = np.arange(len(lengths))
    rows = [np.empty((0, depth), dtype=np.int64)]
    stack: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # prefixes: the indices so far, the last length, what is left of the window
    start = np.arange(len(lengths))[:, None]
    stack.append((start, lengths.copy(), window - lengths))
    for used in range(1, depth + 1):
        prefix, last, left = stack.pop()
        whole = left == 0
        rows.append(np.pad(prefix[whole], ((0, 0), (0, depth - used)), constant_values=-1))
        if used == depth:
            break
        if used == depth - 1:  # the last length is what is left
            ok = (left >= last) & (left > 0)
            ok[ok] = at[left[ok]] >= 0
            stack.append((np.column_stack([prefix[ok], at[left[ok]]]), left[ok], left[ok] * 0))
            continue
        grown = []
        for i in np.flatnonzero(left >= last):
            lo = np.searchsorted(lengths, last[i])
            hi = np.searchsorted(lengths, left[i], side="right")
            nxt = np.arange(lo, hi)
            grown.append(np.column_stack([np.repeat(prefix[i : i + 1], len(nxt), 0), nxt]))
        prefix2 = np.concatenate(grown) if grown else np.empty((0, used + 1), dtype=np.int64)
        stack.append(
            (prefix2, lengths[prefix2[:, -1]], window - lengths[prefix2].sum(axis=1))
        )
    return np.concatenate(rows)


def solve(combos: np.ndarray, counts: np.ndarray, steps: int = 250) -> np.ndarray:
    """Non-negative ``x`` that brings the lengths used by ``x`` near to ``counts``
    by least squares: accelerated projected gradient on the sparse system."""
    n, m = len(counts), len(combos)
    slots = [combos[:, j] for j in range(combos.shape[1])]
    padded = [np.where(s < 0, n, s) for s in slots]

    def forward(x):
        out = np.zeros(n + 1)
        for s in padded:
            out += np.bincount(s, weights=x, minlength=n + 1)
        return out[:n]

    def back(r):
        r = np.append(r, 0.0)
        return sum(r[s] for s in padded)

    v = np.ones(m) / max(1, np.sqrt(m))
    norm = 1.0
    for _ in range(12):  # largest eigenvalue, by the power method
        v = back(forward(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate = 1.0 / (1.05 * norm)
    x = z = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z - rate * back(forward(z) - counts))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def repeats(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole numbers near ``x`` that never use a length more often than it occurs:
    first each combination rounded, then, most wanted first, as often as it still goes."""
    left = counts.astype(np.int64).tolist()
    out = np.zeros(len(combos), dtype=np.int64)
    order = np.argsort(-x, kind="stable")
    members = [[i for i in row if i >= 0] for row in combos.tolist()]
    for again in (False, True):
        for c in order.tolist():
            if x[c] <= 0:
                break
            want = None if again else round(x[c])
            if want == 0:
                continue
            own = members[c]
            most = min(left[i] // own.count(i) for i in own)
            k = most if want is None else min(want, most)
            if k > 0:
                out[c] += k
                for i in own:
                    left[i] -= k
    return out


class Layout:
    """Where the document at each place of the order by length goes."""

    def __init__(self, histogram: dict[int, int], window: int, depth: int):
        self.window = window
        lengths = np.array(sorted(histogram), dtype=np.int64)
        counts = np.array([histogram[r] for r in lengths.tolist()], dtype=np.int64)
        combos = combinations(lengths, window, depth) if len(lengths) else np.empty((0, depth), int)
        used = np.zeros(len(lengths), dtype=np.int64)
        made = repeats(combos, solve(combos, counts), counts) if len(combos) else np.empty(0, int)
        keep = np.flatnonzero(made)
        combos, made = combos[keep], made[keep]
        self.windows = int(made.sum())
        first = np.cumsum(made) - made
        # slots (length, first window, how many, offset), laid out along each length's documents
        parts = []
        offset = np.zeros(len(combos), dtype=np.int64)
        for j in range(combos.shape[1]):
            has = combos[:, j] >= 0
            parts.append(
                np.column_stack([combos[has, j], first[has], made[has], offset[has]])
            )
            offset[has] += lengths[combos[has, j]]
        slots = np.concatenate(parts) if parts else np.empty((0, 4), dtype=np.int64)
        slots = slots[np.argsort(slots[:, 0], kind="stable")]
        np.add.at(used, slots[:, 0], slots[:, 2])
        group = np.cumsum(counts) - counts  # place of each length's first document
        within = np.cumsum(slots[:, 2]) - slots[:, 2]
        seen = np.cumsum(used) - used
        self.slot_start = group[slots[:, 0]] + within - seen[slots[:, 0]]
        self.slot_window, self.slot_offset = slots[:, 1], slots[:, 3]
        self.slot_end = self.slot_start + slots[:, 2]
        rest = counts - used
        size = rest * lengths
        longest_first = np.cumsum(size[::-1])[::-1] - size
        self.lengths, self.group, self.used = lengths, group, used
        self.rest_start = longest_first
        self.rest_windows = int(-(-size.sum() // window))

    def place(self, at: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of the documents with ``r`` ids at the places ``at``; an
        offset may let the document run over into the next window."""
        if len(self.slot_start):
            slot = np.searchsorted(self.slot_start, at, side="right") - 1
            ok = (slot >= 0) & (at < self.slot_end[slot])
            window = self.slot_window[slot] + at - self.slot_start[slot]
            offset = self.slot_offset[slot]
        else:
            ok = np.zeros(len(at), dtype=bool)
            window = offset = np.zeros(len(at), dtype=np.int64)
        i = np.searchsorted(self.lengths, r)
        i = np.minimum(i, max(0, len(self.lengths) - 1))
        if len(self.lengths) == 0:
            return window, offset
        run = self.rest_start[i] + (at - self.group[i] - self.used[i]) * r
        return (
            np.where(ok, window, self.windows + run // self.window),
            np.where(ok, offset, run % self.window),
        )


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    depth: int = DEPTH,
    path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all ``docs``: ``row_key``, ``doc_id``, ``start``, ``length``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and the piece's ``ids`` (binary, see
    ``id_type``). Each sequence is filled without gaps from offset 0."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    width = int(id_type(path)[-1])
    stored = scratch_path(spark, "tokens")
    tokenize(docs, path, end_id).write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.parquet(stored)
    lengths = tokens.select("row_key", "n", (F.col("n") % window).alias("r"))

    histogram = {
        row["r"]: row["count"] for row in lengths.filter("r > 0").groupBy("r").count().collect()
    }  # at most window - 1 rows
    layout = Layout(histogram, window, depth)

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, rows, full = TaskContext.get().partitionId(), 0, 0
        for df in parts:
            blocks = (df["n"] // window).to_numpy()
            has = (df["r"] > 0).to_numpy()
            yield df.assign(
                pid=pid,
                at=rows + np.cumsum(has) - has,
                block=full + np.cumsum(blocks) - blocks,
            )
            rows, full = rows + int(has.sum()), full + int(blocks.sum())

    numbered = cut(
        lengths.repartitionByRange(F.col("r"), F.col("row_key"))
        .sortWithinPartitions("r", "row_key")
        .mapInPandas(number, "row_key long, n long, r long, pid long, at long, block long")
    )
    # one row for each partition of the range exchange
    sizes = (
        numbered.groupBy("pid")
        .agg(
            F.sum((F.col("r") > 0).cast("long")).alias("rows"),
            F.sum(F.floor(F.col("n") / window)).alias("blocks"),
        )
        .orderBy("pid")
        .collect()
    )
    before = np.zeros((max([0, *(s["pid"] for s in sizes)]) + 2, 2), dtype=np.int64)
    for s in sizes:
        before[s["pid"] + 1] = s["rows"], s["blocks"]
    before = np.cumsum(before, axis=0)
    shared = spark.sparkContext.broadcast((layout, before))

    def lay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout, before = shared.value
        packed = layout.windows + layout.rest_windows
        for df in parts:
            if df.empty:
                continue
            key, n, r, pid, at, block = (
                df[c].to_numpy() for c in ("row_key", "n", "r", "pid", "at", "block")
            )
            blocks = n // window
            # whole windows, each a sequence of its own
            row = np.repeat(np.arange(len(n)), blocks)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            out = [(key[row], nth * window, np.full(len(row), window),
                    packed + (before[pid, 1] + block)[row] + nth, np.zeros(len(row), np.int64))]
            some = r > 0
            key, start, r = key[some], (blocks * window)[some], r[some]
            seq, offset = layout.place((before[pid, 0] + at)[some], r)
            fits = np.minimum(r, window - offset)
            out.append((key, start, fits, seq, offset))
            over = fits < r
            out.append((key[over], (start + fits)[over], (r - fits)[over], seq[over] + 1,
                        np.zeros(int(over.sum()), np.int64)))
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pd.DataFrame(dict(zip(("row_key", "start", "length", "sequence_id", "offset"), cols)))

    plan = numbered.mapInPandas(
        lay, "row_key long, start long, length long, sequence_id long, offset long"
    )
    ids = F.substring(F.col("ids"), F.col("start") * width + 1, F.col("length") * width)
    return tokens.join(plan, "row_key").select(
        "row_key", "doc_id", "start", "length", F.col("n").alias("doc_tokens"),
        "sequence_id", "offset", ids.alias("ids"),
    )


def pack_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces with the CRC of their ids as unsigned 32-bit numbers in place of the ids."""
    import zlib

    import pyarrow as pa

    path = path or tokenizer_path()
    dtype = id_type(path)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [
                zlib.crc32(np.frombuffer(x.as_buffer(), dtype=dtype).astype("<u4"))
                for x in b.column("ids")
            ]
            cols = [pa.array(crc, pa.int64()) if c == "ids_crc32" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return pack(docs, path=path).mapInArrow(digest, ", ".join(f"{c} long" for c in names))
