"""Masked pseudo-likelihood of documents.

A token is a word's class: the ``FREQUENT`` most frequent words of the whole corpus
have one each, all others share hashed ones. A network sees the ``WINDOW`` tokens before a
place and the ``WINDOW`` behind it, never the token itself: each neighbour adds its
embedding for that distance, a tanh layer follows, and the token is predicted in
two steps, its group and its place in the group. The log-likelihood of a document is the
sum of the conditional log-probabilities of all of its tokens. With word counts, as in the query,
that of a word within its class is added: its share of the class's words in the whole corpus,
in which one count a class is set aside for words never seen.

Texts are cut into words twice, for the counts and for the tokens, which are stored: training and scoring read those.
Word counts are made over all documents. Training runs in rounds: every task takes gradient steps on its own
share of the corpus from the last round's weights, and the results are averaged, weighted by places,
over a tree of groups. The places are dealt out over the rounds, so every place of every document
is trained on, in one round. What is trained on and what is sent therefore grow with the corpus;
the weights do not.

Null texts count as empty: no tokens, log-likelihood 0 and no mean. Repeated rows score
the same. With no words at all the network stays at its start. Extra columns are never
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sheafline.llm.common import cut, keyed_texts, slices

GROUPS = 32
PER_GROUP = 32
TOKENS = GROUPS * PER_GROUP
FREQUENT = TOKENS - 256  # the other classes are shared by rarer words
WINDOW = 2
WIDTH = 24
ROUNDS = 2
BATCH = 1024
RATE = 0.05
SLICES = 8
FAN_IN = 64
#: Places that are scored together.
PLACES = 1 << 12
MEMO_WORDS = 200_000
#: Most frequent words of hashed classes, whose shares the tasks are sent; all others are joined.
HELD_WORDS = 200_000
EDGE = TOKENS  # stands before the first and behind the last word
#: Blanks of Python's ``split`` that Arrow's does not know.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all lower-cased texts as ``split`` cuts them: the distinct ones, which of them each
    place holds, and how many each text has."""
    low = [t.lower() for t in texts]
    low = [" ".join(t.split()) if _OTHER_BLANKS.search(t) else t for t in low]
    parts = pc.ascii_split_whitespace(pa.array(low, pa.large_string()))
    sizes = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    words = parts.flatten().dictionary_encode()
    distinct, index = words.dictionary, words.indices.to_numpy()
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # before and behind the blanks at a text's ends
        none = index == empty
        text = np.repeat(np.arange(len(texts)), sizes)
        sizes, index = sizes - np.bincount(text[none], minlength=len(texts)), index[~none]
    return distinct, index, sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` over all documents, counted within the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                distinct, index, _ = split_words(part.column("text").to_pylist())
                n = pa.array(np.bincount(index, minlength=len(distinct)), pa.int64())
                made = pa.RecordBatch.from_arrays([distinct.cast(pa.string()), n], names=["word", "n"])
                yield made.filter(pc.greater(n, 0))

    made = keyed_texts(docs).select("text").mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Word -> class; rarer words by hash."""

    def __init__(self, frequent: list[str]):
        self.frequent = {w: i for i, w in enumerate(frequent[:FREQUENT])}
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.frequent

    def __setstate__(self, state):
        self.frequent, self.known = state, {}

    def _class(self, word: str) -> int:
        own = self.frequent.get(word)
        if own is None:
            own = FREQUENT + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (TOKENS - FREQUENT)
        return own

    def of_words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MEMO_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self._class(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint16, count=len(words))

    def of(self, text: str) -> np.ndarray:
        return self.of_words(text.lower().split())


@dataclass
class Network:
    """Weights as float32; ``near[d]`` embeds the neighbour at the d-th distance."""

    near: np.ndarray  # 2 * WINDOW x TOKENS + 1 x WIDTH
    bias: np.ndarray
    group: np.ndarray  # WIDTH x GROUPS
    group_bias: np.ndarray
    inner: np.ndarray  # GROUPS x WIDTH x PER_GROUP
    inner_bias: np.ndarray

    FIELDS = ("near", "bias", "group", "group_bias", "inner", "inner_bias")

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        share = (counts + 1.0).reshape(GROUPS, PER_GROUP)
        make = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(
            make(2 * WINDOW, TOKENS + 1, WIDTH),
            np.zeros(WIDTH, np.float32),
            make(WIDTH, GROUPS),
            np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
            make(GROUPS, WIDTH, PER_GROUP),
            np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f).ravel() for f in self.FIELDS])

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for f in self.FIELDS:
            x = getattr(self, f)
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        around = around.astype(np.intp)
        total = self.near[0].take(around[:, 0], axis=0)
        total += self.bias
        for d in range(1, 2 * WINDOW):
            total += self.near[d].take(around[:, d], axis=0)
        return np.tanh(total, out=total)

    def _outputs(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Of places in the order of their token's ``group``, a column for each: the values of all groups, those of
        the places in the own group, and where each group's columns are."""
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        spans = [(g, ends[g], ends[g + 1]) for g in range(GROUPS) if ends[g] < ends[g + 1]]
        h = h.T
        within = np.empty((PER_GROUP, len(group)), np.float32)
        for g, lo, hi in spans:
            np.matmul(self.inner[g].T, h[:, lo:hi], out=within[:, lo:hi])
        within += self.inner_bias.T.take(group, axis=1)
        among = self.group.T @ h
        among += self.group_bias[:, None]
        return among, within, spans

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given its neighbours."""
        order = np.argsort(token, kind="stable")
        group, place = np.divmod(token.take(order), PER_GROUP)
        among, within, _ = self._outputs(self.hidden(around.take(order, axis=0)), group.astype(np.intp))
        out = np.empty(len(token), np.float32)
        out[order] = _log_share(among, group) + _log_share(within, place)
        return out

    def gradient_parts(self, around: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of the mean negative log-probability: for ``near``, as one table of all distances, the rows that are not
        zero everywhere, and the gradients of all fields, that of ``near`` for these rows."""
        n = len(token)
        order = np.argsort(token, kind="stable")
        around = around.take(order, axis=0)
        group, place = np.divmod(token.take(order), PER_GROUP)
        h = self.hidden(around)
        d_group, d, spans = self._outputs(h, group.astype(np.intp))
        every = np.arange(n)
        for x, own in ((d_group, group), (d, place)):
            x /= _exp(x)[1]
            x[own, every] -= 1
            x *= np.float32(1 / n)
        d_h = self.group @ d_group
        back = np.empty_like(d_h)
        inner, inner_bias = np.zeros_like(self.inner), np.zeros_like(self.inner_bias)
        for g, lo, hi in spans:
            np.matmul(self.inner[g], d[:, lo:hi], out=back[:, lo:hi])
            np.matmul(h[lo:hi].T, d[:, lo:hi].T, out=inner[g])
        inner_bias[[g for g, _, _ in spans]] = np.add.reduceat(d, [lo for _, lo, _ in spans], axis=1).T
        d_h += back
        d_in = 1 - h * h
        d_in *= d_h.T
        # rows of one neighbour at one distance come together
        keys = (around + _DISTANCES).ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys.take(order)
        order //= 2 * WINDOW
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(first, append=len(keys))
        near = d_in.take(order.take(first), axis=0)
        several = size > 1
        if several.any():  # two columns are added as one complex number
            rows = d_in.take(order[np.repeat(several, size)], axis=0).view(np.complex64)
            size = size[several]
            near[several] = np.add.reduceat(rows, np.cumsum(size) - size).view(np.float32)
        return keys.take(first).astype(np.intp), [
            near, d_in.sum(axis=0), h.T @ d_group.T, d_group.sum(axis=1), inner, inner_bias
        ]

    def gradient(self, around: np.ndarray, token: np.ndarray) -> Network:
        """Of the mean negative log-probability."""
        met, parts = self.gradient_parts(around, token)
        near = np.zeros_like(self.near)
        near.reshape(-1, WIDTH)[met] = parts[0]
        return Network(near, *parts[1:])


#: Where the rows of each distance begin in the table of all of them.
_DISTANCES = (np.arange(2 * WINDOW) * (TOKENS + 1)).astype(np.uint16)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In place, less the highest of each column; these and the sums of the columns."""
    high = x.max(axis=0)
    x -= high
    np.exp(x, out=x)
    return high, x.sum(axis=0)


def _log_share(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of ``x`` at this row of each column; ``x`` is used up."""
    own = x[row, np.arange(len(row))]
    high, total = _exp(x)
    return own - high - np.log(total)


def neighbours(tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The tokens around ``places``: those before, nearest first, then those behind."""
    edge = np.full(WINDOW, EDGE, dtype=tokens.dtype)
    padded = np.concatenate([edge, tokens, edge])
    at = places + WINDOW
    sides = [*range(-1, -WINDOW - 1, -1), *range(1, WINDOW + 1)]
    return np.column_stack([padded[at + d] for d in sides])


def coded(
    docs: DataFrame, classes: Classes, held: dict[str, float] | None = None, unseen: np.ndarray | None = None
) -> DataFrame:
    """``row_key``, ``doc_id``, ``size`` (bytes of the text), ``n_tokens`` and ``tokens`` (16 bits each, edges behind
    them) of each row; ``within``, the sum of its words' ``held`` shares, and ``others``, its words that are not
    held, which count as ``unseen`` in ``within``. Without shares there are no others."""
    shared = docs.sparkSession.sparkContext.broadcast((classes, held, unseen))
    struct = pa.struct([("word", pa.string()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, unseen = shared.value
        for batch in batches:
            for part in slices(batch):
                distinct, index, sizes = split_words(part.column("text").to_pylist())
                distinct, n = distinct.to_pylist(), len(sizes)
                of_word = classes.of_words(distinct)
                ends = np.cumsum(sizes)
                text = np.repeat(np.arange(n), sizes)
                tokens = np.full(len(index) + n * WINDOW, EDGE, dtype="<u2")
                tokens[np.arange(len(index)) + text * WINDOW] = of_word[index]
                offsets = np.concatenate([[0], 2 * (ends + WINDOW * np.arange(1, n + 1))]).astype(np.int32)
                within, starts = np.zeros(n), np.zeros(n + 1, np.int32)
                words, times = pa.array([], pa.string()), pa.array([], pa.int32())
                if held is not None:
                    own = np.fromiter(map(held.get, distinct, repeat(np.nan)), np.float64, len(distinct))
                    rare = of_word >= FREQUENT
                    own[~rare] = 0
                    open_ = np.isnan(own)  # as if never seen, until its count is joined
                    own[open_] = unseen[of_word[open_].astype(np.int64) - FREQUENT]
                    within = np.bincount(text, weights=own[index], minlength=n)
                    some = open_[index]
                    pairs, many = np.unique(text[some] * len(distinct) + index[some], return_counts=True)
                    row, word = np.divmod(pairs, max(1, len(distinct)))
                    starts[1:] = np.cumsum(np.bincount(row, minlength=n))
                    words = pa.array([distinct[w] for w in word.tolist()], pa.string())
                    times = pa.array(many, pa.int32())
                packed = [pa.py_buffer(offsets.tobytes()), pa.py_buffer(tokens.tobytes())]
                others = pa.StructArray.from_arrays([words, times], fields=list(struct))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_key"), part.column("doc_id"),
                        pc.binary_length(part.column("text")).cast(pa.int64()), pa.array(sizes, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), n, [None, *packed]), pa.array(within),
                        pa.ListArray.from_arrays(pa.array(starts), others),
                    ],
                    names=["row_key", "doc_id", "size", "n_tokens", "tokens", "within", "others"],
                )

    schema = "row_key long, doc_id long, size long, n_tokens long, tokens binary, within double, "
    return keyed_texts(docs).mapInArrow(run, schema + "others array<struct<word:string,times:int>>")


def joined(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows of ``coded`` with edges between them, the places of real ones, and how many each has."""
    made = part.column("tokens")
    offsets = np.frombuffer(made.buffers()[1], "<i4")[made.offset : made.offset + len(made) + 1]
    tokens = np.frombuffer(made.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u2")
    return tokens, np.flatnonzero(tokens != EDGE), np.diff(offsets) // 2 - WINDOW


def beginning(counts: DataFrame) -> tuple[Classes, Network, int]:
    """Classes and network before training, and the number of words."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_class = np.zeros(TOKENS)
    by_class[: len(top)] = [r["n"] for r in top]
    by_class[FREQUENT:] = (total - by_class.sum()) / (TOKENS - FREQUENT)
    return Classes([r["word"] for r in top]), Network.start(by_class), total


def train(
    docs: DataFrame, rounds: int = ROUNDS, counts: DataFrame | None = None
) -> tuple[Classes, Network]:
    """Classes and network from all of ``docs``; ``counts`` are its stored word counts, if made."""
    counts = cut(word_counts(docs)) if counts is None else counts
    classes, network, total = beginning(counts)
    if total:
        network = descended(cut(coded(docs, classes)), network, rounds)
    return classes, network


def descended(rows: DataFrame, network: Network, rounds: int = ROUNDS) -> Network:
    """The network after training on all places of the stored rows of ``coded``."""
    spark = rows.sparkSession
    texts = rows.select("size", "tokens")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            own = Descent(shared.value, turn)
            seen = 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                for part in slices(batch, size=batch.column("size")):
                    tokens, places, _ = joined(part)
                    # other places in each round, all of them in the end
                    places = places[turn::rounds]
                    held.append((neighbours(tokens, places), tokens[places]))
                    size += len(places)
                    seen += len(places)
                if size >= 64 * BATCH:
                    own.over(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
            if size:
                own.over(*map(np.concatenate, zip(*held)))
            pid = TaskContext.get().partitionId()
            parts = np.array_split(own.network.flat(), SLICES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([pid] * SLICES, pa.int64()),
                    pa.array(range(SLICES), pa.int64()),
                    pa.array([float(seen)] * SLICES, pa.float64()),
                    pa.array([x.astype("<f4").tobytes() for x in parts], pa.binary()),
                ],
                names=["pid", "part", "weight", "values"],
            )

        def average(df: pd.DataFrame) -> pd.DataFrame:
            total, values = 0.0, None
            for w, raw in zip(df["weight"], df["values"]):
                x = np.frombuffer(raw, dtype="<f4").astype(np.float64)
                total += w
                values = w * x if values is None else values + w * x
            if total > 0:
                values = values / total
            return pd.DataFrame(
                {"pid": [int(df["pid"].iloc[0])], "part": [int(df["part"].iloc[0])],
                 "weight": [total], "values": [values.astype("<f4").tobytes()]}
            )

        schema = "pid long, part long, weight double, values binary"
        made = texts.mapInArrow(learn, schema).filter("weight > 0")
        tasks = texts.rdd.getNumPartitions()
        while tasks > 1:  # a group never holds more than FAN_IN rows
            made = made.withColumn("pid", F.floor(F.col("pid") / FAN_IN))
            made = made.groupBy("part", "pid").applyInPandas(lambda df: average(df), schema)
            tasks = -(-tasks // FAN_IN)
        values = sorted(made.collect(), key=lambda r: r["part"])  # SLICES rows of fixed size
        if not values:
            break
        network = network.with_flat(
            np.concatenate([np.frombuffer(r["values"], dtype="<f4") for r in values])
        )
    return network


class Descent:
    """Adaptive gradient steps from a network's weights, over batches of places."""

    def __init__(self, first: Network, turn: int):
        self.network = first.with_flat(first.flat().copy())
        self.sums = first.with_flat(np.full(first.flat().size, 1e-8))
        self.rng = np.random.default_rng(turn)

    def over(self, around: np.ndarray, token: np.ndarray) -> None:
        around, token = around.astype(np.uint16, copy=False), token.astype(np.uint16, copy=False)
        order = self.rng.permutation(len(token))
        near, near_sums = (x.near.reshape(-1, WIDTH) for x in (self.network, self.sums))
        others = [(getattr(self.network, f), getattr(self.sums, f)) for f in Network.FIELDS[1:]]
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            met, (step, *steps) = self.network.gradient_parts(around.take(rows, axis=0), token.take(rows))
            # rows that no place of the batch is near to have no gradient and stay
            s = near_sums.take(met, axis=0)
            s += step * step
            near_sums[met] = s
            np.sqrt(s, out=s)
            step /= s
            step *= np.float32(RATE)
            near[met] = near.take(met, axis=0) - step
            for (x, s), g in zip(others, steps):
                s += g * g
                g /= np.sqrt(s)
                g *= np.float32(RATE)
                x -= g


def scored(rows: DataFrame, network: Network, carry: tuple[str, ...]) -> DataFrame:
    """``carry``, ``n_tokens`` and ``log_likelihood`` of each row of ``coded``, words by class."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            for part in slices(batch, size=batch.column("size")):
                tokens, places, sizes = joined(part)
                values = np.empty(len(places))
                for at in range(0, len(places), PLACES):
                    own = places[at : at + PLACES]
                    values[at : at + PLACES] = network.log_probability(neighbours(tokens, own), tokens[own])
                sums = np.zeros(len(sizes))
                some = sizes > 0
                if some.any():
                    begin = (np.cumsum(sizes) - sizes)[some]
                    sums[some] = np.add.reduceat(values, begin)
                columns = [part.column(c) for c in (*carry, "n_tokens")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums)], names=[*carry, "n_tokens", "log_likelihood"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*carry, "n_tokens")) + ", log_likelihood double"
    return rows.select(*carry, "n_tokens", "size", "tokens").mapInArrow(run, schema)


def _with_mean(scores: DataFrame) -> DataFrame:
    mean = F.expr("if(n_tokens > 0, log_likelihood / n_tokens, null)")
    return scores.withColumn("mean_log_likelihood", mean)


def score(
    docs: DataFrame, classes: Classes, network: Network, carry: tuple[str, ...] | list[str] = ("doc_id",)
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_likelihood`` and ``mean_log_likelihood`` of each row, words by class."""
    return _with_mean(scored(coded(docs, classes), network, tuple(carry)))


def word_shares(counts: DataFrame, classes: Classes) -> tuple[DataFrame, np.ndarray]:
    """``word``, ``n`` and ``share`` (log-probability within its class) of each word of a hashed class,
    and the share of an unseen word in each of these classes."""
    spark, shared = counts.sparkSession, TOKENS - FREQUENT
    frequent = spark.createDataFrame([(w,) for w in classes.frequent], "word string")
    rare = counts.join(F.broadcast(frequent), "word", "left_anti").withColumn(
        "class", F.crc32(F.encode("word", "utf-8")) % shared
    )
    totals = cut(rare.groupBy("class").agg(F.sum("n").alias("all")))
    unseen = np.zeros(shared)
    for r in totals.collect():  # a row for each class
        unseen[r["class"]] = -np.log(r["all"] + 1)
    shares = rare.join(F.broadcast(totals), "class")
    return shares.select("word", "n", (F.log("n") - F.log(F.col("all") + 1)).alias("share")), unseen


def _most_frequent(shares: DataFrame, most: int) -> DataFrame:
    """The words down to some count ``n``, at most ``most`` of them and no count in part."""
    # a row for each count, the highest ones; only words that are sent are collected
    per = shares.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most)
    least, words = None, 0
    for r in per.collect():
        words += r["words"]
        if words > most:
            break
        least = r["n"]
    return shares.limit(0) if least is None else shares.filter(F.col("n") >= least)


def word_coded(docs: DataFrame, classes: Classes, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows of ``coded`` with the shares of words, and the table of these."""
    shares, unseen = word_shares(counts, classes)
    shares = cut(shares)
    held = {r["word"]: r["share"] for r in _most_frequent(shares, HELD_WORDS).collect()}
    return cut(coded(docs, classes, held, unseen)), shares


def word_scored(rows: DataFrame, network: Network, shares: DataFrame) -> DataFrame:
    """As ``score``, from the results of ``word_coded``, with the log-probability of each word within its class."""
    more = (
        rows.select("row_key", F.inline("others"))
        .join(shares.filter("n > 1").select("word", "n"), "word")  # the logarithm of one adds nothing
        .groupBy("row_key").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
    )
    whole = F.col("log_likelihood") + F.col("within") + F.coalesce("more", F.lit(0.0))
    return _with_mean(
        scored(rows, network, ("row_key", "doc_id", "within")).join(more, "row_key", "left")
        .select("doc_id", "n_tokens", whole.alias("log_likelihood"))
    )


def score_words(docs: DataFrame, classes: Classes, network: Network, counts: DataFrame) -> DataFrame:
    """As ``score``, with the log-probability of each word within its class."""
    rows, shares = word_coded(docs, classes, counts)
    return word_scored(rows, network, shares)


def train_and_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``score_words`` after ``train`` on the same ``docs``, from one table of tokens."""
    counts = cut(word_counts(docs))
    classes, network, total = beginning(counts)
    rows, shares = word_coded(docs, classes, counts)
    if total:
        network = descended(rows, network, rounds)
    return word_scored(rows, network, shares)
