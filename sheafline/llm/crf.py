"""Language of code-switched text by a linear-chain conditional random field.

Every word of a text gets a label, one of the languages that may be learned from, however many. A word's score for
a label is the sum of the weights of its features: prefixes and suffixes, character
n-grams with the word's ends marked, the word itself if it is in the lexicon,
and its shape. Neighbouring labels have learned transition weights. Forward-backward
gives each word's label probabilities given the whole text; a document's
language is the one with the largest mean probability over its words that have a
letter, and its score is that mean.

Training uses documents that are not held out, at most ``SAMPLE`` for each
language and taken by a hash of the id; the counts that make the lexicon are over
all documents that may be learned from. As each of these has one language, training
sequences are pieces of several documents put one behind the other, so that there are
switches to learn transitions from. Weights maximise the conditional log-likelihood by
gradient steps.

Null texts and texts without a letter are ``und`` with score 0. Null or repeated ids
are predicted like any other; a null lang is never learned from. With no learnable
document everything is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheafline.llm.common import cut, held_out, keyed_texts, map_texts

#: Training documents of each language, at most.
SAMPLE = 120
LEXICON = 4000
BUCKETS = 1 << 15
PIECE = 12  # words of a document that stand together in a training sequence
SEQUENCE = 48
EPOCHS = 8
RATE = 0.15
L2 = 1e-5
#: Words of the texts that run through forward-backward together.
BATCH_WORDS = 400_000
MEMO_WORDS = 150_000
#: Scores (words by labels) held at a time: with many labels batches get fewer words.
CELLS = 25_000_000

WORD = re.compile(r"[^\W\d_]+")  # runs of letters


_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint64)


def _bucket(parts: list[np.ndarray], kind: int) -> np.ndarray:
    """Hash of equally long arrays of code points, of one kind of feature."""
    h = np.full(len(parts[0]), 97 * kind + 1, dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * _PRIMES[0] & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
    h = h * _PRIMES[1] & np.uint64(0xFFFFFFFF)
    return ((h ^ (h >> np.uint64(13))) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of the word, bucket): affixes, n-grams with ends marked, lexicon, shape."""
    lower = [w.lower() for w in words]
    codes = np.frombuffer("".join(f"<{w}>" for w in lower).encode("utf-32-le"), dtype="<u4")
    codes = codes.astype(np.uint64)
    size = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower)) + 2
    end = np.cumsum(size)
    begin = end - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes))
    places, buckets = [], []
    for k in (1, 2, 3):
        i = at[at + k <= end[word]]
        places.append(word[i])
        buckets.append(_bucket([codes[i + j] for j in range(k)], k))
    for k in (3, 4):  # shorter affixes are n-grams with a marked end
        long = np.flatnonzero(size - 2 >= k)
        places += [long, long]
        buckets.append(_bucket([codes[begin[long] + 1 + j] for j in range(k)], 10 + k))
        buckets.append(_bucket([codes[end[long] - 1 - k + j] for j in range(k)], 20 + k))
    listed = [(i, zlib.crc32(w.encode("utf-8")) % BUCKETS) for i, w in enumerate(lower) if w in lexicon]
    if listed:
        i, own = np.array(listed).T
        places.append(i)
        buckets.append(own)
    shape = [4 * w.isupper() + 2 * w.istitle() + w.isascii() for w in words]
    places.append(np.arange(len(words)))
    buckets.append(_bucket([np.array(shape, dtype=np.uint64)], 30))
    return np.concatenate(places), np.concatenate(buckets)


def word_scores(weights: np.ndarray, places: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """Sums of the weights of the features of n words."""
    return np.column_stack(
        [np.bincount(places, weights[buckets, j], minlength=n) for j in range(weights.shape[1])]
    )


@dataclass
class Chain:
    """Weights and the lexicon; scores whole texts."""

    labels: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray  # bucket x label
    start: np.ndarray
    moves: np.ndarray  # label x label

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the words, each different one computed once as long as it is known."""
        if len(self.known) > min(MEMO_WORDS, CELLS // len(self.labels)):
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            made = word_scores(self.weights, *features(new, self.lexicon), len(new))
            self.table = np.concatenate([self.table, made])
        at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[at]

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities of each word of sequences that lie one behind the other."""
        return forward_backward(scores, sizes, self.start, self.moves)[0]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        held: list[int] = []
        words: list[str] = []
        sizes: list[int] = []

        def flush():
            if not held:
                return
            n = np.array(sizes)
            probability = self.marginals(self.emissions(words), n)
            first = np.cumsum(n) - n
            mean = np.add.reduceat(probability, first, axis=0) / n[:, None]
            for i, row in zip(held, mean):
                best = int(row.argmax())
                langs[i], scores[i] = self.labels[best], float(min(1.0, row[best]))
            held.clear(), words.clear(), sizes.clear()

        for i, text in enumerate(texts):
            own = WORD.findall(text)
            if own:
                held.append(i)
                words += own
                sizes.append(len(own))
                if len(words) >= min(BATCH_WORDS, CELLS // len(self.labels)):
                    flush()
        flush()
        return langs, scores


def forward_backward(
    scores: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities, expected transitions and log-normaliser of each sequence.

    Sequences are stepped through together, longest first, so that each step is one
    array operation over those that are still running.
    """
    k = len(start)
    order = np.argsort(-sizes, kind="stable")
    size = sizes[order]
    first = (np.cumsum(sizes) - sizes)[order]
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    emit = np.exp(scores - top)
    shift = moves.max()
    step = np.exp(moves - shift)
    alpha = np.empty_like(emit)
    scale = np.empty(len(emit))
    # running[t]: how many sequences have more than t words
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    a = np.exp(start - start.max())
    for t in range(len(running)):
        at = first[: running[t]] + t
        a = (emit[at] * a) if t == 0 else emit[at] * (a[: running[t]] @ step)
        total = a.sum(axis=1)
        a = a / total[:, None]
        alpha[at], scale[at] = a, total
    beta = np.ones_like(emit)
    expected = np.zeros((k, k))
    for t in range(len(running) - 2, -1, -1):
        on = running[t + 1]
        at = first[:on] + t
        ahead = emit[at + 1] * beta[at + 1] / scale[at + 1, None]
        beta[at] = ahead @ step.T
        expected += (alpha[at].T @ ahead) * step
    log_z = np.zeros(len(sizes))
    if len(sizes):
        begin = np.cumsum(sizes) - sizes
        log_z = np.add.reduceat(np.log(scale) + top[:, 0], begin)
        log_z += start.max() + shift * (sizes - 1)
    return alpha * beta, expected, log_z


def training_sequences(texts: list[tuple[str, int]], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Pieces of documents, shuffled and put one behind the other, with their labels."""
    pieces = []
    for text, label in texts:
        words = WORD.findall(text)
        pieces += [(words[i : i + PIECE], label) for i in range(0, len(words), PIECE)]
    order = np.random.default_rng(seed).permutation(len(pieces))
    out: list[tuple[list[str], list[int]]] = [([], [])]
    for i in order:
        words, label = pieces[i]
        if len(out[-1][0]) >= SEQUENCE:
            out.append(([], []))
        out[-1][0].extend(words)
        out[-1][1].extend([label] * len(words))
    return [s for s in out if s[0]]


def train(texts: list[tuple[str, int]], labels: list[str], lexicon: frozenset[str]) -> Chain:
    """Conditional maximum likelihood by adaptive gradient steps over batches of sequences."""
    k = len(labels)
    chain = Chain(labels, lexicon, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)))
    sequences = training_sequences(texts)
    index = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in sequences for w in words))}
    places, buckets = features(list(index), lexicon)
    order = np.argsort(places, kind="stable")
    buckets = buckets[order]
    many = np.bincount(places, minlength=len(index))
    begin = np.cumsum(many) - many
    coded = [(np.array([index[w] for w in words]), np.array(own)) for words, own in sequences]
    sums = [np.full_like(x, 1e-6) for x in (chain.weights, chain.start, chain.moves)]
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 64)):
            sizes = np.array([len(coded[i][0]) for i in batch])
            gold = np.concatenate([coded[i][1] for i in batch])
            own, inverse = np.unique(
                np.concatenate([coded[i][0] for i in batch]), return_inverse=True
            )
            place = np.repeat(np.arange(len(own)), many[own])
            within = np.arange(len(place)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            bucket = buckets[begin[own][place] + within]
            scores = word_scores(chain.weights, place, bucket, len(own))[inverse]
            p, expected, _ = forward_backward(scores, sizes, chain.start, chain.moves)
            p[np.arange(len(gold)), gold] -= 1  # gradient of the scores
            by_word = word_scores(p, inverse, np.arange(len(p)), len(own))
            grad = word_scores(by_word, bucket, place, BUCKETS)
            first = np.cumsum(sizes) - sizes
            inner = np.ones(len(gold), dtype=bool)
            inner[first] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            n = len(batch)
            for x, s, g in (
                (chain.weights, sums[0], grad / n),
                (chain.start, sums[1], p[first].sum(axis=0) / n),
                (chain.moves, sums[2], (expected - seen) / n),
            ):
                g = g + L2 * x * (g != 0)
                s += g * g
                x -= RATE * g / np.sqrt(s)
    return chain


def _word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` over all given documents, counted within the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            lang, word = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(word, pa.string()),
                 pa.array(counts.values(), pa.int64())],
                names=["lang", "word", "n"],
            )

        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                # function words are short; longer ones are told by their n-grams
                counts.update((lang, w.lower()) for w in WORD.findall(text) if len(w) <= 4)
            if len(counts) > 200_000:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    made = docs.mapInArrow(count, "lang string, word string, n long")
    return made.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """A chain from the documents that are not held out; None if none has a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).filter(
        ~held_out(F.col("doc_id"))
    )
    texts = keyed_texts(known, F.col("lang").cast("string").alias("lang"))
    # a row per language: every one is a label, only its documents are sampled
    sizes = cut(texts.groupBy("lang").count())
    labels = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not labels:
        return None
    share = F.least(F.lit(1.0), F.lit(sample) / F.col("count"))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    chosen = (
        texts.join(F.broadcast(sizes), "lang").filter(pick)
        .select("lang", "text").limit(2 * sample * len(labels)).collect()
    )
    words = (
        _word_counts(texts.select("lang", "text")).groupBy("word").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word").limit(LEXICON).collect()
    )
    lexicon = frozenset(r["word"] for r in words)
    number = {lang: i for i, lang in enumerate(labels)}
    rows = sorted((r["text"], number[r["lang"]]) for r in chosen)
    return train(rows, labels, lexicon)


def predict(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts: list[str]) -> dict[str, list]:
        if shared.value is None:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        lang, score = shared.value.predict(texts)
        return {"lang_pred": lang, "score": score}

    made = map_texts(
        keyed_texts(docs), run, "doc_id long, lang_pred string, score double", ["doc_id"]
    )
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def word_languages(docs: DataFrame, chain: Chain) -> DataFrame:
    """The label of every word: ``doc_id``, ``words`` and ``langs`` (arrays of equal length)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts: list[str]) -> dict[str, list]:
        own, out = shared.value, {"words": [], "langs": []}
        for text in texts:
            words = WORD.findall(text)
            out["words"].append(words)
            if not words:
                out["langs"].append([])
                continue
            p = own.marginals(own.emissions(words), np.array([len(words)]))
            out["langs"].append([own.labels[i] for i in p.argmax(axis=1)])
        return out

    schema = "doc_id long, words array<string>, langs array<string>"
    return map_texts(keyed_texts(docs), run, schema, ["doc_id"])
