"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters. Each looks at a whole text and fires or abstains: families of insults in several
   languages, beginnings of words that labelled documents suggest (``induce``), and patterns over the
   hits (several different ones, dense ones, addressed to a reader, shouted); some voters speak for
   a clean text. A text's votes are the bits of one integer.
2. Label model. Votes of all documents that are not held out are counted on Spark by pattern. EM fits
   a model of two classes in which each voter has its own rates of firing in toxic and in
   clean texts (its accuracy), and depends on at most one other voter: the tree of these
   correlations is the one of greatest conditional mutual information, so voters that say the same thing
   do not count twice. Each round's expected counts are summed on Spark, over all patterns.
   Labels only give the share of toxic documents that EM starts from.
3. Classifier. A logistic regression over words and beginnings of words is trained on the posteriors,
   not on labels; its score needs no voter to fire.

Beginnings are induced from at most ``SAMPLE`` documents of each label, and the classifier is trained on
at most ``SAMPLE`` documents whose posterior is 0.5 or more and as many others, both weighted to their true
shares; the former are taken by a hash of the id, the latter by one of the row key, so repeated ids do not
add up. Held-out documents take no part in anything but
scoring, and a document's labels, lang, source and id are never inputs of its score.

Null and empty texts score what the intercept says. Without labels no beginnings are induced and
the share starts at ``SHARE``. Repeated labels of a document count once: it is toxic if any of
them is 1. Repeated rows get equal scores; no documents give no rows. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.common import cut, held_out, keyed_texts, map_texts, slices
from sheafline.llm.maxscore import terms_of

SAMPLE = 4000
SHARE = 0.1
#: Beginnings of words that labels may add, and from how many toxic documents on.
STEMS = 32
LEAST_DOCS = 4
#: Features of the classifier.
FEATURES = 1500
#: Rounds of EM, and how many of them take voters to be independent.
ROUNDS, ALONE = 16, 2
STEPS = 400
#: Tasks that sum expected counts over the patterns of votes; patterns are far fewer than texts.
TASKS = 32
RATE = 0.05
L2 = 2e-4
_MEMO = 300_000
#: Marks a beginning that two different words of a text must share; no term holds it.
TWICE = "*"

# fixed values: families of insults, by the beginnings of their words
FAMILIES = {
    "idiot": ["idiot", "imbecil", "imbécil", "cretin", "crétin", "dummkopf", "schwachkopf"],
    "moron": ["moron", "dimwit", "halfwit", "tonto", "débile", "trottel"],
    "stupid": ["stupid", "estúpid", "estupid", "dumb", "bête", "blöd"],
    "loser": ["loser", "perdedor", "versager", "looser"],
    "worthless": ["worthless", "useless", "inútil", "wertlos", "nutzlos"],
    "pathetic": ["pathetic", "patétic", "pathétique", "erbärmlich", "minable"],
    "disgusting": ["disgusting", "revolting", "asqueros", "dégoûtant", "widerlich", "ekelhaft"],
    "scum": ["scum", "vermin", "escoria", "abschaum", "racaille"],
    "trash": ["trash", "garbage", "filth", "basura", "ordure", "dreck"],
    "clown": ["clown", "buffoon", "payas", "bouffon", "hanswurst"],
    "profane": ["shit", "fuck", "bitch", "bastard", "asshole", "arschloch", "merde", "mierda", "putain"],
    "hate": ["loathe", "despise", "odio", "hasse", "déteste"],
}
_ADDRESSED = re.compile(
    r"\b(?:you|ye|u)(?:'re| are| re)? (?:an? |such an? |all |just |nothing but )*(?:"
    + "|".join(s for f in FAMILIES.values() for s in f)
    + r")|\b(?:shut up|kill yourself|go to hell|drop dead|nobody likes you|i hate you)\b"
)
_SHOUTED = re.compile("|".join(s.upper() for f in FAMILIES.values() for s in f))
#: Patterns over a text, after the families and the induced beginnings; the last two speak for clean.
PATTERNS = ("several", "many", "dense", "addressed", "shouted", "none", "long_few")
_CLEAN = 2


class _Begins(dict):
    """Word -> bits of the families and beginnings it starts with."""

    def __init__(self, bits: dict[str, int]):
        super().__init__()
        self.bits = bits
        self.sizes = sorted({len(s) for s in bits})

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        w, out = word.decode("utf-8", "surrogatepass"), 0
        for n in self.sizes:
            out |= self.bits.get(w[:n], 0) if n <= len(w) else 0
        self[word] = out
        return out


class Voters:
    """All voters; ``votes`` gives a text's bits."""

    def __init__(self, stems: list[str] = ()):
        bits = {s: 1 << i for i, f in enumerate(FAMILIES.values()) for s in f}
        self.once, self.twice = (1 << len(FAMILIES)) - 1, 0
        for i, s in enumerate(stems, len(FAMILIES)):
            word = s.removesuffix(TWICE)
            bits[word] = bits.get(word, 0) | 1 << i
            if word == s:
                self.once |= 1 << i
            else:
                self.twice |= 1 << i
        self.names = [*FAMILIES, *stems, *PATTERNS]
        self.begins = _Begins(bits)
        self.first = len(FAMILIES) + len(stems)

    def votes(self, text: str) -> int:
        lower = text.lower()
        words = terms_of(lower)
        known = self.begins
        once = twice = 0
        begun = [x for x in map(known.__getitem__, set(words)) if x]
        for x in begun:
            twice |= once & x
            once |= x
        out = once & self.once | twice & self.twice
        hits = [x for x in begun if x & out]
        n = sum(1 for x in map(known.__getitem__, words) if x & out) if hits else 0
        fired = (
            len(hits) > 1,
            len(hits) > 3,
            100 * n > len(words),
            bool(hits) and bool(_ADDRESSED.search(lower)),
            bool(hits) and bool(_SHOUTED.search(text)),
            not hits,
            len(words) > 300 and n < 2,
        )  # in the order of PATTERNS
        for i, f in enumerate(fired):
            out |= f << (self.first + i)
        return out


# ---- beginnings that labels suggest -------------------------------------------------------


def beginnings(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters."""
    return [word[:k] for k in range(4, min(8, len(word) - 1) + 1)] + [word]


def features(text: str) -> set[str]:
    """Words and beginnings of a text; with ``TWICE``, beginnings of two or more of its words."""
    times = Counter(b for t in set(terms_of(text.lower())) for b in beginnings(t.decode("utf-8", "surrogatepass")))
    return {*times, *(b + TWICE for b, n in times.items() if n > 1)}


def _share(n: int, of: int, key: str = "doc_id") -> Column:
    """True for about n of ``of`` rows, by a hash of a key that no two of them share."""
    part = min(1 << 20, int((1 << 20) * n / max(1, of)) + 1)
    return F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(part)


def _counted(df: DataFrame, column: str) -> DataFrame:
    """For each word and beginning in ``text``: in how many rows, and the sums of ``column`` and
    ``weight`` over these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                total: dict[str, list[float]] = {}
                rows = zip(*(part.column(c).to_pylist() for c in ("text", column, "weight")))
                for text, y, w in rows:
                    for f in features(text):
                        x = total.get(f)
                        if x is None:
                            total[f] = [1, y * w, w]
                        else:
                            x[0] += 1
                            x[1] += y * w
                            x[2] += w
                names = ["feature", "n", "pos", "all"]
                columns = [list(total), *zip(*total.values())] if total else [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    made = df.select("text", F.col(column).cast("double").alias(column), "weight").mapInArrow(
        run, "feature string, n long, pos double, all double"
    )
    return made.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("all").alias("all"))


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``toxic`` of the labelled documents that may be learned from."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )


def induce(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], float]:
    """Beginnings of words that mark toxic documents, and the share of these among the labelled."""
    known = training_labels(labels)
    seen, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not seen or not toxic:
        return [], SHARE
    bad = F.col("toxic") == 1
    some = known.filter((bad & _share(sample, toxic)) | (~bad & _share(sample, seen - toxic)))
    # a bounded number of ids
    # each label stands for all of its documents, however many of them were taken
    toxic_weight, clean_weight = max(1.0, toxic / sample), max(1.0, (seen - toxic) / sample)
    weight = F.when(bad, F.lit(toxic_weight)).otherwise(F.lit(clean_weight))
    rows = keyed_texts(docs).join(F.broadcast(some), "doc_id").withColumn("weight", weight)
    found = _counted(rows.withColumn("toxic", bad.cast("int")), "toxic")
    # share of toxic ones, less than seen by what few documents leave open and by what the clean ones
    # that were not taken may hold
    sure = F.col("pos") / (F.col("all") + clean_weight - 1) - 1 / F.sqrt("n")
    found = found.withColumn("hits", F.round(F.col("pos") / toxic_weight))
    rated = found.filter(F.length("feature") >= 4).filter(F.col("hits") >= LEAST_DOCS).withColumn("sure", sure)
    rated = rated.filter("sure > 0.45").orderBy(F.desc(F.col("sure") * F.log1p("hits")), "feature").limit(40 * STEMS)
    stems: list[str] = []
    for r in rated.collect():
        new = r["feature"].removesuffix(TWICE)
        # of a beginning and a longer one that starts with it, the better one came first
        if not any(new.startswith(x) or x.startswith(new) for x in (s.removesuffix(TWICE) for s in stems)):
            stems.append(r["feature"])
    return stems[:STEMS], min(0.9, max(0.005, toxic / seen))


# ---- label model --------------------------------------------------------------------------


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(fires | class, whether the voter it depends on fires)."""

    prior: float
    parent: list[int]  # -1: depends on the class only
    rates: np.ndarray  # voter, class, parent fires

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for each row of bits."""
        bits = _bits(masks, len(self.parent))
        score = np.tile(np.log([1 - self.prior, self.prior]), (len(bits), 1))
        for j, up in enumerate(self.parent):
            given = bits[:, up] if up >= 0 else np.zeros(len(bits), int)
            for y in (0, 1):
                p = self.rates[j, y, given]
                score[:, y] += np.log(np.where(bits[:, j] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n)) & 1


def majority(masks: np.ndarray, n: int) -> np.ndarray:
    """Where EM starts: more voters for toxic than for clean."""
    bits = _bits(masks, n)
    return 1 / (1 + np.exp(-2.0 * (bits[:, : n - _CLEAN].sum(axis=1) - 2 * bits[:, n - _CLEAN :].sum(axis=1) - 0.5)))


def expected(masks: np.ndarray, times: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Expected numbers of documents by class, and pairs of voters that both fire: [2, n + 1, n + 1],
    where the last voter stands for one that always fires."""
    bits = np.c_[_bits(masks, n), np.ones(len(masks))]
    return np.stack([bits.T @ (bits * (times * w)[:, None]) for w in (1 - p, p)])


def dependence(stats: np.ndarray) -> np.ndarray:
    """Conditional mutual information of each two voters, given the class."""
    n = stats.shape[1] - 1
    out = np.zeros((n, n))
    total = stats[:, n, n].sum() + 1e-9
    for s in stats:
        size = s[n, n] + 2.0
        one = (s[:n, n] + 1) / size
        both = (s[:n, :n] + 2 * np.outer(one, one)) / size
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None, :]
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.clip(joint, 1e-12, 1)
                out += (s[n, n] / total) * joint * np.log(joint / np.clip(pa_ * pb, 1e-12, 1))
    np.fill_diagonal(out, 0)
    return out


def correlation_tree(stats: np.ndarray, least: float = 1e-3) -> list[int]:
    """For each voter the one it depends on: the spanning tree of greatest dependence, without
    the edges that carry next to none."""
    gain = dependence(stats)
    n = len(gain)
    parent, inside = [-1] * n, {0}
    while len(inside) < n:
        _, a, b = max((gain[a, b], -a, b) for a in inside for b in range(n) if b not in inside)
        a = -a
        parent[b] = a if gain[a, b] >= least else -1
        inside.add(b)
    return parent


def maximise(stats: np.ndarray, parent: list[int]) -> LabelModel:
    """The model of given expected counts."""
    n = stats.shape[1] - 1
    rates = np.empty((n, 2, 2))
    for j, up in enumerate(parent):
        for y in (0, 1):
            s = stats[y]
            on = (s[j, up], s[up, up]) if up >= 0 else (s[j, n], s[n, n])
            off = (s[j, n] - s[j, up], s[n, n] - s[up, up]) if up >= 0 else on
            for v, (k, m) in enumerate((off, on)):
                rates[j, y, v] = (max(0.0, k) + 0.1) / (max(0.0, m) + 1.0)
    size = stats[:, n, n]
    return LabelModel(float(np.clip(size[1] / max(1e-9, size.sum()), 1e-4, 0.9)), parent, np.clip(rates, 1e-5, 1 - 1e-5))


def fit_label_model(patterns: DataFrame, n: int, share: float = SHARE, rounds: int = ROUNDS) -> LabelModel:
    """EM over ``mask`` and ``times``; from the round ``ALONE`` on each round finds the tree anew."""

    def step(model: LabelModel | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, n + 1, n + 1))
            for batch in batches:
                masks, times = batch.column("mask").to_numpy(), batch.column("times").to_numpy()
                p = majority(masks, n) if model is None else model.posterior(masks)
                total += expected(masks, times, p, n)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        # 2 (n + 1)^2 numbers from each of at most TASKS tasks
        rows = patterns.mapInArrow(run, "sums binary").collect()
        return sum((np.frombuffer(r["sums"]).reshape(2, n + 1, n + 1) for r in rows), np.zeros((2, n + 1, n + 1)))

    parent = [-1] * n
    stats = step(None)
    model = maximise(stats, parent)
    model.prior = share
    for i in range(rounds):
        stats = step(model)
        if i >= ALONE:
            parent = correlation_tree(stats)
        model = maximise(stats, parent)
    return model


# ---- classifier -----------------------------------------------------------------------------


class _Weights(dict):
    """Word -> those of its beginnings that are features."""

    def __init__(self, features: dict[str, int]):
        super().__init__()
        self.features = features

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > _MEMO:
            self.clear()
        of = self.features
        begun = beginnings(word.decode("utf-8", "surrogatepass"))
        out = tuple(b for b in begun if b in of or b + TWICE in of)
        self[word] = out
        return out


class Linear:
    """Logistic regression over the presence of features."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self.known = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def present(self, text: str) -> list[int]:
        if self.known is None:
            self.known = _Weights({f: i for i, f in enumerate(self.features)})
        found = filter(None, map(self.known.__getitem__, set(terms_of(text.lower()))))
        times, of = Counter(b for x in found for b in x), self.known.features
        have = (f for b, n in times.items() for f in ((b, b + TWICE) if n > 1 else (b,)))
        return sorted(of[f] for f in have if f in of)

    def scores(self, texts: list[str]) -> np.ndarray:
        g = np.array([self.bias + self.weights[self.present(t)].sum() for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def train_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic loss against soft labels, by steps with momentum over all rows."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = weight / weight.sum()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = weight * (p - target)
        dw, db = x.T @ d + L2 * w, d.sum()
        m, mb = 0.9 * m + 0.1 * dw, 0.9 * mb + 0.1 * db
        v, vb = 0.999 * v + 0.001 * dw**2, 0.999 * vb + 0.001 * db**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b = b - RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return w, b


def voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """``row_key``, ``doc_id`` and ``mask`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(voters.names[len(FAMILIES) : voters.first])

    def run(texts: list[str]) -> dict[str, list]:
        own = _voters(tuple(shared.value))
        return {"mask": [own.votes(t) for t in texts]}

    return map_texts(keyed_texts(docs), run, "row_key long, doc_id long, mask long", ["row_key", "doc_id"])


_MADE: dict[tuple, Voters] = {}


def _voters(stems: tuple[str, ...]) -> Voters:
    """A worker's voters, with the words it has met."""
    if stems not in _MADE:
        _MADE.clear()
        _MADE[stems] = Voters(list(stems))
    return _MADE[stems]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear:
    """A classifier from the documents that are not held out."""
    spark = docs.sparkSession
    stems, share = induce(docs, labels, sample)
    voters = Voters(stems)
    n = len(voters.names)
    learn = docs.filter(~held_out(F.col("doc_id")))
    votes = cut(voted(learn, voters))
    patterns = cut(votes.groupBy("mask").agg(F.count(F.lit(1)).alias("times")).coalesce(TASKS))
    model = fit_label_model(patterns, n, share)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.posterior(batch.column("mask").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["x", "p"])

    high = F.col("p") >= 0.5
    rated = patterns.select(F.col("times").alias("x"), "mask").mapInArrow(label, "x long, p double")
    some, rest = rated.agg(
        F.coalesce(F.sum(F.when(high, F.col("x"))), F.lit(0)), F.coalesce(F.sum(F.when(~high, F.col("x"))), F.lit(0))
    ).first()
    own = votes.select("row_key", "mask").mapInArrow(label, "x long, p double").withColumnRenamed("x", "row_key")
    chosen = own.filter((high & _share(sample, some, "row_key")) | (~high & _share(sample, rest, "row_key")))
    weight = F.when(high, F.lit(max(1.0, some / sample))).otherwise(F.lit(max(1.0, rest / sample)))
    # about twice ``sample`` rows of three numbers
    chosen = cut(chosen.select("row_key", "p", weight.alias("weight")))
    texts = keyed_texts(learn).join(F.broadcast(chosen), "row_key")
    found = _counted(texts, "p")
    total, pos = chosen.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("p"))).first()
    if not total or not pos:
        return Linear([], np.zeros(0), float(np.log(share / (1 - share))))
    base = pos / total

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    on, off = F.col("pos"), F.col("all") - F.col("pos")
    gain = part(on, F.col("all") * base) + part(off, F.col("all") * (1 - base))
    rare = found.filter((F.col("n") >= 3) & (F.col("all") < 0.9 * total)).orderBy(F.desc(gain), "feature").limit(FEATURES)
    features = [r["feature"] for r in rare.collect()]
    empty = Linear(features, np.zeros(len(features)), 0.0)
    shared = spark.sparkContext.broadcast(empty)

    def design(rows: list[str]) -> dict[str, list]:
        return {"x": [shared.value.present(t) for t in rows]}

    made = map_texts(texts, design, "p double, weight double, x array<int>", ["p", "weight"]).toPandas()
    x = np.zeros((len(made), len(features)), np.float32)
    for i, at in enumerate(made["x"]):
        x[i, list(at)] = 1
    w, b = train_linear(x, made["p"].to_numpy(), made["weight"].to_numpy())
    return Linear(features, w, float(b))


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        s = shared.value.scores(texts)
        return {"score": s, "predicted": (s >= 0.7).astype(int)}

    made = map_texts(keyed_texts(docs), run, "doc_id long, score double, predicted int", ["doc_id"])
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
