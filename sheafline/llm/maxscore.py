"""Ranked lexical search: MaxScore with bounds of term pairs.

Three steps, each a stored table:

``build_index`` turns every text into postings. A row of the index is a segment of some
megabytes of text: its terms, the documents and frequencies of each, and the documents'
lengths. ``impact_index`` adds what a block of queries needs: the score that each posting
gives (its impact), each term's highest and k-th highest impact, and for pairs of terms
that stand side by side in some query the intersection of their lists, of which the highest
and the k-th highest joint impact are stored. ``search`` answers the queries on each segment,
and only the k best rows of a segment leave its task.

A query's terms are taken from rare to frequent. What the terms not yet taken can add at
most is the least sum over ways to part them into single terms and stored pairs: a pair's
joint maximum is often below the sum of its terms' own, as frequent terms are seldom
both strongest in one document. Once no new document can reach the k-th best score so far,
only those already met are looked up in the other lists, and they go as soon as the
bound says so. Bounds only ever skip documents that cannot be among the k best, so
the result is the same as that of scoring every posting. The k-th highest impacts of terms and
pairs give each query a threshold to start with.

Terms are the maximal runs of ASCII letters, digits and characters above U+007F, with
only A-Z lower-cased. Scores are 64-bit integers (see ``weight``, ``norms``, ``base_impact``).

Null texts have no terms and are never found; null ids are found and come last among
equal scores. Repeated rows are documents of their own; equal scores and ids are ordered by
their place in the table. Repeated queries (same id and text) are answered once; two texts under
one id are ranked each for itself. A query without terms gives no rows, as do empty tables.
Extra columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sheafline.llm.common import keyed_texts, scratch_path, slices
from sheafline.operators.ranking import first_n

#: Documents returned for each query.
TOP = 20
#: Queries, and bytes of their texts, that are answered in one pass over the index.
BLOCK_QUERIES = 2000
BLOCK_BYTES = 16_000_000
#: Text that one segment of the index holds, unless a single text is longer.
SEGMENT_BYTES = 4_000_000
ROW_GROUP = 4 << 20
#: Bytes after which a batch of rows goes to Python: one row of an index, or some hundred texts.
BATCH_BYTES = 1 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Length normalisation: a document of mean length has 100.
FLAT, SLOPE = 75, 25

INDEX = (
    "segment long, row_keys binary, doc_ids array<long>, lengths binary, terms binary, "
    "starts binary, docs binary, times binary"
)
IMPACTS = (
    "segment long, row_keys binary, doc_ids array<long>, starts binary, docs binary, "
    "impacts binary, best binary, kth binary, pair_best binary, pair_kth binary"
)

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def weight(n_docs: int, df: int) -> int:
    """A term's weight from the documents that have a term and those that have this one."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's length, as a hundredfold of the mean, damped."""
    return FLAT + (SLOPE * n_docs * lengths.astype(np.int64)) // max(1, n_terms)


def base_impact(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a posting gives for each unit of its term's weight."""
    times = times.astype(np.int64)
    return (1_000_000_000 * times) // (1000 * times + 12 * norm)


# ---- index ------------------------------------------------------------------------------


def postings(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, joined terms, where each term's postings start, their documents and times."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    n = max(1, len(texts))
    lengths, keys = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = terms_of(text)
        lengths[i] = len(words)
        keys.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) * n + i)
    flat, times = np.unique(np.concatenate(keys or [lengths]), return_counts=True)
    term, doc = np.divmod(flat, n)
    starts = np.searchsorted(term, np.arange(len(known) + 1))
    return lengths, b" ".join(known), starts, doc.astype(np.int32), times.astype(np.int32)


def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in segments of at most ``most`` bytes of text, or one row, whatever Arrow's batches hold."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, most):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + more > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held)


def build_index(docs: DataFrame) -> DataFrame:
    """All documents as a stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for part in segments(batches, SEGMENT_BYTES):
            lengths, terms, starts, doc, times = postings(part.column("text").to_pylist())
            yield _row(INDEX, {
                "segment": segment,
                "row_keys": part.column("row_key").to_numpy(),
                "doc_ids": part.column("doc_id").to_pylist(),
                "lengths": lengths,
                "terms": terms,
                "starts": starts,
                "docs": doc,
                "times": times,
            })
            segment += 1

    return _stored(keyed_texts(docs).mapInArrow(run, INDEX), "lexical-index")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python by ``BATCH_BYTES``; a session's own bound, of 64 MB, would be
    held several times over beside the JVM's heap in each task."""
    before = spark.conf.get(_BATCHES, None)
    spark.conf.set(_BATCHES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCHES)
        else:
            spark.conf.set(_BATCHES, before)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    # a row holds megabytes: small row groups, so that neither side holds many at once; Parquet would look at
    # their size after 100 rows at first, and take each value for one that may come again
    size = {
        "parquet.block.size": ROW_GROUP,
        "parquet.page.size.row.check.min": 1,
        "parquet.page.size.row.check.max": 1,
        "parquet.enable.dictionary": False,
    }
    with small_batches(df.sparkSession):
        df.write.options(**size).parquet(path)
    return df.sparkSession.read.parquet(path)


def _row(schema: str, values: dict) -> pa.RecordBatch:
    """One row; numpy arrays become their bytes."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, put = [], []
    for column in schema.split(", "):
        name, kind = column.split()
        value = values[name]
        value = value.tobytes() if isinstance(value, np.ndarray) else value
        names.append(name)
        put.append(pa.array([value], kinds[kind]))
    return pa.RecordBatch.from_arrays(put, names=names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _ints(blob: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(blob, kind)


# ---- queries ----------------------------------------------------------------------------


@dataclass
class Block:
    """Queries that share a pass: ``ids`` and, for each, its terms from rare to frequent with
    their counts, and the number of the pair that each makes with the next."""

    ids: list[int | None]
    terms: list[bytes]
    weights: np.ndarray
    queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    pairs: np.ndarray
    n_docs: int
    n_terms: int


def frequencies(index: DataFrame, terms: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and how many documents hold each of ``terms``."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, found = 0, 0, Counter()
        for row in _rows(batches):
            lengths, starts = _ints(row["lengths"]), _ints(row["starts"])
            n_docs += int(np.count_nonzero(lengths))
            n_terms += int(lengths.sum())
            size = np.diff(starts)
            for i, t in enumerate(row["terms"].split()):
                if t in shared.value:
                    found[t] += int(size[i])
        names = [b" docs", b" terms", *found]  # no term begins with a blank
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([n_docs, n_terms, *found.values()], pa.int64())],
            names=["term", "n"],
        )

    made = index.select("lengths", "terms", "starts").mapInArrow(run, "term binary, n long")
    # a row for each term of a block of queries
    with small_batches(index.sparkSession):
        total = {bytes(r["term"]): r["n"] for r in made.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return total.pop(b" docs", 0), total.pop(b" terms", 0), total


def plan_block(
    rows: list[tuple[int | None, str]], n_docs: int, n_terms: int, df: dict[bytes, int]
) -> Block:
    """Weights, order of terms and pairs of the queries ``rows``."""
    counted = [(i, Counter(t for t in terms_of(text) if t in df)) for i, text in rows]
    weights = {t: weight(n_docs, df[t]) for _, c in counted for t in c}
    terms = sorted((t for t in weights if weights[t] > 0), key=lambda t: (-weights[t], t))
    number = {t: i for i, t in enumerate(terms)}
    pairs: dict[tuple[int, int], int] = {}
    queries = []
    for _, count in counted:
        order = sorted(number[t] for t in count if t in number)
        beside = [pairs.setdefault(p, len(pairs)) for p in zip(order, order[1:])]
        queries.append((
            np.array(order, np.int64),
            np.array([count[terms[i]] for i in order], np.int64),
            np.array(beside, np.int64),
        ))
    return Block(
        [i for i, _ in rows], terms, np.array([weights[t] for t in terms], np.int64), queries,
        np.array(list(pairs), np.int64).reshape(-1, 2), n_docs, n_terms,
    )


def query_blocks(index: DataFrame, queries: DataFrame) -> Iterator[Block]:
    """The queries in blocks of about ``BLOCK_QUERIES`` rows and ``BLOCK_BYTES`` bytes."""
    named = queries.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows, size = named.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-rows // BLOCK_QUERIES), -(-(size or 0) // BLOCK_BYTES))
    for b in range(blocks):
        of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b
        part = [(r["item_id"], r["text"]) for r in named.filter(of).collect()]
        part.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if part:
            yield plan_block(part, *frequencies(index, {t for _, x in part for t in terms_of(x)}))


# ---- impacts and pairs ------------------------------------------------------------------


def kth_largest(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def impacts_of(row: dict, block: Block, k: int) -> dict:
    """The impact lists and pair bounds of one segment of the index."""
    starts, doc = _ints(row["starts"]), _ints(row["docs"], np.int32)
    times = _ints(row["times"], np.int32)
    norm = norms(_ints(row["lengths"]), block.n_docs, block.n_terms)
    place = {t: i for i, t in enumerate(row["terms"].split())}
    at = [place.get(t, -1) for t in block.terms]
    lists = [slice(starts[i], starts[i + 1]) if i >= 0 else slice(0, 0) for i in at]
    docs = [doc[s] for s in lists]
    impacts = [w * base_impact(times[s], norm[d]) for w, s, d in zip(block.weights, lists, docs)]
    best = np.array([int(x.max()) if len(x) else 0 for x in impacts], np.int64)
    kth = np.array([kth_largest(x, k) for x in impacts], np.int64)
    own = np.zeros(len(norm), np.int64)
    pair_best, pair_kth = np.zeros(len(block.pairs), np.int64), np.zeros(len(block.pairs), np.int64)
    last = -1
    # pairs with the same first term lie side by side, so its list is laid out once
    for p in np.lexsort((block.pairs[:, 1], block.pairs[:, 0])):
        a, b = block.pairs[p]
        if a != last:
            if last >= 0:
                own[docs[last]] = 0
            own[docs[a]] = impacts[a]
            last = a
        joint = own[docs[b]]
        both = joint > 0
        joint = joint[both] + impacts[b][both]
        pair_best[p] = joint.max() if len(joint) else 0
        pair_kth[p] = kth_largest(joint, k)
    return {
        "segment": row["segment"],
        "row_keys": row["row_keys"],
        "doc_ids": row["doc_ids"],
        "starts": np.cumsum([0, *map(len, docs)], dtype=np.int64),
        "docs": np.concatenate([*docs, np.empty(0, np.int32)]),
        "impacts": np.concatenate([*impacts, np.empty(0, np.int64)]),
        "best": best,
        "kth": kth,
        "pair_best": pair_best,
        "pair_kth": pair_kth,
    }


def impact_index(index: DataFrame, block: Block, k: int = TOP) -> DataFrame:
    """The stored impacts and pair bounds that a block of queries needs, by segment."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _row(IMPACTS, impacts_of(row, shared.value, k))

    return _stored(index.mapInArrow(run, IMPACTS), "impact-index")


# ---- search -----------------------------------------------------------------------------


def rest_bounds(
    order: np.ndarray, counts: np.ndarray, beside: np.ndarray,
    best: np.ndarray, pair_best: np.ndarray,
) -> list[int]:
    """For each place in ``order``, what the terms from there on can add at most.

    A pair adds no more than the larger of its joint maximum and its terms' own, times
    the larger of their counts in the query, and no more than its terms alone.
    """
    own = [int(c) * int(best[t]) for t, c in zip(order, counts)]
    rest = [0] * (len(order) + 2)
    for i in range(len(order) - 1, -1, -1):
        rest[i] = own[i] + rest[i + 1]
        if i + 1 < len(order):
            a, b = order[i], order[i + 1]
            joint = max(int(pair_best[beside[i]]), int(best[a]), int(best[b]))
            pair = min(int(max(counts[i], counts[i + 1])) * joint, own[i] + own[i + 1])
            rest[i] = min(rest[i], pair + rest[i + 2])
    return rest[: len(order) + 1]


@dataclass
class Segment:
    """One row of the impact index, ready to be searched."""

    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    best: np.ndarray
    kth: np.ndarray
    pair_best: np.ndarray
    pair_kth: np.ndarray
    size: int
    looked_up: int = 0  # postings that some query has read

    @classmethod
    def of(cls, row: dict) -> Segment:
        kinds = {"docs": np.int32}
        names = "starts docs impacts best kth pair_best pair_kth".split()
        return cls(*(_ints(row[c], kinds.get(c, np.int64)) for c in names), len(row["doc_ids"]))

    def top(self, query: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all that may be among the k best, ties at the end included."""
        order, counts, beside = query
        have = self.best[order] > 0 if len(order) else np.zeros(0, bool)
        if not have.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rest = rest_bounds(order, counts, beside, self.best, self.pair_best)
        floor = int((counts * self.kth[order]).max())
        if len(beside):
            floor = max(floor, int((np.minimum(counts[:-1], counts[1:]) * self.pair_kth[beside]).max()))
        total = np.zeros(self.size, np.int64)
        i = 0
        # a document not met so far may still be among the best
        while i < len(order) and rest[i] >= max(1, floor):
            found = slice(self.starts[order[i]], self.starts[order[i] + 1])
            docs = self.docs[found]
            total[docs] += counts[i] * self.impacts[found]
            self.looked_up += len(docs)
            i += 1
            if len(docs):
                floor = max(floor, kth_largest(total, k))
        alive = np.flatnonzero(total + rest[i] >= max(1, floor))
        alive = alive[total[alive] > 0]
        score = total[alive]
        while i < len(order):
            found = slice(self.starts[order[i]], self.starts[order[i] + 1])
            docs = self.docs[found]
            if len(docs):
                at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                hit = docs[at] == alive
                score = score + np.where(hit, counts[i] * self.impacts[found][at], 0)
                self.looked_up += len(alive)
            i += 1
            floor = max(floor, kth_largest(score, k))
            stays = score + rest[i] >= floor
            alive, score = alive[stays], score[stays]
        stays = score >= max(1, floor)
        return alive[stays], score[stays]


def search_block(impacts: DataFrame, block: Block, k: int = TOP) -> DataFrame:
    """``query`` (number in the block), ``doc_id``, ``row_key`` and ``score`` of each segment's k best."""
    shared = impacts.sparkSession.sparkContext.broadcast(block.queries)
    schema = "query int, doc_id long, row_key long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            segment, keys = Segment.of(row), _ints(row["row_keys"])
            ids = np.array([-1 if x is None else x for x in row["doc_ids"]], np.int64)
            absent = np.array([x is None for x in row["doc_ids"]], bool)
            out: list[list] = [[], [], [], []]
            for q, query in enumerate(shared.value):
                docs, score = segment.top(query, k)
                first = np.lexsort((keys[docs], ids[docs], absent[docs], -score))[:k]
                docs = docs[first]
                out[0] += [q] * len(docs)
                out[1] += [None if absent[d] else int(ids[d]) for d in docs]
                out[2] += keys[docs].tolist()
                out[3] += score[first].tolist()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, kinds)],
                names=["query", "doc_id", "row_key", "score"],
            )

    found = impacts.mapInArrow(run, schema)
    return first_n(found, ["query"], _best_first(), k)


def _best_first() -> list:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row_key")]


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the k best documents for each query
    (``item_id``, ``text``)."""
    spark = index.sparkSession
    found = None
    for block in query_blocks(index, queries):
        best = search_block(impact_index(index, block, k), block, k)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")
        # one row for each query of the block
        best = best.withColumn(
            "rank", F.row_number().over(W.partitionBy("query").orderBy(*_best_first()))
        ).join(F.broadcast(ids), "query")
        best = _stored(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found
