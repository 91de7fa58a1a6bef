"""Near copies by the similarity of their five-word shingles.

Two texts are near copies if the Jaccard similarity of their sets of shingles is at least
``SHARE``; groups are the components of that. No such pair is lost: in any one order of
all shingles, two sets that are similar enough have one in common among the first fifth
of each, so rows meet by the shingles of these prefixes. The order puts shingles of rare
cells first, by a table of counts of fixed size, so common lines bring few rows together.

Rows of equal sets are one node. First the nodes' fingerprints are linked through BK-trees, as in
``bktree``; of these pairs those count whose sets are similar enough. Similar sets may differ in more
bits than a search can follow, so the prefixes find the rest. Of buckets with the same nodes only the one of the
first shingle is kept, which is the first that any two of them share. In each bucket every node is compared with the
least one, then, round by round, nodes of other components with one that a hash picks for the bucket, as long as that joins many;
at last nodes of one bucket that are still in different components are compared in
pairs, so a large group of copies costs a few stars and not all its pairs. Before two sets
are compared, a bitmap of the parities of their hashes bounds how far they
differ from below, for the last pairs while they are made; only pairs that it lets through have their sets made again.

Words are as in ``bktree``: ASCII letters lowered, split at ASCII blanks. A text of fewer
than five words is one shingle. Null texts count as empty, and all empty texts are equal; a null id comes
behind all others, and of rows with one id the first in the table stays. Repeated rows are copies. No
documents give no rows. Extra columns go with their row and are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.bktree import _LOWER, components, fingerprints, links
from sheafline.llm.common import counted, cut, gathered, keyed_texts, ship, slices
from sheafline.operators.rows import maybe_among

SHINGLE = 5
#: Similarity from which two texts are near copies, as a fraction.
SHARE = (4, 5)
#: Cells of the table of counts that orders shingles, and how many go together.
CELLS = 1 << 22
BLOCK = 1 << 14
#: Bytes of text whose shingles are counted at once.
COUNTED = 1_000_000
#: Bits of a set's parity map.
PARITY = 2048
#: Stars go on while one in so many of a round's pairs is similar.
YIELD = 16
#: Powers of two between which the bits of the map of shared shingles lie.
FILTER_BITS = (20, 27)
MEMO_WORDS = 200_000
#: A text or its set counts as so many rows when tasks are made.
WIDE = 64
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Text -> sorted distinct 64-bit hashes of its shingles; a word is hashed once as long
    as it is known."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known = self.known
        if len(known) > MEMO_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        one = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(SHINGLE, len(one))
        made = np.full(max(1, len(one) - size + 1), size, dtype=np.uint64)
        for j in range(size):
            made = (made ^ one[j : j + len(made)]) * _PRIME
            made ^= made >> np.uint64(29)
        return np.unique(made)


def prefix_size(n: int) -> int:
    """How many of n shingles hold one that any set similar enough has among its own."""
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITY`` cells holds an odd number of the hashes, as bits of 64-bit numbers."""
    cells = (hashes >> np.uint64(40)) % np.uint64(PARITY)
    odd = np.bincount(cells.astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cell_counts(docs: DataFrame) -> np.ndarray:
    """How many rows' shingles fall into each of ``CELLS`` cells; a task counts up to 255 of a cell."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Shingles(), np.zeros(CELLS, dtype=np.uint8)
        for batch in batches:
            for part in slices(batch, COUNTED):
                cells = [own.of(t) % np.uint64(CELLS) for t in part.column("text").to_pylist()]
                some, n = np.unique(np.concatenate(cells), return_counts=True)
                total[some] = np.minimum(total[some] + n, 255)
        if total.any():
            blocks = total.reshape(-1, BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())],
                names=["block", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # blocks of this task
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.uint8).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in sums.values()], pa.binary())],
            names=["block", "counts"],
        )

    schema = "block int, counts binary"
    parts = keyed_texts(docs).select("text").mapInArrow(count, schema).repartition("block")
    counts = np.zeros((CELLS // BLOCK, BLOCK), dtype=np.uint16)
    for r in parts.mapInArrow(add, schema).collect():  # CELLS numbers
        counts[r["block"]] = np.frombuffer(r["counts"], np.uint16)
    return counts.ravel()


def shingled(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, ``h1`` and ``h2`` (hash of the set), ``n``, ``odd`` (parities) and
    ``prefix`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(cell_counts(docs))
    names = ["row_key", "doc_id", "h1", "h2", "n", "odd", "prefix"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Shingles(), shared.value
        for batch in batches:
            for part in slices(batch):
                made: list[list] = [[] for _ in kinds]
                for text in part.column("text").to_pylist():
                    hashes = own.of(text)
                    digest = xxhash.xxh3_128_digest(hashes.tobytes())
                    rare = counts[(hashes % np.uint64(CELLS)).astype(np.int64)]
                    first = np.lexsort((hashes, rare))[: prefix_size(len(hashes))]
                    for out, x in zip(made, (
                        int.from_bytes(digest[:8], "little", signed=True),
                        int.from_bytes(digest[8:], "little", signed=True),
                        len(hashes), parity(hashes), hashes[first].view(np.int64),
                    )):
                        out.append(x)
                columns = [part.column(c) for c in names[:2]]
                columns += [pa.array(x, kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row_key long, doc_id long, h1 long, h2 long, n long, odd array<long>, prefix array<long>"
    return keyed_texts(docs).mapInArrow(run, schema)


def texts_of(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id`` and ``text`` of the rows whose ``row_key`` is in ``own``, which has each once."""
    # no left semi join: Catalyst moves those below the bitmap, so that every text is shuffled
    return maybe_among(keyed_texts(docs), ["row_key"], own).join(own, "row_key")


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``a``, ``b`` of ``pairs`` whose sets are similar enough."""
    most, least = SHARE[1] - SHARE[0], SHARE[1] + SHARE[0]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            odd = [
                batch.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, PARITY // 64)
                for c in ("odd_a", "odd_b")
            ]
            # sets this similar differ in a ninth of both sizes at most
            differ = np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1, dtype=np.int64)
            differ = np.maximum(differ, np.abs(n[0] - n[1]))
            yield batch.select(["a", "b"]).filter(pa.array(differ * least <= (n[0] + n[1]) * most))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingles()
        for batch in batches:
            for part in slices(batch):
                made = [own.of(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_key"), pa.array(made, pa.binary())], names=["node", "set"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * SHARE[1] >= (len(x) + len(y) - both) * SHARE[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            own = right.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
            left = left.join(own.hint("merge"), side)
        return left

    pairs, rows = counted(cut(pairs))
    figures = nodes.select("node", "n", "odd")
    likely = gathered(beside(pairs, figures, ["n", "odd"]), rows).mapInArrow(bound, "a long, b long")
    likely, rows = counted(cut(likely))
    own = likely.select(F.explode(F.array("a", "b")).alias("row_key")).distinct()
    own = cut(gathered(own, 2 * rows))
    # texts and sets are wide
    made = cut(gathered(texts_of(docs, own), WIDE * rows).mapInArrow(sets, "node long, set binary"))
    return cut(gathered(beside(likely, made, ["set"]), WIDE * rows).mapInArrow(compare, "a long, b long"))


def _may_be_similar(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether two sets of these sizes can be similar if what stands ``at`` these places of
    their orders is the first that they share."""
    rest = F.least(n_a - at_a, n_b - at_b)
    return rest * (SHARE[0] + SHARE[1]) >= (n_a + n_b) * SHARE[0]


def _differ_little(n_a: Column, odd_a: Column, n_b: Column, odd_b: Column) -> Column:
    """As ``_similar`` bounds it by the parities."""
    differ = sum((F.bit_count(odd_a[i].bitwiseXOR(odd_b[i])) for i in range(PARITY // 64)), F.lit(0))
    return differ * (SHARE[1] + SHARE[0]) <= (n_a + n_b) * (SHARE[1] - SHARE[0])


def tree_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between ``nodes`` whose fingerprints the BK-trees link and whose sets are
    similar enough."""
    rows = fingerprints(docs, SHINGLE).select(F.col("row_key").alias("node"), "fp")
    prints, many = counted(cut(rows.join(nodes.select("node"), "node", "left_semi")))
    first = cut(gathered(prints.groupBy("fp").agg(F.min("node").alias("first")), many))
    found = links(first.select("fp"))
    for side in ("a", "b"):
        found = gathered(found.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_")), side), many)
    equal = prints.join(first, "fp").filter("node != first").select(F.col("first").alias("a_"), F.col("node").alias("b_"))
    pairs = found.select("a_", "b_").unionByName(equal)
    pairs = gathered(pairs.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct(), many)
    return _similar(docs, nodes, pairs)


def similar_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between ``nodes`` that span their components."""
    tokens = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    # nearly all shingles are in one set only, so their rows are told by counts and not shuffled
    several, many = counted(cut(tokens.groupBy("token").count().filter("count > 1").select("token")))
    # a small bitmap for few of them: the driver holds it several times
    bits = 1 << min(FILTER_BITS[1], max(FILTER_BITS[0], (64 * many).bit_length()))
    tokens, rows = counted(cut(maybe_among(tokens, ["token"], several, bits)))
    shared = tokens.groupBy("token").agg(
        F.min(F.struct("node", "n", "at")).alias("least"), F.count(F.lit(1)).alias("many"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    )
    # of buckets with the same nodes that of the first shingle, in the order of all
    shared = (
        gathered(shared.filter("many > 1"), rows).groupBy("x1", "x2", "many")
        .agg(F.min(F.struct("least.at", "token", "least")).alias("first")).select("first.token", "first.least")
    )
    shared = cut(gathered(shared, rows))
    buckets, rows = counted(cut(gathered(tokens.join(shared.hint("merge"), "token"), rows)))

    def stars(of: DataFrame) -> DataFrame:
        low = F.col("least")
        fits = _may_be_similar(F.col("n"), F.col("at"), low["n"], low["at"])
        ends = F.least(low["node"], "node").alias("a"), F.greatest(low["node"], "node").alias("b")
        return of.filter((F.col("node") != low["node"]) & fits).select(*ends)

    def mixed(roots: DataFrame, turn: int) -> DataFrame:
        """Rows of buckets that hold several components, with their ``root`` and a ``least`` by hash."""
        rooted = buckets.drop("least").join(roots.hint("merge"), "node", "left")
        rooted = gathered(rooted.withColumn("root", F.coalesce("root", "node")), rows)
        by_hash = F.min(F.struct(F.xxhash64("node", "token", F.lit(turn)), "node", "n", "at", "root"))
        several = (
            rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), by_hash.alias("least"))
            .filter("low != high").select("token", "least")
        )
        return cut(gathered(rooted.join(several.hint("merge"), "token"), rows))

    linked = tree_edges(docs, nodes)
    one = gathered(stars(buckets).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), rows)
    star = _similar(docs, nodes, gathered(one.join(linked.hint("merge"), ["a", "b"], "left_anti"), rows))
    roots = components(linked.unionByName(star))
    spanning = lambda: roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    turn = 0
    while True:
        open_ = mixed(roots, turn)
        apart, many = counted(cut(gathered(stars(open_.filter("root != least.root")).distinct(), rows)))
        turn += 1
        found = _similar(docs, nodes, apart) if many else None
        joined = found.count() if found is not None else 0
        if joined:  # else the components are as they were
            roots = components(spanning().unionByName(found))
        if joined * YIELD <= many:
            break
    open_ = gathered(mixed(roots, turn).drop("least").join(nodes.select("node", "odd"), "node"), WIDE * rows)
    other = open_.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "root", "odd")])
    rest = (
        open_.join(
            other,
            (open_["token"] == other["token"]) & (open_["node"] < F.col("node_b")) & (open_["root"] != F.col("root_b"))
            & _may_be_similar(open_["n"], open_["at"], F.col("n_b"), F.col("at_b"))
            & _differ_little(open_["n"], open_["odd"], F.col("n_b"), F.col("odd_b")),
        )
        .select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    )
    rest = gathered(rest, WIDE * rows).distinct()
    return spanning().unionByName(_similar(docs, nodes, rest))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, the first of each group, with all their columns."""
    # the row key decides before the arrays behind it are looked at
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n", "odd", "prefix"))
    sets = shingled(docs).groupBy("h1", "h2").agg(first.alias("low")).select("low.*")
    nodes, many = counted(cut(sets.withColumnRenamed("row_key", "node")))
    nodes = gathered(nodes, WIDE * many)  # their prefixes are many rows
    joined = components(similar_edges(docs, nodes))
    low = F.struct("none", "doc_id", F.col("node").alias("row_key")).alias("low")
    rooted = nodes.join(joined, "node", "left").select(low, F.coalesce("root", "node").alias("root"))
    keep = gathered(rooted, many).groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.row_key").alias("row_key_"))
    whole = docs.select(F.struct("*").alias("row_"), F.monotonically_increasing_id().alias("row_key_"))
    return whole.join(keep, "row_key_", "left_semi").select("row_.*")
