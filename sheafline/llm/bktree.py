"""Near duplicates by 64-bit SimHash, linked through BK-trees.

Each text has a fingerprint of its word shingles. Different fingerprints at
most ``RADIUS`` bits apart are found in shards: a fingerprint is cut into
``RADIUS + 1`` blocks, two linked ones agree in at least one of them, and so each goes
to the shard of every block's value. A shard with more than ``SHARD_LIMIT`` fingerprints is cut again, by
blocks of the bits that its fingerprints do not share, which again loses no
link. A shard's fingerprints form a BK-tree: a node's children are keyed by their
Hamming distance to it, and a query that lies d bits from a node follows only
the edges d - radius to d + radius. Each fingerprint is looked up in its shards'
trees; a shard hands on one edge for each fingerprint it could join to a smaller
one, never all pairs. Components over those edges are found by alternating
large-star and small-star steps.

Shards travel by shuffle to the task that builds their trees: together they grow with the
input, so they are not broadcast. Copies are folded into one fingerprint before any
of this, on the map side, so a group of copies is one node however large it is.

Null texts count as empty. A text without words has fingerprint zero. A null
doc_id never becomes a component's id unless all of its ids are null. No documents
give no rows. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.common import counted, cut, gathered, keyed_texts, map_texts

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a shard before it is cut again by further blocks.
SHARD_LIMIT = 4096
BITS = 64
#: Look-ups that are followed through the trees at a time.
QUERIES = 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    words = text.encode("utf-8").translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        m = min(4096, n - at)
        hashes = np.fromiter(
            (hash_(b" ".join(words[i : i + shingle]), SEED) for i in range(at, at + m)),
            dtype="<u8", count=m,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``row_key``, ``doc_id`` and ``fp`` (the 64 bits as a signed long)."""

    def run(texts: list[str]) -> dict[str, list]:
        fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return {"fp": fps.view(np.int64)}

    schema = "row_key long, doc_id long, fp long"
    return map_texts(keyed_texts(docs), run, schema, ["row_key", "doc_id"])


def blocks(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """Cut the free bit ranges (first bit, width) into ``parts`` of about equal width."""
    bits = [b for at, w in free for b in range(at, at + w)]
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        ranges: list[tuple[int, int]] = []
        for b in bits[lo:hi]:
            if ranges and sum(ranges[-1]) == b:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + 1)
            else:
                ranges.append((b, 1))
        out.append(ranges)
    return out


class Forest:
    """BK-trees of many shards, built and searched level by level in arrays."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """``fps`` (unsigned), distinct within a ``shard``; shards are numbered from 0, in order."""
        n = len(fps)
        self.fps = fps
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = first[np.cumsum(np.r_[False, shard[1:] != shard[:-1]])]
        item = np.setdiff1d(np.arange(n), first)
        at = self.root[item]
        keys, kids = [], []
        while len(item):
            d = np.bitwise_count(fps[item] ^ fps[at]).astype(np.int64)
            edge = at * (BITS + 1) + d
            edges, lead = np.unique(edge, return_index=True)
            child = item[lead]  # the first to come along an edge is the child there
            keys.append(edges)
            kids.append(child)
            rest = np.ones(len(item), dtype=bool)
            rest[lead] = False
            at = child[np.searchsorted(edges, edge[rest])]
            item = item[rest]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.kid = (np.concatenate(kids) if kids else np.empty(0, np.int64))[order]

    def near(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of places at most ``radius`` apart in one tree."""
        at, found_q, found_n = self.root[query], [], []
        while len(query):
            d = np.bitwise_count(self.fps[query] ^ self.fps[at]).astype(np.int64)
            hit = (d <= radius) & (at != query)
            found_q.append(query[hit])
            found_n.append(at[hit])
            base = at * (BITS + 1)
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 1))
            hi = np.searchsorted(self.key, base + np.minimum(d + radius, BITS), side="right")
            many = hi - lo
            query = np.repeat(query, many)
            at = self.kid[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(query))]
        return np.concatenate(found_q), np.concatenate(found_n)


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place it is joined to, directly or not."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def shard_links(sharded: DataFrame, radius: int) -> DataFrame:
    """Edges ``a > b`` between the ``fp`` of rows with the same ``shard``, which spans each
    shard's components. Shards come whole to a task, several at a time."""

    def links(fps: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((fps, shard))
        fps, shard = fps[order], shard[order]
        n = len(fps)
        edge = np.r_[True, shard[1:] != shard[:-1]]
        size = np.diff(np.r_[np.flatnonzero(edge), n])
        several = np.repeat(size > 1, size)
        fps, edge = fps[several], edge[several]
        n = len(fps)
        if n == 0:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        forest = Forest(fps.view(np.uint64), np.cumsum(edge) - 1)
        label = np.arange(n)
        for at in range(0, n, QUERIES):
            q, o = forest.near(np.arange(at, min(n, at + QUERIES)), radius)
            later = o < q  # each pair once
            q, o = q[later], o[later]
            # joined to what earlier look-ups found
            label = smallest_linked(
                n, np.r_[q, np.arange(n)], np.r_[o, label]
            )
        some = label != np.arange(n)
        # fps are sorted as signed numbers within a shard, so the label is the smaller one
        return pd.DataFrame({"a": fps[some], "b": fps[label[some]]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for df in parts:
            held.append(df)
            rows += len(df)
            if rows < QUERIES:
                continue
            df = pd.concat(held)
            last = (df["shard"] == df["shard"].iloc[-1]).to_numpy()
            if last.all():
                held, rows = [df], len(df)
                continue
            yield links(df["fp"].to_numpy()[~last], df["shard"].to_numpy()[~last])
            held, rows = [df[last]], int(last.sum())
        if held:
            df = pd.concat(held)
            yield links(df["fp"].to_numpy(), df["shard"].to_numpy())

    return (
        sharded.select("shard", "fp")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInPandas(run, "a long, b long")
        .distinct()
    )


def links(fps: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """Edges that join all of the distinct ``fp`` (long) within ``radius`` bits."""

    def spread(rows: DataFrame, free: list[tuple[int, int]], level: int):
        """A frame for each block of the free bits, with what is free below it."""
        out = []
        for own in blocks(free, radius + 1):
            value = F.lit(0).cast("long")
            for at, width in own:
                bits = F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)
                value = F.shiftleft(value, width).bitwiseOR(bits)
            taken = {b for at, w in own for b in range(at, at + w)}
            left = [(b, 1) for at, w in free for b in range(at, at + w) if b not in taken]
            key = F.xxhash64(F.col("shard"), F.lit(level), F.lit(own[0][0]), value)
            out.append((rows.select("fp", key.alias("shard")), left))
        return out

    todo = [(fps.select("fp", F.lit(0).cast("long").alias("shard")), [(0, BITS)])]
    edges = []
    for level in range(4):
        parts = [p for rows, free in todo for p in spread(rows, free, level)]
        tagged = None
        for i, (rows, _) in enumerate(parts):
            rows = rows.withColumn("part", F.lit(i))
            tagged = rows if tagged is None else tagged.unionByName(rows)
        tagged = cut(tagged)
        size = tagged.groupBy("shard").count().filter(F.col("count") > limit).select("shard")
        large = cut(size)
        free_bits = len([b for at, w in parts[0][1] for b in range(at, at + w)])
        # with few free bits a shard holds no more fingerprints than they can tell apart
        if large.isEmpty() or free_bits <= 20:
            edges.append(shard_links(tagged, radius))
            break
        edges.append(shard_links(tagged.join(large, "shard", "left_anti"), radius))
        more = cut(tagged.join(large, "shard", "left_semi"))
        seen = {r["part"] for r in more.select("part").distinct().collect()}  # few parts
        todo = [
            (more.filter(F.col("part") == i).select("fp", "shard"), free)
            for i, (_, free) in enumerate(parts)
            if i in seen
        ]
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.unionByName(e)
    return whole


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of the edges ``a, b`` is joined to.

    Alternates large-star and small-star steps until no edge changes. In each step
    a node's neighbours are folded to their minimum and joined back, so a node with
    very many neighbours is never gathered in one place.
    """
    edges, rows = counted(
        cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    )
    seen = None
    while True:
        # large star: each larger neighbour of a node to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a").join(low.hint("merge"), "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        )
        large = gathered(gathered(large, rows).distinct(), rows)
        # small star: a node and its smaller neighbours to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low.hint("merge"), "a")
            .select(F.col("b").alias("x"), "m").filter("x != m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        )
        small = gathered(small, rows).unionByName(gathered(low.select("a", F.col("m").alias("b")), rows)).distinct()
        edges = cut(gathered(small, rows))
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)


def near_groups(
    docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, limit: int = SHARD_LIMIT
) -> DataFrame:
    """``row_key``, ``doc_id``, ``fp`` (long) and ``component_id`` for each row of ``docs``,
    and ``kept``: true for the first row of each component."""
    rows = cut(fingerprints(docs, shingle))
    lowest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("low")
    fps = cut(rows.groupBy("fp").agg(lowest))
    joined = components(links(fps, radius, limit))
    rooted = fps.join(joined, fps["fp"] == joined["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    low = rooted.groupBy("root").agg(F.min("low").alias("least"))
    of_fp = rooted.join(low, "root").select("fp", "least")
    return rows.join(of_fp, "fp").select(
        "row_key", "doc_id", "fp", F.col("least.doc_id").alias("component_id"),
        (F.col("row_key") == F.col("least.row_key")).alias("kept"),
    )


def hex64(fp: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keep = near_groups(docs, radius, shingle).filter("kept").select(F.col("row_key").alias("row_key_"))
    whole = docs.select(F.struct("*").alias("row_"), F.monotonically_increasing_id().alias("row_key_"))
    return whole.join(keep, "row_key_", "left_semi").select("row_.*")
