"""Prefix trie of conversations by truncation peeling.

The trie is never built. Starting at the greatest depth, the nodes of one depth are those that
survive from the depth below, their last turn stripped, and those of conversations that end
there; rows with the same prefix are regrouped into a node, whose figures are complete
at that moment, as everything below it has been merged. So nodes are found and aggregated
in the same pass, and a row of a node is written once.

A prefix is known by 128 bits: the XOR of hashes of its turns, each mixed with its depth, so the
prefixes of a conversation are running XORs. Conversations with the same turns are one
sequence from the start (their number, least id and list of ids are kept).

Shallow depths, where many conversations meet, are peeled by one grouping of Spark each.
From depth ``SHALLOW`` on, sequences are dealt out by their prefix of that depth, and a
task peels each group for itself down to it. A group of more than ``GROUP_ROWS`` turns and more than
one sequence is not dealt out there but at twice the depth (and so on); the
depths above are then peeled by groupings. A conversation that holds very many turns is numbered
and hashed over ranges of its turns, not in one task (``running``).

Turns are ordered by turn (null first), then role and text. Null roles and texts are empty;
rows with a null conv_id are left out; repeated rows are turns of their own. Without rows
there is no node. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sheafline.llm.common import cut, ship

#: A conversation starts with the first h turns of that of the next lower multiple of this.
FAMILY = 5
#: h is a hash of the id, below this.
HEADS = 9
SHALLOW = 8
GROUP_ROWS = 200_000
#: Ids of a node are joined in parts of so many consecutive ids.
ID_RANGE = 4096

NODE = (
    "conv_id long, depth long, x1 long, x2 long, p1 long, p2 long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, key: str, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Add running aggregates over each key's rows in ``order``: ``sums`` maps a new column to
    the column it XORs, or to ``1`` to number the rows.

    Rows are dealt out by ranges of key and order, so a hot key spreads over many tasks.
    Each range runs for itself; what a key has in earlier ranges is added then. Only keys
    that span ranges have any, so those rows are fewer than twice the ranges.
    """
    placed = cut(df.repartitionByRange(F.col(key), *order).withColumn("_p", F.spark_partition_id()))
    here = W.partitionBy("_p", key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)

    def folded(column: str) -> Column:
        return F.count(F.lit(1)) if column == "1" else F.bit_xor(column)

    parts = placed.groupBy(key, "_p").agg(*(folded(c).alias(n) for n, c in sums.items()))
    before = parts.select(
        key, "_p",
        *((F.sum(n) if c == "1" else F.bit_xor(n)).over(earlier).alias(f"{n}_") for n, c in sums.items()),
    ).filter(F.col(f"{next(iter(sums))}_").isNotNull())
    made = placed.select("*", *(folded(c).over(here).alias(n) for n, c in sums.items()))
    made = made.join(F.broadcast(before), [key, "_p"], "left")
    for n, c in sums.items():
        part = F.coalesce(F.col(f"{n}_"), F.lit(0))
        made = made.withColumn(n, F.col(n) + part if c == "1" else F.col(n).bitwiseXOR(part))
    return made.drop("_p", *(f"{n}_" for n in sums))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``i`` (from 1), two hashes of role and text, and the text's ``bytes``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
    ).filter("conv_id is not null")
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    made = running(given, "conv_id", order, {"i": "1"})
    return made.select(
        "conv_id", "i", F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("bytes"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and ``conv_id``, ``depth`` (from 1), ``x1``, ``x2`` (of the prefix that ends
    there), ``bytes`` of each rebuilt turn."""
    turns = cut(numbered_turns(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = cut(sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h")))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    heads = sizes.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("of_base", F.lit(0))).alias("k")
    )
    # at most HEADS - 1 turns of a base, for its family
    first = turns.filter(F.col("i") < HEADS).withColumnRenamed("conv_id", "base")
    given = heads.filter("k > 0").join(first, "base").filter("i <= k")
    given = given.select("conv_id", F.col("i").alias("depth"), "t1", "t2", "bytes")
    kept = turns.join(heads, "conv_id").filter("i > h")
    kept = kept.select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "t1", "t2", "bytes")
    mixed = given.unionByName(kept).select(
        "conv_id", F.col("depth").cast("int").alias("depth"), "bytes",
        F.xxhash64(F.lit(3), "depth", "t1", "t2").alias("g1"), F.xxhash64(F.lit(4), "depth", "t1", "t2").alias("g2"),
    )
    made = running(mixed, "conv_id", [F.asc("depth")], {"x1": "g1", "x2": "g2"})
    return sizes.select("conv_id"), cut(made.select("conv_id", "depth", "x1", "x2", "bytes"))


def sequences(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each distinct rebuilt conversation: ``conv_id`` (the least that has it), ``length``, ``n_convs``
    and ``ends_sha256`` of the ids."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "x1", "x2")).alias("end"))
    zero = F.lit(0).cast("long")
    whole = ids.join(ends, "conv_id", "left").select(
        "conv_id", F.coalesce("end.depth", F.lit(0)).alias("length"),
        F.coalesce("end.x1", zero).alias("x1"), F.coalesce("end.x2", zero).alias("x2"),
    )
    key = ["length", "x1", "x2"]
    # floor division, so that negative ids keep their order too
    part = (F.col("conv_id") - F.pmod("conv_id", F.lit(ID_RANGE))).alias("part")
    parts = whole.groupBy(*key, part).agg(
        F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams the parts of a sequence through one hash; nothing is gathered."""
        names = ["conv_id", "length", "n_convs", "ends_sha256"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*key, "least", "n", "ids"))))
        out: list[list] = [[] for _ in names]
        for (length, _, _), group in groupby(rows, key=lambda r: r[:3]):
            hashed, least, n = hashlib.sha256(), None, 0
            for _, _, _, low, m, ids in group:
                hashed.update(b"," * (n > 0) + ids.encode())
                least, n = low if least is None else least, n + m
            for o, x in zip(out, (least, length, n, hashed.hexdigest())):
                o.append(x)
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)

    ordered = parts.repartition(*key).sortWithinPartitions(*key, "part")
    return ordered.mapInArrow(digest, "conv_id long, length int, n_convs long, ends_sha256 string")


def dealt(seqs: DataFrame, paths: DataFrame, shallow: int, group_rows: int) -> tuple[DataFrame, int]:
    """``seqs`` with ``cut`` (the depth down to which it is peeled in its group, or its length) and the
    prefix of that depth; the greatest cut."""
    done, open_, at = [], seqs, shallow
    while True:
        done.append(
            open_.filter(F.col("length") <= at).select("*", F.col("length").alias("cut"),
                F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
        )
        here = paths.filter(F.col("depth") == at).select("conv_id", F.col("x1").alias("k1"), F.col("x2").alias("k2"))
        deep = cut(open_.filter(F.col("length") > at).join(here, "conv_id"))
        large = cut(
            deep.groupBy("k1", "k2").agg(F.sum(F.col("length") - at).alias("rows"), F.count(F.lit(1)).alias("seqs"))
            .filter((F.col("rows") > group_rows) & (F.col("seqs") > 1)).select("k1", "k2")
        )
        done.append(deep.join(large, ["k1", "k2"], "left_anti").withColumn("cut", F.lit(at)))
        if large.isEmpty():
            break
        open_ = deep.join(large, ["k1", "k2"], "left_semi").drop("k1", "k2")
        at *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut(out), at


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "row", "up")

    def __init__(self):
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, NO_ENDS
        self.row, self.up = 0, None


def peel(rows: list[tuple], cut_at: int) -> Iterator[tuple]:
    """Nodes deeper than ``cut_at`` of one group, as tuples of ``NODE``; the parent's id is left out
    where the parent is no longer in the group.

    ``rows`` are conv_id, depth, x1, x2, bytes, length, n_convs, ends_sha256, by conv_id and depth.
    """
    first: dict[int, int] = {}
    ends: defaultdict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] not in first:
            first[r[0]] = i
            ends[r[5]].append(r[0])
    alive: dict[tuple, _Node] = {}
    for depth in range(max(ends), cut_at - 1, -1):
        below, alive = alive, {}
        if depth > cut_at:
            for conv, ended in [*((n.conv, n) for n in below.values()), *((c, None) for c in ends.pop(depth, ()))]:
                i = first[conv] + depth - cut_at - 1  # this conversation's turn at this depth
                r = rows[i]
                node = alive.setdefault(r[2:4], _Node())
                if node.conv is None or conv < node.conv:
                    node.conv, node.row = conv, i
                if ended is None:
                    node.n += r[6]
                    node.ends = r[7]
                else:
                    ended.up = node
                    node.n += ended.n
                    node.children += 1
                    node.leaves += ended.leaves
                    node.saved += ended.saved
            for node in alive.values():
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * rows[node.row][4]
        for node in below.values():
            r = rows[node.row]
            parent = rows[node.row - 1][2:4] if node.up else (None, None)
            yield (
                node.conv, r[1], *r[2:4], *parent, node.up.conv if node.up else None, node.n,
                node.children, node.leaves, node.saved, node.ends,
            )


def deep_nodes(seqs: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes below the cut of their group, each group peeled in a task."""
    columns = "conv_id depth x1 x2 bytes length n_convs ends_sha256".split()
    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int32() if c.endswith("int") else pa.int64() for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "cut", *columns))))
        out: list[tuple] = []
        for (k1, k2, cut_at), group in groupby(rows, key=lambda r: r[:3]):
            for node in peel([r[3:] for r in group], cut_at):
                out.append(node if node[1] > cut_at + 1 else (*node[:4], k1, k2, *node[6:]))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    below = paths.join(seqs.filter("length > cut"), "conv_id").filter("depth > cut")
    dealt_out = below.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "cut", "conv_id", "depth")
    return dealt_out.select("k1", "k2", "cut", *columns).mapInArrow(run, NODE)


def peel_level(rows: DataFrame, depth: int) -> DataFrame:
    """Regroup rows of ``depth`` by their prefix into complete nodes.

    A row is a conversation that ends here (``children`` 0, ``leaves`` 0) or a child (1, its leaves).
    """
    last = F.element_at("path", depth) if depth else F.struct(*(F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "bytes")))
    grouped = rows.withColumn("at", last).groupBy("at.x1", "at.x2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
        F.first("path").alias("path"), F.first("at.bytes").alias("bytes"),
    )
    saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")
    return grouped.withColumns({"leaves": F.greatest("leaves", F.lit(1)), "saved": saved})


def conversation_trie(
    conversations: DataFrame, shallow: int = SHALLOW, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row for each node, with the columns ``COLUMNS``."""
    ship(conversations.sparkSession)
    ids, prefixes = rebuilt(conversations)
    seqs = cut(sequences(ids, prefixes))
    # only the least conversation of each sequence goes on
    paths = cut(prefixes.join(seqs.select("conv_id"), "conv_id", "left_semi"))
    seqs, deepest = dealt(seqs, paths, shallow, group_rows)
    deep = cut(deep_nodes(seqs, paths))
    head = paths.join(seqs.select("conv_id", "cut"), "conv_id").filter("depth <= cut")
    step = F.struct("depth", "x1", "x2", "bytes")
    steps = F.sort_array(F.collect_list(step)).cast("array<struct<depth:int,x1:long,x2:long,bytes:long>>")
    heads = head.groupBy("conv_id").agg(steps.alias("path"))
    empty = F.array().cast("array<struct<depth:int,x1:long,x2:long,bytes:long>>")
    long = lambda n: F.lit(n).cast("long")
    ended = seqs.filter("length = cut").select(
        "conv_id", "cut", "n_convs", long(0).alias("children"), long(0).alias("leaves"), long(0).alias("saved"),
        F.col("ends_sha256").alias("ends"),
    )
    tops = deep.filter("parent_conv_id is null").select(
        "conv_id", (F.col("depth") - 1).alias("cut"), "n_convs", long(1).alias("children"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"),
    )
    fresh = cut(ended.unionByName(tops).join(heads, "conv_id", "left").withColumn("path", F.coalesce("path", empty)))
    levels, alive = [], None
    for depth in range(deepest, -1, -1):
        rows = fresh.filter(F.col("cut") == depth).drop("cut")
        rows = rows if alive is None else rows.unionByName(alive)
        nodes = cut(peel_level(rows, depth))
        alive = nodes.select(
            "conv_id", "n_convs", long(1).alias("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends"),
            F.slice("path", 1, max(0, depth - 1)).alias("path"),
        )
        up = F.element_at("path", depth - 1) if depth > 1 else F.lit(None)
        levels.append(nodes.select(
            "conv_id", F.lit(depth).alias("depth"), "x1", "x2",
            (up["x1"] if depth > 1 else F.lit(0)).cast("long").alias("p1"),
            (up["x2"] if depth > 1 else F.lit(0)).cast("long").alias("p2"),
            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        ))
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    known = found.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    open_ = found.filter("depth > 0").unionByName(deep.filter("parent_conv_id is null"))
    # a parent is one row; its children may be many, and that side can be split
    joined = open_.join(known, ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("parent"))
    root = found.filter("depth = 0")
    return joined.select(*COLUMNS).unionByName(root.select(*COLUMNS)).unionByName(
        deep.filter("parent_conv_id is not null").select(*COLUMNS)
    )
