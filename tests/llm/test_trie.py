"""The prefix trie beside one built node by node."""

import hashlib
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sorted(own.items()):
        h = crc32(str(conv).encode()) % 9
        base = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        path = [t[2:] for t in [*own.get(base, [])[:h], *turns[h:]]]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
        ends[tuple(path)].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[c] for c in below)
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def nodes(table, **more):
    made = trie.conversation_trie(table, **more)
    assert made.columns == trie.COLUMNS
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, made.collect()))


def talks(seed, convs=60, longest=14):
    """Conversations over few texts, so that prefixes meet; some long ones, copied and cut short."""
    random = np.random.default_rng(seed)
    rows = []
    for conv in range(-7, convs):
        for turn in range(int(random.integers(0, longest))):
            rows.append((conv, turn, str(random.choice(["user", "ä"])), "x" * int(random.integers(0, 2))))
    long = [(t, "user", f"turn {t % 3}") for t in range(40)]
    for conv, n in ((1000, 40), (1010, 40), (1025, 33), (1030, 20), (1044, 40)):
        rows += [(conv, *t) for t in long[:n]]
    return rows


@pytest.mark.parametrize("more", [{}, {"shallow": 2}, {"shallow": 1, "group_rows": 10}, {"shallow": 3, "group_rows": 60}])
def test_same_as_built(spark, more):
    rows = talks(3)
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(5), **more) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "b", "z"),
        (6, None, "user", "x" * 50_000), (6, 2, None, "é日"), (7, 1, "user", ""), (10, 3, "", None), (11, 3, None, ""),
        (-3, 0, "user", "n"), (0, 0, "user", "n"), (2**62, 1, "r", "t"),
    ]
    rows += [(c, t, "user", "same") for c in (20, 21, 22, 30, 35) for t in range(3)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in "depth x1 x2 i h k base own path bytes cut n_convs _p".split():
        table = table.withColumn(c, F.lit("clash"))
    assert nodes(table) == brute(rows)


def test_empty_table(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []


def test_many_ids_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_RANGE", 16)
    rows = [(c, 0, "user", "hello") for c in range(-40, 400)]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_one_long_conversation_spreads(spark):
    """Running sums over many ranges of one key."""
    rows = [(1, t, (t * 7919) % 1000) for t in range(5000)] + [(2, t, t) for t in range(3)]
    table = spark.createDataFrame(rows, "k long, t long, g long")
    made = {(r["k"], r["t"]): (r["i"], r["x"]) for r in
            trie.running(table, "k", [F.asc("t")], {"i": "1", "x": "g"}).collect()}
    for key in (1, 2):
        mine = [r for r in rows if r[0] == key]
        xors = np.bitwise_xor.accumulate([r[2] for r in mine])
        assert [made[r[:2]] for r in mine] == [(i + 1, int(x)) for i, x in enumerate(xors)]
