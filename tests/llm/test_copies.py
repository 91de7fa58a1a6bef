"""Exact and near copies and repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from sheafline.llm import bktree, dedup, spans

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def groups_of(rows):
    """Brute force: (doc_id, keep_id, group_size, kept) for distinct ids."""
    by = {}
    for d, t, *_ in rows:
        by.setdefault(BLANKS.sub(" ", t or ""), []).append(d)
    return sorted((d, min(g), len(g), d == min(g)) for g in by.values() for d in g)


@pytest.mark.parametrize("primes", [dedup.PRIMES, (5, 7)])
@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_exact_groups(stored, primes, chunk):
    """With small primes most fingerprints collide, and the comparison has to part them."""
    rnd = random.Random(3)
    texts = ["", None, " ", "a  b", "a b", "a\tb", "abcd" * 3, "abcd" * 3 + "e", "é" * 9]
    texts += ["".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    rows = list(enumerate(texts + ["hot copy"] * 60))
    got = dedup.exact_groups(stored(rows), primes=primes, chunk_bytes=chunk).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == groups_of(rows)


def test_hashes_compose(spark):
    """The hash of a text does not depend on where it is cut."""
    text = "Ünïcode and a long tail " * 50
    rows = spark.createDataFrame([(1, text)], "row_key long, body string")
    found = {tuple(dedup.fingerprints(rows, chunk_bytes=c).first()["fp"]) for c in (1, 7, 64, 1 << 16)}
    n, h1, h2 = found.pop()
    assert not found and n == len(text.encode())
    for p, h in zip(dedup.PRIMES, (h1, h2)):
        want = 0
        for b in text.encode():
            want = (want * dedup.BASE + b + 1) % p
        assert want == h


def test_drop_copies_keeps_one_row(stored):
    rows = [(1, "x"), (1, "x"), (0, "x "), (None, "x"), (None, "y"), (None, "y")]
    got = dedup.drop_copies(stored(rows)).collect()
    kept = sorted(str((r["doc_id"], r["text"])) for r in got)
    assert kept == ["(0, 'x ')", "(1, 'x')", "(None, 'y')"]


def plain_fingerprint(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, d in enumerate(ids)}


def test_near_groups(stored):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(300)) for _ in range(6)]
    rows = [(0, None), (1, "…"), (2, "  "), (3, "A b C"), (4, "a B c")]
    for i in range(120):
        words = base[i % 6].split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = "new"
        rows.append((10 + i, " ".join(words)))
    rows += [(1000 + i, base[0]) for i in range(40)]
    got = {r["doc_id"]: r for r in bktree.near_groups(stored(rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    ids = [d for d, _ in rows]
    want = plain_components(ids, fps, 2)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert {d: r["fp"] % 2**64 for d, r in got.items()} == dict(zip(ids, fps))
    assert sum(r["kept"] for r in got.values()) == len(set(want.values()))
    assert len(set(want.values())) < len(set(fps))


@pytest.mark.parametrize("limit", [4096, 8, 1])
def test_links_lose_nothing(spark, limit):
    """Dense neighbourhoods, with shards that have to be cut again."""
    rnd = random.Random(limit)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(seeds) | {0, 2**64 - 1}
    for _ in range(700):
        x = rnd.choice(sorted(fps)) if rnd.random() < 0.5 else rnd.choice(seeds)
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = bktree.components(bktree.links(table, 2, limit))
    got = {r["node"]: r["root"] for r in roots.collect()}
    want = plain_components(signed, fps, 2)
    assert {s: got.get(s, s) for s in signed} == want


def test_forest_search():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 12, 600)).astype(np.uint64)
    shard = np.sort(rng.integers(0, 5, len(fps)))
    shard = np.unique(shard, return_inverse=True)[1]
    forest = bktree.Forest(fps, shard)
    q, o = forest.near(np.arange(len(fps)), 2)
    want = {
        (i, j)
        for i in range(len(fps))
        for j in range(len(fps))
        if i != j and shard[i] == shard[j] and int(fps[i] ^ fps[j]).bit_count() <= 2
    }
    assert set(zip(q.tolist(), o.tolist())) == want and len(q) == len(want)


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n) if i != 150], "a long, b long")
    got = {r["node"]: r["root"] for r in bktree.components(edges).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(1, n + 1) if i != 151}


def plain_spans(rows):
    seen, gone = set(), {}
    for d, text in sorted(rows):
        cut_up = spans.units(text or "")
        covered = set()
        for first, last in spans.runs(cut_up):
            key = tuple(w for _, _, words in cut_up[first:last] for w in words)
            key = " ".join(key)
            if key in seen:
                covered |= set(range(first, last))
            seen.add(key)
        gone[d] = sum(len(cut_up[i][2]) for i in covered)
    return gone


def test_repeated_passages(stored):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = " ".join(sentence(rnd.randint(5, 14)) for _ in range(7))
    long_sentence = sentence(60)
    rows = [(0, None), (1, ""), (2, "Short one. Short one.")]
    for i in range(3, 40):
        own = [sentence(rnd.randint(3, 12)) for _ in range(6)]
        own.insert(rnd.randrange(6), {0: passage, 1: long_sentence}.get(i % 3, "Common line."))
        rows.append((i, " ".join(own).replace(". ", ".  \n", i % 2)))
    got = {r["doc_id"]: r for r in spans.drop_repeated(stored(rows)).collect()}
    want = plain_spans(rows)
    assert {d: r["removed_words"] for d, r in got.items()} == want
    texts = dict(rows)
    assert got[3]["text"] == texts[3] and got[4]["text"] == texts[4]
    for d, r in got.items():
        if d > 4 and d % 3 < 2:
            assert r["removed_words"] >= 50
            kept = texts[d]
            for s in reversed(r["removed"]):
                kept = kept[: s["start"]] + kept[s["end"] :]
            assert r["text"].split() == kept.split()
        elif d > 4:
            assert r["text"] == texts[d] and not r["removed"]


def test_query_on_table(spark, sf):
    from sheafline.llm.queries import QUERIES

    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op5_sentence_spans"](spark, sf).select("doc_id", "removed_words").collect()
    assert {r["doc_id"]: r["removed_words"] for r in got} == plain_spans(table)
    got = QUERIES["op2_exact_dedup"](spark, sf).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == groups_of(table)
    got = QUERIES["op10_simhash"](spark, sf).collect()
    fps = [plain_fingerprint(t) for _, t in table]
    ids = [d for d, _ in table]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{f:016x}" for d, f in zip(ids, fps)}
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(ids, fps, 2)
