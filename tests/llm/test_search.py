"""Ranked search beside scoring every document."""

import math
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sheafline.llm import maxscore

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, queries, k):
    """(item, rank, doc_id, score), every posting scored."""
    docs = [(d, Counter(terms(t))) for d, t in rows]
    total = sum(sum(c.values()) for _, c in docs)
    n_docs = sum(bool(c) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set(queries), key=str):
        asked, scored = terms(text), []
        for place, (doc, count) in enumerate(docs):
            n, score = sum(count.values()), 0
            for t in asked:
                if t in count:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * n * n_docs // total
                    score += w * (10**9 * count[t] // (1000 * count[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, place, doc))
        for rank, s in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, s[4], -s[0]))
    return sorted(out, key=str)


def ask(spark, table, queries, k):
    index = maxscore.build_index(table)
    made = maxscore.search(index, spark.createDataFrame(queries, "item_id long, text string"), k)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, made.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_same_as_scoring_all(spark, stored, monkeypatch, k):
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 7)
    random = np.random.default_rng(k)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    share /= share.sum()

    def text(n):
        return " ".join(random.choice(words, n, p=share))

    rows = [(i, text(int(random.integers(0, 60)))) for i in range(400)]
    queries = [(i, text(int(random.integers(1, 25)))) for i in range(20)]
    assert ask(spark, stored(rows), queries, k) == brute(rows, queries, k)


def test_edges(spark, stored, edge_rows):
    queries = [(1, "one TWO three word"), (1, "one TWO three word"), (2, None), (3, "  ,"), (4, "absent"),
               (None, "a ünïcode"), (5, "日本語, ÜNÏCODE a"), (6, "x" * 30_000)]
    table = stored(edge_rows)
    for c in "term n score rank query item_id segment row_key starts".split():
        table = table.withColumn(c, F.lit("clash"))
    got = ask(spark, table, queries, 20)
    want = brute([r[:2] for r in edge_rows], [(i, t) for i, t in queries], 20)
    assert got == want
    assert {r[0] for r in got} == {None, 1, 5, 6}


def test_empty_tables(spark, stored):
    assert ask(spark, stored([]), [(1, "a")], 20) == []
    assert ask(spark, stored([(1, "a")]), [], 20) == []


def segments(rows, queries, k):
    lengths, names, starts, docs, times = maxscore.postings([t for _, t in rows])
    row = {
        "segment": 0, "row_keys": np.arange(len(rows)).tobytes(), "doc_ids": [d for d, _ in rows],
        "lengths": lengths.tobytes(), "terms": names, "starts": starts.tobytes(),
        "docs": docs.tobytes(), "times": times.tobytes(),
    }
    df = dict(zip(names.split(), np.diff(starts).tolist()))
    block = maxscore.plan_block(queries, int(np.count_nonzero(lengths)), int(lengths.sum()), df)
    made = maxscore.impacts_of(row, block, k)
    made = {c: v.tobytes() if isinstance(v, np.ndarray) else v for c, v in made.items()}
    return block, maxscore.Segment.of(made)


def test_bounds_hold_and_pairs_tighten_them():
    random = np.random.default_rng(4)
    # two frequent words that are never frequent together, beside rare ones
    rows = []
    for i in range(600):
        filler = " ".join(f"r{x}" for x in random.integers(0, 300, 12))
        rows.append((i, f"{'aa ' * 9 if i % 2 else 'bb ' * 9}{filler}"))
    block, segment = segments(rows, [(1, "aa bb r1 r2 r3")], 5)
    (order, counts, beside) = block.queries[0]
    bounds = maxscore.rest_bounds(order, counts, beside, segment.best, segment.pair_best)
    apart = [int((segment.best[order[i:]] * counts[i:]).sum()) for i in range(len(order) + 1)]
    assert all(b <= a for a, b in zip(apart, bounds)) and bounds[-3] < apart[-3]
    dense = np.zeros((len(order), len(rows)), np.int64)
    for i, t in enumerate(order):
        found = slice(segment.starts[t], segment.starts[t + 1])
        dense[i, segment.docs[found]] = segment.impacts[found] * counts[i]
    for i, b in enumerate(bounds[:-1]):
        assert dense[i:].sum(axis=0).max() <= b
    docs, score = segment.top(block.queries[0], 5)
    exact = np.sort(dense.sum(axis=0))[::-1]
    assert sorted(score.tolist(), reverse=True)[:5] == exact[:5].tolist()
    # the lists of the frequent words are not read as a whole
    assert segment.looked_up < len(rows) / 2


def test_rows_of_an_index_are_stored_and_read_a_few_at_a_time(spark, stored, monkeypatch):
    monkeypatch.setattr(maxscore, "SEGMENT_BYTES", 50_000)
    monkeypatch.setattr(maxscore, "ROW_GROUP", 200_000)
    monkeypatch.setattr(maxscore, "BATCH_BYTES", 300_000, raising=False)
    random = np.random.default_rng(7)
    rows = [(i, " ".join(f"{x:06x}" for x in random.integers(0, 1 << 20, 6_000))) for i in range(40)]
    queries = [(i, " ".join(rows[i][1].split()[:40])) for i in range(3)]
    rows_of = maxscore._rows

    def few(batches):
        for batch in batches:
            assert batch.num_rows == 1 or batch.nbytes < 600_000, f"{batch.num_rows} rows, {batch.nbytes} bytes"
            yield from rows_of([batch])

    monkeypatch.setattr(maxscore, "_rows", few)
    index = maxscore.build_index(stored(rows, 1))
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = sorted(map(tuple, maxscore.search(index, asked, 5).collect()), key=str)
    assert got == brute(rows, queries, 5)
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in index.inputFiles()]
    assert sum(f.num_rows for f in files) == len(rows)
    assert max(f.row_group(g).num_rows for f in files for g in range(f.num_row_groups)) <= 4


def test_a_session_keeps_its_own_bound_of_batches(spark, stored):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    table = stored([(1, "a b"), (2, "b")])
    try:
        for own in ("20m", None):
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)
            with maxscore.small_batches(spark):
                assert spark.conf.get(key) == str(maxscore.BATCH_BYTES)
            assert len(ask(spark, table, [(1, "b")], 20)) == 2
            assert spark.conf.get(key, None) == own
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_segments_are_full_whatever_the_batches_hold():
    texts = ["abcd"] * 30 + ["x" * 70, "", "", "é" * 10] + ["abcd"] * 15
    for n in (1, 3, 100):
        batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + n]}) for i in range(0, len(texts), n)]
        batches.insert(1, pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())}))
        made = [t.column("text").to_pylist() for t in maxscore.segments(iter(batches), 40)]
        assert [t for part in made for t in part] == texts
        size = [sum(len(t.encode()) for t in part) for part in made]
        assert all(s <= 40 or len(part) == 1 for s, part in zip(size, made))
        # 270 bytes: full ones, however small the batches
        assert len(made) <= 10
