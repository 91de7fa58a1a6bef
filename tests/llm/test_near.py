"""The near-copy stage against brute-force similarity of five-word shingles."""

import random

from sheafline.llm import bktree, near


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The least id of each component of pairs with Jaccard >= 0.8."""
    ids = sorted(d for d, _ in rows)
    sets = {d: plain_set(t) for d, t in rows}
    group = {d: d for d in ids}
    pairs = 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                pairs += 1
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return set(group.values()), pairs


def test_all_similar_pairs_are_linked(stored):
    """Edits of every size around the limit, chains, a hot group and common lines."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    line = [word() for _ in range(30)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")]
    hot = [word() for _ in range(200)]
    for i in range(60):
        base = [word() for _ in range(rnd.choice([8, 30, 90, 300, 900]))]
        at = rnd.randrange(len(base))
        rows.append((10 + 4 * i, " ".join(base[:at] + line + base[at:])))
        copy = base[:at] + line + base[at:]
        for j in range(1, 4):
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((10 + 4 * i + j, " ".join(copy)))
    for i in range(150):
        copy = list(hot)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(200)] = word()
        rows.append((1000 + i, " ".join(copy)))
    want, pairs = plain_kept(rows)
    got = {r["doc_id"] for r in near.drop_near_copies(stored(rows)).collect()}
    assert pairs > 1000 and len(want) < len(rows) - 100
    assert got == want


def test_stage_takes_five_words_at_four_fifths(spark, stored):
    """The two texts differ in 7 bits of their fingerprints, so the rule of op10 keeps both."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id in (6, 145)").collect()]
    got = corpus_pipeline.near_dedup(spark, stored(rows), "").collect()
    assert [r["doc_id"] for r in got] == [6]


def test_nodes_are_linked_through_the_trees_and_confirmed(stored):
    """Equal fingerprints of different sets, few bits between similar ones, and unlike texts."""
    from sheafline.llm.common import cut

    words = [f"w{i}" for i in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed(words)))]
    # the halves of the second are the first again, so the bits agree and the sets hardly differ
    rows += [(4, " ".join(words * 2))]
    docs = stored(rows, 1)
    table = cut(near.shingled(docs))
    ids = {r["row_key"]: r["doc_id"] for r in table.collect()}
    nodes = table.withColumnRenamed("row_key", "node").select("node", "n", "odd", "prefix")
    found = {frozenset((ids[r["a"]], ids[r["b"]])) for r in near.tree_edges(docs, nodes).collect()}
    assert frozenset((1, 2)) in found and not any(3 in pair for pair in found)
    sets = {i: plain_set(t) for i, t in rows}
    for a, b in map(tuple, found):
        assert 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])


def test_large_group_costs_few_pairs(stored, monkeypatch):
    """Copies of one text of which many are too far from each other, the first from nearly all."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 8)))
    base, rows = [word() for _ in range(200)], []
    for i in range(200):
        copy = list(base)
        for at in rnd.sample(range(5, 195), 5 if i == 0 else rnd.choice([1, 1, 2, 3])):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    want, pairs = plain_kept(rows)
    compared, plain = [], near._similar
    monkeypatch.setattr(near, "_similar", lambda d, n, p: compared.append(p.count()) or plain(d, n, p))
    got = {r["doc_id"] for r in near.drop_near_copies(stored(rows)).collect()}
    assert pairs > 5000 and got == want
    assert sum(compared) < 3000


def test_buckets_of_the_same_nodes_are_one(stored, monkeypatch):
    """Pairs of unlike texts with many rare shingles in common are made once, in any order of ids."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 8)))
    rows = []
    for i in range(40):
        base = [word() for _ in range(100)]
        for j, n in enumerate((1, 2, 3)):
            copy = list(base)
            for at in rnd.sample(range(100), n):
                copy[at] = word()
            rows.append((1000 - 3 * i - j, " ".join(copy)))
    want, _ = plain_kept(rows)
    got = {r["doc_id"] for r in near.drop_near_copies(stored(rows)).collect()}
    assert got == want


def test_only_texts_of_candidates_are_shuffled(stored):
    """The bitmap stands below the join, so what it rejects is not exchanged."""
    docs = stored([(i, f"text {i}") for i in range(50)])
    own = near.keyed_texts(docs).filter("doc_id in (3, 40)").select("row_key")
    got = near.texts_of(docs, own.localCheckpoint())
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 40]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join " in line]
    assert "row_key" in joins[0] and "getbit" in joins[1], joins


def test_rows_of_shingles_met_once_are_not_kept(stored, monkeypatch):
    """Of unlike texts no row of a shingle is stored; of near copies all shared ones are."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(40)]
    rows += [(100, " ".join(base)), (101, " ".join([*base, word()]))]
    seen, plain = [], near.cut

    def noted(df):
        out = plain(df)
        if out.columns == ["node", "n", "at", "token"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(near, "cut", noted)
    got = {r["doc_id"] for r in near.drop_near_copies(stored(rows)).collect()}
    assert got == {i for i in range(40)} | {100}
    assert seen and 20 <= sum(seen) <= 42


def test_small_tables_take_few_tasks(spark, stored, monkeypatch):
    """Steps over few rows do not run as many tasks as the shuffles of the texts."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 8)))
    base, rows = [word() for _ in range(100)], []
    for i in range(20):
        copy = list(base)
        for at in rnd.sample(range(100), i % 4):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    cores = spark.sparkContext.defaultParallelism
    seen = {}
    for module in (near, bktree):

        def noted(df, plain=module.cut, name=module.__name__):
            out = plain(df)
            seen.setdefault(name, []).append(out.rdd.getNumPartitions())
            return out

        monkeypatch.setattr(module, "cut", noted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["doc_id"] for r in near.drop_near_copies(stored(rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_kept(rows)[0]
    for parts in seen.values():
        assert sum(n <= cores for n in parts) > len(parts) / 2, seen
