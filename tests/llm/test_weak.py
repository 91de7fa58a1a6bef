"""Voters, label model and classifier of the toxicity score."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import weak
from sheafline.llm.common import documents


def fired(text, stems=()):
    voters = weak.Voters(list(stems))
    mask = voters.votes(text)
    return {name for i, name in enumerate(voters.names) if mask >> i & 1}


@pytest.mark.parametrize("text, want", [
    ("", {"none"}),
    ("a plain sentence about trains", {"none"}),
    ("word " * 400, {"none", "long_few"}),
    ("What an IDIOT, truly", {"idiot", "dense", "shouted"}),
    ("you are such an idiot. you are just a clown", {"idiot", "clown", "several", "dense", "addressed"}),
    ("idiotic moron, stupid loser " + "x " * 900, {"idiot", "moron", "stupid", "loser", "several", "many"}),
])
def test_voters(text, want):
    assert fired(text) == want


def test_beginnings_once_and_twice():
    stems = ["zork", "blimp" + weak.TWICE]
    assert fired("a zorkish thing " + "x " * 200, stems) == {"zork"}
    assert fired("blimpa " + "x " * 200, stems) == {"none"}
    assert fired("blimpa blimpo " + "x " * 300, stems) == {"blimp*", "several"}
    assert "abcd*" in weak.features("abcde abcdf") and "abcd*" not in weak.features("abcde abcde")


def mixture(random, n, rates, copies):
    """Votes of two classes; each of ``copies`` (a, b) makes b repeat a, but for one time in twenty."""
    y = random.random(n) < 0.2
    bits = random.random((n, len(rates))) < np.where(y[:, None], rates[:, 1], rates[:, 0])
    for a, b in copies:
        bits[:, b] = np.where(random.random(n) < 0.95, bits[:, a], bits[:, b])
    return y, bits.astype(np.int64) @ (1 << np.arange(len(rates)))


def test_label_model_finds_accuracies_and_correlations(spark):
    random = np.random.default_rng(1)
    rates = np.array([[0.05, 0.7], [0.1, 0.6], [0.02, 0.5], [0.05, 0.7], [0.05, 0.6], [0.9, 0.1], [0.8, 0.2]])
    y, masks = mixture(random, 20_000, rates, [(0, 3)])
    kinds, times = np.unique(masks, return_counts=True)
    table = spark.createDataFrame(list(zip(kinds.tolist(), times.tolist())), "mask long, times long")
    model = weak.fit_label_model(table.repartition(3), len(rates), 0.3)
    assert abs(model.prior - 0.2) < 0.03
    assert model.parent[3] == 0 or model.parent[0] == 3
    single = [j for j in (1, 2, 4, 5, 6) if model.parent[j] < 0]
    assert single and np.abs(model.rates[single, :, 0] - rates[single]).max() < 0.06
    right = (model.posterior(masks) >= 0.5) == y
    # the best that any rule can do, from the true rates
    bits = (masks[:, None] >> np.arange(7)) & 1
    odds = np.log(0.25) + sum(
        np.where(bits[:, j], np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0])))
        for j, r in enumerate(rates) if j != 3
    )
    assert right.mean() > ((odds > 0) == y).mean() - 0.01


def test_two_voters_that_agree_count_once():
    """Posteriors with a copied voter are those without it."""
    random = np.random.default_rng(2)
    rates = np.array([[0.1, 0.6], [0.1, 0.6], [0.9, 0.2]])
    y, masks = mixture(random, 20_000, np.vstack([rates, rates[:1]]), [(0, 3)])
    stats = weak.expected(masks, np.ones(len(masks)), y.astype(float), 4)
    tree = weak.maximise(stats, weak.correlation_tree(stats))
    naive = weak.maximise(stats, [-1] * 4)
    alone = weak.maximise(weak.expected(masks & 7, np.ones(len(masks)), y.astype(float), 3), [-1] * 3)
    both = np.array([0b1101]), np.array([0b0101])
    assert abs(tree.posterior(both[0]) - alone.posterior(both[1])) < 0.05
    assert naive.posterior(both[0]) > alone.posterior(both[1]) + 0.15


def test_training_descends_to_soft_labels():
    random = np.random.default_rng(3)
    x = (random.random((400, 6)) < 0.4).astype(np.float32)
    target = 1 / (1 + np.exp(-(x @ np.array([2, -2, 1, 0, 0, 0]) - 0.5)))
    w, b = weak.train_linear(x, target, np.ones(400))
    assert np.abs(1 / (1 + np.exp(-(x @ w + b))) - target).max() < 0.05


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    made = weak.score(docs, weak.fit(docs, labels))
    assert made.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = made.join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda d: crc32(str(d).encode()) % 3 == 1)).all()
    rows = rows[rows["held_out"]]
    y = rows["toxic"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.95
    assert rows["predicted"][y == 1].mean() > 0.8 and rows["predicted"][y == 0].mean() < 0.02


def test_held_out_rows_teach_nothing(spark, stored):
    """Other labels and texts of held-out documents change no other score."""
    rows = [(i, f"plain words here {i % 7} and {'you idiot loser zork' if i % 5 == 0 else 'tea'}") for i in range(300)]
    held = {i for i, _ in rows if crc32(str(i).encode()) % 3 == 1}
    other = [(i, "scum zork" if i in held else t) for i, t in rows]
    label = [(i, int(i % 5 == 0)) for i, _ in rows]
    wrong = [(i, 1 - y if i in held else y) for i, y in label]

    def scores(given, marks):
        table = stored(given)
        made = weak.score(table, weak.fit(table, spark.createDataFrame(marks, "doc_id long, toxic int")))
        return {r["doc_id"]: round(r["score"], 9) for r in made.collect() if r["doc_id"] not in held}

    assert scores(rows, label) == scores(other, wrong)


def test_edges(spark, stored, edge_rows):
    table = stored(edge_rows)
    for c in "mask p weight toxic feature n pos row_key score x times".split():
        table = table.withColumn(c, F.lit("clash"))
    marks = [(0, 1), (0, 0), (4, None), (None, 1), (6, 0), (7, 1), (8, 1), (9, 1)]
    for labels in (marks, marks[2:3], []):
        given = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("weight", F.lit("clash"))
        got = weak.score(table, weak.fit(table, given)).collect()
        assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
        same = [r["score"] for r in got if r["doc_id"] in (6, 7)]
        assert same[0] == same[1]


def test_empty_table(spark, stored):
    table = stored([])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert weak.score(table, weak.fit(table, labels)).collect() == []


def test_common_words_are_no_beginnings_of_toxic_texts_when_clean_ones_are_sampled(spark, docs):
    rows = [(i, f"commonplace words {'zorkian' if i % 6 == 0 else 'plain'} x{i}") for i in range(12_000)]
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    stems, share = weak.induce(docs(rows), labels, sample=1300)
    assert any("zorkian".startswith(s) for s in stems)
    assert not any(w.startswith(s.removesuffix(weak.TWICE)) for s in stems for w in ("commonplace", "words", "plain"))
    assert abs(share - 1 / 6) < 0.03
