"""Rules, classifiers and searches against brute force or on held-out documents."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sheafline.llm import cascade, crf, masked_lm, pii, pu
from sheafline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


# rules


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {
        i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)
    }
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_figures(stored):
    texts = [
        None, "", "a b c a b c a b c", "x\n\nx\n \nx y\x0bz", "é ü # | <>", "a a a a a", "one\r\none\r\none",
        "a b c d a b c e a b", " ".join("ab"[i % 2] for i in range(120)), "word " * 60, "\x1c a\x85b",
    ]
    got = {r["doc_id"]: r for r in cascade.rule_report(stored(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = plain_figures(t)
        assert tuple(got[i][f] for f in FIGURES) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == failed
        assert not (failed and got[i]["kept"])


def test_order_never_changes_a_verdict():
    texts = ["", "a" * 99, "GOOD TEXT " * 40, "fine words here " * 5, "### " * 80] + [
        " ".join(f"word{(i * j) % 97}x" for j in range(90)) for i in range(1, 12)
    ]
    want = [cascade.verdict(cascade.Stats(t), list(cascade.RULES)) for t in texts]
    for order in itertools.permutations(cascade.RULES):
        if hash(order[0].name) % 7 == 0:
            assert [cascade.verdict(cascade.Stats(t), list(order)) for t in texts] == want
    assert any(want) and not all(want)


def test_cascade_stops_and_orders():
    ran = []

    def rule(name, out, work):
        def rejects(stats):
            ran.append(name)
            sum(range(work))
            return out(stats.text)

        return cascade.Rule(name, rejects)

    never = rule("never", lambda t: False, 10)
    slow = rule("slow", lambda t: t == "bad", 200_000)
    quick = rule("quick", lambda t: t == "bad", 10)
    order = cascade.cascade_order(["bad", "good", "bad"], (never, slow, quick))
    assert [r.name for r in order] == ["quick", "slow", "never"]
    ran.clear()
    assert not cascade.verdict(cascade.Stats("bad"), order) and ran == ["quick"]


def test_good_documents_pass_the_rules(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in cascade.rule_report(docs).collect() if r["doc_id"] in labels and not r["base_failed"]]
    kept = {q: np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == q]) for q in (0, 1)}
    assert kept[1] >= 0.99 and kept[0] <= 0.3


# classifier


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = np.asarray(label) == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out(spark):
    rows = QUERIES["op7_pu_quality"](spark, DATA).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r["held_out"] == fold(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    test = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, predicted, label = map(np.array, zip(*test))
    assert auc(score, label) > 0.95
    assert (predicted == label).mean() > 0.93
    assert predicted[label == 1].mean() > 0.97


def test_negative_labels_are_not_learned_from():
    """Training sees positives, unlabelled rows and a prior only."""
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (600, 3))
    bad = rng.normal(3, 1, (200, 3))
    model = pu.train(good[:300], np.concatenate([good[300:], bad]), prior=0.6)
    g = lambda x: pu.design(x, model.edges) @ model.weights + model.bias
    assert (g(rng.normal(0, 1, (400, 3))) > 0).mean() > 0.85
    assert (g(rng.normal(3, 1, (400, 3))) > 0).mean() < 0.15


# personal data


def test_base_patterns(stored):
    def luhn(d):
        total = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (i % 2 + 1)
            total += x // 10 + x % 10
        return total % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(re.sub("[ -]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    import random

    rnd = random.Random(4)
    parts = ["a", "@", ".", "1", "22", "0", "255", "300", "+", "-", " ", "(", "b.c", "\n", "é", "%",
             "4111111111111111", "x@y.z", "+1 (555) 555-1234", "1.2.3.4", "😀"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        want = [
            (m.start(), m.end(), k)
            for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m[0])
        ]
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000):
        pii.candidates(text, pii.base_spans(text))


def test_bootstrapped_identifiers(stored):
    """Contexts of known addresses lead to identifiers of another form; other numbers stay."""
    rows = [(i, f"Hello there, mail user{i}@site{i}.org today, order {70_000 + i} is fine") for i in range(40)]
    rows += [(100 + i, f"Please mail AB-{55_000 + i}-X today or later") for i in range(4)]
    rows += [(200 + i, f"It was chapter {12_345 + i} of the book") for i in range(30)]
    rows += [(300, None), (301, "")]
    got = {r["doc_id"]: r for r in pii.pii_digest(stored(rows)).collect()}
    for i in range(4):
        text = rows[40 + i][1]
        at = text.index("AB-")
        assert got[100 + i]["spans"] == f"other:{at}:{at + 10}" and got[100 + i]["n_email"] == 0
    for i in range(40):
        assert got[i]["n_email"] == 1 and got[i]["spans"].count(":") == 2
    assert all(got[200 + i]["spans"] == "" for i in range(30))
    masked = {r["doc_id"]: r["text"] for r in pii.mask(stored(rows)).collect()}
    assert masked[0] == "Hello there, mail <EMAIL> today, order 70000 is fine"
    assert masked[100] == "Please mail <OTHER> today or later"
    assert masked[300] is None and masked[301] == "" and masked[200] == rows[44][1]


# languages


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    k, sizes = 3, np.array([4, 1, 3])
    scores, start, moves = rng.normal(size=(8, k)), rng.normal(size=k), rng.normal(size=(k, k))
    p, expected, log_z = crf.forward_backward(scores, sizes, start, moves)
    want, pairs, at = np.zeros((8, k)), np.zeros((k, k)), 0
    for j, n in enumerate(sizes):
        weights = {}
        for path in itertools.product(range(k), repeat=int(n)):
            s = start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path))
            weights[path] = np.exp(s + sum(moves[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        assert np.isclose(log_z[j], np.log(z))
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[at + i, y] += w / z
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_language_on_held_out(spark):
    rows = QUERIES["op9_language_crf"](spark, DATA).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r["held_out"] == fold(r["doc_id"]) for r in rows)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words(spark, stored):
    """Words of two languages in one text are told apart."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    chain = crf.fit(docs)
    own = {}
    for r in docs.filter("length(text) > 600").collect():
        if fold(r["doc_id"]) and r["lang"] in ("en", "de"):
            own.setdefault(r["lang"], crf.WORD.findall(r["text"])[:40])
    mixed = " ".join(own["en"][:20] + own["de"][:20] + own["en"][20:])
    row = crf.word_languages(stored([(1, mixed), (2, None), (3, "12 34")]), chain).collect()
    by = {r["doc_id"]: r for r in row}
    want = ["en"] * 20 + ["de"] * 20 + ["en"] * 20
    assert np.mean([a == b for a, b in zip(by[1]["langs"], want)]) > 0.85
    assert by[2]["langs"] == [] and by[3]["langs"] == []
    und = {r["doc_id"]: r for r in crf.predict(stored([(2, None), (3, "12 34")]), chain).collect()}
    assert und[2]["lang_pred"] == und[3]["lang_pred"] == "und"


# language model


def test_gradient_and_normalisation():
    rng = np.random.default_rng(5)
    net = masked_lm.Network.start(np.ones(masked_lm.TOKENS))
    net = net.with_flat(net.flat() + rng.normal(0, 0.05, net.flat().size))
    around = rng.integers(0, masked_lm.TOKENS + 1, (6, 2 * masked_lm.WINDOW))
    token = rng.integers(0, masked_lm.TOKENS, 6)
    every = np.arange(masked_lm.TOKENS)
    total = np.exp(net.log_probability(np.repeat(around[:1], len(every), 0), every)).sum()
    assert abs(total - 1) < 1e-4
    before = net.log_probability(around, token).mean()
    # the gradient against a difference quotient along a random direction
    away = rng.normal(size=net.flat().size)
    slope = float(net.gradient(around, token).flat() @ away)
    ahead = net.with_flat(net.flat() + 1e-3 * away).log_probability(around, token).mean()
    assert abs((before - ahead) / 1e-3 - slope) < 0.05 * max(1.0, abs(slope))
    steps = masked_lm.Descent(net, 0)
    for _ in range(20):
        steps.over(around, token)
    assert steps.network.log_probability(around, token).mean() > before + 0.5


def test_scores_are_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    classes, net = masked_lm.train(docs, rounds=1)
    got = {r["doc_id"]: r for r in masked_lm.score(docs, classes, net).collect()}
    for r in docs.limit(25).collect():
        words = r["text"].lower().split()
        ids = [classes._class(w) for w in words]
        edge = [masked_lm.EDGE] * masked_lm.WINDOW
        padded = edge + ids + edge
        total = 0.0
        for i, t in enumerate(ids):
            at = i + masked_lm.WINDOW
            around = [padded[at - 1], padded[at - 2], padded[at + 1], padded[at + 2]]
            total += float(net.log_probability(np.array([around]), np.array([t]))[0])
        assert got[r["doc_id"]]["n_tokens"] == len(words)
        assert np.isclose(got[r["doc_id"]]["log_likelihood"], total, rtol=1e-4)


def test_order_of_words_is_learned(stored):
    """In texts that walk round a cycle of words a shuffled text scores far lower."""
    rng = np.random.default_rng(0)
    walk = lambda n: " ".join(f"w{(s + i) % 30}" for s in [rng.integers(30)] for i in range(n))
    docs = stored([(i, walk(400)) for i in range(300)])
    trained = masked_lm.train(docs)
    texts = [walk(80) for _ in range(30)]
    mixed = [" ".join(rng.permutation(t.split())) for t in texts]
    old = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.score(stored(list(enumerate(texts))), *trained).collect()}
    new = {r["doc_id"]: r["mean_log_likelihood"] for r in masked_lm.score(stored(list(enumerate(mixed))), *trained).collect()}
    assert all(new[d] < old[d] - 1 for d in new)


def test_network_beats_word_shares(spark):
    """On the corpus itself, tokens given their neighbours are likelier than by share alone."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    trained = masked_lm.train(docs)
    ids = [trained[0]._class(w) for r in docs.collect() for w in r["text"].lower().split()]
    unigram = sum(n * np.log(n / len(ids)) for n in Counter(ids).values()) / len(ids)
    got = masked_lm.score(docs, *trained).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    assert got > unigram


def test_every_place_is_trained_on(docs):
    cycle = "ant bee cow dog eel fox gnu hen".split()
    classes, net = masked_lm.train(docs([(1, " ".join(cycle * 12_000))], 1))
    tokens = classes.of(" ".join(cycle * 3))
    places = np.arange(8, 16)
    own = net.log_probability(masked_lm.neighbours(tokens, places), tokens[places])
    assert own.min() > np.log(0.5)
