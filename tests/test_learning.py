"""Patterns learned from examples, abbreviations learned from a corpus, places of terms."""

import random

import pytest
from pyspark.sql import functions as F

from sheafline.functions import chunks as C
from sheafline.functions import tokens as T
from sheafline.operators import extraction as E
from sheafline.operators import induction as I
from sheafline.operators import requirements as R
from sheafline.operators import sentences as S
from sheafline.plans import views as V


def test_places_of_words(spark):
    texts = ["", " ", "--", "a", " (é日) — \U0001F600x, end. ", "x " * 200 + "«last»\n", "　ß STRASSE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", T.placed_words(F.col("text")).alias("w"), T.bare_words(F.col("text")).alias("b")).collect()
    for r in rows:
        text = texts[r.i]
        assert [text[w.start : w.end] for w in r.w] == [w.word for w in r.w]
        assert len(r.w) == len(r.b)
    assert [w.word for w in rows[4].w] == ["é日", "x", "end"]
    assert rows[6].b == ["ss", "strasse"]


def test_terms_have_places_and_fold_case(spark):
    docs = [(1, "Die Straße, die STRASSE; und die (strasse)."), (2, "nothing here"), (3, None)]
    terms = spark.createDataFrame([("way", "STRAßE"), ("two", "die strasse")], "label string, value string")
    table = spark.createDataFrame(docs, "doc_id int, text string")
    found = E.extract_terms(table, terms, ["doc_id"], places=True).collect()
    got = sorted((r.extraction_class, docs[0][1][r.start : r.end]) for r in found)
    assert got == [("two", "Die Straße"), ("two", "die (strasse"), ("two", "die STRASSE"),
                   ("way", "STRASSE"), ("way", "Straße"), ("way", "strasse")]
    assert {r.extraction_text for r in found} == {"strasse", "die strasse"}


def test_only_likely_sequences_are_shuffled(spark):
    """Between the sequences of the texts and the join with the list stands the bitmap."""
    docs = spark.range(100).select("id", F.lit("a b c d").alias("text"))
    terms = spark.range(5).select(F.lit("l").alias("label"), F.concat(F.lit("b c"), F.col("id")).alias("value"))
    plan = E.extract_terms(docs, terms, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [x.strip() for x in plan.splitlines() if "Join Inner" in x]
    assert len(joins) == 2 and "extraction_text" in joins[0] and "rightHint=(strategy=broadcast)" in joins[1]
    assert plan.index(joins[1]) < plan.index("Generate")


def example_rows(n, seed):
    """Orders with a code behind 'code', a city between 'from' and 'on', and noise of the same shapes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        code = f"{rng.choice('ABCXYZ')}{rng.choice('KLM')}-{rng.randrange(100, 99999)}"
        city = rng.choice(["Oslo", "New York", "Rome", "Lima", "Bad Tölz"])
        noise = f"{rng.choice('QRS')}{rng.choice('TUV')}-{rng.randrange(100, 999)}"
        text = f"Ref {noise} then order code {code}, sent from {city} on {rng.choice(['Monday', 'Friday'])}."
        out.append((i, text, [("code", code), ("city", city)]))
    return out


PAIRS = "id int, text string, extractions array<struct<label:string,value:string>>"


def test_patterns_are_learned_from_examples(spark):
    learned = I.induce_patterns(spark.createDataFrame(example_rows(60, 1), PAIRS))
    kinds = {(r.label, r.kind, r.left, r.right, r.n) for r in learned.collect()}
    # shape alone is not precise for codes, as the noise looks alike; the word before them is
    assert ("code", "left", "code", "", 1) in kinds
    assert not any(label == "code" and kind == "shape" for label, kind, *_ in kinds)
    # unseen values, a city among them that no example names
    fresh = [(i, t.replace("Rome", "Quito"), [(k, v.replace("Rome", "Quito")) for k, v in p]) for i, t, p in example_rows(80, 2)]
    table = spark.createDataFrame(fresh, PAIRS)
    found = I.extract_by_patterns(table, learned, ["id"]).collect()
    got = {(r.id, r.extraction_class, r.extraction_text) for r in found}
    want = {(i, k, v) for i, _, p in fresh for k, v in p}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    texts = {i: t for i, t, _ in fresh}
    assert all(texts[r.id][r.start : r.end] == r.extraction_text for r in found)


def test_counts_of_patterns(spark):
    rows = [
        (1, "id 12 end", [("n", "12")]), (2, "id 34 end", [("n", "34")]), (3, "id 56 stop", [("n", "56")]),
        (4, "page 78 end", []), (5, "id 90 end", []),
    ]
    table = spark.createDataFrame(rows, PAIRS)
    made = I.induce_patterns(table, support=3, precision=0.5).collect()
    # the shape matches all five numbers, three of them labelled, and covers "id 9"
    assert [(r.kind, r.shape, r.support, r.total) for r in made] == [("shape", "9", 3, 5)]
    made = I.induce_patterns(table, support=3, precision=0.7).collect()
    assert ("left", "id", 3, 4, 0.75) in {(r.kind, r.left, r.support, r.total, r.precision) for r in made}


def test_induction_edges(spark):
    rows = [(1, None, [("a", "x")]), (2, "", [("a", "")]), (3, "x y", None), (4, "x", [(None, "x")]), (5, "--", [("a", "--")])]
    learned = I.induce_patterns(spark.createDataFrame(rows, PAIRS), support=1, precision=0.1)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id int, text string")
    assert all(r.id == 3 for r in I.extract_by_patterns(texts, learned, ["id"]).collect())
    none = spark.createDataFrame([], PAIRS)
    assert I.induce_patterns(none).count() == 0
    assert I.extract_by_patterns(texts, I.induce_patterns(none), ["id"]).count() == 0


def test_held_out_documents(spark):
    """Learned on one half of the documents, measured on the other."""
    sf = "/root/testdata/sf0.1"
    learned = I.induce_patterns(V.labelled_examples(spark, sf))
    other = V.labelled_examples(spark, sf, half=1)
    pairs = other.select("doc_id", F.explode("extractions").alias("e"))
    truth = {(r.doc_id, r.label, r.value) for r in pairs.select("doc_id", "e.*").collect()}
    found = I.extract_by_patterns(other, learned, ["doc_id"]).collect()
    got = {(r.doc_id, r.extraction_class, r.extraction_text) for r in found}
    assert len(got & truth) / len(truth) > 0.95
    assert len(got & truth) / len(got) > 0.95


# ---- sentences


def corpus(seed, lang, short, words, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        said = []
        for _ in range(6):
            w = [rng.choice(words) for _ in range(rng.randrange(3, 9))]
            if rng.random() < 0.6:
                w.insert(rng.randrange(1, len(w)), rng.choice(short))
            said.append(" ".join(w).capitalize() + ".")
        out.append((i, lang, " ".join(said)))
    return out


def test_abbreviations_of_any_language(spark):
    base = "lorem ipsum dolor amet elit tempor magna aliqua veniam quis nostrud ullamco".split()
    rows = corpus(1, "xx", ["Dr.", "bzw.", "z.B."], base) + corpus(2, "yy", ["ul."], [w[::-1] for w in base])
    rows += [(9000 + i, None, "Vgl. dazu mehr. Vgl. auch das.") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    learned = {(r.lang, r.word) for r in S.learn_abbreviations(docs).collect()}
    assert {("xx", "dr"), ("xx", "bzw"), ("xx", "z.b"), ("yy", "ul"), ("", "vgl")} <= learned
    assert not {w for _, w in learned} & {*base, *(w[::-1] for w in base)}
    made = S.split_sentences(docs, S.learn_abbreviations(docs)).collect()
    assert {len(r.sentences) for r in made if r.lang} == {6}
    assert all(" ".join(r.sentences) == r.text for r in made)


@pytest.mark.parametrize("short, want", [
    ([], ["He saw Dr.", "Who.", "(No. \n 5?)", "End"]),
    (["dr"], ["He saw Dr. Who.", "(No. \n 5?)", "End"]),
    (["dr", "who"], ["He saw Dr. Who. (No. \n 5?)", "End"]),
])
def test_joined_where_no_sentence_ends(spark, short, want):
    text = "He saw Dr. Who. (No. \n 5?) End"
    df = spark.createDataFrame([(text, [*short, "no"])], "text string, s array<string>")
    got = df.select(C.chunk_sentences(F.col("text"), short=F.col("s")).alias("c")).first().c
    assert got == want


def test_sentences_without_anything(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "en", ""), (3, "en", "One. Two.")], "doc_id int, lang string, text string")
    learned = S.learn_abbreviations(docs)
    assert learned.count() == 0
    made = {r.doc_id: r.sentences for r in S.split_sentences(docs, learned).collect()}
    assert made == {1: None, 2: [""], 3: ["One.", "Two."]}


# ---- aligned periods


def test_spans_are_parted_exactly(spark):
    rng = random.Random(5)
    spans = [(a, a + rng.randrange(-3, 900)) for a in (rng.randrange(-500, 20_000) for _ in range(200))]
    df = spark.createDataFrame(spans, "a int, b int")
    for r in df.select("a", "b", R.aligned_periods(F.col("a"), F.col("b")).alias("p")).collect():
        days = sorted(d for p in r.p for d in range(p._at * p._size, (p._at + 1) * p._size))
        assert days == list(range(r.a, r.b + 1))
        assert sum(p._size < 64 for p in r.p) <= 28
