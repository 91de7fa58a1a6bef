"""Words without marks, their places and sequences, against the rule word by word."""

import random

from pyspark.sql import functions as F

from sheafline.functions import tokens
from sheafline.functions.text import WS_CHARS, words
from sheafline.operators.extraction import extract_terms
from sheafline.operators.rows import maybe_among


def test_words_are_those_of_the_rule_for_each(spark):
    rnd = random.Random(5)
    signs = [*"aZ9ßÉ日ñ.,-'$+“”—€", "́", "\u0007", "​", "", "😀", "𝔘", *WS_CHARS]
    rows = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))) for i in range(2000)]
    rows += [(-1, None), (-2, ""), (-3, " . "), (-4, "a-" * 30_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    bare = F.transform(words(F.col("text")), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    out = df.select(
        "text", F.array_remove(bare, "").alias("want"), tokens.plain_words(F.col("text")).alias("got"),
        tokens.placed_words(F.col("text")).alias("placed"),
    ).collect()
    for r in out:
        assert r["got"] == r["want"]
        for p in r["placed"] or []:
            assert r["text"][p["start"] : p["end"]] == p["word"]


def test_sequences_of_a_long_text(spark):
    text = " ".join(f"w{i}," for i in range(30_000))
    chunks = spark.createDataFrame([(1, text), (2, "w1")], "doc_id long, text string")
    terms = spark.createDataFrame([("two", "W7 w8"), ("one", "w29999"), ("none", "w8 w7")], "label string, value string")
    found = extract_terms(chunks, terms, ["doc_id"], places=True)
    got = {(r["doc_id"], r["extraction_text"], text[r["start"] : r["end"]]) for r in found.collect()}
    assert got == {(1, "w7 w8", "w7, w8"), (1, "w29999", "w29999")}


def test_bitmap_loses_no_member_at_any_bit(spark):
    members = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    rows = spark.range(0, 5000).select(F.col("id").alias("k"))
    got = {r["k"] for r in maybe_among(rows, ["k"], members, 1 << 20).collect()}
    want = set(range(0, 5000, 7))
    assert want <= got and len(got) < len(want) + 30
