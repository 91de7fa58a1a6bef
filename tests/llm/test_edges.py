"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from sheafline.llm import bktree, bpe, cascade, crf, dedup, masked_lm, near, packing, pii, pu, spans

CLASHES = "row_key row_ row_key_ fp class body chunk i n h1 h2 s1 s2 round count kept score ids at r pid shard".split()


def quality(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    return pu.score(docs, pu.fit(docs, labels))


def good(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    return pu.keep_good(docs, pu.fit(docs, labels))


def scored_words(docs):
    counts = masked_lm.word_counts(docs)
    return masked_lm.score_words(docs, *masked_lm.train(docs, rounds=1, counts=counts), counts)


PER_ROW = {
    "encode_decode": bpe.encode_decode,
    "encode_digest": bpe.encode_digest,
    "exact_groups": dedup.exact_groups,
    "masked_lm": lambda d: masked_lm.score(d, *masked_lm.train(d, rounds=1)),
    "score_words": scored_words,
    "drop_repeated": spans.drop_repeated,
    "apply_rules": cascade.apply_rules,
    "rule_report": cascade.rule_report,
    "quality": quality,
    "pii_digest": pii.pii_digest,
    "mask": pii.mask,
    "language": lambda d: crf.predict(d, crf.fit(d)),
    "near_groups": bktree.near_groups,
}
OTHER = {
    "pack": packing.pack,
    "drop_copies": dedup.drop_copies,
    "drop_near_copies": bktree.drop_near_copies,
    "near_copies": near.drop_near_copies,
    "good": good,
}


@pytest.mark.parametrize("name", [*PER_ROW, *OTHER])
def test_edges(stored, edge_rows, name):
    table = stored(edge_rows)
    for c in CLASHES:
        table = table.withColumn(c, F.lit("clash"))
    got = (PER_ROW | OTHER)[name](table).collect()
    if name in PER_ROW:
        assert len(got) == len(edge_rows)
    if name in ("mask", "drop_copies", "drop_near_copies", "near_copies", "good"):
        assert set(table.columns) == set(got[0].asDict())


@pytest.mark.parametrize("name", [*PER_ROW, *OTHER])
def test_empty_table(stored, name):
    assert (PER_ROW | OTHER)[name](stored([])).collect() == []
