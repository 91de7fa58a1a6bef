"""Every token's probability is that of its word, not of its class alone."""

from collections import Counter

import numpy as np
import pytest

from sheafline.llm import masked_lm
from sheafline.llm.common import cut


@pytest.mark.parametrize("held", [masked_lm.HELD_WORDS, 50])
def test_words_within_their_class(spark, monkeypatch, held):
    monkeypatch.setattr(masked_lm, "HELD_WORDS", held)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
    counts = cut(masked_lm.word_counts(docs))
    trained = masked_lm.train(docs, rounds=1, counts=counts)
    n = Counter(w for words in texts.values() for w in words)
    of_class = Counter()
    for w in n:
        of_class[trained[0]._class(w)] += n[w]
    plain = {r["doc_id"]: r["log_likelihood"] for r in masked_lm.score(docs, *trained).collect()}
    got = {r["doc_id"]: r["log_likelihood"] for r in masked_lm.score_words(docs, *trained, counts).collect()}
    assert len(got) == len(texts)
    for d, words in texts.items():
        rare = [w for w in words if w not in trained[0].frequent]
        want = sum(np.log(n[w] / (of_class[trained[0]._class(w)] + 1)) for w in rare)
        assert np.isclose(got[d], plain[d] + want, rtol=1e-6)
    assert any(got[d] < plain[d] - 1 for d in got)


def test_words_are_cut_as_by_split():
    texts = ["", " a  b ", "\x1cA\x85b C\xa0", "\n", "İx ΑΣ b", "a\u2028b\x0bc\x1fd\u3000e\u200bf"]
    distinct, index, sizes = masked_lm.split_words(texts)
    words = distinct.to_pylist()
    assert [words[i] for i in index] == [w for t in texts for w in t.lower().split()]
    assert sizes.tolist() == [len(t.lower().split()) for t in texts]


def test_texts_are_read_twice_only(spark, monkeypatch):
    """For the counts and for the tokens; training and scoring read the tokens, and score as one by one."""
    from sheafline.llm.queries import QUERIES

    data, calls, plain = "/root/testdata/sf0.001", [], masked_lm.keyed_texts
    monkeypatch.setattr(masked_lm, "keyed_texts", lambda *a: calls.append(a) or plain(*a))
    got = {r["doc_id"]: r["log_likelihood"] for r in QUERIES["op4_masked_lm"](spark, data).collect()}
    assert len(calls) == 2
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = cut(masked_lm.word_counts(docs))
    want = masked_lm.score_words(docs, *masked_lm.train(docs, counts=counts), counts).collect()
    assert len(got) == len(want)
    assert all(np.isclose(got[r["doc_id"]], r["log_likelihood"], rtol=1e-5) for r in want)
