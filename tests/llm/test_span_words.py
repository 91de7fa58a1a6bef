"""Sentences and spans found over a text's words at once, against the cuts one by one."""

import random

import numpy as np

from sheafline.llm import spans


def texts():
    rnd = random.Random(9)
    pieces = ["a", "Bc.", "d!)", "x.y", '."', "?", "é", "über.", "日本", "ab。cd", "語。", "...", "q'", "end.]", "\udc80", "w" * 9]
    blanks = [" ", "  ", "\n", "\n\n", "\t", " ", "\xa0", "\x1c", "\r\n", "　"]
    out = ["", " ", "\n", "one", "。", "same " * 95, "same " * 41 + "\n" + "same. " * 3]
    for i in range(300):
        own = pieces if i % 3 == 0 else [p for p in pieces if not spans._WIDE.search(p)]
        words = own + [f"v{rnd.randrange(40)}" for _ in range(len(own))]
        at = blanks if i % 2 else [" "] * 12 + ["\n"]
        out.append("".join(rnd.choice(words) + rnd.choice(at) for _ in range(rnd.randrange(200))))
        out.append(rnd.choice(at) + out[-1])
    return out


def test_sentences_are_those_of_one_by_one():
    own, seen, back = spans.Words(), {}, {}
    for text in texts():
        cut_up = spans.units(text)
        _, many = spans.bounds(text, own)
        assert many.tolist() == np.cumsum([0, *(len(w) for _, _, w in cut_up)]).tolist()
        runs = spans.runs(cut_up)
        assert list(enumerate(spans.ends_of_runs(many).tolist())) == runs
        begin, end = spans.places(text, many)
        assert list(zip(begin.tolist(), end.tolist())) == [(a, b) for a, b, _ in cut_up]
        # equal hashes for equal runs of words, and for no others
        for (first, last), key in zip(runs, spans.hashed_spans(text, own).T.tolist()):
            words = tuple(w for u in cut_up[first:last] for w in u[2])
            assert seen.setdefault(tuple(key), words) == words and back.setdefault(words, key) == key
    assert len(seen) > 1000


def test_many_words_at_once_are_known_again(monkeypatch):
    monkeypatch.setattr(spans, "MEMO_WORDS", 500)
    own, text = spans.Words(), " ".join(f"w{i}" for i in range(3000))
    want = spans.hashed_spans(text, own)
    assert len(want[0]) > 300 and np.array_equal(spans.hashed_spans(text, own), want)
    assert np.array_equal(spans.hashed_spans(text, spans.Words()), want)


def test_spans_are_made_once_for_the_first_places_and_the_join(stored):
    docs = stored([(i, " ".join(f"w{j}" for j in range(i, i + 90))) for i in range(0, 40, 4)])
    found = spans.repeated(docs)
    assert len(found.collect()) > 3
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
