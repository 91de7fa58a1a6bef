"""Passages in the middle of long sentences against shared windows of 51 words."""

import random

import pytest

from sheafline.llm import spans


def plain_covered(rows):
    """For each text the places of words in a window of 51 that an earlier text holds."""
    seen, out = set(), {}
    for d, words in rows:
        windows = [tuple(words[i : i + 51]) for i in range(len(words) - 50)]
        out[d] = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 51)}
        seen |= set(windows)
    return out


@pytest.mark.parametrize("size", [60, 81, 150])
def test_passages_inside_sentences(stored, size):
    rnd = random.Random(size)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(size)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(rnd.randint(1, 70))]
        rows.append((i, own + passage + [word() for _ in range(rnd.randint(1, 70))]))
    want = plain_covered(rows)
    got = {r["doc_id"]: r["removed_words"] for r in
           spans.drop_repeated(stored([(d, " ".join(w)) for d, w in rows])).collect()}
    assert got[0] == 0 and all(len(want[d]) >= size for d in range(1, 40))
    assert all(len(want[d]) / 2 <= got[d] <= len(want[d]) for d in range(1, 40))


def test_texts_without_blanks(stored):
    rnd = random.Random(1)
    letters = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = letters(90)
    rows = [(i, letters(20 + i) + passage + letters(30) + "。") for i in range(4)]
    got = {r["doc_id"]: r for r in spans.drop_repeated(stored(rows)).collect()}
    assert got[0]["removed_words"] == 0
    assert all(60 <= got[d]["removed_words"] <= 90 for d in (1, 2, 3))
