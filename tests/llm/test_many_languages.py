"""Every language that may be learned from is a label."""

import random

from sheafline.llm import crf


def test_no_language_is_left_out(stored):
    rnd = random.Random(2)
    rows, n = [], 0
    for k in range(70):
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)]
        for _ in range(12 if k < 64 else 6):  # the last ones are the rarest
            rows.append((n, " ".join(rnd.choice(own) for _ in range(12)), f"l{k:02}"))
            n += 1
    table = stored(rows)
    chain = crf.fit(table)
    assert chain.labels == [f"l{k:02}" for k in range(70)]
    lang = {r[0]: r[2] for r in rows}
    got = {r["doc_id"]: r["lang_pred"] for r in crf.predict(table, chain).collect()}
    rare = [d for d in lang if lang[d] >= "l64"]
    assert sum(got[d] == lang[d] for d in rare) > 0.9 * len(rare)
