"""The pipeline's stages against brute force on what each was given."""

import re

import pytest

import corpus_pipeline
from sheafline.llm import pii, pu

BLANKS = re.compile(r"[\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the pipeline does it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_in_order(stages):
    assert [n for n, _ in stages] == ["documents", "quality", "exact_dedup", "near_dedup", "personal_data", "pack"]
    assert all(df.columns == COLUMNS for _, df in stages[:-1])


def test_quality_keeps_what_is_scored_good(spark, stages):
    docs, kept = stages[0][1], rows(stages[1][1])
    model = pu.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r["doc_id"] for r in docs.collect() if model.scores([r["text"] or ""])[0] >= 0.5}
    assert set(kept) == want and 0 < len(want) < docs.count()


def test_one_of_equal_texts_stays(stages):
    given, kept = rows(stages[1][1]), rows(stages[2][1])
    first = {}
    for d in sorted(given):
        first.setdefault(BLANKS.sub(" ", given[d]["text"]), d)
    assert set(kept) == set(first.values())
    assert all(kept[d] == given[d] for d in kept)


def five_words(text):
    """The five-word shingles of a text, ASCII letters lowered."""
    words = [w for w in BLANKS.split("".join(c.lower() if c.isascii() else c for c in text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_of_near_copies_stays(stages):
    """The first of each component of Jaccard similarity 0.8 or more."""
    given, kept = rows(stages[2][1]), rows(stages[3][1])
    sets = {d: five_words(r["text"] or "") for d, r in given.items()}
    group = {d: d for d in given}
    for d in sorted(given):
        for e in sorted(given):
            both = len(sets[d] & sets[e])
            if group[d] != group[e] and 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((group[d], group[e]))
                group = {k: a if v == b else v for k, v in group.items()}
    assert set(kept) == set(group.values())


def test_personal_data_is_masked(stages):
    given, masked = rows(stages[3][1]), rows(stages[4][1])
    assert set(given) == set(masked)
    changed = 0
    for d, r in masked.items():
        spans = pii.base_spans(given[d]["text"])
        assert not pii.base_spans(r["text"])
        assert r["text"] == pii.mask_text(given[d]["text"], spans) and r["n_chars"] == len(r["text"])
        changed += bool(spans)
    assert changed


def test_all_is_packed(stages):
    from test_tokens import check_pieces

    texts = [(r["doc_id"], r["text"]) for r in stages[4][1].collect()]
    check_pieces(stages[5][1].collect(), texts)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(
        map(tuple, stages[-1][1].collect())
    )
