"""Encoding, decoding and packing against the tokenizers library and by count."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sheafline.llm import bpe, packing

PATH = bpe.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst hld.'’éß1<|>\n"), st.characters()), max_size=60))
def test_encoder_is_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe.encoder(PATH).encode([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert bpe.encoder(PATH).decode(ids).decode() == LIBRARY.decode(want, skip_special_tokens=False)
    own = packing._library(PATH, "<u4").encode(text)
    assert np.frombuffer(own, "<u4").tolist() == want


def test_whole_table(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.encode_decode(table).collect()}
    for row in table.collect():
        want = LIBRARY.encode(row["text"], add_special_tokens=False).ids
        assert got[row["doc_id"]]["ids"] == want
        assert got[row["doc_id"]]["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)


def test_special_tokens_and_long_words(docs):
    texts = ["a<|endoftext|>b <|startoftext|>", "ab" * 5_000, "!?" * 4_000, "<|endoftext|"]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == LIBRARY.encode(t, add_special_tokens=False).ids


def check_pieces(pieces, texts):
    """Every id in one piece, sequences without gaps; returns the fill of each sequence."""
    ids = {d: np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        part = own[p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(part) > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes())
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert set(by_doc) == set(ids)
    fills = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        fills.append(at)
    return fills


def test_pack_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    fills = check_pieces(packing.pack_digest(table).collect(), texts)
    assert sum(f < packing.WINDOW for f in fills) <= 1


@pytest.mark.parametrize("words", [0, 1100, 2046, 2047, 2048, 5000])
def test_pack_one_length(stored, words):
    texts = [(i, "the " * words) for i in range(40)]
    fills = check_pieces(packing.pack_digest(stored(texts)).collect(), texts)
    assert sum(f < packing.WINDOW for f in fills) <= 1


def test_solution_fills_windows():
    rng = np.random.default_rng(0)
    histogram = {int(r): int(n) for r, n in zip(range(1, 64), rng.integers(1, 50, 63))}
    layout = packing.Layout(histogram, 64, 3)
    total = sum(r * n for r, n in histogram.items())
    # long ones have too few short partners for more
    assert layout.windows * 64 >= 0.65 * total
    found = packing.combinations(np.array([1, 2, 3, 5]), 6, 3)
    # 1+5, 3+3, 1+2+3, 2+2+2 as places in the list of lengths
    assert {tuple(i for i in c if i >= 0) for c in found.tolist()} == {(0, 3), (2, 2), (0, 1, 2), (1, 1, 1)}
