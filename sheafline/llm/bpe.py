"""Byte-pair encoding of whole texts, and decoding.

A text is normalised and split into words as the tokenizer file says; each
word is encoded by backtracking. An Aho-Corasick automaton of the vocabulary
gives all tokens that occur in the word in one pass. The encoder walks from
left to right, takes the longest token at its place, and keeps it if the pair it
forms with the token before is compatible, that is, if byte-pair merging of
the two joined strings would end in these two tokens again. Otherwise it
tries the next shorter token, and if there is none it goes back by one. A
sequence whose neighbours are all compatible is the one that merging ends in,
so no merge is ever replayed over a whole word. Places found to be dead ends are
remembered, so that the steps stay linear in the word.

Decoding looks up each id's start in one blob of all token strings.

Null texts count as empty ones and have no ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from sheafline.llm.common import keyed_texts, map_texts

#: Words kept per worker before the older half is dropped.
MEMO_WORDS = 300_000
_END = "\u0000"  # stands for the end-of-word mark in the automaton


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Word -> value, in two generations so that memory is bounded."""

    def __init__(self, size: int = MEMO_WORDS):
        self.size, self.young, self.old = size, {}, {}

    def fill(self, words, make) -> dict:
        """``young`` holding all of ``words``; ``make`` gets the list of unknown ones."""
        young, old = self.young, self.old
        if len(young) > self.size:
            self.old = old = young
            self.young = young = {}
        missing = []
        for w in set(words).difference(young):
            if w in old:
                young[w] = old[w]
            else:
                missing.append(w)
        if missing:
            young.update(zip(missing, make(missing)))
        return young


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies use for each byte: printable
    Latin-1 characters for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BacktrackingBPE:
    """Encoder and decoder for a tokenizer file of word-ended byte-level BPE."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.library = Tokenizer.from_file(path)  # for its normaliser and splitter only
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile(
            "(" + "|".join(map(regex.escape, self.specials)) + ")"
        )
        suffix = model["end_of_word_suffix"]
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.specials}
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix = suffix
        self.size = 1 + max(*vocab.values(), *self.specials.values())
        names = [""] * self.size
        for k, v in (vocab | self.specials).items():
            names[v] = k
        self.names = names
        self.pattern = regex.compile(
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        )
        symbols = byte_symbols()
        self.bytes_to_symbols = {b: s for b, s in enumerate(symbols)}
        self.automaton = ahocorasick.Automaton()
        for k, v in vocab.items():
            # a token that merging its own string does not give can never come out
            if self._merge(self._symbols_of(k)) == [k]:
                text = k[: -len(suffix)] + _END if k.endswith(suffix) else k
                self.automaton.add_word(text, (v, len(text)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        blob = [n.encode("utf-8") for n in names]
        self.offsets = np.zeros(self.size + 1, dtype=np.int64)
        np.cumsum([len(b) for b in blob], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(blob), dtype=np.uint8)
        self.memo, self.word_memo = Memo(), Memo()

    def _symbols_of(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, for single tokens and pairs of tokens only."""
        rank, best = self.rank, len(self.rank)
        while len(symbols) > 1:
            low, at = min((rank.get(p, best), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if low == best:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _fits(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is None:
            a, b = self.names[left], self.names[right]
            known = not a.endswith(self.suffix) and self._merge(
                self._symbols_of(a) + self._symbols_of(b)
            ) == [a, b]
            self.compatible[key] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as it stands after normalising and splitting."""
        text = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        text = text.translate(self.bytes_to_symbols) + _END
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):
            starts[end - found[1] + 1].append(found)  # the longest comes last
        compatible, size = self.compatible, self.size
        ids: list[int] = []
        lengths: list[int] = []
        tried: list[list[tuple[int, int]]] = []  # of each place on the path: what is left to try
        dead: set[tuple[int, int]] = set()
        at, found, left = 0, starts[0], -1
        while at < n:
            while found:
                token, length = found.pop()
                if left >= 0:
                    ok = compatible.get(left * size + token)
                    if ok is None:
                        ok = self._fits(left, token)
                    if not ok:
                        continue
                if dead and (at, token) in dead:
                    continue
                ids.append(token)
                lengths.append(length)
                tried.append(found)
                at += length
                left = token
                found = starts[at][:]
                break
            else:
                if not ids:
                    raise ValueError(f"the vocabulary cannot spell {word!r}")
                at -= lengths.pop()
                dead.add((at, ids.pop()))
                left = ids[-1] if ids else -1
                found = tried.pop()
        return ids

    def _words(self, chunk: str) -> list[str]:
        """Words of a chunk without blanks, as byte strings' texts."""
        if not chunk:
            return []
        if max(chunk) < "ƀ":  # here Unicode versions do not differ
            return self.pattern.findall(unicodedata.normalize("NFC", chunk).lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(
            self.library.normalizer.normalize_str(chunk)
        )
        back = {s: b for b, s in self.bytes_to_symbols.items()}
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in found]

    def _chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for part in self.special_split.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.specials:
                ids.append(self.specials[part])
            else:
                words = self._words(part)
                known = self.word_memo.fill(words, lambda new: map(self.encode_word, new))
                for word in words:
                    ids += known[word]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without its own special tokens.

        Merging never crosses a blank, so texts are cut at U+0020 and each
        different chunk is encoded once as long as it is remembered.
        """
        out = []
        for text in texts:
            chunks = text.split(" ")
            known = self.memo.fill(chunks, lambda new: map(self._chunk_ids, new))
            ids = b"".join(map(known.__getitem__, chunks))
            out.append(np.frombuffer(ids, dtype="<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by blanks, in UTF-8."""
        if len(ids) == 0:
            return b""
        ids = np.asarray(ids, dtype=np.int64)
        out = []
        for at in range(0, len(ids), 1 << 16):  # bounded work space for very long texts
            part = ids[at : at + (1 << 16)]
            start, length = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(length + 1)
            place = np.ones(ends[-1], dtype=np.int64)
            first = ends - length - 1
            place[first] = start
            place[first[1:]] -= start[:-1] + length[:-1]
            place = np.cumsum(place)
            place[ends - 1] = 0
            text = self.blob[place]
            text[ends - 1] = 0x20
            out.append(text.tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingBPE:
    """One per worker process and tokenizer file."""
    return BacktrackingBPE(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` for each row of ``docs``."""
    path = path or tokenizer_path()

    def run(texts: list[str]) -> dict[str, list]:
        bpe = encoder(path)
        ids = bpe.encode(texts)
        return {"ids": ids, "decoded": [bpe.decode(x).decode("utf-8") for x in ids]}

    return map_texts(
        keyed_texts(docs), run, "doc_id long, ids array<int>, decoded string", ["doc_id"]
    )


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of what ``encode_decode`` gives, made where the ids are made."""
    path = path or tokenizer_path()

    def run(texts: list[str]) -> dict[str, list]:
        bpe = encoder(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in bpe.encode(texts):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(keyed_texts(docs), run, schema, ["doc_id"])
