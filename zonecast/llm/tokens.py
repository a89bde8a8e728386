"""Token ids of whole texts with a public tokenizer file, one cached word at a time.

A tokenizer that drops white space encodes each blank-separated word by itself, so a worker
keeps the ids of the words it has seen (bounded, cleared when full).  New words of common Latin
letters are cut by the file's own pattern and only unseen pieces go through its BPE; every
other new word goes through the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Words that a worker keeps (about 300 bytes each with its pieces): a larger cache spares encoding, a
#: smaller one memory.
CACHE = 1_000_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 + n."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit token ids, as
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        self.most_words, self.most_pieces = cache, cache // 2
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        if self.by_word:
            import regex

            self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.latin = re.compile("[!-~À-ÿ]+").fullmatch  # their lower case and NFC need no table
            self.letters = byte_letters()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) >= self.most_pieces:
                self.pieces.clear()
            mapped = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            ids = self.pieces[piece] = b"".join(t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(mapped))
        return ids

    def _word(self, word: str) -> bytes:
        if not self.latin(word) or "<|" in word:
            return self._whole(word)
        return b"".join(map(self._piece, self.cut(word.lower())))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._whole(text)
        words = text.replace("\n", " ").split(" ")
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) >= self.most_words:
            known.clear()
            known[""] = b""
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join([known[w] for w in words])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]


def forget() -> None:
    """Frees this worker's encoder."""
    _ENCODERS.clear()
