"""Token ids of whole texts by a public tokenizer, with a bounded memory of words seen before."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: The memory is emptied when it holds this many words or characters.
MOST_WORDS, MOST_CHARS = 600_000, 8_000_000

#: The split pattern and the normalizers of the lower-case word tokenizer, for which
#: words of printable ASCII and Latin-1 letters can be cut here and given to the model by pieces.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
LATIN_WORD = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,63}")
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte, keyed for ``str.translate``.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, get 256 and up.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    If the tokenizer drops white space, a text's ids are the ids of its words one after the other,
    so each distinct word is encoded once and looked up afterwards; ``plain`` is the direct way.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            source = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = all(self.plain(f"{a} {b}") == self.plain(f"{a}\n{b}") == self.plain(a) + self.plain(b) for a, b in (("a", "b"), ("Ab,", "'s é"), ("1", " x ")))
        self.special = [t["content"] for t in source.get("added_tokens", [])]
        kinds = [n["type"] for n in (source.get("normalizer") or {}).get("normalizers", [])]
        self.by_piece = self.by_word and kinds == WORD_NORMALIZERS and WORD_PATTERN in json.dumps(source["pre_tokenizer"]).replace("\\\\", "\\")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0

    def plain(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.plain(text)
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self.words.__getitem__, words))

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > MOST_WORDS or self.chars > MOST_CHARS:
            self.words.clear()
            self.chars = 0
        if len(self.pieces) > MOST_WORDS:
            self.pieces.clear()
        known, rest = self.words, []
        for word in {w for w in words if w not in known}:
            self.chars += len(word)
            if self.by_piece and LATIN_WORD.fullmatch(word) and not ("<" in word and any(s in word for s in self.special)):
                known[word] = b"".join(map(self._piece, LATIN_PIECES.findall(word.lower())))
            else:
                rest.append(word)
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[word] = _bytes(found.ids)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return ids


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each file and Python worker."""
    return WordTokenizer(path)
