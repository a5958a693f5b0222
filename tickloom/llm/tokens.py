"""Token ids of whole texts by a public tokenizer file.

The tokenizers served here drop white space before they split a text into
words, so a text's ids are those of its white-space separated words in order.
Distinct words are encoded once per worker and kept in a bounded cache.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

from tickloom.llm.words import hold

CACHE_WORDS = 600_000
#: A word of a-z and the lower-case letters U+00DF to U+00FF, which no step before the model changes, then ASCII signs but the apostrophe.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: Byte-level tokenizers write a printable byte as itself and the n-th other as chr(256 + n).
_BYTE_LETTERS = [chr(b) if b in _printable else chr(256 + sum(x not in _printable for x in range(b))) for b in range(256)]
_loaded: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Encodes UTF-8 texts into little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.direct = False
        probe = [b"the", b"\xc3\xbcber", b"\xc3\xa9l\xc3\xa8ve", b"unquestionably", b"stra\xc3\x9fe", b"word,", b"odd.###"]
        self._learn(probe)
        known, self.direct = dict(self.cache), True
        self._learn(probe)
        self.direct = self.cache == known

    def encode(self, texts: list[bytes]) -> list[bytes]:
        hold(self.cache)
        split = [self._fold(t).split() for t in texts]
        missing = set().union(*split).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = set().union(*split)
        if missing:
            self._learn(list(missing))
        look = self.cache.__getitem__
        return [b"".join(map(look, words)) for words in split]

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words; plain lower-case ones skip to the BPE model."""
        rest = []
        for w in words:
            parts = _PLAIN.fullmatch(w) if self.direct else None
            if parts and (not parts[2] or parts[2] in self.cache):
                self.cache[w] = self._letters(parts[1]) + (self.cache[parts[2]] if parts[2] else b"")
            else:
                rest.append(w)
        for w, found in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.cache[w] = array("I", found.ids).tobytes()
            parts = _PLAIN.fullmatch(w)
            if parts and parts[2] and parts[2] not in self.cache:
                self.cache[parts[2]] = array("I", self.tokenizer.encode(parts[2].decode(), add_special_tokens=False).ids).tobytes()

    def _letters(self, word: bytes) -> bytes:
        if word in self.cache:
            return self.cache[word]
        found = self.tokenizer.model.tokenize(word.decode() if word.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, word)))
        return array("I", [t.id for t in found]).tobytes()

    @staticmethod
    def _fold(text: bytes) -> bytes:
        """Lower A-Z early, so that fewer distinct words are encoded.

        Left alone are texts that hold a special token's opening, or combining
        marks, whose composition comes before lower-casing in the tokenizer.
        """
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return text
        return text.lower()


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
