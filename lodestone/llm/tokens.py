"""Token ids by a public tokenizer file, with a bounded cache of words in each Python worker."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Words kept by a worker, some 45 MB. Common ones come early, so a full cache stays as it is, and others are looked up each time.
CACHE_WORDS, LONGEST_KEPT = 300_000, 100
_FOLD = bytes.maketrans(b"\n\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"   abcdefghijklmnopqrstuvwxyz")
#: Letters of ASCII and Latin-1: what the tokenizer's pattern calls a letter, a number or neither is sure among these and ASCII.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[\x00-\x7f{_LETTERS}]*").fullmatch
_RUN = re.compile(f"[{_LETTERS}]+").fullmatch
#: The tokenizer's own pattern, for words of such characters.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\v\f\r0-9{_LETTERS}]+").findall
#: A run of these is one part after letters. An apostrophe may begin one with the letters behind it.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that stand for bytes in the tokenizer's model.
_BYTES = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Word (lower-case in A-Z, no space, tab or line end) to its ids as little-endian unsigned 32-bit. A word is kept when it
    is met again: half of all words are met once. ``met`` has a byte for each remainder of the words' hashes."""

    def __init__(self, tokenizer):
        super().__init__({b"": b""})
        self.tokenizer, self.model, self.met = tokenizer, tokenizer.model, bytearray(1 << 22)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """Ids of what the tokenizer's pattern takes as one part; its model sees characters that stand for bytes."""
        if not text.isascii() or not text.isprintable():
            text = text.lower().encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        letters = word.rstrip(_MARKS)
        text = letters.decode()
        if letters.isalpha() or _RUN(text):
            ids = self[letters] + self[word[len(letters) :]] if len(letters) < len(word) else self.part(text)
        elif _PLAIN(text := word.decode()):
            parts = _PARTS(text)
            ids = self.part(text) if parts == [text] else b"".join([self[p.encode()] for p in parts])
        else:
            ids = self.whole(text)
        if len(self) < CACHE_WORDS and len(word) <= LONGEST_KEPT:
            at = hash(word) % len(self.met)
            if self.met[at]:
                self[word] = ids
            self.met[at] = 1
        return ids


class WordTokenizer:
    """Ids of whole texts, equal to those of ``Tokenizer.encode``, for a tokenizer that lower-cases, drops white
    space and never joins runs of letters with what surrounds them (word_bpe_49k).

    A text is split at white space and each word looked up, since the tokenizer treats such words apart. Texts
    for which lower-casing first could matter, or which hold a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.words = _Words(self.tokenizer)

    def ids(self, text: str) -> bytes:
        raw = text.encode()
        folded = raw.translate(_FOLD)
        if b"<|" in raw or not (text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", folded.decode())):
            return self.words.whole(text)
        return b"".join(map(self.words.__getitem__, folded.split(b" ")))


@lru_cache(4)
def word_tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    return WordTokenizer(path, special_as_text)
