"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

A text is cut at white space, which no token of the file spans, and each distinct word is encoded once while it stays
in the cache. Words of printable ASCII and precomposed Latin-1 letters go straight to the library's pre-tokenised BPE
model (lower-casing and the split pattern have no context beyond the word there); any other word goes through the
library's whole chain. `ids_bytes` therefore equals `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

#: Words of which the chain of normaliser and splitter is simple: no combining marks, one-to-one lower case, no "<|".
PLAIN = re.compile("(?:(?!<\\|)[!-~À-ÖØ-öø-ÿ])+")
#: The split pattern of word_bpe_49k.json restricted to those characters.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: str.split() also splits at the four separators 0x1C-0x1F, which are no white space to the library.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class _Cache(dict):
    """Two generations of entries: when the young one is full it becomes the old one; a hit in the old one moves over.
    ``size`` bounds each generation."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Letters(dict):
    """Character -> its byte-level form, as the library writes it."""

    def __missing__(self, c):
        self[c] = out = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]
        return out


class Encoder:
    """``ids_bytes(text)``: the ids as little-endian unsigned 32-bit integers. ``path`` is a tokenizers JSON file whose
    chain is NFC, white space, lower case, a word pattern and byte-level BPE."""

    def __init__(self, path: str, cache: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _Letters()
        self.parts = _Cache(self._part, cache)
        self.words = _Cache(self._word, cache)

    def _part(self, part: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, part)))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
