"""Byte-level BPE ids of whole texts through caches of pre-tokens.

A text is cut into pre-tokens by the vocabulary's published pattern; ids of a
pre-token do not depend on its neighbours, so each worker encodes a pre-token once
and looks it up afterwards.  Texts with characters on which two Unicode versions may
disagree go to the library whole, so ids equal the library's on every text.
"""

from __future__ import annotations

import re
import threading
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracelode.llm.frames import trim

VOCABULARY = "byte_bpe_50k.json"

# The published pattern over the characters that PLAIN admits, where \w less digits and _ is exactly the letters.
# Contractions come after words and numbers, which never start with their sign.
PIECES = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# ASCII, Latin, Greek and Cyrillic text with usual punctuation; no superscript digits, fractions or control characters.
PLAIN = re.compile("[\t-\r -~ -±´-¸º»¿-ɏͰ-ͳ΄-ΆΈ-ΊΌΎ-ΡΣ-ҁҊ-ԯ–—‘-„•…€]*")

# Bytes as the letters of the vocabulary: printable ones stand for themselves, the others for those from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: b if b in _PRINTED else 256 + sum(c not in _PRINTED for c in range(b)) for b in range(256)}

LONGEST_CACHED = 64  # characters; longer pre-tokens are encoded each time
CACHE_ENTRIES = 400_000  # of one generation of a worker; the one before it is kept too


class PreTokens:
    """The library's vocabulary behind a cache: pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = VOCABULARY, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        # Added strings stand for one id each wherever they occur, which is the library's default.
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens of a text; None if the library must see it whole."""
        if not PLAIN.fullmatch(text) or any(word in text for word in self.added):
            return None
        return PIECES.findall(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that the cache lacks; all but the long ones are kept in it."""
        if len(self.cache) + len(missing) > self.entries:
            self.older, self.cache = self.cache, {}
        found = {p: self.older[p] for p in missing if p in self.older}
        tokenize = self.library.model.tokenize
        for piece in missing:
            if piece not in found and len(piece) <= LONGEST_CACHED:
                tokens = tokenize(piece.encode().decode("latin-1").translate(LETTERS))
                found[piece] = array("I", [t.id for t in tokens]).tobytes()
        self.cache.update(found)
        return found | {p: self.whole(p) for p in missing if len(p) > LONGEST_CACHED}

    def ids(self, text: str | None) -> bytes:
        """Ids of a text; a null text is empty."""
        pieces = self.pieces(text) if text else []
        if pieces is None:
            return self.whole(text)
        held = list(map(self.cache.get, pieces))
        if None in held:
            found = self.learn({p for p, ids in zip(pieces, held, strict=True) if ids is None})
            held = [found[p] if ids is None else ids for p, ids in zip(pieces, held, strict=True)]
        return b"".join(held)


_ENCODERS: dict[tuple[str, int], PreTokens] = {}
_LOCK = threading.Lock()


def encoder(name: str = VOCABULARY, entries: int = CACHE_ENTRIES) -> PreTokens:
    """The worker's encoder; its cache outlives a task.  ``entries`` of the cache decide speed and memory only."""
    with _LOCK:
        if (name, entries) not in _ENCODERS:
            _ENCODERS[name, entries] = PreTokens(name, entries)
            trim()  # reading the vocabulary takes several times what it holds
        return _ENCODERS[name, entries]
