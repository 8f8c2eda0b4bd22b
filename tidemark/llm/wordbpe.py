"""Token ids of whole texts as bytes, with a bounded cache of words.

The tokenizer never merges across white space, so a text's ids are the ids of its words in
a row.  Words repeat, therefore each task keeps the ids of words it has seen.  A new word
is cut into the pieces that the tokenizer's own splitter makes and those go straight to the
library's merge model, which spares the alignment bookkeeping of a full ``encode``.  That
is only done where the rules are plain: one of the known splitters and Latin-1 text without
special tokens.  Everything else is encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

MAX_WORDS = 600_000  # entries kept by a task, about 150 MB
SLICE_CHARS = 2_000_000

# The splitting rule of the public word-level BPE file, and that rule for Latin-1.
_SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        rule, form = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        self.plain = _SPLIT_RULE in rule.replace("\\\\", "\\") and "ByteLevel(add_prefix_space=False" in rule and "Lowercase()" in form
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = [t.id for t in self.model.tokenize(shown.translate(self.letters))]
        self.pieces[piece] = out = pack(f"<{len(ids)}I", *ids)
        return out

    def _word(self, word: str) -> bytes:
        known = self.pieces
        return b"".join([known.get(p) or self._piece(p) for p in _LATIN.findall(word.lower())])

    def _is_plain(self, text: str) -> bool:
        if not self.plain or any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _slice(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if self._is_plain(t) else None for t in texts]
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        if len(self.pieces) > MAX_WORDS:
            self.pieces.clear()
        for word in set().union(*[c for c in cut if c is not None]).difference(self.words):
            self.words[word] = self._word(word)
        look = self.words.__getitem__
        return [self._whole(t) if c is None else b"".join(map(look, c)) for t, c in zip(texts, cut)]

    def encode(self, texts: list[str]):
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                yield from self._slice(batch)
                batch, size = [], 0
        if batch:
            yield from self._slice(batch)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(vocabulary)
