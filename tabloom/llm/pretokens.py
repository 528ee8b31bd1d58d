"""Pre-tokens of a byte-level BPE vocabulary, and their ids, each worked out once.

The vocabulary's own library splits a text by a pattern over Unicode classes and then merges
bytes inside each piece, so a text's tokens are those of its pre-tokens in order. For texts of
the characters in SAFE, Python's `re` gives the same pieces; any other text is split by the library's own
pre-tokenizer. Special strings inside a text are cut out first, as the library does by default.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ƺ"
SAFE = re.compile(rf"[\t\n\r -~¡§«°»¿×÷{LETTERS}]*")
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Entries a worker keeps between slices.
MOST_KEPT = 400_000


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: a visible one of Latin-1 as itself, the others in order from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class BytePairs(dict):
    """pre-token -> its ids, as little-endian bytes; a missing one is worked out by the library, once."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.vocab_size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        # where nothing comes before the merges, they can be asked for alone
        bare = self.library.normalizer is None and isinstance(self.library.pre_tokenizer, ByteLevel) and not self.library.pre_tokenizer.add_prefix_space
        self.letters, self.model = byte_letters() if bare else None, self.library.model

    def numbers(self, piece: str) -> list[int]:
        if self.letters is None or piece in self.special:
            return self.library.encode(piece, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.numbers(piece), self.kind).tobytes()
        return ids

    def trim(self) -> None:
        if len(self) > MOST_KEPT:
            self.clear()

    def _between(self, text: str) -> list[str]:
        if SAFE.fullmatch(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a text, in order."""
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self._between(text)
        out, at = [], 0
        for m in found:
            out += self._between(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._between(text[at:])

    def ids(self, text: str) -> bytes:
        """A text's ids, kind.itemsize bytes each."""
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """One per worker process and file."""
    return BytePairs(path)
