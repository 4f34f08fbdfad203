"""Token ids of whole texts, with the words of a task remembered.

Both public vocabularies split a text before they merge: no merge crosses the white space between two
words. A text is therefore cut at single blanks and line ends, each distinct chunk is encoded once by the
tokenizer and kept in a bounded dictionary. A plain word goes straight to the vocabulary's merge model;
anything else, and a text whose runs of white space would be split otherwise, goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np

CACHE_WORDS = 1_000_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others shifted past 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class _Chunks(dict):
    """Chunk to its ids as unsigned 16-bit integers; filled on demand."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoder.fresh(chunk)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    """``spaced``: blanks belong to the words after them; otherwise white space is dropped and case folded."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits; the vocabulary is larger")
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.letters = _byte_letters()
        self.chunks = _Chunks(self)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, text: str) -> bytes:
        return array("H", self.whole(text)).tobytes()

    def fresh(self, chunk: str) -> bytes:
        """Ids of a chunk not met before."""
        if not chunk:
            return b""
        body = chunk[1:] if self.spaced and chunk[0] == " " else chunk
        core = body.rstrip(".,!?;:")
        if not core.isalpha():
            return self._packed(chunk)
        if len(core) < len(body):  # a word and its punctuation never merge
            tail = len(core) - len(body)
            return self.chunks[chunk[:tail]] + self.chunks[chunk[tail:]]
        if not self.spaced:
            if chunk.isascii():
                chunk = chunk.lower()
            elif chunk != chunk.lower() or not unicodedata.is_normalized("NFC", chunk):
                return self._packed(chunk)
        if chunk[0] == " " or not chunk.isascii():
            chunk = chunk.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(chunk)]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """All ids of ``text`` as unsigned 16-bit integers."""
        if not self.spaced:
            parts = text.replace("\n", " ").split(" ")
            return np.frombuffer(b"".join(map(self.chunks.__getitem__, parts)), np.uint16)
        if "\0" in text:
            return np.frombuffer(self._packed(text), np.uint16)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if " " in parts or "\n" in parts:
            lone = [p in (" ", "\n") for p in parts]
            if lone[-1] or any(a and b for a, b in zip(lone[:-1], lone[1:], strict=True)):
                return np.frombuffer(self._packed(text), np.uint16)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, parts)), np.uint16)


_KNOWN: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this process; its dictionary outlives a task."""
    if (path, spaced) not in _KNOWN:
        _KNOWN[path, spaced] = Encoder(path, spaced)
    return _KNOWN[path, spaced]
