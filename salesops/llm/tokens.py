"""Whole-text token ids with the ``tokenizers`` library, fast on repeated words.

The vocabulary's pre-tokenizer drops white space and never joins across it, so
a text's ids are the ids of its white-space separated chunks in order. Each
chunk is encoded once per task and remembered; ``check_chunks`` verifies the
property for the file in use, and other files are encoded text by text.
"""

from __future__ import annotations

import os
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np

# Chunks remembered by one task in each of two generations: when the newer is
# full it becomes the older, and what is met again moves on to the newer.
REMEMBERED = 500_000
# Characters of text encoded at a time, cut at white space.
PIECE_BYTES = 1 << 22
# Letters that are lowered one by one, without marks of their own to compose, lie below.
PLAIN = "\u0130"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkIds(dict):
    """White-space free chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.most = REMEMBERED
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = {t.content[-1:] for t in self.tokenizer.get_added_tokens_decoder().values()}
        # Marks that stand apart when they end a word: none that may end a special token.
        self.marks = "".join(c for c in string.punctuation if c not in ends)
        self.letters = self.letter_table()

    def letter_table(self) -> dict[int, str] | None:
        """How the file's pre-tokenizer spells each plain small letter, or None where it splits or joins words of them."""
        pre = self.tokenizer.pre_tokenizer
        small = [c for c in map(chr, range(ord(PLAIN))) if c.isalpha() and c == c.lower()]
        table = {}
        for c in small if pre else ():
            spelt = pre.pre_tokenize_str(c)
            if len(spelt) != 1:
                return None
            table[ord(c)] = spelt[0][0]
        probes = ["".join(small), *small, *(a + b for a, b in zip(small, small[7:], strict=False)), "perhaps", "\u00e9l\u00e8ve", "ma\u00f1ana"]
        return table if table and all(self.word(w, table) == self.direct(w) for w in probes) else None

    def word(self, letters: str, table: dict[int, str]) -> bytes:
        """Ids of a word of plain small letters, by the model alone: it is its own normal form and one piece."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters.translate(table))]).tobytes()

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    older: dict[bytes, bytes] = {}  # noqa: RUF012 - replaced, never changed

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.made(chunk)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def made(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        # Marks after a plain letter stand apart, as one run.
        head = text.rstrip(self.marks)
        if len(head) < len(text) and head and head[-1].isalpha() and head[-1] < PLAIN:
            head = head.encode()
            return self[head] + self[chunk[len(head) :]]
        if text.isalpha() and max(text) < PLAIN:
            if (small := text.lower()) != text:
                return self[small.encode()]
            if self.letters:
                return self.word(text, self.letters)
        return self.direct(text)

    def encode(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if len(data) <= PIECE_BYTES:
            return b"".join(map(self.__getitem__, data.split()))
        return b"".join(self.long(data))

    def long(self, data: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(data):
            end = at + PIECE_BYTES
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            yield b"".join(map(self.__getitem__, data[at:end].split()))
            at = end


_LOADED: dict[str, ChunkIds] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> ChunkIds:
    """One encoder for each task process and file; ``remembered``: chunks in each generation."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
        check_chunks(_LOADED[path])
    _LOADED[path].most = remembered
    return _LOADED[path]


def check_chunks(ids: ChunkIds) -> None:
    """Fail early on a file whose ids depend on what stands around a chunk."""
    if array("I").itemsize != 4 or sys.byteorder != "little":
        raise ValueError("ids are held as little-endian unsigned 32-bit integers")
    probe = "It's 12 o'clock, they've\tsaid: \"no\"!?\nÉté-- ñandú; (x_y) 3.14 a.b,c <|endoftext|> THE End. \u00c9L\u00c8VE,!! heat*** '' won't** x>> <|endoftext|>!!"
    if ids.encode(probe) != ids.direct(probe):
        raise ValueError("the tokenizer's ids of a text are not those of its white-space separated chunks")


def encode_ids(ids: ChunkIds, text: str | None, end_id: int) -> np.ndarray:
    """All ids of one whole text and the end id."""
    return np.frombuffer(ids.encode(text) + np.array([end_id], "<u4").tobytes(), "<u4")
