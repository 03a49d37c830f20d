"""Tokenisation shared by the binary writer and the packer.

Encoding a text equals encoding its pieces, where a piece is a blank with the
non-blank run that follows it: the byte-level pre-tokeniser never lets a token
span the border between a non-blank and a blank. Each Python worker remembers
the ids of pieces it has met (at most ``MAX_PIECES``, then it starts anew), so
only pieces new to the worker go through the tokenizers library. Texts with
other or repeated blanks, and texts that hold the string of an added token
(such as `<|endoftext|>`), are encoded as a whole: the library finds added
tokens before it cuts a text into pieces, and gives them their own ids unless
`special_as_text` is set.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

#: Pieces that a worker remembers; bounds its memory, not the result.
MAX_PIECES = 300_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_PAIRS = ("  ", "\n\n", " \n", "\n ")
_CONTROLS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _odd(text: str) -> bool:
    """Whether two blanks meet or a blank other than space and line break occurs."""
    return any(p in text for p in _PAIRS) or any(c in text for c in _CONTROLS) or (not text.isascii() and any(c in text for c in _WIDE))


class _Known(dict):
    """Ids of a piece (a blank stands before it unless it begins with a line break)."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.letters = tokenizer, _byte_letters()
        self.model = tokenizer.model

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, letters: str, blank: bool) -> bytes:
        """Ids of one pre-token: a run of letters, with the blank before it."""
        if letters.isascii():
            spelt = "\u0120" + letters if blank else letters
        else:
            spelt = (" " * blank + letters).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def head(self, piece: str) -> bytes:
        """Ids of the piece that begins a text, with no blank before it."""
        return self.word(piece, False) if piece.isalpha() else self.whole(piece)

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():  # one pre-token: straight to the model
            got = self.word(piece, True)
        elif piece[-1:] in (",", ".") and piece[:-1].isalpha():  # a word and one sign are two pre-tokens
            got = (self.get(piece[:-1]) or self.word(piece[:-1], True)) + self["\n" + piece[-1]][4:]
        elif piece[:1] == "\n" and piece[1:].isalpha():
            got = self["\n,"][:4] + self.word(piece[1:], False)
        else:
            got = self.whole(piece if piece[:1] == "\n" else " " + piece)
        if len(self) >= MAX_PIECES:
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.vocab = tokenizer.get_vocab_size()
        self.known = _Known(tokenizer)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _odd(text) or any(a in text for a in self.added):
            return self.known.whole(text)
        pieces = text.replace("\n", " \n").split(" ")
        known = self.known
        head = known.head(pieces[0])
        return head + b"".join([known[p] for p in pieces[1:]])


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path, special_as_text)


def keyed_texts(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple[int | None, str | None]]:
    """(key, text) of a batch's rows, as Python objects for `step` rows at a time."""
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())
