"""Token ids of whole texts from a public tokenizer file, through caches of words and pieces.

In a byte-level BPE a blank between two words always begins a new piece, and a newline between two
words is a piece of its own. So a text cut at single blanks and newlines encodes to the same ids as
the whole. Each distinct cut is encoded once: it is split into pieces as the tokenizer does, and pieces
that were not met before go to the tokenizers library. Texts with runs of white space are cut before
blanks only, where no white space stands before.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable

#: Bytes of cuts and of pieces held in a worker, of whatever length they are; bounds its memory.
CUT_BYTES, PIECE_BYTES = 80 << 20, 32 << 20
#: Bytes that an entry takes besides its characters and ids.
ENTRY_BYTES = 110
_CUT = re.compile(r"(?<=\S)(?= )")
#: Marks a cut that no blank stands before.
BARE = "\0"
#: What keeps a text from being cut at every blank and newline: runs of white space, other white space, BARE.
_ASCII_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", BARE)
_ODD = tuple(c for c in map(chr, range(0x80, 0x3001)) if c.isspace())
#: The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BLANK = _BYTES[0x20]
#: A mark between a letter or digit and white space is a piece of its own, and is cut off.
_MARK, _APART = re.compile(r"([,.])(?<=[^\W_].)(?= |\n|\Z)"), f" {BARE}\\1"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer gives them without adding special tokens.

    Texts that hold an added token's string go through the tokenizer as a whole.
    """

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a piece needs the model alone: neither patterns nor special tokens apply inside it
        self.model = self.tokenizer.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.cache = _Held(self.learn, CUT_BYTES)
        self.pieces = _Held(self._ids, PIECE_BYTES)

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The worker's encoder for a file; it outlives tasks."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    @staticmethod
    def cuts(text: str) -> list[str]:
        """Keys of a text's cuts: a word stands for itself after a blank, BARE + word for the word alone."""
        if any(x in text for x in _ASCII_ODD) or not text.isascii() and any(x in text for x in _ODD):
            return [BARE + c for c in _CUT.split(text)]
        return (BARE + _MARK.sub(_APART, text)).replace("\n", f" {BARE}\n {BARE}").split(" ")

    def _pieces(self, key: str) -> list[str]:
        """Pieces of a cut, as the tokenizer makes them."""
        return self.split(key[1:] if key[:1] == BARE else " " + key)

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece by the model: each byte is written as its printed character."""
        return array("I", [t.id for t in self.model(piece.encode("utf-8", "replace").decode("latin-1").translate(_BYTES))]).tobytes()

    def learn(self, key: str) -> bytes:
        """Ids of a cut; pieces of cuts that have several are kept apart, as they come in many cuts."""
        if key.isascii() and key.isalpha():  # the usual cut: a word after a blank, one piece
            return array("I", [t.id for t in self.model(_BLANK + key)]).tobytes()
        word = key[1:] if key[:1] == BARE else key
        if word.isalpha():
            return self._ids(word if word is not key else " " + key)
        return b"".join(map(self.pieces.__getitem__, self._pieces(key)))

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # many small objects, none of them in cycles
        try:
            return [self._whole(t) if any(a in t for a in self.added) else b"".join(map(self.cache.__getitem__, self.cuts(t))) for t in texts]
        finally:
            if collects:
                gc.enable()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids).tobytes()


class _Held(dict):
    """Strings and their ids, learned as they are asked for, within ``most`` bytes also inside one text.

    When half of these are full, the entries become ``old`` and the old ones go; what is asked for
    again comes over. A string that alone would take a good part is learned each time.
    """

    def __init__(self, learn: Callable[[str], bytes], most: int):
        self.learn, self.half, self.left = learn, most // 2, most // 2
        self.long = self.half // 64
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.learn(key)
        size = ENTRY_BYTES + len(key) + 2 * len(out)  # wide characters have as many bytes of ids as of their own, or more
        if size > self.long:
            return out
        self.left -= size
        if self.left < 0:
            self.old = {}  # before the copy, which then takes its place
            self.old = dict(self)
            self.clear()
            self.left = self.half - size
        self[key] = out
        return out


def text_groups(texts: list[str | None], most_chars: int = 2_000_000) -> list[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about most_chars, null as empty."""
    out, run, chars, first = [], [], 0, 0
    for i, t in enumerate(texts):
        run.append(t or "")
        chars += len(run[-1])
        if chars >= most_chars:
            out.append((first, run))
            run, chars, first = [], 0, i + 1
    if run:
        out.append((first, run))
    return out
