"""Token ids of whole texts, by the tokenizers library with files of public tokenizers.

The library is asked once per distinct piece of text, not once per text. A text is cut where no token can
cross: before a single space between two other characters (``byte`` vocabularies keep that space in front of
the piece) or at spaces and line feeds (``word`` vocabularies drop white space), and before a full stop or
comma that follows a letter or digit. Pieces of Latin letters, by far the most, go to the library's BPE model
directly; all others go through its whole chain. Texts with other spacing are cut by a slower pattern. Ids
equal those of encoding the text at once; a text that holds the string of an added token (such as the end of a text)
is encoded at once.

Remembered pieces are bounded: they live in two generations of at most MEMORY pieces; when the newer is full it
becomes the older one, whose pieces move up again when they are met.
"""

from __future__ import annotations

import re
from array import array
from os.path import commonprefix

import numpy as np

from lorekeep.llm.worker import kept

MEMORY = 200_000
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
BEFORE_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
UNEVEN_SPACE = re.compile(r" (?:\s|$|(?<!\S ))")
UNEVEN_MARK = re.compile(r"[.,](?<![^\W_].)")
WHITE = re.compile("[ \n]+")
CUT = "\x01"


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(others)}


LETTERS = byte_letters()
SPACE = LETTERS[0x20]


class PieceEncoder(dict):
    """piece -> its ids as bytes, filled on demand."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        # What all of them begin with, as far as it has no case: most texts do not hold it.
        self.mark = re.match(r"[^a-zA-Z]*", commonprefix(added))[0] if all(map(str.isascii, added)) else ""
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.encoded(piece)).tobytes()
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encoded(self, piece: str) -> list[int]:
        word = piece[1:] if piece[:1] == " " and not self.lower else piece
        if word.isalpha():
            if word.isascii():
                letters = word.lower() if self.lower else piece.replace(" ", SPACE)
                return [t.id for t in self.model.tokenize(letters)]
            if LATIN.fullmatch(word):
                letters = (word.lower() if self.lower else piece).encode().decode("latin-1").translate(LETTERS)
                return [t.id for t in self.model.tokenize(letters)]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        marked = text
        if CUT not in text and not UNEVEN_MARK.search(text):
            marked = text.replace(",", CUT + ",").replace(".", CUT + ".")
        if self.lower:
            return marked.replace("\n", CUT).replace(" ", CUT).split(CUT) if marked is not text else WHITE.split(text)
        if marked is text or UNEVEN_SPACE.search(text):
            return BEFORE_SINGLE_SPACE.split(text)
        return marked.replace(" ", CUT + " ").split(CUT)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.mark in text and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), dtype=np.uint32)


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file; workers outlive tasks."""
    encoders = kept("encoders")
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    encoders[path].older = {}  # of the tasks before, only the newer generation stays in memory
    return encoders[path]
