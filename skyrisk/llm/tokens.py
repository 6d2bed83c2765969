"""Token ids of whole texts by a public tokenizer file, with a cache of words in each worker.

A byte-level BPE with the usual word pattern never merges over a single space between two visible
characters, nor over a single line break between them.  So a text whose white space has only these
two forms is cut there, and a piece's ids are taken from the cache or from the library.  Any other
text goes to the library whole.  Both give the library's ids (``tests/llm/test_tokens.py`` holds
them against each other).  The cache has two generations of ``CACHE_WORDS`` pieces and so a bound.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from skyrisk.llm.common import held_in_worker

CACHE_WORDS = 300_000

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{2,})([!-&(-/:-@\[-`{-~]+)")  # no apostrophe, which a word may go on after
MARKS = 10_000  # runs of marks that are kept


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text for the executors (a vocabulary of fixed size, a few MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class TextEncoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers, without an end id."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {"\n": self.plain("\n")}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.space = chr(256 + hidden.index(32))
        self.as_letters = {b: 256 + k for k, b in enumerate(hidden)}

    def plain(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _mark(self, run: str) -> bytes:
        """Ids of a run of marks after a word, or of a line break."""
        found = self.marks.get(run)
        if found is None:
            found = self.plain(run)
            if len(self.marks) < MARKS:
                self.marks[run] = found
        return found

    def _word(self, word: str, space: str) -> bytes:
        """Ids of one run of letters, with a space before it or not: one BPE word."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.as_letters)
        return array("I", [t.id for t in self.model.tokenize(space + word)]).tobytes()

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece with the space before it, or of a line break and what follows; None if the
        text can't be cut there."""
        found = self.old.get(piece)
        if found is None:
            if piece.isascii() and piece.isalpha() or _LETTERS.fullmatch(piece):
                found = self._word(piece, self.space)
            elif not piece or piece[-1].isspace() or piece[0].isspace() and (piece[0] != "\n" or piece[1].isspace()):
                return None
            elif tail := _TAIL.fullmatch(piece):
                found = self.piece(tail[1]) + self._mark(tail[2])
            elif _LETTERS.fullmatch(piece, 1):
                found = self.marks["\n"] + self._word(piece[1:], "") if piece[0] == "\n" else self.plain(" " + piece)
            else:
                found = self.plain(piece if piece[0] == "\n" else " " + piece)
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[piece] = found
        return found

    def piece(self, piece: str) -> bytes | None:
        found = self.new.get(piece)
        return self._piece(piece) if found is None else found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = text.replace("\n", " \n").split(" ")
        head = pieces[0]
        if not head or head[-1].isspace() or "<|" in text:
            return self.plain(text)
        out = list(map(self.new.get, pieces))
        out[0] = self._word(head, "") if _LETTERS.fullmatch(head) else self.plain(head)
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = x = self.piece(pieces[i])
            if x is None:
                return self.plain(text)
        return b"".join(out)


def encoder(spec: Broadcast) -> TextEncoder:
    """The worker's encoder; a reused worker keeps its cache."""
    return held_in_worker("tokens", hash(spec.value), lambda: TextEncoder(spec.value))
