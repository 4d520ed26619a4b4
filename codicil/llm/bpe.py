"""Exact ids of a byte-level BPE file, through the ``tokenizers`` library's own model.

The pre-tokeniser works on runs between single spaces independently of their neighbours, so the ids
of each distinct run are kept and looked up again. A text in which white space touches a space
(where a run's neighbours do matter) goes through the whole tokenizer instead, and so does one that holds
an added token such as ``<|endoftext|>``.
"""

from __future__ import annotations

import zlib
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from codicil.llm import worker

#: Kept runs per worker; older ones go when twice as many are held.
KEPT = 200_000
#: Closing marks that are neither letters, digits, white space nor part of a contraction.
MARKS = ".,;:!?#$%&*|"
#: Ids of the few strings of closing marks met so far; kept small by the runs' own bound.
TAILS: dict[str, bytes] = {}


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class _Whole(Exception):
    """The text must be encoded as a whole."""


@cache
def _alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Runs(dict):
    """Ids (native unsigned 32-bit) by run; ``lead`` is what stands before each run of this table (a space or nothing)."""

    def __init__(self, model: object, lead: str, bare: _Runs | None = None):
        super().__init__()
        self.tokenize, self.lead, self.old = model.tokenize, lead, {}
        self.bare = self if bare is None else bare
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _alphabet()

    def part(self, text: str) -> bytes:
        """Ids of one pre-token."""
        return array("I", [t.id for t in self.tokenize(text.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def fresh(self, run: str) -> bytes:
        if run.isalpha():
            return self.part(self.lead + run)
        if not run or run[0].isspace() or run[-1].isspace():
            raise _Whole
        word = run.rstrip(MARKS)
        if word != run and word.isalpha():  # a word and its closing marks are two pre-tokens
            tail = run[len(word) :]
            return self[word] + (TAILS.get(tail) or TAILS.setdefault(tail, self.part(tail)))
        if run.count("\n") == 1:
            above, below = run.split("\n")
            if not (above[-1].isspace() or below[0].isspace()):  # so is a line end between two words
                return self[above] + (TAILS.get("\n") or TAILS.setdefault("\n", self.part("\n"))) + self.bare[below]
        return b"".join(map(self.part, self.split(self.lead + run)))

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.fresh(run)
        if len(self) >= KEPT:
            if len(TAILS) > KEPT:
                TAILS.clear()
            self.old = dict(self)
            self.clear()
        self[run] = ids
        return ids


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = _Runs(model, "")
        self.rest = _Runs(model, " ", self.first)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        head, *tail = text.split(" ")
        try:
            if any(t in text for t in self.added):
                raise _Whole
            ids = self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except _Whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(ids, np.uint32)


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept while this is what the worker does."""
    worker.keep("bpe", encoder.cache_clear)
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
