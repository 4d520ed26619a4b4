"""Exact byte-level BPE, encoded by backtracking over longest matches and decoded through an offset table.

A sequence of tokens is what BPE makes of a text exactly if no merge crosses the border of any two neighbours
(the pair table of :class:`Encoder`). So the encoder puts down the longest token that starts at a place, goes to shorter
ones where the border to the token before does not hold, and steps back one token where none holds; a place
that was stepped back from is never entered again, which bounds the work by the length of the text times the longest
chain of prefixes. The longest token at a place comes from an Aho-Corasick automaton that runs on over the text, and
is set anew only behind a token that was shortened.

Decoding lays the bytes of all tokens end to end behind a table of offsets, and gathers the ids' byte ranges from it.

:func:`encode` and :func:`decode` run both over DataFrames without a shuffle. Edge cases: a null or empty text gives no
ids and decodes to the empty text; null ids decode to null; ids outside the vocabulary decode to nothing; bytes that
are no UTF-8 decode to U+FFFD; repeated rows and null document ids stay as they are; an empty table gives an empty
table; a text of any length is encoded whole. A column of the name that is added is replaced.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from codicil.llm import worker
from codicil.llm.bpe import default_path
from codicil.llm.scratch import small_batches

#: Pre-tokens, and pairs of tokens, that a worker remembers; of twice as many the older half goes, which costs time and no result.
KEPT, KEPT_PAIRS = 250_000, 400_000
#: Longer pre-tokens are encoded anew each time, so that the table's size is bounded.
KEPT_CHARS = 64
#: Fixed value: pre-tokens of the byte-level scheme; letters come first here as they are the most frequent.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a batch that a task hands back, and ids decoded at once.
BATCH, BLOCK = 128, 1 << 16
FOREVER = 1 << 62


def rare() -> np.ndarray:
    """By code point, whether Unicode tables of different age may class it differently; the library cuts texts that hold one."""
    flags = np.zeros(sys.maxunicode + 1, bool)
    flags[[c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]] = True
    flags[0x10000:0x1F000] = flags[0x1FB00:] = True  # between them are pictures, letters in no version
    return flags


def alphabet() -> dict[str, int]:
    """Byte by character of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class OffsetTable:
    """Byte strings by id in one buffer; ids outside stand for no bytes."""

    def __init__(self, parts: list[bytes]):
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def gather(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        out = []
        for at in range(0, len(ids), BLOCK):
            block = ids[at : at + BLOCK]
            start, size = self.offsets[block], self.offsets[block + 1] - self.offsets[block]
            ends = np.cumsum(size)
            places = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
            out.append(self.buffer[places].tobytes())
        return b"".join(out)


def read(path: str) -> tuple[dict, list[dict], list[bytes]]:
    """The model, the added tokens and the bytes of every token of a tokenizer file.

    Only files that this algorithm can follow exactly are accepted: byte-level pre-tokens, no normaliser, added tokens without options.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec.get("added_tokens") or []
    split, shape = spec.get("pre_tokenizer") or {}, (spec.get("decoder") or {}).get("type")
    options = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model["type"] != "BPE" or options or spec.get("normalizer") or shape != "ByteLevel" or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        raise ValueError(f"{path} is no plain byte-level BPE file")
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with options")
    byte = alphabet()
    parts = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in added)], default=-1))
    for token, i in model["vocab"].items():
        parts[i] = bytes(byte[c] for c in token)
    for t in added:
        parts[t["id"]] = bytes(byte[c] for c in t["content"]) if all(c in byte for c in t["content"]) else t["content"].encode()
    return model, added, parts


class Decoder:
    """Texts of ids, added tokens included."""

    def __init__(self, path: str):
        self.table = OffsetTable(read(path)[2])

    def decode(self, ids: np.ndarray) -> str:
        return self.table.gather(ids).decode("utf-8", "replace")


class Encoder:
    """Ids of texts as ``tokenizers`` gives them for a byte-level BPE file whose tokens are made by one merge each."""

    def __init__(self, path: str):
        model, added, parts = read(path)
        size = len(parts)
        #: When BPE makes a token (bytes: before all merges), and what it is made of.
        self.born, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.left[made] >= 0:
                raise ValueError("a token that two merges make")
            self.born[made], self.left[made], self.right[made] = rank, x, y
            self.merged[x, y] = made
        self.size = [len(p) for p in parts]
        self.words = self._reachable(parts, set(model["vocab"].values()))
        if len([w for w in self.words if len(w) == 1]) != 256:
            raise ValueError("a byte without a token")
        #: Longest token that is a proper prefix, -1 for none.
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for word, i in self.words.items():
            self.shorter[i] = next((self.words[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.words), -1)
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.simple, self.rare = regex.compile(PATTERN).findall, rare()
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        #: The pair table: whether no merge crosses the border of two tokens.
        self.known: dict[int, bool] = {}
        self.kept = _Kept(self)

    def _reachable(self, parts: list[bytes], ids: set[int]) -> dict[str, int]:
        """Tokens (bytes as characters) that BPE does make of their own bytes, in the order of their making."""
        good: set[int] = set()
        for i in sorted(ids, key=lambda i: self.born[i]):
            x, y = self.left[i], self.right[i]
            if x < 0 and len(parts[i]) == 1 or x in good and y in good and self._holds(x, y, whole=True):
                good.add(i)
        return {parts[i].decode("latin-1"): i for i in good}

    def _holds(self, a: int, b: int, whole: bool = False) -> bool:
        """Whether no merge crosses the border of a and b; whole: up to the merge of a and b itself.

        Goes back in time over the tokens that meet at the border. A pair (x, y) there merges if its rank comes before
        x and y go into what they are part of; among equal ranks BPE takes the leftmost pair, so on the left an equal
        rank goes first and on the right it goes last.
        """
        born, merged = self.born, self.merged
        x, y = a, b
        x_ends = y_ends = born[merged[a, b]] if whole else FOREVER
        while True:
            made = merged.get((x, y))
            if made is not None and born[made] < x_ends and born[made] <= y_ends:
                return False
            if born[x] > born[y]:
                x, x_ends = self.right[x], born[x]
            elif self.left[y] >= 0:
                y, y_ends = self.left[y], born[y]
            else:
                return True

    def _learn(self, a: int, b: int) -> bool:
        """Put a pair of tokens into the pair table."""
        if len(self.known) >= KEPT_PAIRS:
            self.known.clear()
        got = self.known[a << 32 | b] = self._holds(a, b)
        return got

    def piece(self, data: str) -> list[int]:
        """Ids of one pre-token, whose bytes are given as characters."""
        whole = self.words.get(data)
        if whole is not None:
            return [whole]
        matches, size, shorter, known = self.automaton.iter_long, self.size, self.shorter, self.known.get
        last = len(data) - 1
        left_again: set[int] = set()
        ids: list[int] = []
        ahead = matches(data)  # gives the longest token at the place behind the one it gave before
        end, token = next(ahead)
        at, before, fits = 0, -1, True
        while True:
            if fits:
                ids.append(token)
                if end == last:
                    return ids
                at, before = end + 1, token
                if ahead is None:
                    ahead = matches(data, at)
                end, token = next(ahead)
            elif shorter[token] >= 0:
                token, ahead = shorter[token], None
                end = at + size[token] - 1
            else:
                left_again.add(at)
                token, ahead = ids.pop(), None
                end = at - 1
                at -= size[token]
                before = ids[-1] if ids else -1
            fits = end + 1 not in left_again
            if fits and before >= 0:
                fits = known(before << 32 | token)
                if fits is None:
                    fits = self._learn(before, token)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if not text.isascii() and self.rare[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return [text[a:b] for _, (a, b) in self.library(text)]
        return self.simple(text)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        out = []
        for i, part in enumerate(self.cut(text) if self.cut else [text]):
            if i % 2:
                out.append(array("I", [self.added[part]]).tobytes())
            else:
                out += map(self.kept.__getitem__, self.split(part))
        return np.frombuffer(b"".join(out), np.uint32)


class _Kept(dict):
    """Ids (native unsigned 32-bit) by pre-token, in a younger and an older half."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("I", self.encoder.piece(part if part.isascii() else part.encode().decode("latin-1"))).tobytes()
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept while this is what the worker does."""
    worker.keep("bpe_codec", encoder.cache_clear)
    return Encoder(path)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _with_column(df: DataFrame, source: str, name: str, kind: str, make) -> DataFrame:
    """df with the column name, which make computes from the column source."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c.lower() != name.lower()]
    given = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{source}`").alias("__given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("bpe_codec")
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], make(piece.columns[-1])], names=[*rest, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, `{name}` {kind}".lstrip(", "))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """df with a column ids, array<int>, of the whole texts."""
    path = tokenizer or default_path()

    def make(texts: pa.Array) -> pa.Array:
        found = [encoder(path).encode(t) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int32)))

    return _with_column(df.withColumn(text, F.col(f"`{text}`").cast("string")), text, ids, "array<int>", make)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """df with a column text of what the ids stand for."""
    path = tokenizer or default_path()

    def make(lists: pa.Array) -> pa.Array:
        known, values, ends = lists.is_valid().to_pylist(), lists.values.fill_null(-1).to_numpy(), lists.offsets.to_numpy()
        return pa.array([decoder(path).decode(values[a:b]) if ok else None for ok, a, b in zip(known, ends[:-1], ends[1:], strict=True)], pa.string())

    return _with_column(df.withColumn(ids, F.col(f"`{ids}`").cast("array<int>")), ids, text, "string", make)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of docs (doc_id, text)."""
    encoded = encode(docs.select("doc_id", "text"), tokenizer=tokenizer).drop("text")
    return decode(encoded, tokenizer=tokenizer)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what round_trip gives."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
