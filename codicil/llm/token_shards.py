"""Token-id shards with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id; each task appends their ids to shards of bounded size and
returns one row for each shard. A shard is::

    magic "EFTOK1\\0\\0" | u64 n_docs, n_null, n_tokens, id_base, width
    ids, little-endian, ``width`` bytes each (2 where every id fits)
    Elias-Fano sequence of the n_docs + 1 token boundaries
    Elias-Fano sequence of the sorted document ids less id_base (those of the first n_null are null)

An Elias-Fano sequence of n values up to u keeps ``l = floor(log2(u / n))`` low bits of each value packed, and
the high parts in unary in a bit vector of about 2n bits; the place of every 256th set bit stands behind them, and
``select`` finds the i-th from that and a scan of the bits after it. Offsets thus take about ``2 + l`` bits a document, and
no table of 64-bit offsets exists.

Edge cases: a null or empty text is the end id alone. Null ids come first. Rows that repeat an id follow one
another in the order of their texts. An empty table gives no shard and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm import bpe, worker
from codicil.llm.scratch import Scratch

MAGIC = b"EFTOK1\0\0"
END = 2
#: Tokens in a shard, but for one longer document.
SHARD_TOKENS = 1 << 21
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        unary = np.zeros((top >> low_bits) + n + 1, np.uint8)
        unary[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), (np.flatnonzero(unary)[::SAMPLE]).astype("<u8"))

    def select(self, i: int) -> int:
        """The i-th value, from the place of the sampled bit before it and a scan of the bits behind."""
        place, left = int(self.sample[i // SAMPLE]), i % SAMPLE
        at, skip = place // 8, place % 8
        while True:  # SAMPLE bits of one are mostly within 2 * SAMPLE
            ones = np.flatnonzero(np.unpackbits(self.high[at : at + SAMPLE // 4], bitorder="little"))
            ones = ones[np.searchsorted(ones, skip) :]
            if left < len(ones):
                break
            left, at, skip = left - len(ones), at + SAMPLE // 4, 0
        place = at * 8 + int(ones[left])
        first = i * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (place - i << self.low_bits) | (word >> first % 8) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1) if self.low_bits else 0
        return (places.astype(np.int64) << self.low_bits) + low

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at byte ``at``, and where it ends."""
        n, low_bits, a, b = struct.unpack_from("<QQQQ", data, at)
        at += 32
        marks = -(-n // SAMPLE)
        sample = np.frombuffer(data, "<u8", marks, at + a + b)
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), sample), at + a + b + 8 * marks


def shard_bytes(ids: list[np.ndarray], docs: list[int | None]) -> bytes:
    """A shard of the documents' ids; docs are sorted, nulls first."""
    tokens = np.concatenate(ids)
    width = 2 if int(tokens.max(initial=0)) < 2**16 else 4
    known = np.array([d for d in docs if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    head = struct.pack("<QQQqQ", len(docs), len(docs) - len(known), len(tokens), base, width)
    body = tokens.astype("<u2" if width == 2 else "<u4").tobytes()
    return MAGIC + head + body + EliasFano.encode(bounds).to_bytes() + EliasFano.encode(known - base).to_bytes()


class Shard:
    """Random access to a shard's documents through select."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        assert bytes(view[:8]) == MAGIC
        self.n_docs, self.n_null, self.n_tokens, base, width = struct.unpack_from("<QQQqQ", view, 8)
        self.tokens = np.frombuffer(view, "<u2" if width == 2 else "<u4", self.n_tokens, 48)
        self.bounds, at = EliasFano.read(view, 48 + self.n_tokens * width)
        self.base = base
        self.known, _ = EliasFano.read(view, at)

    def ids(self, i: int) -> np.ndarray:
        """Token ids of the i-th document of the shard."""
        return self.tokens[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_id(self, i: int) -> int | None:
        """Id of the i-th document of the shard."""
        return None if i < self.n_null else self.base + self.known.select(i - self.n_null)


WRITTEN = "path string, part int, seq int, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Write docs (doc_id, text) as shards below folder; one WRITTEN row for each shard, in doc_id order by (part, seq).

    A retried task writes under other names; only files named in the rows count.
    """
    tokenizer = tokenizer or bpe.default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("bpe")
        enc, part, seq = bpe.encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        ids: list[np.ndarray] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            name = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.eft"
            with store.open_output_stream(name) as f:
                f.write(shard_bytes(ids, names))
            row = {"path": [name], "part": [part], "seq": [seq], "n_docs": [len(names)], "n_tokens": [sum(map(len, ids))]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    new = np.append(enc.ids(text or ""), np.uint32(end))
                    if held and held + len(new) > shard_tokens:
                        yield flush()
                        ids, names, held, seq = [], [], 0, seq + 1
                    ids.append(new)
                    names.append(doc)
                    held += len(new)
        if names:
            yield flush()

    return ordered.mapInArrow(run, WRITTEN)


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, read from the shards' bytes."""
    tasks = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # running sums of the parts, a row each, and of the shards within a part
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before(Window.orderBy("part"))), F.lit(0)).alias("from"))
    within = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    placed = shards.withColumn("within", within).join(parts, "part").select("path", (F.col("from") + F.col("within")).cast("long").alias("base"))
    spread = placed.repartition(tasks, F.col("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    shard = Shard(f.read())
                for first in range(0, shard.n_docs, 4096):
                    docs = range(first, min(first + 4096, shard.n_docs))
                    starts = [shard.bounds.select(i) for i in range(docs.start, docs.stop + 1)]
                    crcs = [bpe.crc(shard.tokens[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                    cols = [pa.array([shard.doc_id(i) for i in docs], pa.int64()), pa.array(np.array(starts[:-1]) + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as shards in a working folder and return what read_shards finds there."""
    with Scratch(docs.sparkSession, "shards") as scratch:
        folder = scratch.path("data")
        shards = scratch.save(write_shards(docs, folder, tokenizer), "list")
        return scratch.result(read_shards(shards, folder))
