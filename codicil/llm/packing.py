"""Best-fit packing of token sequences by a configuration linear program.

1. Spark tokenises whole texts and cuts only documents longer than the capacity, into full pieces after a
   first piece that may be shorter. Only (id, piece, start, length, crc) rows remain.
2. The histogram of lengths, at most ``capacity`` rows whatever the corpus, goes to the driver. The covering
   program over configurations (multisets of lengths that fit) is solved by multiplicative weights: each
   step prices lengths by their weights and takes the best configuration found by knapsack dynamic
   programming. The averaged configurations are rounded, and the program is solved anew for what that leaves
   until less than one sequence is left, which goes best-fit. Configurations are kept with their multiplicity, so
   no work grows with the number of documents.
3. Each configuration owns a run of sequences, and each of its lengths a run of ranks. Pieces of one length
   are ranked within hash buckets and by the buckets' running counts, so a length that a third of all rows
   share is spread over many tasks; rank and plan give sequence and offset.

Edge cases: a null or empty text is the end id alone. Rows with a null id, or rows that repeat an id, are
packed like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm import bpe, worker
from codicil.llm.scratch import Scratch

END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
#: Hash buckets over which the pieces of each length are ranked.
BUCKETS = 256
#: Steps of the multiplicative weights, and how often the program is solved for what rounding left.
STEPS, ROUNDS = 64, 40
#: Learning rates tried: small ones suit histograms that fill sequences, large ones those that can't.
RATES = (0.05, 1.0)
#: First prices are lengths to this power: of configurations equally full, those with long pieces come first.
TILT = 1.1
#: Share of sequences over the bound by volume within which no other rate is tried.
GAP = 0.001


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces at the end, the rest first."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end: int = END) -> DataFrame:
    """PIECES rows of docs (doc_id, text); row tells repeated rows of a batch apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("bpe")
        enc = bpe.encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for row, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    ids = np.append(enc.ids(text or ""), np.uint32(end))
                    out += [(doc, i, s, n, bpe.crc(ids[s : s + n]), at + row) for i, (s, n) in enumerate(cut(len(ids), capacity))]
                if out:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def knapsack(value: np.ndarray, limit: np.ndarray, capacity: int) -> Counter:
    """Configuration of greatest value by bounded dynamic programming over the capacity.

    value, limit: by length, 0 to capacity; no length is used more often than its limit, whose copies enter in
    lots of 1, 2, 4 and so on.
    """
    best = np.zeros(capacity + 1)
    lots: list[tuple[int, int, np.ndarray]] = []
    for s in np.flatnonzero((limit > 0) & (value > 0))[::-1].tolist():
        n, k = min(int(limit[s]), capacity // s), 1
        while n:
            k = min(k, n)
            gain = best[: capacity + 1 - k * s] + k * value[s]
            better = gain > best[k * s :] + 1e-12
            np.copyto(best[k * s :], gain, where=better)
            lots.append((s, k, better))
            n, k = n - k, 2 * k
    found: Counter = Counter()
    room = capacity
    for s, k, better in reversed(lots):
        if room >= k * s and better[room - k * s]:
            found[s] += k
            room -= k * s
    return found


def fractional(counts: np.ndarray, capacity: int, rate: float, steps: int) -> dict[tuple, float]:
    """Configuration -> fractional multiplicity covering the counts, by multiplicative weights.

    A length that is ahead of the share covered so far loses weight, one that is behind gains, by a factor
    of at most e**rate in a step; the weights stay near the dual prices of the covering program. The
    multiplicities are those of all steps together.
    """
    sizes = np.flatnonzero(counts)
    need = counts[sizes].astype(float)
    place = {int(s): i for i, s in enumerate(sizes)}
    weight = TILT * np.log(sizes / capacity)
    covered = np.zeros(len(sizes))
    used: Counter = Counter()
    volume = float((need * sizes).sum())
    for _ in range(steps):
        value = np.zeros(capacity + 1)
        value[sizes] = np.exp(weight)
        config = knapsack(value, counts, capacity)
        amount = volume / steps / sum(s * n for s, n in config.items())
        amount = min(amount, *(need[place[s]] / n for s, n in config.items()))
        used[tuple(sorted(config.items(), reverse=True))] += amount
        for s, n in config.items():
            covered[place[s]] += n * amount
        done = float((covered * sizes).sum()) / volume
        weight = weight - rate * np.clip(covered / need - done, -1, 1)
    return used


def best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over a histogram; bins with equal contents are one entry with a count."""
    bins: dict[int, Counter] = defaultdict(Counter)  # by free room: contents -> how many bins
    for s in np.flatnonzero(left)[::-1].tolist():
        n = int(left[s])
        for room in range(s, capacity):
            while n and bins.get(room):
                contents, have = bins[room].popitem()
                per = min(room // s, n)  # as many as fit, while bins last
                take = min(have, n // per)
                if have > take:
                    bins[room][contents] = have - take
                bins[room - per * s][(*contents, (s, per))] += take
                n -= take * per
            if not n:
                break
        per = capacity // s
        if n // per:
            bins[capacity - per * s][((s, per),)] += n // per
        if n % per:
            bins[capacity - n % per * s][((s, n % per),)] += 1
    return sum((Counter(b) for b in bins.values()), Counter())


def rounded(counts: np.ndarray, capacity: int, rate: float) -> Counter:
    """Configuration -> integer multiplicity that packs the histogram exactly.

    The program is solved again and again for what is left. Each time its multiplicities are rounded down and,
    fullest configuration first, one more is taken of each that what is left still admits. At least one sequence
    is filled each time; what is under one sequence, or left after ROUNDS times, goes best-fit.
    """
    left, chosen = counts.copy(), Counter()
    tokens = np.arange(capacity + 1)
    for _ in range(ROUNDS):
        volume = int(left @ tokens)
        if volume < capacity:
            break
        shares = fractional(left, capacity, rate, min(STEPS, volume // capacity))
        order = sorted(shares, key=lambda c: (-sum(s * k for s, k in c), c))
        for up in (False, True):
            for config in order:
                n = min(1 if up else int(shares[config]), *(int(left[s]) // k for s, k in config))
                if n > 0:
                    chosen[config] += n
                    for s, k in config:
                        left[s] -= n * k
    return chosen + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """(configuration, multiplicity) list that packs the histogram exactly, by the configuration program.

    Each rate is tried until the rounded program is within GAP of the bound that the tokens' number gives.
    """
    best: Counter | None = None
    if not counts.any():
        return []
    bound = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    for rate in RATES:
        found = rounded(counts, capacity, rate)
        if best is None or found.total() < best.total():
            best = found
        if best.total() - bound <= GAP * bound:
            break
    return sorted(best.items(), reverse=True)


def placed(rows: DataFrame, configs: list[tuple[tuple, int]], scratch: Scratch) -> DataFrame:
    """rows (length, ...) with sequence_id and offset by the plan."""
    spark = rows.sparkSession
    slots, at, base = [], Counter(), 0
    for config, times in configs:
        offset = 0
        for s, per in config:
            slots.append((s, at[s], at[s] + per * times, per, base, offset))
            at[s] += per * times
            offset += s * per
        base += times
    slot = spark.createDataFrame(slots or [(0, 0, 0, 1, 0, 0)], "length long, low long, high long, per long, base long, off long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = scratch.save(sums.select("length", "bucket", before.alias("before")), "ranks")
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row", "ids_crc32")) - 1
    # both tables are bounded: lengths x buckets rows, and the plan's lengths x configurations
    ranked = rows.withColumn("inner", inner).join(F.broadcast(sums), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inner"))
    s = F.broadcast(slot.withColumnRenamed("length", "s_length"))
    hit = ranked.join(s, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    return hit.withColumn("sequence_id", F.col("base") + F.floor(k / F.col("per"))).withColumn("offset", F.col("off") + (k % F.col("per")) * F.col("length"))


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    with Scratch(spark, "pack") as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = scratch.save(pieces(docs, capacity, tokenizer or bpe.default_path(), end), "pieces")
        counts = np.zeros(capacity + 1, np.int64)
        for length, n in rows.groupBy("length").count().collect():  # at most one row for each length
            counts[length] = n
        out = placed(rows, plan(counts, capacity), scratch)
        return scratch.result(out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
