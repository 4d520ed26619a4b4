"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and an exact check.

Each text becomes its set of word shingles and 125 registers: register i is the truncated, exponentially
spaced minimum ``floor(1 - log_b(x_i))`` of an exponential variable per shingle, so the registers of a
union are the element-wise maximum (:func:`merge`). Equal runs of registers (bands) make texts meet.

* Texts with the same set collapse to one class first, so copies never meet one another.
* In each band, every class is paired with the band's hub, the class that meets most others over all its bands (the
  likely origin of near copies). The classes that met one hub are its group; those that its links connect need no
  further pair, so a large group of near copies costs about one pair per class.
* Classes of one group that aren't connected yet are compared without forming all pairs (:func:`_apart`). A shingle
  is popular in a group if more than ``RARE`` classes of it hold it. Two sets at the threshold either share rare
  shingles, which an equal join over a prefix of each set's rarest ones finds, or both hold so many popular ones that
  these alone could reach it, which a join over sizes finds. Both are bounds on full sets: no pair is lost by them.
* A pair is first held to bounds over 4 standard deviations below the threshold: the size ratio, the agreement
  of the registers' lowest bits inside the join, then the maximum-likelihood estimate from both register sets.
  The rest are confirmed on their full shingle sets. Only texts of classes that met another are moved for it.

Edge cases: a null, empty or white-space-only text has an empty set, is linked with nothing and kept. A text
of fewer words than a shingle is one shingle. Rows with a null id are returned with a null component and
kept. Rows that repeat an id get the same component, and each is kept or not like the others. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm import worker
from codicil.llm.scratch import Scratch
from codicil.llm.words import hash_words, mix, shingles, text_bytes

#: Registers, registers in a band: a pair at 0.8 shares a band with probability 1 - 5e-5.
REGISTERS, ROWS = 125, 5
#: SetSketch parameters: base, rate, largest register value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Estimates this far below the threshold are left out (the deviation at 0.8 is 0.036).
SLACK = 0.16
#: Of the registers' lowest bits, how many may differ: at 0.8 the mean is 12.5 and the deviation 3.4.
BITS = 28
#: A shingle is rare in a group if at most this many of its classes hold it; groups of as few classes compare them directly.
RARE = 64
#: Components that hold this fraction of a group are set against others without meeting themselves.
SLOTS = 16
#: Classes of one size and component in one cell of the join over sizes.
CELL = 256
#: Shared rare shingles that are broadcast; beyond it they are shuffled.
BROADCAST_SHINGLES = 500_000
#: Most ids or pairs that are broadcast to pick, pair or drop texts; beyond it the two are shuffled together.
BROADCAST_IDS = 2_000_000

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, registers binary"


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 1024):
        np.minimum(least, (elements[i : i + 1024, None] * _factors()).min(axis=0), out=least)
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of register rows with known set sizes."""
    above = (a > b).sum(1)[:, None].astype(float)
    below = (a < b).sum(1)[:, None].astype(float)
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u) * (1 - 1e-9)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    score = above * np.log(up + tiny) + below * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)
    return grid[np.arange(len(a)), score.argmax(1)]


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """One row of SKETCH for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("near")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, bounds, _, _ = hash_words(*text_bytes(part.column(1)))
                n, a, b, regs, bits = [], [], [], [], []
                for s in shingles(hashes, bounds, k):
                    n.append(len(s))
                    x, y = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    a.append(x)
                    b.append(y)
                    own = registers(s) if len(s) else np.zeros(REGISTERS, "<u2")
                    regs.append(own.tobytes() if len(s) else None)
                    bits.append(np.frombuffer(np.packbits(np.append(own & 1, [0, 0, 0]).astype(bool)).tobytes(), np.int64))
                low, high = np.array(bits, np.int64).reshape(-1, 2).T
                cols = [part.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, a, b, low, high)), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_a", "set_b", "bits_a", "bits_b", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def band_keys(reps: DataFrame) -> DataFrame:
    """(band, doc_id) for each band of each class; band is a 64-bit key of band number and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("near")
        salt = mix(np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1, ROWS).astype(np.uint64)
            key = np.broadcast_to(salt, r.shape[:2]).copy()
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j])
            ids = np.repeat(np.asarray(batch.column(0)), r.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["band", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(run, "band long, doc_id long")


def _could(x: str, y: str, percent: int) -> Column:
    """Whether two sketched rows, with columns prefixed x and y, can be at the threshold by sizes and lowest bits."""
    size = 100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")
    differ = F.bit_count(F.col(f"{x}bits_a").bitwiseXOR(F.col(f"{y}bits_a"))) + F.bit_count(F.col(f"{x}bits_b").bitwiseXOR(F.col(f"{y}bits_b")))
    return size & (differ <= BITS if percent >= 80 else F.lit(True))


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimate isn't far below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("near")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(part.num_rows, -1) for i in (3, 5))
                est = jaccard(x, y, *(np.asarray(part.column(i)).astype(float) for i in (2, 4)))
                yield part.select([0, 1]).filter(pa.array(est >= least - SLACK))

    side = lambda s: reps.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with these distinct ids; ids are broadcast only if they were counted to be few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("near")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x, y = (list(shingles(*hash_words(*text_bytes(part.column(i)))[:2], k)) for i in (2, 3))
                same = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y, strict=True)]
                good = [100 * n >= percent * (len(s) + len(t) - n) for n, s, t in zip(same, x, y, strict=True)]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"t_{s}"))
    # pairs that are few go to one side's texts, so that these are moved once, and the other's as they are
    few = F.broadcast(pairs) if pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else pairs
    joined = few.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of docs (doc_id, text); an id that stands for several texts has the shingles of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("near")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = list(shingles(*hash_words(*text_bytes(part.column(1)))[:2], k))
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "shingles"])

    each = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")
    return each.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))


def _apart(groups: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of one group and two components that can be at the threshold.

    groups: (hub, doc_id, n, bits_a, bits_b, component_id, n_rows), the classes of each group and their number;
    docs: (doc_id, text) of all of them. With t the popular shingles of a set and n its size, sets that share o
    rare shingles have at most min(t) + o in common, and the threshold asks for percent / (100 + percent) of n_a + n_b.
    A partner is no smaller than percent of a set, so a set needs at least percent of its n in t + o.
    """
    enough = lambda t, o, n: (100 + percent) * (t + o) >= percent * n
    facts = ("doc_id", "component_id", "n", "bits_a", "bits_b")
    named = lambda rows, s, *more: rows.select(*more, *(F.col(c).alias(f"{s}{c}") for c in facts))
    ends = (F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b"))

    few = groups.where(F.col("n_rows") <= RARE)
    direct = named(few, "x_", "hub").join(named(few, "y_", "hub"), "hub").where("x_component_id < y_component_id").where(_could("x_", "y_", percent)).select(*ends)
    many = groups.where(F.col("n_rows") > RARE)
    if many.isEmpty():
        return direct

    sets = _sets(_texts(docs, many.select("doc_id").distinct()), k)
    sets = scratch.save(many.groupBy("hub", "doc_id").agg(F.min("n").alias("n"), F.min("component_id").alias("component_id")).join(sets, "doc_id"), "sets")
    each = sets.select("hub", "doc_id", F.explode("shingles").alias("shingle"))
    rare = each.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("only")).where(F.col("held") <= RARE)
    rare = scratch.save(rare, "rare")
    # shingles that one class holds are only counted; those of more find their holders, at most RARE each
    once = rare.where("held = 1").groupBy("hub", F.col("only").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_once"))
    shared = rare.where("held > 1").select("hub", "shingle", "held")
    held = each.join(F.broadcast(shared) if shared.count() <= BROADCAST_SHINGLES else shared, ["hub", "shingle"])
    held = held.groupBy("hub", "doc_id").agg(F.count(F.lit(1)).alias("n_shared"), F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
    own = sets.select("hub", "doc_id", "component_id", "n", F.size("shingles").alias("size")).join(held, ["hub", "doc_id"], "left").join(once, ["hub", "doc_id"], "left")
    own = own.withColumn("shared", F.coalesce("shared", F.array().cast("array<struct<held:bigint,shingle:bigint>>"))).withColumn("n_rare", F.coalesce("n_once", F.lit(0)) + F.coalesce("n_shared", F.lit(0)))
    own = own.withColumn("t", (F.col("size") - F.col("n_rare")).cast("long"))
    # shared rare shingles by number of holders: the prefix leaves out what the least overlap allows
    least = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100) - F.col("t"))
    own = own.withColumn("prefix", F.greatest(F.lit(0), F.size("shared") - least + 1).cast("int")).withColumn("whole", F.col("prefix") == F.size("shared"))
    own = scratch.save(own.select("hub", "doc_id", "component_id", "n", "t", "whole", F.slice("shared", 1, F.col("prefix")).alias("shared")), "own")

    # pairs that meet in a rare shingle of both prefixes; where the prefixes are whole, what they share is known
    of = F.struct("doc_id", "component_id", "n", "t", "whole")
    meet = own.select("hub", of.alias("x"), F.explode("shared.shingle").alias("shingle")).groupBy("hub", "shingle").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    later = F.filter("xs", lambda y: (y["doc_id"] > F.col("x.doc_id")) & (y["component_id"] != F.col("x.component_id")))
    meet = meet.select("hub", F.explode("xs").alias("x"), "xs").select("hub", "x", F.explode(later).alias("y"))
    meet = meet.groupBy("hub", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    can = ~F.col("x.whole") | ~F.col("y.whole") | enough(F.least("x.t", "y.t"), F.col("o"), F.col("x.n") + F.col("y.n"))
    size = (100 * F.least("x.n", "y.n")) >= percent * F.greatest("x.n", "y.n")
    by_rare = meet.where(can & size).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))

    # pairs whose popular shingles could do: sizes of partners lie in a range
    step = lambda n: F.floor(64 * F.log2(n)).cast("int")
    most = F.least(F.floor(((100 + percent) * F.col("t") - percent * F.col("n")) / percent), F.floor(100 * F.col("n") / percent))
    heavy = own.withColumn("low", F.ceil(percent * F.col("n") / 100)).withColumn("high", most).where("high >= low")
    heavy = many.join(heavy.select("hub", "doc_id", "t", "low", "high"), ["hub", "doc_id"]).withColumn("step", step(F.col("n")))
    large = heavy.groupBy("hub", "component_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_rows").alias("n_rows")).where(F.col("rows") * SLOTS >= F.col("n_rows"))
    large = large.select("hub", "component_id", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("rows"), "component_id")).alias("slot"))  # at most SLOTS a hub
    heavy = scratch.save(heavy.join(large, ["hub", "component_id"], "left").withColumn("slot", F.coalesce("slot", F.lit(SLOTS + 1))), "heavy")
    cells = heavy.groupBy("hub", "slot", "step").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    cells = scratch.save(cells, "cells")
    x = named(heavy, "x_", "hub", F.col("slot").alias("x_slot"), F.col("t").alias("x_t"), step(F.col("low")).alias("low"), step(F.col("high")).alias("high"))
    x = x.join(cells, "hub").where("(slot < x_slot or slot > %d and x_slot > %d) and step between low and high" % (SLOTS, SLOTS))
    x = x.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("low", "high", "cells")
    y = heavy.join(cells, ["hub", "slot", "step"]).withColumn("cell", F.pmod(F.xxhash64("doc_id"), "cells").cast("int"))
    y = named(y, "y_", "hub", "slot", "step", "cell", F.col("t").alias("y_t"))
    by_size = x.join(y, ["hub", "slot", "step", "cell"]).where("x_component_id <> y_component_id and (x_slot <> slot or x_doc_id < y_doc_id)")
    by_size = by_size.where(enough(F.least("x_t", "y_t"), F.lit(0), F.col("x_n") + F.col("y_n"))).where(_could("x_", "y_", percent)).select(*ends)
    return direct.union(by_rare).union(by_size)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, component_id) of all ends of links (a, b): the smallest id reachable.

    Labels take the least label among neighbours, then the label of their label, until nothing changes.
    Each round is written, so its lineage is one table.
    """
    edges = scratch.save(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.col("a"), F.min("b")).alias("component_id")), f"{name}-0")
    step = 0
    while True:
        near = edges.join(labels.select(F.col("doc_id").alias("b"), F.col("component_id").alias("c")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("c").alias("c"))
        one = labels.join(near, "doc_id").select("doc_id", F.col("component_id").alias("old"), F.least("component_id", "c").alias("mid"))
        far = labels.select(F.col("doc_id").alias("mid"), F.col("component_id").alias("of_mid"))
        two = one.join(far, "mid", "left").select("doc_id", F.least("mid", "of_mid").alias("component_id"), (F.least("mid", "of_mid") < F.col("old")).alias("moved"))
        step += 1
        saved = scratch.save(two, f"{name}-{step}")
        moved = saved.where("moved").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = saved.select("doc_id", "component_id")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    k: words of a shingle; percent: least similarity of a link. component_id is the smallest doc_id
    reachable over links, kept says that doc_id is that one.
    """
    spark = docs.sparkSession
    with Scratch(spark, "near") as scratch:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sketches = scratch.save(sketch(docs, k), "sketches")
        full = sketches.where("n_shingles > 0 and doc_id is not null")
        classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        classes = scratch.save(classes, "classes")
        reps = full.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi")
        reps = scratch.save(reps.drop("set_a", "set_b").distinct(), "reps")
        bands = scratch.save(band_keys(reps), "bands")
        shared = bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        met = scratch.save(bands.join(shared.where("first < last").select("band", F.col("n").alias("meets")), "band"), "met")
        scratch.drop("bands")
        weight = met.groupBy("doc_id").agg(F.sum("meets").alias("weight"))
        facts = reps.select("doc_id", F.col("n_shingles").alias("n"), "bits_a", "bits_b").join(weight, "doc_id")
        met = scratch.save(met.select("band", "doc_id").join(facts, "doc_id"), "facts")
        scratch.drop("met")
        # ids that met another one, once; the texts that later rounds move are among these
        candidates = scratch.save(_texts(docs, met.select("doc_id").distinct()), "candidates")

        ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

        def linked(pairs: DataFrame, name: str) -> DataFrame:
            likely = scratch.save(_likely(scratch.save(pairs, f"pairs-{name}"), reps, percent / 100), f"likely-{name}")
            return scratch.save(_confirmed(likely, candidates, k, percent), f"links-{name}")

        # every class with the hub of each of its bands
        pick = F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), "doc_id", "n", "bits_a", "bits_b")).alias("c")
        hub = met.groupBy("band").agg(pick).select("band", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("doc_id", "n", "bits_a", "bits_b")))
        groups = met.join(hub, "band").select(F.col("c_doc_id").alias("hub"), "c_n", "c_bits_a", "c_bits_b", "doc_id", "n", "bits_a", "bits_b").distinct()
        groups = scratch.save(groups, "groups")
        starred = groups.where("doc_id <> hub").withColumnsRenamed({x: f"o_{x}" for x in ("n", "bits_a", "bits_b")}).where(_could("c_", "o_", percent))
        links = linked(ordered(starred.select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))), "hubs")
        comps = components(links, scratch, "hubs")
        # groups of three classes or more that are still apart
        groups = groups.join(comps, "doc_id", "left").select("hub", "doc_id", "n", "bits_a", "bits_b", F.coalesce("component_id", "doc_id").alias("component_id"))
        split = groups.groupBy("hub").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"), F.count(F.lit(1)).alias("n_rows"))
        groups = scratch.save(groups.join(split.where("low < high and n_rows > 2").select("hub", "n_rows"), "hub"), "open")
        more = linked(ordered(_apart(groups, candidates, k, percent, scratch)), "apart")
        # the labels of both ends are linked, so the first links aren't followed again
        label = lambda s: comps.select(F.col("doc_id").alias(s), F.col("component_id").alias(f"of_{s}"))
        joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        wider = components(joined, scratch, "apart").select(F.col("doc_id").alias("label"), F.col("component_id").alias("wider"))
        known = comps.union(joined.select(F.explode(F.array("a", "b")).alias("doc_id"), F.lit(None).cast("long"))).groupBy("doc_id").agg(F.min("component_id").alias("own"))
        known = known.withColumn("label", F.coalesce("own", "doc_id")).join(wider, "label", "left")
        comps = scratch.save(known.select("doc_id", F.coalesce("wider", "label").alias("component_id")), "comps")

        member = sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"], "left")
        member = member.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
        member = member.join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
        out = member.select("doc_id", "n_shingles", component.alias("component_id"))
        return scratch.result(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id")).distinct()
    # whole rows are moved only where more ids go than can be broadcast
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
