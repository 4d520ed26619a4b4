"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources' roots.

Every row is a leaf, the SHA-256 of its fields' lengths and values. Within a source leaves are ordered by id, and of every
``FANOUT`` neighbours conditional aggregates make one row with a column for each slot (the slot pivot). The parent's digest is the
hash of its columns laid end to end; a child's siblings are the columns without its own. Sources' roots are ordered by
source and joined in the same way. All of it is DataFrame code.

* Places within a source come from one sort of the whole table by range, so a source that holds most rows is spread over all tasks;
  the running sums are over a row for each source and task.
* Going down, a parent meets the columns and the path of the row above it, by a key that sixteen rows hold at most; no path is
  shuffled for every leaf.

Edge cases: null fields are hashed as ``-``; rows without a source form a source of their own, before all others; null ids come before
all others and are never altered; rows that repeat an id are ordered by their digests, and equal rows are leaves of their own.
A source of one row has that leaf as its root, and one source's root is the whole root. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.scratch import Scratch

FANOUT = 16
#: What is hashed of a document, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a task that puts rows in order, at least.
TASK_ROWS = 2_000
#: monotonically_increasing_id keeps a task's own count in so many bits.
TASK_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts laid end to end."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*map(field, values))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with their ``index`` in the order within their group, and their group's ``size``; group is the first of the order."""
    n = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS))
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())  # equal rows may be dealt over tasks
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_salt"]]
    dealt = salted.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumn("_task", F.shiftright("_at", TASK_BITS)), f"{name}-dealt")
    per_task = scratch.save(dealt.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), f"{name}-tasks")
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_task.select(F.col(group).alias("_group"), F.col("_task").alias("_its"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    joined = dealt.join(starts, (dealt[group] == starts["_group"]) & (dealt["_task"] == starts["_its"]))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("index"), "size")


def _slots(prefix: str = "c") -> list[str]:
    return [f"{prefix}{k}" for k in range(FANOUT)]


def pivot(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """Parents of nodes (group, index, size, the kept columns with ``hash`` first), a struct column of kept for each slot.

    ``index`` is the parent's place, ``size`` the number of the group's parents, ``hash`` the parent's digest.
    """
    child = F.struct(*kept)
    spread = [F.max(F.when(F.col("index") % FANOUT == k, child)).alias(c) for k, c in enumerate(_slots())]
    parents = nodes.groupBy("group", F.expr(f"index div {FANOUT}").alias("parent")).agg(F.max("size").alias("_of"), *spread)
    size = F.expr(f"(_of + {FANOUT - 1}) div {FANOUT}")
    return parents.select("group", F.col("parent").alias("index"), size.alias("size"), digest(*_hashes()).alias("hash"), *_slots())


def _hashes() -> list[Column]:
    return [F.coalesce(F.col(f"{c}.hash"), F.lit("")) for c in _slots()]


def siblings(hashes: Column, slot: Column) -> Column:
    """What stands left and right of a slot among its parent's columns."""
    left, right = F.slice(hashes, F.lit(1), slot), F.slice(hashes, slot + 2, F.lit(FANOUT))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def grow(nodes: DataFrame, kept: list[str], scratch: Scratch, name: str) -> list[DataFrame]:
    """Tables of parents, level by level, until each group has one node."""
    levels: list[DataFrame] = []
    many = nodes.where("size > 1")
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(scratch.save(pivot(many, kept), f"{name}-{len(levels)}"))
        kept, most = ["hash"], -(-most // FANOUT)
        many = levels[-1].where("size > 1").select("group", "index", "size", "hash")
    return levels


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame | None:
    """The lowest level's rows with ``path``: left and right siblings from their own level up, ended by what ``tops`` has.

    tops: group, height (levels of the group's own tree), path, and any columns that every row of the group gets.
    """
    above: DataFrame | None = None
    given = [c for c in tops.columns if c not in ("group", "height", "path")]
    for k in reversed(range(len(levels))):
        roots = levels[k].where("size = 1").join(tops.where(F.col("height") == k + 1).drop("height"), "group")
        if above is None:
            above = roots
            continue
        up = above.select(F.col("group"), F.col("index").alias("_up"), F.array(*_hashes()).alias("_hashes"), F.col("path").alias("_path"), *given)
        rest = levels[k].where("size > 1").withColumn("_up", F.expr(f"index div {FANOUT}")).join(up, ["group", "_up"])
        slot = (F.col("index") % FANOUT).cast("int")
        rest = rest.withColumn("path", F.concat(F.array(siblings(F.col("_hashes"), slot)), F.col("_path"))).drop("_up", "_hashes", "_path")
        above = roots.unionByName(rest)
    return above


def children(parents: DataFrame) -> DataFrame:
    """A row for each child of parents with a path: ``child`` and its own path."""
    own = parents.withColumn("_hashes", F.array(*_hashes()))
    rest = [c for c in own.columns if c not in (*_slots(), "index", "size", "hash")]
    slots = own.select(*rest, F.posexplode(F.array(*_slots())).alias("_slot", "child")).where("child IS NOT NULL")
    return slots.withColumn("path", F.concat(F.array(siblings(F.col("_hashes"), F.col("_slot"))), F.col("path"))).drop("_hashes", "_slot")


def manifest(docs: DataFrame, scratch: Scratch, altered: Column | None = None) -> tuple[DataFrame, str | None]:
    """(doc_id, source, leaf, given, subroot, path) for each document, and the root.

    path: array of structs of the concatenated digests left and right of the node, from the leaf's level up to the root's.
    given: the leaf of the document with ``altered`` as its text (null without it).
    """
    d = docs.select(*FIELDS)
    values = [F.col(c) for c in FIELDS]
    given = leaf([altered if c == "text" else F.col(c) for c in FIELDS]) if altered is not None else F.lit(None).cast("string")
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    rows = scratch.save(d.select(key.alias("group"), "doc_id", leaf(values).alias("hash"), given.alias("given")), "leaves")
    kept = ["hash", "doc_id", "given"]
    leaves = scratch.save(placed(rows, "group", ["group", "doc_id", "hash", "given"], scratch, "leaves"), "placed")
    levels = grow(leaves, kept, scratch, "level")
    roots = leaves.where("size = 1").select("group", F.lit(0).alias("height"), F.col("hash").alias("subroot"))
    for k, level in enumerate(levels):
        roots = roots.unionByName(level.where("size = 1").select("group", F.lit(k + 1).alias("height"), F.col("hash").alias("subroot")))
    roots = scratch.save(roots, "roots")
    # the tree over the sources' roots: one group, whose leaves carry the source
    named = roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "height", F.col("subroot").alias("hash"))
    upper = scratch.save(placed(named, "group", ["group", "name"], scratch, "upper"), "upper")
    over = grow(upper, ["hash", "name", "height"], scratch, "upper-level")
    root = (over[-1] if over else upper).select("hash").first()
    end = F.array().cast("array<struct<left:string,right:string>>")
    if over:
        whole = docs.sparkSession.range(1).select(F.lit("").alias("group"), F.lit(len(over)).alias("height"), end.alias("path"))
        tops = children(descend(over, whole)).select(F.col("child.name").alias("group"), F.col("child.height").alias("height"), F.col("child.hash").alias("subroot"), "path")
    else:
        tops = upper.select(F.col("name").alias("group"), "height", F.col("hash").alias("subroot"), end.alias("path"))
    tops = scratch.save(tops, "tops")
    lone = leaves.where("size = 1").join(tops.where("height = 0"), "group").select("group", "doc_id", "hash", "given", "subroot", "path")
    below = descend(levels, tops)
    if below is not None:
        lone = lone.unionByName(children(below).select("group", "child.doc_id", "child.hash", "child.given", "subroot", "path"))
    source = F.when(F.col("group") != "0", F.expr("substring(group, 2)"))
    return lone.select("doc_id", source.alias("source"), F.col("hash").alias("leaf"), "given", "subroot", "path"), root and root["hash"]


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, node, lambda below, level: digest(level["left"], below, level["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level and from left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def verify(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each document proved anew.

    altered: the text with which a document is proved; its own where that is left out.
    """
    with Scratch(docs.sparkSession, "merkle") as scratch:
        proofs, root = manifest(docs, scratch, altered)
        folded = proofs.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("given", "leaf"), F.col("path")).alias("folded_root"))
        return scratch.result(folded.withColumn("verified", F.col("folded_root") == F.col("root")))


def lowered_fifth() -> Column:
    """The text, lower-cased in A-Z where 5 divides the crc32 of the decimal doc_id."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(chosen, lower_ascii(F.col("text"))).otherwise(F.col("text"))
