"""Ingestion: chunks, unique references, quality gate, versioned load, manifest and increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.config import MAX_SECTION_WORDS, MIN_CHUNK_WORDS, MIN_SECTION_WORDS, OVERLAP_WORDS, PARSE_FAILURE_LIMIT
from codicil.functions.text import fitted_ref, has_markup, tail_words, word_count


def counted(paragraphs: Column) -> Column:
    """Paragraphs with a word, each with its number of words."""
    return F.filter(F.transform(paragraphs, lambda p: F.struct(p.alias("p"), word_count(p).alias("n"))), lambda x: x["n"] > 0)


def chunked(counted_: Column) -> Column:
    """Chunks of a section's counted paragraphs by one fold over them.

    A section of at most MAX_SECTION_WORDS or of one paragraph is one chunk. A chunk closes before a paragraph
    that would take it over the limit, if it has MIN_CHUNK_WORDS; the next one begins with its last words.
    """
    total = F.aggregate(counted_, F.lit(0), lambda a, x: a + x["n"])
    state = "struct<chunks:array<string>,current:array<string>,n:int>"
    start = F.from_json(F.lit('{"chunks":[],"current":[],"n":0}'), state)

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["current"]) > 0) & (s["n"] >= MIN_CHUNK_WORDS) & (s["n"] + x["n"] > MAX_SECTION_WORDS)
        tail = tail_words(F.array_join(s["current"], " "))
        carried = F.struct(F.concat(s["chunks"], F.array(F.array_join(s["current"], "\n\n"))).alias("chunks"), F.array(tail, x["p"]).alias("current"), (F.least(s["n"], F.lit(OVERLAP_WORDS)) + x["n"]).alias("n"))
        grown = F.struct(s["chunks"].alias("chunks"), F.concat(s["current"], F.array(x["p"])).alias("current"), (s["n"] + x["n"]).alias("n"))
        return F.when(full, carried).otherwise(grown).cast(state)

    last = lambda s: F.when(F.size(s["current"]) > 0, F.array(F.array_join(s["current"], "\n\n"))).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(counted_, start, step, lambda s: F.concat(s["chunks"], last(s)))
    whole = F.array(F.array_join(F.transform(counted_, lambda x: x["p"]), "\n\n"))
    return F.when((total <= MAX_SECTION_WORDS) | (F.size(counted_) < 2), whole).otherwise(folded)


def chunks(sections: DataFrame) -> DataFrame:
    """Sections (doc, ord, section_ref, heading, paragraphs) as chunks: short ones dropped, long ones split, numbered.

    Returns doc, section_ref, heading, text, position and parts (chunks of the section).
    """
    # a generator, so that words are counted once and not again by the filter and the fold
    rows = sections.select("doc", "ord", "section_ref", "heading", F.inline(F.array(F.struct(counted(F.col("paragraphs")).alias("counted")))))
    rows = rows.where(F.aggregate("counted", F.lit(0), lambda a, x: a + x["n"]) >= MIN_SECTION_WORDS).withColumn("parts", chunked(F.col("counted")))
    rows = rows.select("doc", "ord", "section_ref", "heading", F.size("parts").alias("parts"), F.posexplode("parts").alias("k", "text"))
    suffix = F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("#"), (F.col("k") + 1).cast("string")))
    position = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "k")) - 1
    return rows.select("doc", fitted_ref(F.col("section_ref"), suffix).alias("section_ref"), "heading", "text", position.alias("position"), "parts")


def unique_refs(sections: DataFrame) -> DataFrame:
    """Repeats of a reference within a document get ~2, ~3, ..."""
    nth = F.row_number().over(Window.partitionBy("doc", "section_ref").orderBy("ord"))
    suffix = F.when(nth == 1, "").otherwise(F.concat(F.lit("~"), nth.cast("string")))
    return sections.withColumn("section_ref", fitted_ref(F.col("section_ref"), suffix))


def gate(documents: DataFrame) -> DataFrame:
    """One row of counts and the blocking reasons in their order.

    documents: document_number, title, document_type, publication_date, parse_error, n_chunks, n_residual.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    usable = F.col("publication_date").isNotNull() & F.col("parse_error").isNull()
    counts = documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(blank("document_number") | blank("title") | blank("document_type")).alias("missing_fields"),
        (F.count(F.lit(1)) - F.count_distinct("document_number")).alias("duplicates"),
        F.count("parse_error").alias("parse_failures"),
        F.coalesce(F.sum(F.when(usable, F.col("n_residual"))), F.lit(0)).alias("residual_markup"),
        F.count_if(F.col("publication_date").isNull()).alias("date_failures"),
        F.count_if(usable & (F.col("n_chunks") == 0)).alias("without_sections"),
        F.count_if(usable & (F.col("n_chunks") > 0) & (F.col("n_residual") == 0)).alias("curated"),
    )
    over = F.col("parse_failures") / F.greatest("documents", F.lit(1)) > PARSE_FAILURE_LIMIT
    reasons = {
        "missing_required_fields": F.col("missing_fields") > 0,
        "duplicate_document_numbers": F.col("duplicates") > 0,
        "xml_parse_failure_rate": over,
        "residual_markup": F.col("residual_markup") > 0,
        "unparsed_dates": F.col("date_failures") > 0,
        "no_sections_after_quality": (F.col("documents") > 0) & (F.col("curated") == 0) & ~over,
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))
    return counts.withColumn("reasons", F.array_join(named, ",")).withColumn("blocking", F.col("reasons") != "")


def passed(documents: DataFrame) -> DataFrame:
    """Rows to load: none if the gate blocks."""
    good = F.col("publication_date").isNotNull() & F.col("parse_error").isNull() & (F.col("n_chunks") > 0) & (F.col("n_residual") == 0)
    return documents.where(good).crossJoin(F.broadcast(gate(documents).select("blocking"))).where("not blocking").drop("blocking")  # one row


def content_hash(chunks_: DataFrame) -> DataFrame:
    """doc, content_sha256, sections of each document's chunks (doc, position, text) in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n")
    return chunks_.groupBy("doc").agg(F.sha2(body, 256).alias("content_sha256"), F.count(F.lit(1)).alias("sections"), F.max(has_markup(F.col("text")).cast("int")).alias("markup"))


def status_for(document_type: Column) -> Column:
    kind = F.lower(F.regexp_replace(F.trim(document_type), r"\s+", " "))
    return F.when(kind.isin("rule", "final rule"), "ACTIVE").otherwise("DRAFT")


def versioned_load(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next snapshot of current (document_number, version, content_hash, status) after incoming (document_number, content_hash, status).

    An equal hash changes nothing; another one retires the latest version and adds the next. Both sides are
    shuffled once, by document number.
    """
    last = F.max("version").over(Window.partitionBy("document_number"))
    marked = current.withColumn("last", last)
    latest = marked.where("version = last").select("document_number", "version", F.col("content_hash").alias("old_hash"))
    changed = incoming.join(latest, "document_number", "left").where(~F.col("content_hash").eqNullSafe(F.col("old_hash")))
    new = changed.select("document_number", (F.coalesce("version", F.lit(0)) + 1).alias("version"), "content_hash", "status")
    retire = changed.where("version is not null").select("document_number", "version", F.lit(True).alias("gone"))
    kept = current.join(retire, ["document_number", "version"], "left").withColumn("status", F.when(F.col("gone"), "RETIRED").otherwise(F.col("status"))).drop("gone")
    return kept.select("document_number", "version", "content_hash", "status").unionByName(new)


def dataset_digest(hashes: DataFrame) -> DataFrame:
    """A row with the version of a set of (doc, content_sha256): first 12 digits of a hash over hashes of buckets.

    Each bucket's documents are sorted within it, so no task holds the whole corpus.
    """
    bucket = F.pmod(F.xxhash64("doc"), F.lit(1024))
    rows = hashes.groupBy(bucket.alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", "content_sha256"))), lambda x: F.concat(x["doc"].cast("string"), F.lit(":"), x["content_sha256"])), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256)
    return rows.agg(F.left(whole, F.lit(12)).alias("dataset_version"), F.sum("n").alias("documents"))


def manifest(hashes: DataFrame, query: dict[str, str], files: list[tuple[str, str]], source: str, code: str | None = None) -> DataFrame:
    """One row (body, dataset_version): canonical JSON of a load, and the first 12 digits of its hash.

    hashes: (document_number, content_sha256, source_xml_sha256, section_count), a line of the manifest each, so this is
    for loads whose manifest is one file; dataset_digest has no such bound. files: (path, sha256). Members are sorted
    by name and written without spaces; nulls are kept.
    """
    members = F.struct("content_sha256", "document_number", F.col("section_count").cast("long").alias("section_count"), "source_xml_sha256")
    one = hashes.agg(F.array_sort(F.collect_list(F.struct("document_number", members.alias("d")))).alias("d"), F.coalesce(F.sum("section_count"), F.lit(0)).cast("long").alias("section_count"))
    listed = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(h).alias("sha256")) for p, h in files)) if files else F.array().cast("array<struct<path:string,sha256:string>>")
    asked = F.struct(*(F.lit(query[k]).alias(k) for k in sorted(query)))
    body = F.struct(F.size("d").cast("long").alias("document_count"), F.transform("d", lambda x: x["d"]).alias("documents"), listed.alias("files"), F.lit(code).cast("string").alias("git_sha"), asked.alias("query"), "section_count", F.lit(source).alias("source"))
    return one.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("body")).withColumn("dataset_version", F.left(F.sha2("body", 256), F.lit(12)))


def watermark(documents: DataFrame, at: str = "publication_date") -> DataFrame:
    return documents.agg(F.max(at).alias("watermark"))


def increment(documents: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Documents that are not known yet, also those published late for a day that is covered already."""
    return documents.join(known.select(key), key, "left_anti")


def incremental_embeddings(sections: DataFrame, stored: DataFrame, only_missing: bool = False) -> DataFrame:
    """Sections (section_id, content_sha256, ...) whose embedding is missing or, unless only_missing, of another content."""
    old = stored.select("section_id", F.col("content_sha256").alias("old_sha256"), F.lit(True).alias("stored"))
    rows = sections.join(old, "section_id", "left")
    todo = F.col("stored").isNull() if only_missing else ~F.col("content_sha256").eqNullSafe(F.col("old_sha256"))
    return rows.where(todo).drop("old_sha256", "stored")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot with the new rows in place of those with their keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)
