"""Full text: web searches, cover density and the best k, in one pass over sections or over an index of postings built before.

Without an index, :mod:`codicil.operators.covers` matches and scores each section where it is, and only the best are moved.

A :class:`PostingIndex` numbers sections and keeps, for each lexeme and block of 64 numbers, a long with a bit for each section
that holds the lexeme, the most occurrences in one of them, and their places. A batch of searches goes through it in steps, each
of which reads less than a join of words with words would:

1. Of each alternative the lexeme that the fewest sections hold drives: only its blocks are looked at.
2. In these blocks the alternative is tested with ``bit_and`` over its lexemes; no places are read.
3. A block's greatest possible score follows from its most occurrences. With a limit k, each search's most promising blocks are scored
   first, and of the others only those that can still reach the k-th score.
   Before that, phrases are held against the places of their own words: equal shifts of places are a phrase.
4. Places of all words are read for what is left, and one pass over a section's occurrences adds up the covers of all alternatives.

Everything is DataFrame code; no row goes to Python, except words that are stemmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.config import SCORE_DIGITS
from codicil.functions.stems import english
from codicil.operators import covers
from codicil.operators.catalog import in_force
from codicil.operators.retrieval import KEY
from codicil.sources.working import Tables, few

WEIGHT = covers.WEIGHT
#: Sections of a block: the bits of a long.
BLOCK = 64
#: So many matching sections, over all searches, are scored without looking at their bounds first.
AT_ONCE = 1_000_000


def lexemes(text: Column) -> Column:
    """Word tokens in lower case, in order and with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column, stemmed: bool) -> Column:
    """Lexemes, or English stems with an empty text for each stop word."""
    return english(lexemes(text)) if stemmed else lexemes(text)


class PostingIndex:
    """Postings of sections in blocks (``lexeme, block, held, most, places``) and the sections themselves by number."""

    def __init__(self, tables: Tables, sections: DataFrame, postings: DataFrame, stemmed: bool):
        self.tables, self.sections, self.postings, self.stemmed = tables, sections, postings, stemmed

    @classmethod
    def build(cls, flat: DataFrame, stemmed: bool = False, asked: DataFrame | None = None) -> PostingIndex:
        """Index flat's bodies; with asked (lexeme), only these lexemes."""
        tables = Tables(flat.sparkSession, "postings")
        keep = [c for c in (*KEY, "name", "version", "effective_from", "effective_to") if c in flat.columns]
        numbered = tables.save(flat.select(F.monotonically_increasing_id().alias("section"), *keep, "body"), "sections")
        block = F.expr(f"section div {BLOCK}").alias("block")
        words = numbered.select("section", block, F.posexplode(terms(F.col("body"), stemmed)).alias("place", "lexeme")).where("lexeme <> ''")
        if asked is not None:
            words = words.join(few(asked.select("lexeme").distinct()), "lexeme", "left_semi")
        # dealt once: sections and then blocks are put together where a lexeme's block is
        held = words.repartition("lexeme", "block").groupBy("lexeme", "block", "section").agg(F.array_sort(F.collect_list("place")).alias("own"))
        bit = F.expr(f"shiftleft(1L, cast(section % {BLOCK} AS INT))")
        blocks = held.groupBy("lexeme", "block").agg(
            F.bit_or(bit).alias("held"),
            F.max(F.size("own")).alias("most"),
            F.collect_list(F.struct((F.col("section") % BLOCK).cast("int").alias("slot"), "own")).alias("places"),  # 64 sections at most
        )
        return cls(tables, numbered.drop("body"), tables.save(blocks, "blocks", "lexeme"), stemmed)

    def frequencies(self, words: DataFrame) -> DataFrame:
        """lexeme, sections: how many sections hold each of words (lexeme)."""
        asked = self.postings.select("lexeme", "held").join(few(words.select("lexeme").distinct()), "lexeme", "left_semi")
        return asked.groupBy("lexeme").agg(F.sum(F.bit_count("held")).alias("sections"))


def parsed(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(query_id, as_of, clause, unit, negated, n, shift, lexeme) for each word of web searches (query_id, text, as_of).

    A search is a disjunction, by OR, of clauses of words, "phrases" and -negations. A part of several words is a phrase; shift is a
    word's distance from the first of them, n their number. Stop words of stemmed searches are left out and keep their distance. A
    clause without a part that must be there is left out.
    """
    part = F.regexp_extract_all(F.lower("text"), F.lit(r'(?U)-?"[^"]*"|\S+'), F.lit(0))
    parts = queries.select("query_id", "as_of", F.posexplode(part).alias("unit", "part"))
    own = Window.partitionBy("query_id")
    parts = parts.withColumn("clause", F.count_if(F.col("part") == "or").over(own.orderBy("unit"))).where("part <> 'or'")
    words = parts.select("query_id", "as_of", "clause", "unit", F.startswith("part", F.lit("-")).alias("negated"), F.posexplode(terms(F.col("part"), stemmed)).alias("at", "lexeme"))
    words = words.where("lexeme <> ''")
    unit, clause = Window.partitionBy("query_id", "unit"), Window.partitionBy("query_id", "clause")
    words = words.select("*", (F.col("at") - F.min("at").over(unit)).alias("shift"), F.count(F.lit(1)).over(unit).alias("n"), F.bool_or(~F.col("negated")).over(clause).alias("asks"))
    return words.where("asks").drop("at", "asks")


def candidates(units: DataFrame, index: PostingIndex) -> DataFrame:
    """(query_id, clause, block, bits, most): sections of a block that hold all words of a clause, and the most covers that any can have."""
    whole = units.where("NOT negated").groupBy("query_id", "clause", "lexeme").agg(F.lit(1).alias("one")).drop("one")
    counted = whole.join(index.frequencies(units), "lexeme", "left")
    clause = Window.partitionBy("query_id", "clause")
    counted = counted.withColumn("found", F.min(F.coalesce("sections", F.lit(0))).over(clause)).withColumn("words", F.count(F.lit(1)).over(clause)).where("found > 0")
    counted = index.tables.save(counted.withColumn("nth", F.row_number().over(clause.orderBy("sections", "lexeme"))), "asked")
    bits = index.postings.select("lexeme", "block", "held", "most")
    # single words that must not be there can be tested as bits; phrases wait for places
    barred = units.where("negated AND n = 1").select("query_id", "clause", "lexeme")
    driven = bits.join(few(counted.where("nth = 1").drop("nth", "sections", "found")), "lexeme")
    meets = driven.select("query_id", "clause", "block", "words", "held", "most", F.lit(True).alias("must"))
    rest = counted.where("nth > 1").select("query_id", "clause", "lexeme", F.lit(True).alias("must")).unionByName(barred.withColumn("must", F.lit(False)))
    # other words only in the blocks of the rarest
    places = driven.select("query_id", "clause", "block").join(few(rest), ["query_id", "clause"])
    more = places.join(bits, ["lexeme", "block"]).select("query_id", "clause", "block", F.lit(0).cast("long").alias("words"), "held", "most", "must")
    tested = meets.unionByName(more).groupBy("query_id", "clause", "block").agg(
        F.bit_and(F.when(F.col("must"), F.col("held"))).alias("all"),
        F.coalesce(F.bit_or(F.when(~F.col("must"), F.col("held"))), F.lit(0)).alias("none"),
        F.count_if("must").alias("met"),
        F.max("words").alias("words"),
        F.sum(F.when(F.col("must"), F.col("most"))).alias("most"),  # a cover ends at an occurrence of some word
    )
    good = tested.where("met = words").withColumn("bits", F.col("all").bitwiseAND(F.bitwise_not("none"))).where("bits <> 0")
    return good.select("query_id", "clause", "block", "bits", "most")


def hits_in(words: DataFrame, blocks: DataFrame, index: PostingIndex, by: list[str]) -> DataFrame:
    """(by, section, lexeme, place) of the words (by, lexeme) in the sections of blocks (by, block, bits), dealt by search and section."""
    chosen = F.filter("places", lambda p: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p["slot"])) != 0)
    met = index.postings.select("lexeme", "block", "places").join(blocks.join(few(words), by), ["lexeme", "block"])
    met = met.select(*by, "lexeme", "block", F.explode(chosen).alias("p"))
    return met.select(*by, (F.col("block") * BLOCK + F.col("p.slot")).alias("section"), "lexeme", F.explode("p.own").alias("place")).repartition("query_id", "section")


def verified(units: DataFrame, clauses: DataFrame, index: PostingIndex) -> DataFrame:
    """(query_id, block, bits, bound): sections that match some clause of clauses, whose phrases are held against places.

    Only the words of phrases are read, and those only where all words of their clause are.
    """
    phrases = units.where("n > 1")
    needed = phrases.where("NOT negated").groupBy("query_id", "clause").agg(F.count_distinct("unit").alias("needed"))
    some = phrases.select("query_id", "clause").distinct()
    plain = clauses.join(few(some), ["query_id", "clause"], "left_anti")
    with_phrases = clauses.join(few(some), ["query_id", "clause"], "left_semi")
    hits = hits_in(phrases.select("query_id", "clause", "lexeme").distinct(), with_phrases, index, ["query_id", "clause"])
    each = hits.join(few(phrases.drop("as_of")), ["query_id", "clause", "lexeme"]).withColumn("first", F.col("place") - F.col("shift"))
    found = each.groupBy("query_id", "section", "clause", "unit", "negated", "n", "first").agg(F.count(F.lit(1)).alias("c")).where("c = n")
    own = found.groupBy("query_id", "section", "clause").agg(F.bool_or("negated").alias("barred"), F.count_distinct(F.when(~F.col("negated"), F.col("unit"))).alias("met"))
    bit = F.expr(f"shiftleft(1L, cast(section % {BLOCK} AS INT))")
    good = own.join(few(needed), ["query_id", "clause"]).where("met = needed AND NOT barred").select("query_id", "clause", F.expr(f"section div {BLOCK}").alias("block"), bit.alias("bit"))
    bad = own.where("barred").select("query_id", "clause", F.expr(f"section div {BLOCK}").alias("block"), bit.alias("bit"))
    held = good.groupBy("query_id", "clause", "block").agg(F.bit_or("bit").alias("held"))
    gone = bad.groupBy("query_id", "clause", "block").agg(F.bit_or("bit").alias("gone"))
    must = needed.select("query_id", "clause", F.lit(True).alias("must"))
    key = ["query_id", "clause", "block"]
    tested = with_phrases.join(few(must), ["query_id", "clause"], "left").join(held, key, "left").join(gone, key, "left")
    kept = F.when(F.col("must"), F.col("bits").bitwiseAND(F.coalesce("held", F.lit(0)))).otherwise(F.col("bits"))
    tested = tested.withColumn("bits", kept.bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0))))).where("bits <> 0")
    every = plain.unionByName(tested.select(*plain.columns))
    return every.groupBy("query_id", "block").agg(F.bit_or("bits").alias("bits"), (WEIGHT * F.sum("most")).alias("bound"))


def _cover(events: Column, clauses: Column, units: Column) -> Column:
    """Sum over the shortest stretches that hold all units of some clause: WEIGHT over 1 and the other words between.

    events: (end, place of end, (unit, start, place of start) of all occurrences that end there), in order; clauses: arrays of units.
    The state holds each unit's last start; a stretch counts where its start is later than that of the one before.
    """
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).cast("long").alias("at"))
    begin = F.struct(F.array_repeat(none, units).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

    def step(state: Column, event: Column) -> Column:
        def latest(old: Column, unit: Column) -> Column:
            new = F.array_max(F.transform(F.filter(event["occs"], lambda o: o["unit"] == unit), lambda o: F.struct(o["start"].alias("start"), o["at"].alias("at"))))
            return F.greatest(old, F.coalesce(new, none))

        last = F.transform(state["last"], latest)
        own = F.array_max(F.transform(clauses, lambda c: F.array_min(F.transform(c, lambda u: F.get(last, u)))))
        fresh = own["start"] > state["before"]
        gaps = (event["end"] - own["start"]) - (event["at"] - own["at"])
        return F.struct(
            last.alias("last"), F.when(fresh, own["start"]).otherwise(state["before"]).alias("before"), (state["total"] + F.when(fresh, WEIGHT / (1 + gaps)).otherwise(0.0)).alias("total")
        )

    return F.aggregate(events, begin, step, lambda state: state["total"])


def scored(units: DataFrame, blocks: DataFrame, index: PostingIndex) -> DataFrame:
    """query_id, KEY, name, version, score of the sections of blocks (query_id, block, bits) that match."""
    # all that follows is within a search and a section, which one task has
    hits = hits_in(units.select("query_id", "lexeme").distinct(), blocks, index, ["query_id"])
    pair = ["query_id", "section"]
    hits = hits.withColumn("at", F.row_number().over(Window.partitionBy(*pair).orderBy("place")).cast("long"))
    each = hits.join(few(units.drop("as_of")), ["query_id", "lexeme"]).withColumn("first", F.col("place") - F.col("shift"))
    occs = each.groupBy(*pair, "clause", "unit", "negated", "n", "first").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("start"), F.max("place").alias("end"), F.min("at").alias("at"), F.max("at").alias("end_at"))
    parts = occs.where("c = n").groupBy(*pair, "clause", "unit", "negated").agg(F.collect_list(F.struct("start", "at", "end", "end_at")).alias("own"))
    clauses = parts.groupBy(*pair, "clause").agg(F.bool_or("negated").alias("barred"), F.count(F.lit(1)).alias("met"), F.collect_list(F.struct("unit", "own")).alias("parts"))
    needed = units.where("NOT negated").groupBy("query_id", "clause").agg(F.count_distinct("unit").alias("needed"))
    clauses = clauses.where("NOT barred").join(few(needed), ["query_id", "clause"]).where("met = needed")
    rows = clauses.groupBy(*pair).agg(F.collect_list("parts").alias("clauses"))
    flat = F.flatten("clauses")
    occurrences = F.flatten(F.transform(F.sequence(F.lit(0), F.size("flat") - 1), lambda i: F.transform(F.get("flat", i)["own"], lambda o: F.struct(o["end"].alias("end"), o["end_at"].alias("end_at"), i.alias("unit"), o["start"].alias("start"), o["at"].alias("at")))))
    sizes = F.transform("clauses", F.size)
    start = lambda k: F.aggregate(F.slice(F.col("sizes"), F.lit(1), k), F.lit(0), lambda a, b: a + b)
    numbered = F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.sequence(start(k), start(k) + F.get("sizes", k) - 1))
    rows = rows.withColumn("flat", flat).withColumn("sizes", sizes).select(*pair, F.size("flat").alias("units"), numbered.alias("numbers"), F.explode(occurrences).alias("o"))
    ends = rows.groupBy(*pair, "units", "numbers", "o.end").agg(F.max("o.end_at").alias("at"), F.collect_list(F.struct("o.unit", "o.start", "o.at")).alias("occs"))
    ordered = ends.groupBy(*pair, "units", "numbers").agg(F.sort_array(F.collect_list(F.struct("end", "at", "occs"))).alias("events"))
    total = ordered.select(*pair, F.round(_cover(F.col("events"), F.col("numbers"), F.col("units")), SCORE_DIGITS).alias("score"))
    dated = total.join(few(units.select("query_id", "as_of").distinct()), "query_id").join(index.sections, "section")
    return dated.where(in_force(F.col("as_of"))).select("query_id", *KEY, "name", "version", "score")


def fulltext_scores(queries: DataFrame, flat: DataFrame, stemmed: bool = False, best: int | None = None, index: PostingIndex | None = None) -> DataFrame:
    """query_id, KEY, name, version, score of sections in force that match web searches (query_id, text, as_of).

    The score adds WEIGHT over 1 and the gaps for every cover: a shortest stretch that holds all words of some alternative which
    the section matches; gaps are its words that the search doesn't name. best: only what can be among so many best of each search, ties
    included. index: one built before over flat, for more searches; without it flat is gone over once.
    """
    tables = Tables(queries.sparkSession, "searches")
    units = tables.save(parsed(queries, stemmed), "units")
    if index is None:
        return covers.search(units, flat, terms(F.col("body"), stemmed), [*KEY, "name", "version"], best)
    blocks = tables.save(verified(units, tables.save(candidates(units, index), "candidates"), index), "blocks")
    if best is None or (blocks.agg(F.sum(F.bit_count("bits"))).first()[0] or 0) <= AT_ONCE:
        return scored(units, blocks, index)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum(F.bit_count("bits")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = tables.save(blocks.withColumn("before", before), "ordered")
    found = tables.save(scored(units, first.where(F.col("before") < best), index), "first")
    nth = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("nth") == best)
    later = first.where(F.col("before") >= best).join(nth.select("query_id", F.col("score").alias("reached")), "query_id", "left")
    # rounded scores may lie half a digit above the bound
    later = later.where(F.coalesce(F.col("bound") + 10.0**-SCORE_DIGITS >= F.col("reached"), F.lit(True)))
    return found.unionByName(scored(units, later, index))


def all_words(queries: DataFrame, flat: DataFrame, stemmed: bool = False, best: int | None = None) -> DataFrame:
    """Sections in force that hold every word of a query, scored WEIGHT for each occurrence. best: only what is among so many best of each query."""
    named = queries.select("query_id", "as_of", F.posexplode(F.array_remove(F.array_distinct(terms(F.col("text"), stemmed)), "")).alias("unit", "lexeme"))
    units = named.select("*", F.lit(0).alias("clause"), F.lit(False).alias("negated"), F.lit(0).alias("shift"))
    units = Tables(queries.sparkSession, "words").save(units, "units")
    return covers.search(units, flat, terms(F.col("body"), stemmed), [*KEY, "name", "version"], best, counted=True)
