"""Queries of retrieval: scopes, rankings, fusion and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.config import CANDIDATES, PRIOR_WEIGHT, SCORE_DIGITS
from codicil.functions.text import SYNONYMS, _form_tokens, embedding_key, leading_passage, overlap_share, websearch_text
from codicil.operators import applicability, catalog, embedding, evaluate, fulltext, ingest, neighbours, priors, retrieval, validate
from codicil.sources.tables import IN_FORCE, ORDER, SQL, policies, queries, sections, table
from codicil.sources.working import Tables, few

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.flat_sections(policies(spark, sf_dir), sections(spark, sf_dir))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active policies, each as one section."""
    p = policies(spark, sf_dir).where("status = 'ACTIVE'")
    one = {"section_ref": F.lit("document"), "heading": F.col("name"), "text": F.col("content"), "body": F.concat_ws(" ", "name", "content"), "position": F.lit(0)}
    return p.withColumns(one).drop("content")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "policy_id", "section_ref", "score", "rank")


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"
#: Whole policies as sections, for flat in the shared adapters.
WHOLE = """whole AS (
  SELECT policy_id, name, version, status, effective_from, effective_to, lang, source, 'document' AS section_ref,
    content AS text, name || ' ' || content AS body, 0 AS position FROM policies),"""


def form_sql(text: str, form: str) -> str:
    pattern = r"\s+".join(w.replace(".", r"\.") for w in form.split(" "))
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9]){pattern}($|[^a-z0-9])')"


def any_form_sql(text: str, forms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(form_sql(text, f) for f in forms) + ")"


def tokens_sql(text: str) -> str:
    """Distinct tokens of a column with those of its synonyms."""
    more = " || ".join(f"CASE WHEN {any_form_sql(text, f)} THEN {_form_tokens(f)} ELSE [] END" for f in SYNONYMS)
    return f"list_distinct({TOKENS.format(text)} || {more})"


def scores_sql(rows: str, items: str = "items", name: str = "scores") -> str:
    return f"""
{name}_q AS (SELECT query_id, as_of, greatest(len(t), 1) AS n, unnest(t) AS token FROM (SELECT *, {tokens_sql('text')} AS t FROM {items})),
{name}_d AS (SELECT policy_id, section_ref, position, name, version, status, effective_from, effective_to, unnest({tokens_sql('body')}) AS token FROM {rows}),
{name} AS (
  SELECT q.query_id, f.policy_id, f.section_ref, f.position, f.name, f.version, round(count(*) / q.n, {SCORE_DIGITS}) AS score
  FROM {name}_d f JOIN {name}_q q USING (token) WHERE {IN_FORCE}
  GROUP BY q.query_id, q.n, f.policy_id, f.section_ref, f.position, f.name, f.version),"""


def top_sql(rows: str, name: str = "best", k: int = 5) -> str:
    return f"""
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {ORDER}) AS INTEGER) AS rank FROM {rows} QUALIFY rank <= {k})"""


RANKED = "SELECT query_id, policy_id, section_ref, score, rank FROM best"


@query(f"WITH {SQL} q AS (SELECT DATE '2024-06-01' AS as_of) SELECT f.policy_id, f.name, f.section_ref, f.text, f.body, f.position FROM flat f, q WHERE {IN_FORCE}")
def eligible_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.eligible_sections(policies(spark, sf_dir), sections(spark, sf_dir), F.lit("2024-06-01").cast("date"))
    return rows.select("policy_id", "name", "section_ref", "text", "body", "position")


@query(f"WITH {SQL} n AS (SELECT 1) SELECT policy_id, name FROM policies WHERE status = 'ACTIVE' AND policy_id NOT IN (SELECT policy_id FROM sections)")
def sectionless_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sectionless(policies(spark, sf_dir), sections(spark, sf_dir)).select("policy_id", "name")


@query(f"WITH {SQL} {scores_sql('flat')} {top_sql('scores')} {RANKED}")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best sections in force for each query by share of its tokens."""
    return ranked(retrieval.keyword(queries(spark, sf_dir), flat(spark, sf_dir)))


@query(f"WITH {SQL} dates AS (SELECT DISTINCT as_of FROM items) SELECT q.as_of, count(*) AS policies FROM policies f, dates q WHERE {IN_FORCE} GROUP BY q.as_of")
def keyword_asof_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in force on each date that a query asks about, by running sums over the windows' ends."""
    p = policies(spark, sf_dir).where("status = 'ACTIVE'")
    opened = p.groupBy(F.coalesce("effective_from", F.lit("0001-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("step"))
    closed = p.where("effective_to is not null").groupBy(F.col("effective_to").alias("day")).agg((-F.count(F.lit(1))).alias("step"))
    asked = queries(spark, sf_dir).select("as_of").distinct()
    steps = opened.unionByName(closed).groupBy("day").agg(F.sum("step").alias("step"))  # a row for each day
    # days are few, so that each asked date meets those up to it
    both = asked.join(F.broadcast(steps), F.col("day") <= F.col("as_of"))
    return both.groupBy("as_of").agg(F.sum("step").alias("policies")).where("policies > 0")


_CASES = "cases AS (SELECT o_orderkey AS case_id, DATE '2024-01-01' + CAST((CAST(o_orderdate AS DATE) - DATE '1992-01-01') % 730 AS INTEGER) AS case_date FROM orders),"


@query(f"WITH {SQL} {_CASES} n AS (SELECT 1) SELECT q.case_id, f.source, count(*) AS policies, min(f.policy_id) AS first_policy, CAST(sum(f.policy_id) AS BIGINT) AS policy_sum FROM policies f, (SELECT case_id, case_date AS as_of FROM cases WHERE case_id % 100 = 0) q WHERE {IN_FORCE} GROUP BY 1, 2")
def applicable_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in force on the dates of the stated cases (orders whose key 100 divides), by source."""
    return applicability.applicable_sums(_dated_cases(spark, sf_dir).where("case_id % 100 = 0"), policies(spark, sf_dir).where("status = 'ACTIVE'"), "source")


@query(f"WITH {SQL} n AS (SELECT 1) SELECT q.query_id AS case_id, f.policy_id FROM policies f, items q WHERE {IN_FORCE}")
def applicable_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a benchmark case and a policy in force on its date."""
    cases = queries(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.col("as_of").alias("case_date"))
    return applicability.applicable(cases, policies(spark, sf_dir).where("status = 'ACTIVE'"))


def _dated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shift = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) % 730
    return o.select(F.col("o_orderkey").alias("case_id"), F.date_add(F.lit("2024-01-01").cast("date"), shift).alias("case_date"))


SUFFIX = {0: " NOx limits", 1: " the greenhouse  gas", 2: " PM2.5 and SIP", 3: ""}


def suffixed(rows: DataFrame, key: str) -> DataFrame:
    tail = F.when(F.lit(False), "")
    for k, s in SUFFIX.items():
        tail = tail.when(F.col(key) % len(SUFFIX) == k, s)
    return rows.withColumn("text", F.concat("text", tail))


def suffix_sql(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(SUFFIX)} = {k} THEN '{s}'" for k, s in SUFFIX.items()) + " END"


@query(f"""WITH {SQL} items2 AS (SELECT query_id, as_of, text || {suffix_sql('query_id')} AS text FROM items),
{scores_sql('flat', 'items2')} {top_sql('scores')} {RANKED}""")
def keyword_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(retrieval.keyword(suffixed(queries(spark, sf_dir), "query_id"), flat(spark, sf_dir)))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.col("lang").alias("label"), "text")


def prior_sql(train: str, asked: str) -> str:
    """CTEs up to prior(query_id, label, probability): naive Bayes on train(doc, label, text) for asked(query_id, text)."""
    return f"""
nb_tokens AS (SELECT doc, label, unnest({tokens_sql('text')}) AS token FROM {train} WHERE label <> ''),
nb_counts AS (SELECT label, token, count(*) AS n FROM nb_tokens GROUP BY 1, 2),
nb_docs AS (SELECT label, count(*) AS docs FROM {train} WHERE label <> '' AND len({tokens_sql('text')}) > 0 GROUP BY 1),
nb_totals AS (SELECT label, sum(n) AS total, any_value(docs) AS docs FROM nb_counts JOIN nb_docs USING (label) GROUP BY 1),
nb_size AS (SELECT count(DISTINCT token) AS v FROM nb_counts),
nb_q AS (SELECT query_id, unnest({tokens_sql('text')}) AS token FROM {asked}),
nb_score AS (
  SELECT q.query_id, t.label, ln(any_value(t.docs) / (SELECT sum(docs) FROM nb_totals)) + sum(ln(coalesce(c.n, 0) + 1.0) - ln(t.total + v)) AS s
  FROM nb_q q CROSS JOIN nb_totals t CROSS JOIN nb_size LEFT JOIN nb_counts c ON c.label = t.label AND c.token = q.token GROUP BY 1, 2),
nb_e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY query_id)) AS e FROM nb_score),
prior AS (SELECT query_id, label, e / sum(e) OVER (PARTITION BY query_id) AS probability FROM nb_e),"""


DOCS = "docs AS (SELECT doc_id AS doc, lang AS label, text FROM documents),"


@query(f"""WITH {SQL} {WHOLE} {DOCS} {prior_sql('docs', 'items')} {scores_sql('whole')}
biased AS (SELECT s.* EXCLUDE (score), round(score + {PRIOR_WEIGHT} * coalesce(probability, 0), {SCORE_DIGITS}) AS score
  FROM (SELECT s.*, p.lang FROM scores s JOIN policies p USING (policy_id)) s LEFT JOIN prior r ON r.query_id = s.query_id AND r.label = s.lang),
{top_sql('biased')} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best""")
def keyword_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword ranking with the class prior as a bonus; classes are languages."""
    q = queries(spark, sf_dir)
    prior = priors.predict_prior(q, *priors.fit_prior(_examples(spark, sf_dir)))
    # sections of a language have the same bonus, so the best of each language hold the best of all
    scores = retrieval.best_by_keywords(q, whole(spark, sf_dir), 5, carry=("lang",), by="lang").withColumn("labels", F.array("lang")).drop("lang")
    return ranked(retrieval.top(retrieval.with_prior(scores, prior), 5)).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS a, {TOKENS.format("coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')")} AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0e0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS overlap FROM t""")
def token_overlap_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each turn's tokens that the next turn repeats."""
    c = table(spark, sf_dir, "conversations")
    following = F.expr("coalesce(lead(text) over (partition by conv_id order by turn, role, text), '')")
    return c.withColumn("next", following).select("conv_id", "turn", F.round(overlap_share(F.col("text"), F.col("next")), 6).alias("overlap"))


_FORMS = sorted((form, forms) for forms in SYNONYMS for form in forms)
_MORE = ", ".join(f"CASE WHEN {any_form_sql('text', forms)} AND NOT contains(clean, '{form}') THEN '{chr(34) + form + chr(34) if ' ' in form else form}' END" for form, forms in _FORMS)


@query(rf"""WITH {SQL} i AS (SELECT query_id, text || {suffix_sql('query_id')} AS text FROM items),
c AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS clean FROM i)
SELECT query_id, array_to_string(list_filter([clean, {_MORE}], lambda x: x IS NOT NULL), ' OR ') AS websearch FROM c""")
def websearch_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixed(queries(spark, sf_dir), "query_id").select("query_id", websearch_text(F.col("text")).alias("websearch"))


LEXEMES = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def all_words_sql(rows: str) -> str:
    return f"""
lexed AS (SELECT query_id, as_of, list_distinct({LEXEMES.format('text')}) AS w FROM items),
fq AS (SELECT query_id, as_of, len(w) AS n, unnest(w) AS lexeme FROM lexed),
fd AS (SELECT policy_id, section_ref, position, name, version, status, effective_from, effective_to, unnest({LEXEMES.format('body')}) AS lexeme FROM {rows}),
words_found AS (
  SELECT q.query_id, f.policy_id, f.section_ref, f.position, f.name, f.version, q.n, count(DISTINCT lexeme) AS c, count(*) AS times
  FROM fd f JOIN fq q USING (lexeme) WHERE {IN_FORCE} GROUP BY ALL),
matched AS (SELECT query_id, policy_id, section_ref, position, name, version, round(CAST({fulltext.WEIGHT} AS DOUBLE) * times, {SCORE_DIGITS}) AS score FROM words_found WHERE c = n),"""


#: What full text searches: the text alone, without a section-less policy's name.
CONTENT = "content AS (SELECT * REPLACE (text AS body) FROM whole),"


@query(f"WITH {SQL} {WHOLE} {CONTENT} {all_words_sql('content')} {top_sql('matched')} {RANKED}")
def fulltext_simple_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that hold all words of each query, ranked by their occurrences."""
    return ranked(retrieval.top(fulltext.all_words(queries(spark, sf_dir), catalog.text_only(whole(spark, sf_dir)), best=5), 5))


def _websearch(q: DataFrame) -> DataFrame:
    """Each query as alternatives of a phrase and a word, the last without its first word."""
    w = fulltext.lexemes(F.col("text"))
    at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    clause = lambda i: F.concat(F.lit('"'), at(i), F.lit(" "), at(i + 1), F.lit('" '), at(i + 2), F.when(i + 3 >= F.size(w), F.concat(F.lit(" -"), at(F.lit(0)))).otherwise(""))
    return q.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(3)), clause), " OR "))


_WORD = lambda i: f"coalesce(w[{i}], '')"
#: The same in SQL: alternatives start at every third word.
WEBSEARCH = f"""lexed_items AS (SELECT query_id, as_of, {LEXEMES.format('text')} AS w FROM items),
searches AS (SELECT query_id, as_of, array_to_string(list_transform(range(0, greatest(len(w), 1), 3),
  lambda i: '"' || {_WORD('i + 1')} || ' ' || {_WORD('i + 2')} || '" ' || {_WORD('i + 3')} || CASE WHEN i + 3 >= len(w) THEN ' -' || {_WORD('1')} ELSE '' END), ' OR ') AS text FROM lexed_items),"""


def fulltext_sql(rows: str, searches: str = "searches") -> str:
    """CTEs up to covered(query_id, section columns, score) of web searches over rows."""
    return rf"""
ft_parts AS (SELECT query_id, as_of, unnest(p) AS part, unnest(range(len(p))) AS unit FROM (SELECT *, regexp_extract_all(lower(text), '-?"[^"]*"|\S+') AS p FROM {searches})),
ft_clauses AS (SELECT *, sum(CASE WHEN part = 'or' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY unit) AS clause FROM ft_parts),
ft_words AS (SELECT query_id, as_of, clause, unit, starts_with(part, '-') AS negated, len(w) AS n, unnest(w) AS lexeme, unnest(range(len(w))) AS shift
  FROM (SELECT *, {LEXEMES.format('part')} AS w FROM ft_clauses WHERE part <> 'or')),
ft_units AS (SELECT * FROM ft_words QUALIFY bool_or(NOT negated) OVER (PARTITION BY query_id, clause)),
ft_asked AS (SELECT DISTINCT query_id, as_of, lexeme FROM ft_units),
ft_places AS (SELECT row_number() OVER () AS section, * FROM {rows}),
ft_terms AS (SELECT section, unnest(w) AS lexeme, unnest(range(len(w))) AS place FROM (SELECT section, {LEXEMES.format('body')} AS w FROM ft_places)),
ft_hits AS (SELECT q.query_id, section, lexeme, place FROM ft_terms JOIN ft_asked q USING (lexeme) JOIN ft_places f USING (section) WHERE {IN_FORCE}),
ft_occs AS (SELECT query_id, section, clause, unit, negated, n, min(place) AS a, max(place) AS z FROM ft_hits JOIN ft_units USING (query_id, lexeme)
  GROUP BY query_id, section, clause, unit, negated, n, place - shift HAVING count(*) = n),
ft_met AS (SELECT query_id, section, clause, count(DISTINCT unit) AS met FROM ft_occs GROUP BY ALL HAVING NOT bool_or(negated)),
ft_needed AS (SELECT query_id, clause, count(DISTINCT unit) AS met FROM ft_units WHERE NOT negated GROUP BY ALL),
ft_good AS (SELECT o.*, met FROM ft_occs o JOIN ft_met USING (query_id, section, clause) JOIN ft_needed USING (query_id, clause, met)),
ft_ends AS (SELECT DISTINCT query_id, section, z AS e FROM ft_good),
ft_last AS (SELECT query_id, section, e, clause, met, unit, max(a) AS a FROM ft_ends JOIN ft_good USING (query_id, section) WHERE z <= e GROUP BY ALL),
ft_starts AS (SELECT query_id, section, e, clause, min(a) AS b FROM ft_last GROUP BY query_id, section, e, clause, met HAVING count(*) = met),
ft_covers AS (SELECT query_id, section, b, min(e) AS e FROM (SELECT query_id, section, e, max(b) AS b FROM ft_starts GROUP BY ALL) GROUP BY ALL),
ft_inside AS (SELECT query_id, section, b, e, count(*) AS named FROM ft_covers JOIN ft_hits USING (query_id, section) WHERE place BETWEEN b AND e GROUP BY ALL),
covered AS (SELECT query_id, policy_id, section_ref, position, name, version, round(score, {SCORE_DIGITS}) AS score
  FROM (SELECT query_id, section, sum({fulltext.WEIGHT} / (1 + (e - b + 1 - named))) AS score FROM ft_inside GROUP BY ALL) JOIN ft_places USING (section)),"""


#: Web searches of plain items: their folded text and forms of synonyms.
SEARCHES = f"""cleaned AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS clean FROM items),
searches AS (SELECT query_id, as_of, array_to_string(list_filter([clean, {_MORE}], lambda x: x IS NOT NULL), ' OR ') AS text FROM cleaned),"""
FLAT_CONTENT = "content AS (SELECT * REPLACE (text AS body) FROM flat),"


@query(f"WITH {SQL} {FLAT_CONTENT} {WEBSEARCH} {fulltext_sql('content')} {top_sql('covered')} {RANKED}")
def fulltext_websearch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web searches of whole queries, ranked by cover density."""
    asked, rows = _websearch(queries(spark, sf_dir)), catalog.text_only(flat(spark, sf_dir))
    return ranked(retrieval.top(fulltext.fulltext_scores(asked, rows, best=5), 5))


@query()
def fulltext_english_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with English stems and stop words."""
    asked, rows = _websearch(queries(spark, sf_dir)), catalog.text_only(flat(spark, sf_dir))
    return ranked(retrieval.top(fulltext.fulltext_scores(asked, rows, stemmed=True, best=5), 5))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors (ids divisible by 100) and all vectors with the columns that rankings need."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("policy_id"), F.lit("vector").alias("section_ref"), F.lit(0).alias("position"), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("name"), F.lit(1).alias("version"), "embedding", "label")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("label").alias("query_label")), rows


_COSINE = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


def cosine_sql(a: str, b: str) -> str:
    dot, na, nb = _COSINE.format(a=a, b=b), _COSINE.format(a=a, b=a), _COSINE.format(a=b, b=b)
    return f"CASE WHEN {na} > 0 AND {nb} > 0 THEN {dot} / (sqrt({na}) * sqrt({nb})) ELSE 0 END"


VECTORS = f"""scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.label, e.vec_id AS policy_id, 'vector' AS section_ref, 0 AS position,
    'v' || lpad(CAST(e.vec_id AS VARCHAR), 9, '0') AS name, 1 AS version, round({cosine_sql('q.embedding', 'e.embedding')}, {SCORE_DIGITS}) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),"""


@query(f"WITH {VECTORS} {top_sql('scored', k=10)} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = _vectors(spark, sf_dir)
    # of scores half way between two, those whose product is below the half are rounded down, as in the SQL
    six = F.signum("score") * F.floor(F.abs("score") * 1e6 + 0.5) / 1e6
    return ranked(retrieval.best_by_vectors(q, rows, 10)).withColumn("score", six)


@query(f"WITH {VECTORS} {top_sql('scored', k=10)} SELECT query_id, round(avg(CASE WHEN label = query_label THEN 1e0 ELSE 0e0 END), 6) AS same_label FROM best GROUP BY query_id")
def vector_by_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows = _vectors(spark, sf_dir)
    best = retrieval.best_by_vectors(q, rows, 10)
    same = F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0)
    return best.groupBy("query_id").agg(F.round(F.avg(same), 6).alias("same_label"))


_NEAR = f"""WITH {VECTORS} {top_sql('scored', k=10)}, q AS (SELECT query_id, count(*) AS wanted FROM best GROUP BY 1)"""


def _approximate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ten nearest vectors of each query by the index, and exactly."""
    q, rows = _vectors(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = neighbours.VectorIndex.build(vectors)
    exact = retrieval.best_by_vectors(q, rows, 10)
    return index.search(q, vectors, 10), exact.withColumnRenamed("policy_id", "id")


@query(f"{_NEAR} SELECT count(*) AS queries, CAST(sum(wanted) AS BIGINT) AS wanted, true AS recall_is_high FROM q")
def vector_approximate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds at least nine tenths of the ten nearest vectors of all queries."""
    r = neighbours.recall(*_approximate(spark, sf_dir))
    return r.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("met") >= 0.9 * F.sum("wanted")).alias("recall_is_high"))


@query(f"{_NEAR} SELECT query_id, policy_id, round(score, 6) AS score FROM best WHERE rank = 1")
def vector_approximate_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of each query by the index, which is the query's own."""
    q, _ = _vectors(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = neighbours.VectorIndex.build(vectors).search(q, vectors, 10)
    return found.where("rank = 1").select("query_id", F.col("id").alias("policy_id"), F.round("score", 6).alias("score"))


def _semantic(spark: SparkSession, sf_dir: str, positive: bool, limit: int | None = None) -> DataFrame:
    """Scores of policies in force by vectors: a policy's and a query's vector have its id. limit: of the so many best alone."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = whole(spark, sf_dir).join(e.withColumnRenamed("vec_id", "policy_id"), "policy_id")
    q = queries(spark, sf_dir).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id")
    q, rows = q.select("query_id", "as_of", "query_embedding"), rows.select(*retrieval.KEY, "name", "version", "effective_from", "effective_to", "embedding")
    if limit is not None:
        return retrieval.best_by_vectors(q, rows, limit, positive).select("query_id", *retrieval.KEY, "name", "version", "score")
    scored = retrieval.vector_scores(q, rows, positive)
    return scored.where(catalog.in_force(F.col("as_of"))).select("query_id", *retrieval.KEY, "name", "version", "score")


def semantic_sql(positive: bool) -> str:
    return f"""
semantic AS (
  SELECT q.query_id, f.policy_id, f.section_ref, f.position, f.name, f.version, round({cosine_sql('e.embedding', 'g.embedding')}, {SCORE_DIGITS}) AS score
  FROM whole f JOIN embeddings e ON e.vec_id = f.policy_id, items q JOIN embeddings g ON g.vec_id = q.query_id
  WHERE {IN_FORCE}{' AND score > 0' if positive else ''}),"""


def fused_sql(left: str, right: str, bound: int) -> str:
    return f"""
{top_sql(left, 'a', bound)}, {top_sql(right, 'b', bound)},
fused AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.policy_id, b.policy_id) AS policy_id, coalesce(a.section_ref, b.section_ref) AS section_ref,
    coalesce(a.position, b.position) AS position, coalesce(a.name, b.name) AS name, coalesce(a.version, b.version) AS version,
    round(coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0), {SCORE_DIGITS}) AS score
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.policy_id = b.policy_id AND a.section_ref = b.section_ref),
{top_sql('fused')}"""


@query(f"WITH {SQL} {WHOLE} {scores_sql('whole')} {semantic_sql(True)} {fused_sql('scores', 'semantic', 2**31 - 1)} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of whole keyword and vector lists."""
    lexical = retrieval.best_by_keywords(queries(spark, sf_dir), whole(spark, sf_dir), 1, share=0.0).where("NOT listed").drop("listed")  # whole lists, counted row by row
    return ranked(retrieval.fused(lexical, _semantic(spark, sf_dir, True), 5)).withColumn("score", F.round("score", 6))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries(spark, sf_dir)
    return q.withColumn("text", websearch_text(F.col("text")))


@query(f"WITH {SQL} {WHOLE} {CONTENT} {SEARCHES} {fulltext_sql('content')} {semantic_sql(False)} {fused_sql('covered', 'semantic', CANDIDATES)} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best")
def hybrid_rrf_pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the hundred best of full text and of vectors."""
    lexical = fulltext.fulltext_scores(_searches(spark, sf_dir), catalog.text_only(whole(spark, sf_dir)), best=CANDIDATES)
    return ranked(retrieval.fused(lexical, _semantic(spark, sf_dir, False, CANDIDATES), 5, CANDIDATES)).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id AS section_id, sha256(concat_ws(' ', nullif(source, ''), nullif(text, ''))) AS content_sha256 FROM documents
WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose stored embedding is missing (every third) or of an older text (every fifth)."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("section_id"), embedding_key(F.col("source"), F.col("text")).alias("content_sha256"))
    stored = rows.where("section_id % 3 <> 0").withColumn("content_sha256", F.when(F.col("section_id") % 5 == 0, "old").otherwise(F.col("content_sha256")))
    return ingest.incremental_embeddings(rows, stored)


@query("""WITH r AS (SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS current, len(regexp_extract_all(lower(concat_ws(' ', nullif(source, ''), nullif(text, ''))), '[a-z0-9]+')) AS words FROM documents)
SELECT count(*) FILTER (NOT current) AS embedded, count(*) FILTER (current) AS skipped, count(*) FILTER (words > 256) AS truncated, count(*) AS filled FROM r""")
def embedding_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a run over documents of which some have a vector of their content, and the vectors that a search then has."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.col("source").alias("heading"), "text")
    model = "hashed@1"
    key = embedding_key(F.col("heading"), F.col("text"))
    stored = d.where("section_id % 3 <> 0").select("section_id", F.lit(model).alias("model_id"), F.when(F.col("section_id") % 5 == 0, "old").otherwise(key).alias("content_sha256"), F.array(F.lit(1.0)).alias("embedding"))
    rows, seen = embedding.embed_sections(d, stored, embedding.HashedWords, model)
    rows.write.format("noop").mode("overwrite").save()
    n = embedding.filled(d, stored, embedding.HashedWords, model).agg(F.count("embedding").alias("filled"))
    return n.select(*(F.lit(seen.get[c]).alias(c) for c in ("embedded", "skipped", "truncated")), "filled")


GOLD = f"gold_pairs AS (SELECT q.query_id, f.policy_id FROM items q, whole f WHERE len({TOKENS.format('q.text')}) > 0 AND contains(f.text, q.text) AND {IN_FORCE}),"


@query(f"""WITH {SQL} {WHOLE} {scores_sql('whole')} {GOLD} {top_sql('scores', k=10)},
judged AS (SELECT b.query_id, b.rank, g.policy_id IS NOT NULL AS hit FROM best b LEFT JOIN gold_pairs g ON g.query_id = b.query_id AND g.policy_id = b.policy_id),
per AS (SELECT query_id, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM judged GROUP BY 1),
g AS (SELECT query_id, count(*) AS n FROM gold_pairs GROUP BY 1)
SELECT query_id, CASE WHEN first <= 1 THEN 1e0 ELSE 0e0 END AS recall_1, CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END AS recall_5,
  CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END AS recall_10, round(CASE WHEN first <= 10 THEN 1e0 / first ELSE 0e0 END, 6) AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
FROM g LEFT JOIN per USING (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, MRR and nDCG of the keyword ranking; gold are policies in force that hold the query's text.

    A text that holds the query holds all its tokens, so gold pairs are looked for among full scores only.
    """
    q, w = queries(spark, sf_dir), whole(spark, sf_dir)
    scores = Tables(spark, "metrics").save(retrieval.best_by_keywords(q, w, 10, share=1.0), "scores")
    pairs = scores.where("NOT listed").select("query_id", "policy_id").join(q.select("query_id", F.col("text").alias("wanted")), "query_id").join(w.select("policy_id", "text"), "policy_id")
    pairs = pairs.where(F.contains("text", "wanted")).select("query_id", "policy_id", F.lit(True).alias("gold"))
    judged = retrieval.top(scores.where("listed"), 10).join(pairs, ["query_id", "policy_id"], "left").select("query_id", "rank", F.coalesce("gold", F.lit(False)).alias("hit"))
    m = evaluate.query_metrics(judged, pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))
    return m.withColumns({c: F.round(c, 6) for c in ("mrr", "ndcg")})


@query(rf"""WITH {SQL} {WHOLE} asked AS (SELECT conv_id * 1000 + turn AS query_id, text, DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER) AS as_of FROM conversations WHERE role = 'user'),
{scores_sql('whole', 'asked')} {top_sql('scores', k=1)},
s AS (SELECT b.query_id, b.name, b.section_ref, trim(regexp_replace(w.text, '\s+', ' ', 'g'), ' ') AS clean FROM best b JOIN whole w USING (policy_id)),
p AS (SELECT query_id, name, section_ref, CASE WHEN length(clean) > 240 THEN regexp_replace(clean[:240], ' [^ ]*$', '') ELSE clean END AS quote FROM s)
SELECT a.query_id, quote IS NOT NULL AS supported, name, section_ref, quote, CASE WHEN quote IS NOT NULL THEN 65e-2 ELSE 0e0 END AS confidence FROM asked a LEFT JOIN p USING (query_id)""")
def deterministic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns answered by the leading passage of the best policy."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).alias("as_of"))
    w = whole(spark, sf_dir)
    best = Tables(spark, "answers").save(retrieval.keyword(asked, w, 1).select("query_id", "rank", "policy_id", "name", "section_ref"), "best")
    # a policy's passage is cut once, and not for each turn
    passages = w.join(few(best.select("policy_id").distinct()), "policy_id", "left_semi").select("policy_id", leading_passage(F.col("text")).alias("quote"))
    return validate.deterministic_answers(asked.select("query_id"), best.join(passages, "policy_id"))


