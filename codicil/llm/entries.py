"""Queries of the training-data operators over their whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codicil.llm import bpe_codec, compaction, decontaminate, html_blocks, licenses, merkle, packing, quality_rules, setsketch, token_shards, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.encode_and_read(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.shard_and_read(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), merkle.lowered_fifth())


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op12 gives in whole numbers, which SQL can express unlike the components."""
    return whitening.exact_deviations(table(spark, sf_dir, "embeddings"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.round_trip(table(spark, sf_dir, "documents")))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2's base rule reads, which SQL can express unlike the learned list."""
    stats = quality_rules.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stats.select("doc_id", *quality_rules.BASE, quality_rules.base_failed().alias("base_failed"))


QUERIES = (quality_statistics, op1_html_main_text, op2_quality_rules, op3_warc_normaliser, op4_best_fit_packing, op5_decontamination, op6_token_shards, op7_toxicity, op8_sharding, op9_license_scan, op10_near_duplicates, op11_merkle_manifest, op12_embedding_whitening, embedding_deviations, op13_bpe_codec)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


SQL_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
      lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN [w[1]] ELSE [] END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_id AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sizes LEFT JOIN least_id ON x = doc_id
"""


SQL_WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

SQL_STATISTICS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM w),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + 4), ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM n WHERE n > 1) GROUP BY 1),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM w)
SELECT s.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM s LEFT JOIN r USING (doc_id)
"""


#: A list that starts with all bits, then each byte of the decimal id followed by eight times -1: a byte is mixed in, -1 is one step of the checksum.
SQL_CRC = r"""xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: list_concat([CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda c, x: CASE WHEN x < 0 THEN xor(c >> 1, (c & 1) * 3988292384) ELSE xor(c, x) END), 4294967295)"""


def _sql_leaf(text: str) -> str:
    fields = (f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text))
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"


SQL_MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN {SQL_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS altered
  FROM documents),
leaves AS (SELECT doc_id, source, {_sql_leaf("text")} AS leaf, {_sql_leaf("altered")} AS given FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf, given) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree(lvl, source, i, n, h) AS (
  SELECT 0, source, i, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lvl, source, i // 16, n),
roots AS (SELECT source, h, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper(lvl, i, n, h) AS (
  SELECT 0, i, n, h FROM roots
  UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY lvl, i // 16, n),
lower_beside AS (
  SELECT lvl, source, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, i // 16 ORDER BY i)),
upper_beside AS (
  SELECT lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 16 ORDER BY i)),
steps AS (
  SELECT p.doc_id, p.leaf, p.given, b.lvl, l, r FROM placed p JOIN lower_beside b ON b.source IS NOT DISTINCT FROM p.source AND b.i = p.i // CAST(pow(16, b.lvl) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.given, 100 + b.lvl, l, r FROM placed p JOIN roots s ON s.source IS NOT DISTINCT FROM p.source JOIN upper_beside b ON b.i = s.i // CAST(pow(16, b.lvl) AS BIGINT)),
paths AS (SELECT doc_id, leaf, given, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS steps FROM steps GROUP BY ALL),
folded AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([p.given], coalesce(steps, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN roots s ON s.source IS NOT DISTINCT FROM p.source
  LEFT JOIN paths q ON q.doc_id = p.doc_id AND q.leaf = p.leaf AND q.given = p.given)
SELECT *, folded_root = root AS verified FROM folded
"""


SQL_DEVIATIONS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT DISTINCT x FROM v), size AS (SELECT count(*) AS n FROM u),
sums AS (SELECT i, sum(x[i]) AS s FROM u, range(1, len(x) + 1) t(i) GROUP BY i),
all_sums AS (SELECT list(s ORDER BY i) AS s FROM sums)
SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation FROM v, size, all_sums
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_near_duplicates": SQL_NEAR, "op3_warc_normaliser": SQL_WARC, "op11_merkle_manifest": SQL_MERKLE, "embedding_deviations": SQL_DEVIATIONS, "quality_statistics": SQL_STATISTICS}
