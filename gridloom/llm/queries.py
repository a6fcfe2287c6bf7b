"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import brown, decontam, fingerprint, html_text, langid, lexical, licenses, mixing, neardup, negatives, pii, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op2_order_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, the first document with the same text, and whether it is the one that stays."""
    return neardup.classes(_table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_order_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))


def op5_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(_table(spark, sf_dir, "pages"))


def op10_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n_words, ranges, found = decontam.names(docs)
    n_hit = decontam.hit_words(F.col(ranges))
    marked = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col(n_words))).alias("contaminated"),
    )


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_embeddings(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(3 * source_size) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS gone
  FROM weighted WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT *, CAST(total - used AS DOUBLE) / CAST(all_weight - gone AS DOUBLE) AS share FROM levels),
rates AS (SELECT *, 3 * source_size <= share * weight AS is_full FROM shares),
rate AS (SELECT arg_min(share, gone) AS r FROM rates WHERE NOT is_full),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full OR r IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), r * weight) END AS target
  FROM rates, rate),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
running AS (
  SELECT d.*, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source),
cuts AS (
  SELECT source, min(h) AS boundary FROM running WHERE upto > budget GROUP BY source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
  CAST(size * least(3, passes + CASE WHEN boundary IS NULL OR h > boundary THEN 0
    WHEN h < boundary THEN 1 WHEN upto - budget < budget - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
"""

OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS gram
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM items)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT rid, size, s, array_to_string(w[s:s + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT rid, g.size, s, item FROM grams g JOIN windows v ON g.size = v.size AND g.gram = v.gram),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM found) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


def queries() -> dict:
    named = (op1_personal_data, op2_order_minhash_dedup, op3_quality_mil, op4_order_minhash_fingerprints, op5_language_kernel, op6_mix_sources, op7_brown_lm, op8_html_text, op9_decontaminate, op10_toxicity_knn, op11_license_templates, op12_hard_negatives, op13_lexical_search)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": OP6_SQL, "op9_decontaminate": OP9_SQL, "op11_license_templates": licenses.scan_sql(), "op12_hard_negatives": negatives.SQL, "op13_lexical_search": lexical.SQL}
