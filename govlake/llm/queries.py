"""Registered queries of the corpus operators: each applies one operator, with
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm import (conversations, decontam, embeddings, hard_negatives, html_text, language_model, lines,
                         mixing, neardup, private_data, suffixes, toxicity, voronoi)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private_data.find_private_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      sha256(F.col("base")).alias("base_sha256"), "spans", "n_discovered")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                  table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 0.9)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                      F.col("toxicity").alias("score"),
                      F.when(F.col("toxicity") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"),
                      "toxic_spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "source"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    out = conversations.repair(conversations.damage(rows), rows.select(F.col("conv_id").alias("conv")))
    return out.withColumnRenamed("conv", "conv_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"),
                                         vec_id % 100 == 0, label=moved)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voronoi.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)
    return out.withColumnRenamed("id", "vec_id")


REGISTRY = {
    "op1_html_extraction": op1_html_extraction,
    "op2_private_data": op2_private_data,
    "op3_suffix_array": op3_suffix_array,
    "op4_language_model": op4_language_model,
    "op5_minhash": op5_minhash,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_embeddings": op8_embeddings,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_top_k": op13_top_k,
}

_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = lines.UPPER, lines.UPPER.lower()
#: Usable vectors as whole numbers, for the exact searches.
_WHOLE_SQL = """
  SELECT *, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE_SQL = {
    "op7_line_dedup": f"""
WITH pieces AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WHITE_SQL}), '{_UPPER}', '{_LOWER}') AS k
  FROM pieces),
shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT a.doc_id, a.pos, a.line, s.k IS NOT NULL AND a.doc_id <> s.holder AS gone
  FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_conversation_repair": """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_transform(k, lambda c: ascii(c)::BIGINT), lambda a, b:
           list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda r, z: xor(r >> 1, 3988292384 * (r & 1))), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM coded, (VALUES (1), (2)) AS c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS neighbours
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE neighbours NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
inserted(state, n, after) AS (
  VALUES ('', 0, ''), ('s', 0, 's'), ('u', 0, 'u'), ('a', 0, 'a'), ('', 1, 'u'), ('s', 1, 'u'), ('u', 1, 'a'),
         ('a', 1, 'u'), ('', 2, 'a'), ('s', 2, 'a')),
best(conv_id, i, state, held) AS (
  SELECT conv_id, 0::BIGINT, after,
         {'cost': 2 * s.n, 'audit': repeat('I', s.n),
          'turns': ['user:', 'assistant:'][:s.n]}
  FROM counts, inserted s WHERE state = ''
  UNION ALL
  SELECT e.conv_id, e.i, s.after,
         min({'cost': e.cost + 2 * s.n, 'audit': e.audit || repeat('I', s.n),
              'turns': e.turns || CASE WHEN e.state = 'u' THEN ['assistant:'][:s.n]
                                       ELSE ['user:', 'assistant:'][:s.n] END})
  FROM (
    SELECT b.conv_id, f.i, e.edit,
           CASE e.edit WHEN 'D' THEN b.state WHEN 'K' THEN left(f.role, 1)
                       ELSE CASE b.state WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
           b.held.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
             + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
           b.held.audit || e.edit AS audit,
           CASE e.edit WHEN 'D' THEN b.held.turns WHEN 'K' THEN b.held.turns || [f.role || ':' || f.text]
             ELSE b.held.turns || [CASE b.state WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text] END AS turns
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1,
         (VALUES ('D'), ('K'), ('R')) AS e(edit)
    WHERE e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND
          (e.edit = 'R' OR b.state || left(f.role, 1) IN ('su', 'ua', 'au') OR b.state = '' AND left(f.role, 1) IN ('s', 'u'))
  ) e JOIN inserted s ON s.state = e.state
  GROUP BY e.conv_id, e.i, s.after),
ended AS (
  SELECT b.conv_id, min(held) AS held
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  WHERE b.state IN ('', 'a') GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(held.cost, 0)::BIGINT AS cost,
       coalesce(held.audit, '') AS audit,
       sha256(coalesce(array_to_string(held.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op12_hard_negatives": f"""
WITH v AS ({_WHOLE_SQL} AND label IS NOT NULL),
w AS (SELECT vec_id, q, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab FROM v),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.lab = b.lab AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM w a JOIN w b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INTEGER AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5""",
    "op13_top_k": f"""
WITH v AS ({_WHOLE_SQL}),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
}
