"""The corpus queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    conversation_repair,
    hard_negatives,
    mixing,
    near_dedup,
    packing,
    quality_model,
    quality_rules,
    sharding,
    suffix_dedup,
    surrogates,
    toxicity,
    winnowing,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.external_shuffle(table(spark, sf_dir, "documents"), n_shards=16))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = surrogates.pseudonymise(table(spark, sf_dir, "documents"))
    return rewritten.select("record.doc_id", "text", "n_entities")


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("record")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.with_edits(table(spark, sf_dir, "documents"))


def op7_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).selectExpr(
        "CAST(-1 AS BIGINT) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.prefix_targets(turns.unionByName(planted)))


OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'))
         + length(regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'))
         + 23 AS size
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS so_far, (role = 'assistant' OR i = n) AS target
  FROM numbered)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (target) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "reason")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(turns), turns)


# crc32 byte by byte; then row by row the cheapest way into each of four states, as (cost, audit, repaired text)
OP11_SQL = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
              ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
marked AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
                         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind
  FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE kind <> 0),
placed AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN body = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS initial_before
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         count(*) AS n
  FROM faults GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i,
         CAST({'cost': 0, 'audit': '', 'said': ''} AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR)) AS s0,
         CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR)) AS s1,
         CAST({'cost': 5, 'audit': 'I', 'said': chr(10) || 'user:'} AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR)) AS s2,
         CAST({'cost': 10, 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'}
              AS STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR)) AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, i, s0, s1, c2, list_min([s3, {'cost': c2.cost + 5, 'audit': c2.audit || 'I', 'said': c2.said || chr(10) || 'assistant:'}])
  FROM (
    SELECT conv_id, i, s0, s1, s3,
           list_min(list_filter([s2,
             {'cost': s0.cost + 5, 'audit': s0.audit || 'I', 'said': s0.said || chr(10) || 'user:'},
             {'cost': s1.cost + 5, 'audit': s1.audit || 'I', 'said': s1.said || chr(10) || 'user:'},
             {'cost': s3.cost + 5, 'audit': s3.audit || 'I', 'said': s3.said || chr(10) || 'user:'}], lambda x: x.cost IS NOT NULL)) AS c2
    FROM (
      SELECT conv_id, f.i AS i,
             {'cost': s0.cost + 2, 'audit': s0.audit || 'D', 'said': s0.said} AS s0,
             list_min(list_filter([
               {'cost': s1.cost + 2, 'audit': s1.audit || 'D', 'said': s1.said},
               CASE WHEN ok AND initial = 's' THEN {'cost': s0.cost + more, 'audit': s0.audit || 'K', 'said': s0.said || line} END],
               lambda x: x.cost IS NOT NULL)) AS s1,
             list_min(list_filter([
               {'cost': s2.cost + 2, 'audit': s2.audit || 'D', 'said': s2.said},
               CASE WHEN ok THEN {'cost': s0.cost + more + tag_u, 'audit': s0.audit || edit_u, 'said': s0.said || line_u} END,
               CASE WHEN ok THEN {'cost': s1.cost + more + tag_u, 'audit': s1.audit || edit_u, 'said': s1.said || line_u} END,
               CASE WHEN ok THEN {'cost': s3.cost + more + tag_u, 'audit': s3.audit || edit_u, 'said': s3.said || line_u} END],
               lambda x: x.cost IS NOT NULL)) AS s2,
             list_min(list_filter([
               {'cost': s3.cost + 2, 'audit': s3.audit || 'D', 'said': s3.said},
               CASE WHEN ok THEN {'cost': s2.cost + more + tag_a, 'audit': s2.audit || edit_a, 'said': s2.said || line_a} END],
               lambda x: x.cost IS NOT NULL)) AS s3
      FROM steps JOIN (
        SELECT conv_id AS of_conv, i, initial, fault NOT IN ('blank', 'duplicate') AS ok,
               CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
               chr(10) || role || ':' || text AS line,
               CASE WHEN initial = 'u' THEN 0 ELSE 1 END AS tag_u, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS edit_u,
               chr(10) || CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text AS line_u,
               CASE WHEN initial = 'a' THEN 0 ELSE 1 END AS tag_a, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS edit_a,
               chr(10) || CASE WHEN initial = 'a' THEN role ELSE 'assistant' END || ':' || text AS line_a
        FROM faults) f ON steps.conv_id IS NOT DISTINCT FROM f.of_conv AND f.i = steps.i + 1))),
ended AS (
  SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, list_min([s0, s3]) AS best
  FROM counted c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.hard_negatives(vectors.withColumn("label", hard_negatives.shifted_label()))


OP12_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5),
inside AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, vec_id NULLS LAST) AS rank
  FROM positives p JOIN pairs n ON p.a = n.a AND NOT n.alike
   AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM inside WHERE rank <= 10
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# name -> (query, SQL or None)
_REGISTRY: dict[str, tuple[Query, str | None]] = {
    "op1_minhash_near_dedup": (op1_minhash_near_dedup, None),
    "op2_shards": (op2_shards, None),
    "op3_pii_surrogates": (op3_pii_surrogates, None),
    "op4_quality_scores": (op4_quality_scores, None),
    "op5_temperature_mixing": (op5_temperature_mixing, None),
    "op6_winnowing": (op6_winnowing, None),
    "op7_chat_prefix_targets": (op7_chat_prefix_targets, OP7_SQL),
    "op8_retrieval_packing": (op8_retrieval_packing, None),
    "op9_repeated_passages": (op9_repeated_passages, None),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_conversation_repair": (op11_conversation_repair, OP11_SQL),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_toxicity": (op13_toxicity, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql is not None}
