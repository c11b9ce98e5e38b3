"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    byte_bpe, collocations, conversation_repair, fingerprints, jaccard_join, language_id, packing, personal_data, quality_rules, rule_ensemble, tool_calls,
    toxicity, warc,
)
from codeloom.llm.common import id_remainder, table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")), ["page_id"])


def op2_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sparse_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels from rows whose crc32(doc_id) mod 5 is not 0."""
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    scored = rule_ensemble.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op5_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0; a null doc_id counts as held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    model = language_id.train(docs, ~held)
    return language_id.identify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"], reject=False)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: The tools that plain conversations call: a first question, and one that goes on in a shorter text and up to turn 5.
TOOLS = {
    "reply": {"text": ("string", True, {"min_length": 1, "max_length": 320}), "turn": ("integer", True, {"minimum": 0})},
    "follow_up": {"text": ("string", True, {"min_length": 40, "max_length": 300}), "turn": ("integer", True, {"minimum": 2, "maximum": 5})},
}


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    made = tool_calls.serialised(tool_calls.ordered(tool_calls.link(calls, results)), TOOLS)
    return made.select("conv_id", "call_id", "level", "name", "turn", "result_turn", "n_calls", "n_results", "status", "valid", "violations", "record")


OP7_SQL = """
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
asked AS (SELECT conv_id, turn, text, conv_id || ':' || CASE WHEN turn % 10 IN (6, 7) THEN turn - 2 ELSE turn END AS call_id,
  CASE WHEN turn >= 2 THEN conv_id || ':' || CASE WHEN (turn - 2) % 10 IN (6, 7) THEN turn - 4 ELSE turn - 2 END END AS need1,
  CASE WHEN turn >= 4 THEN conv_id || ':' || CASE WHEN (turn - 4) % 10 IN (6, 7) THEN turn - 6 ELSE turn - 4 END END AS need2 FROM turns WHERE role = 'user'),
calls AS (SELECT conv_id, call_id, min(turn) AS turn, arg_min(text, (turn, '{"' || CASE WHEN text IS NOT NULL THEN 'text":' || to_json(text) ELSE 'turn' END)) AS text,
  list_sort(list_filter([arg_min(need1, turn), arg_min(need2, turn)], lambda x: x IS NOT NULL AND x <> call_id)) AS needs, count(*) AS n_calls FROM asked GROUP BY conv_id, call_id),
results AS (SELECT conv_id, conv_id || ':' || CASE WHEN (turn - 1) % 10 IN (6, 7) THEN turn - 3 ELSE turn - 1 END AS call_id, min(turn) AS result_turn, arg_min(text, (turn, text)) AS content, count(*) AS n_results
  FROM turns WHERE role = 'assistant' GROUP BY ALL),
steps AS (SELECT DISTINCT c.conv_id, c.call_id, n.call_id AS need FROM (SELECT conv_id, call_id, unnest(needs) AS need FROM calls) c JOIN calls n ON n.conv_id = c.conv_id AND n.call_id = c.need),
way AS (SELECT conv_id, call_id, 0 AS level FROM calls UNION SELECT s.conv_id, s.call_id, level + 1 FROM way JOIN steps s ON s.conv_id = way.conv_id AND s.need = way.call_id),
levels AS (SELECT conv_id, call_id, max(level)::int AS level FROM way GROUP BY ALL),
both_ AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, level, CASE WHEN turn < 2 THEN 'reply' WHEN turn >= 2 THEN 'follow_up' END AS name, turn, result_turn, text, content, needs,
  coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' WHEN result_turn < turn THEN 'early' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id),
checked AS (SELECT *, concat_ws('; ', CASE WHEN name IS NOT NULL AND text IS NULL THEN 'missing: text' END, CASE WHEN length(text) < CASE name WHEN 'reply' THEN 1 ELSE 40 END THEN 'too short: text' END,
  CASE WHEN length(text) > CASE name WHEN 'reply' THEN 320 ELSE 300 END THEN 'too long: text' END, CASE WHEN name = 'reply' AND turn < 0 THEN 'too small: turn' END, CASE WHEN name = 'follow_up' AND turn > 5 THEN 'too large: turn' END) AS violations FROM both_)
SELECT conv_id, call_id, level, name, turn, result_turn, n_calls, n_results, status, violations = '' AS valid, violations,
  '{' || CASE WHEN status <> 'orphan' THEN '"arguments":{' || coalesce('"text":' || to_json(text) || ',', '') || '"turn":' || turn || '},' ELSE '' END
  || '"call_id":"' || call_id || '"' || CASE WHEN content IS NOT NULL THEN ',"content":' || to_json(content) ELSE '' END
  || CASE WHEN len(needs) > 0 THEN ',"depends_on":["' || array_to_string(needs, '","') || '"]' ELSE '' END
  || coalesce(',"level":' || level, '') || coalesce(',"name":"' || name || '"', '') || ',"status":"' || status || '"}' AS record
FROM checked"""


def op8_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels from rows whose crc32(doc_id) mod 3 is not 1."""
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(True))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    scored = toxicity.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), *toxicity.FEATURES)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), k=4, pct=85)


def op10_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"), personal_data.fit(personal_data.table()), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc_derivatives, op2_line_frequency_rules, op3_mixture_packing, op4_sparse_rule_ensemble, op5_nearest_centroid_language, op6_byte_bpe, op7_tool_call_linking,
        op8_class_kneser_ney, op9_jaccard_join, op10_quartile_digest, op11_phrase_collocations, op12_conversation_repair, op13_personal_data,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_derivatives": warc.ORACLE_SQL, "op7_tool_call_linking": OP7_SQL, "op11_phrase_collocations": collocations.ORACLE_SQL, "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
