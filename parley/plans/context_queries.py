"""Context, flattening and data-quality queries over the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.context import (
    HISTORY_CELL,
    context_of,
    evaluation_examples,
    fill_nulls,
    history_arrays,
    is_supporter,
    null_report,
    transcripts,
    with_recent,
)
from parley.operators.positions import CELL, with_position
from parley.plans import corpus
from parley.plans.corpus_sql import UTT, strip
from parley.sources.readers import flatten_dialogues, parse_dialogues


def ctx_window5(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_recent(corpus.utterances(spark, folder, CELL)).filter(is_supporter())
    return rows.select("conv_id", "turn_idx", "split", context_of(F.col("recent")).alias("context"))


def ctx_window2(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_recent(corpus.utterances(spark, folder, CELL), 2, include_labels=False).filter(is_supporter())
    return rows.select("conv_id", "turn_idx", context_of(F.col("recent"), 2).alias("context"))


def ctx_eval_split(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation_examples(corpus.utterances(spark, folder, CELL)).select(
        "conv_id", "turn_idx", "context_t1", "context_t2", "context", "current_turn", "label_context"
    )


def ctx_history_array(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.transform(
        "dialogue",
        lambda u: F.concat_ws("|", u["speaker"], F.coalesce(u["strategy"], F.lit("-")), u["text"]),
    )
    return history_arrays(corpus.utterances(spark, folder, HISTORY_CELL)).select(
        "conv_id",
        "turn_idx",
        F.size("dialogue").alias("n_turns"),
        F.array_join(turn, "\n").alias("dialogue"),
    )


def ctx_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts(corpus.utterances(spark, folder, HISTORY_CELL)).select("conv_id", "turn_idx", "input_dialog")


def example_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.utterances(spark, folder).filter(is_supporter()).select("split", "conv_id", "turn_idx")
    numbered = with_position(rows, ["split"], ["conv_id", "turn_idx"], "idx")
    return numbered.withColumn("idx", F.col("idx") - 1)


def null_columns(spark: SparkSession, folder: str) -> DataFrame:
    return null_report(corpus.utterances(spark, folder), ["situation", "strategy", "text"])


def filled_situations(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.utterances(spark, folder).select("conv_id", "turn_idx", "situation")
    return fill_nulls(rows, ["situation"])


def dialogue_json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues nested to one literal per conversation, parsed back and flattened.

    A nested dialogue is one row by definition, so only this format needs it to fit a row.
    """
    turn = F.struct("turn_idx", F.struct("speaker", "text", "strategy").alias("u"))
    nested = (
        corpus.utterances(spark, folder)
        .groupBy("conv_id", "split")
        .agg(F.max("situation").alias("situation"), F.sort_array(F.collect_list(turn)).alias("t"))
        .select(
            "conv_id",
            "split",
            F.to_json(
                F.struct("situation", F.transform("t", lambda x: x["u"]).alias("dialog")),
                {"ignoreNullFields": "false"},
            ).alias("raw"),
        )
    )
    parsed = parse_dialogues(nested, clean=False)
    return flatten_dialogues(parsed).select("conv_id", "turn_idx", "split", "situation", "speaker", "text", "strategy")


QUERIES = {
    "ctx_window5": ctx_window5,
    "ctx_window2": ctx_window2,
    "ctx_eval_split": ctx_eval_split,
    "ctx_history_array": ctx_history_array,
    "ctx_transcript": ctx_transcript,
    "example_ordinal": example_ordinal,
    "null_report": null_columns,
    "filled_situations": filled_situations,
    "dialogue_json_roundtrip": dialogue_json_roundtrip,
}

_LINE = f"CASE WHEN {strip('text')} <> '' THEN CASE speaker WHEN 'sys' THEN 'Supporter : ' ELSE 'Seeker : ' END || {strip('text')} END"
_EARLIER = "OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

ORACLES = {
    "ctx_window5": f"WITH {UTT} SELECT conv_id, turn_idx, split, context5 AS context FROM ctx",
    "ctx_window2": f"""
WITH {UTT}, plain AS (
  SELECT conv_id, turn_idx, speaker, CASE speaker WHEN 'sys' THEN '[supporter] ' ELSE '[seeker] ' END || text AS said FROM utt),
two AS (
  SELECT *, string_agg(said, ' ') OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS j FROM plain)
SELECT conv_id, turn_idx, CASE WHEN turn_idx = 0 THEN '<START>' ELSE j END AS context FROM two WHERE speaker = 'sys'""",
    "ctx_eval_split": f"""
WITH {UTT}, parts AS (
  SELECT conv_id, turn_idx, text AS label_context,
         CASE WHEN turn_idx = 0 OR len(before) = 1 THEN '' ELSE array_to_string(before[:-2], ' ') END AS context_t1,
         context1 AS context_t2 FROM ctx)
SELECT *, {strip("context_t1 || ' ' || context_t2")} AS context, {strip('context_t2')} AS current_turn FROM parts""",
    "ctx_history_array": f"""
WITH {UTT}, h AS (
  SELECT conv_id, turn_idx, speaker,
         list(speaker || '|' || coalesce(strategy, '-') || '|' || text) {_EARLIER} AS d FROM utt)
SELECT conv_id, turn_idx, coalesce(len(d), 0) AS n_turns, coalesce(array_to_string(d, chr(10)), '') AS dialogue
FROM h WHERE speaker = 'sys'""",
    "ctx_transcript": f"""
WITH {UTT}, h AS (SELECT conv_id, turn_idx, speaker, string_agg({_LINE}, chr(10)) {_EARLIER} AS t FROM utt)
SELECT conv_id, turn_idx, {strip("coalesce(t, '')")} AS input_dialog FROM h WHERE speaker = 'sys'""",
    "example_ordinal": f"""
WITH {UTT} SELECT split, conv_id, turn_idx,
  row_number() OVER (PARTITION BY split ORDER BY conv_id, turn_idx) - 1 AS idx FROM utt WHERE speaker = 'sys'""",
    "null_report": f"""
WITH {UTT} SELECT 'situation' AS column_name, count(*) - count(situation) AS nulls FROM utt
UNION ALL SELECT 'strategy', count(*) - count(strategy) FROM utt
UNION ALL SELECT 'text', count(*) - count(text) FROM utt""",
    "filled_situations": f"WITH {UTT} SELECT conv_id, turn_idx, coalesce(situation, '') AS situation FROM utt",
    "dialogue_json_roundtrip": f"WITH {UTT} SELECT conv_id, turn_idx, split, situation, speaker, text, strategy FROM utt",
}
