"""Occurrence matching, stage choice, prompts, generation and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import tidy
from parley.operators import matching
from parley.operators.context import HISTORY_CELL, transcripts
from parley.operators.generation import (
    ERROR,
    echo_generator,
    failures,
    generate_text,
    read_ledger,
    records,
    resume_generation,
    with_combinations,
    with_prompts,
)
from parley.operators.prompts import ANSWER_HEADING, SCORE_NAMES, resolve_stage, templates
from parley.plans import corpus
from parley.plans.corpus_sql import LABELLED, NAMES, PREDICTIONS, STAGE_OF, UTT, case, normal, predicted, strip, text
from parley.plans.text_queries import rendered, shown_probability
from parley.schema import GENERATORS, NO_SITUATION, STAGE_ALIASES, STAGES
from parley.session import scratch_path

KEYS = ["conv_id", "turn"]
REQUEST = [*KEYS, "attempt"]
COMBINED = ["qwen3-8b", "llama-8b-instruct"]


def lookup_build(spark: SparkSession, folder: str) -> DataFrame:
    return matching.build_lookup(corpus.utterances(spark, folder)).select(
        "conv_id", "turn_idx", "strategy_n", "response_n", "pair_rank", "response_rank", "input_dialog", "situation"
    )


def _matches(spark: SparkSession, folder: str, group: list[str] | None = None) -> DataFrame:
    """Requests against the supporter turns of all splits, by true strategy and whole reply."""
    turns = corpus.labelled_turns(spark, folder).withColumnRenamed("text", "label_context")
    asked = corpus.requests(turns.withColumn("classifier", corpus.classifier_name()))
    lookup = matching.lookup_keys(corpus.utterances(spark, folder))
    return matching.match_requests(asked, lookup, REQUEST, group=group)


def occurrence_match(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select(*REQUEST, "corpus_conv", "corpus_turn", "match_kind")


def _requests_with_context(spark: SparkSession, folder: str, group: list[str] | None = None) -> DataFrame:
    turns = corpus.utterances(spark, folder, HISTORY_CELL)
    said = transcripts(turns).select("conv_id", "turn_idx", "input_dialog", "situation")
    asked = corpus.requests(corpus.predictions(spark, folder))
    return matching.attach_context(asked, _matches(spark, folder, group), said, REQUEST, group=group)


def occurrence_join(spark: SparkSession, folder: str) -> DataFrame:
    return _requests_with_context(spark, folder).select(
        *REQUEST, "match_kind", "context_source", "situation", "input_dialog"
    )


def _patchy(rows: DataFrame) -> DataFrame:
    """Leave out more and more of what tells the stage, by id."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    return rows.withColumns(
        {
            "stage_pred": F.when(kind == 0, F.col("stage_pred")).when(kind == 1, " supporting ").otherwise("?"),
            "stage_true": F.when(kind == 2, F.upper("stage_true")).otherwise(F.lit(None)),
            "strategy_pred": F.when(kind == 3, F.lower("strategy_pred")).otherwise(""),
            "strategy_pred_id": F.when((F.col("conv_id") % 2) == 0, F.col("strategy_pred_id").cast("string")).otherwise("none"),
        }
    )


def stage_choice(spark: SparkSession, folder: str) -> DataFrame:
    rows = _patchy(corpus.labelled_turns(spark, folder))
    return rows.select(
        *KEYS, resolve_stage().alias("stage"), resolve_stage(allow_truth=False).alias("stage_without_truth")
    )


def _prompt_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Supporter turns with their own transcript and situation."""
    said = transcripts(corpus.utterances(spark, folder, HISTORY_CELL)).withColumn("situation", tidy(F.col("situation")))
    return corpus.with_predictions(said)


def build_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return with_prompts(_prompt_rows(spark, folder)).select(*KEYS, "stage", "prompt")


def build_flat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return with_prompts(_prompt_rows(spark, folder), mode="flat").select(*KEYS, "prompt")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    requests = with_prompts(_requests_with_context(spark, folder, ["classifier"]))
    # the classifier of a request is part of its row; generators each get a copy
    generated = generate_text(with_combinations(requests, COMBINED))
    return records(generated, keep=tuple(REQUEST))


def generate_records(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder)


class _Refusing:
    """A generator that fails on prompts of the Action stage."""

    def __call__(self, prompts: list[str]) -> list[str]:
        if any("stage Action" in p for p in prompts):
            raise RuntimeError("no answer")
        return ["Response: ok"] * len(prompts)


def generation_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts a generator refuses end up as error rows, counted by combination."""
    rows = with_prompts(_prompt_rows(spark, folder)).withColumn("classifier", corpus.classifier_name())
    done = generate_text(with_combinations(rows.select("classifier", "prompt"), COMBINED), _Refusing())
    return failures(done)


def generation_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs over the same prompts: one that fails on a stage, one that asks those again, one with nothing to do."""
    ledger = scratch_path(spark, "ledger")
    rows = with_combinations(with_prompts(_prompt_rows(spark, folder)).select("stage", "prompt"), COMBINED)
    for generator in (_Refusing(), echo_generator, _Refusing()):
        done = resume_generation(rows, ledger, generator, asked_of=("llm_alias",))
    runs = read_ledger(spark, ledger)
    asked = runs.groupBy("run").agg(F.count("*").alias("asked"), F.count_if("failed").alias("failed"))
    left = done.agg(F.count_if(F.col("llm_raw_output").startswith(ERROR)).alias("failed_rows"), F.count("*").alias("rows"))
    return asked.withColumn("one", F.lit(1)).join(F.broadcast(left.withColumn("one", F.lit(1))), "one").drop("one")


QUERIES = {
    "lookup_build": lookup_build,
    "occurrence_match": occurrence_match,
    "occurrence_join": occurrence_join,
    "resolve_stage": stage_choice,
    "build_prompts": build_prompts,
    "build_flat_prompts": build_flat_prompts,
    "generate_records": generate_records,
    "generation_failures": generation_failures,
    "generation_resumed": generation_resumed,
}

_LINE = f"CASE WHEN {strip('text')} <> '' THEN CASE speaker WHEN 'sys' THEN 'Supporter : ' ELSE 'Seeker : ' END || {strip('text')} END"
_EARLIER = "OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SAID = f"""
told AS (SELECT *, {strip(f"coalesce(string_agg({_LINE}, chr(10)) {_EARLIER}, '')")} AS input_dialog FROM utt),
said AS (SELECT * FROM told WHERE speaker = 'sys')"""
_SERVED = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, conv_id, turn_idx"
_LOOKUP = f"""{_SAID},
lookup AS (
  SELECT conv_id, turn_idx, {normal('strategy')} AS strategy_n, {normal('text')} AS response_n, input_dialog,
         {strip("coalesce(situation, '')")} AS situation,
         row_number() OVER (PARTITION BY {normal('strategy')}, {normal('text')} ORDER BY {_SERVED}) AS pair_rank,
         row_number() OVER (PARTITION BY {normal('text')} ORDER BY {_SERVED}) AS response_rank
  FROM said)"""


def _matched(source: str, group: str = "") -> str:
    more = f"{group}, " if group else ""
    return f"""
wanted AS (SELECT conv_id, turn, attempt, {more}{normal('strategy_true')} AS strategy_n, {normal('label_context')} AS response_n FROM {source}),
asked AS (SELECT *, row_number() OVER (PARTITION BY {more}strategy_n, response_n ORDER BY conv_id, turn, attempt) AS k FROM wanted),
first_try AS (
  SELECT a.*, l.conv_id AS pc, l.turn_idx AS pt FROM asked a
  LEFT JOIN lookup l ON a.strategy_n = l.strategy_n AND a.response_n = l.response_n AND k = pair_rank AND a.response_n <> ''),
missed AS (
  SELECT *, row_number() OVER (PARTITION BY {more}response_n ORDER BY conv_id, turn, attempt) AS j FROM first_try
  WHERE pc IS NULL AND response_n <> ''),
second_try AS (
  SELECT m.conv_id, m.turn, m.attempt, l.conv_id AS rc, l.turn_idx AS rt FROM missed m
  LEFT JOIN lookup l ON m.response_n = l.response_n AND j = response_rank),
matched AS (
  SELECT f.conv_id, f.turn, f.attempt, coalesce(pc, rc) AS corpus_conv, coalesce(pt, rt) AS corpus_turn,
         CASE WHEN pc IS NOT NULL THEN 'pair' WHEN rc IS NOT NULL THEN 'response' ELSE 'none' END AS match_kind
  FROM first_try f LEFT JOIN second_try s ON f.conv_id = s.conv_id AND f.turn = s.turn AND f.attempt = s.attempt)"""


_REQUESTS = f"""{PREDICTIONS}, requests AS (
  SELECT * EXCLUDE (label_context, strategy_true),
    CASE WHEN (conv_id * 3 + turn) % 7 = 0 THEN '' WHEN (conv_id + turn) % 9 = 4 THEN '  ' || label_context || chr(9)
         WHEN (conv_id + turn) % 11 = 5 THEN label_context || ' again' ELSE label_context END AS label_context,
    CASE WHEN (conv_id + turn) % 4 = 1 THEN strategy_pred ELSE strategy_true END AS strategy_true,
    unnest(CASE WHEN (conv_id + turn) % 6 = 0 THEN [0, 1] ELSE [0] END) AS attempt FROM pred)"""


def _joined(group: str = "") -> str:
    return f"""{_REQUESTS}, {_LOOKUP}, {_matched('requests', group)},
joined AS (
  SELECT r.*, match_kind, CASE WHEN match_kind = 'none' THEN 'context' ELSE 'corpus' END AS context_source,
         CASE WHEN match_kind = 'none' THEN '' ELSE l.situation END AS situation,
         CASE WHEN match_kind = 'none' THEN r.context ELSE l.input_dialog END AS raw_dialog
  FROM requests r JOIN matched m ON r.conv_id = m.conv_id AND r.turn = m.turn AND r.attempt = m.attempt
  LEFT JOIN lookup l ON l.conv_id = corpus_conv AND l.turn_idx = corpus_turn)"""


def _prompt_sql(template: str) -> str:
    out = text(template)
    for column in SCORE_NAMES.values():
        if "{" + column + "}" in template:
            out = out.replace("{" + column + "}", f"' || {shown_probability(column)} || '")
    situation = f"coalesce(nullif(trim(situation), ''), {text(NO_SITUATION)})"
    out = out.replace("{situation}", f"' || {situation} || '")
    return "(" + out.replace("{input_dialog}", "' || input_dialog || '") + ")"


_STAGED = "CASE stage " + " ".join(f"WHEN '{s}' THEN {_prompt_sql(templates()[s])}" for s in STAGES) + " END"
_OWN = f"""
{UTT}, {_SAID}, given AS (SELECT * EXCLUDE (situation), coalesce(situation, '') AS situation FROM said)"""
# the stand-in generator: best scored strategy of the list before the answer form, last seeker line
def _scores(part: int) -> str:
    lines = f"split_part(prompt, {text(ANSWER_HEADING)}, 1)"
    return f"regexp_extract_all({lines}, '(?m)^- ([^:\\n]+): (-?\\d+\\.\\d{{3}})$', {part})"


_SCORE_VALUES = f"list_transform({_scores(2)}, lambda v: CAST(v AS double))"
_BEST_NAME = f"({_scores(1)})[list_position({_SCORE_VALUES}, list_max({_SCORE_VALUES}))]"
_SEEKER = "regexp_extract_all(prompt, '(?m)^Seeker : (.*)$', 1)"
_ANSWER = f"""trim(CASE WHEN len({_scores(1)}) > 0 THEN 'Strategy: ' || {_BEST_NAME} || chr(10) ELSE '' END
  || 'Response: I hear you say: ' || coalesce(({_SEEKER})[-1], 'nothing yet'))"""

_KIND = "(conv_id + turn) % 5"
_STAGE_SCORES = "[prob_ex, greatest(prob_su, prob_co), prob_ac, prob_ot]"
_NAME_STAGES = {name.lower(): STAGE_OF[i] for i, name in NAMES.items()}
_CHOICE = f"""WITH {LABELLED}, p AS (SELECT conv_id, turn,
  CASE {_KIND} WHEN 0 THEN stage_pred WHEN 1 THEN ' supporting ' ELSE '?' END AS sp,
  CASE {_KIND} WHEN 2 THEN upper(stage_true) END AS st, CASE {_KIND} WHEN 3 THEN lower(strategy_pred) ELSE '' END AS np,
  CASE WHEN conv_id % 2 = 0 THEN strategy_pred_id END AS ip, {_STAGE_SCORES} AS scores FROM pred),
c AS (SELECT conv_id, turn, {case(normal('sp'), STAGE_ALIASES)} AS a, {case(normal('st'), STAGE_ALIASES)} AS b,
  {case('np', _NAME_STAGES)} AS c, {case('ip', STAGE_OF)} AS d,
  ['{"', '".join(STAGES)}'][list_position(scores, list_max(scores))] AS e FROM p)
SELECT conv_id, turn, coalesce(a, b, c, d, e) AS stage, coalesce(a, c, d, e) AS stage_without_truth FROM c"""

_ALIAS_ROWS = ", ".join(f"({text(a)}, {text(GENERATORS[a])})" for a in COMBINED)

ORACLES = {
    "lookup_build": f"""WITH {UTT}, {_LOOKUP}
SELECT conv_id, turn_idx, strategy_n, response_n, pair_rank, response_rank, input_dialog, situation FROM lookup""",
    "occurrence_match": f"WITH {_REQUESTS}, {_LOOKUP}, {_matched('requests')} SELECT * FROM matched",
    "occurrence_join": f"""WITH {_joined()}
SELECT conv_id, turn, attempt, match_kind, context_source, situation, {rendered('raw_dialog')} AS input_dialog FROM joined""",
    "resolve_stage": _CHOICE,
    "build_prompts": f"""WITH {_OWN}, {predicted('given')}, p AS (SELECT *, stage_pred AS stage FROM pred)
SELECT conv_id, turn, stage, {_STAGED} AS prompt FROM p""",
    "build_flat_prompts": f"WITH {_OWN}, {predicted('given')} SELECT conv_id, turn, {_prompt_sql(templates()['flat'])} AS prompt FROM pred",
    "generate_records": f"""WITH {_joined('classifier')},
ready AS (SELECT *, {rendered('raw_dialog')} AS input_dialog, stage_pred AS stage FROM joined),
prompted AS (SELECT *, {_STAGED} AS prompt FROM ready),
answered AS (SELECT *, {_ANSWER} AS raw FROM prompted),
names(llm_alias, llm_id) AS (VALUES {_ALIAS_ROWS})
SELECT conv_id, turn, attempt, llm_alias, llm_id, classifier, strategy_pred AS prediction, CAST(strategy_pred_id AS varchar) AS prediction_id,
  strategy_true AS reference, CAST(strategy_true_id AS varchar) AS reference_id, {strip('label_context')} AS reference_response,
  raw AS llm_raw_output,
  CASE WHEN raw LIKE 'Strategy: %' THEN regexp_extract(raw, '^Strategy: ([^\\n]*)', 1) ELSE 'N/A' END AS llm_predict_strategy,
  {strip("regexp_extract(raw, '(?s)Response: (.*)', 1)")} AS llm_parsed_response, input_dialog, context_source, situation, prompt
FROM answered, names""",
    "generation_resumed": f"""WITH {_OWN}, {predicted('given')},
q AS (SELECT *, {_STAGED} AS prompt FROM (SELECT *, stage_pred AS stage FROM pred)),
asked AS (SELECT DISTINCT prompt, prompt LIKE '%stage Action%' AS refused FROM q),
totals AS (SELECT 2 * count(*) AS n, 2 * count_if(refused) AS r, (SELECT 2 * count(*) FROM q) AS rows FROM asked)
SELECT CAST(1 AS int) AS run, n AS asked, r AS failed, 0 AS failed_rows, rows FROM totals
UNION ALL SELECT 2, r, 0, 0, rows FROM totals WHERE r > 0""",
    "generation_failures": f"""WITH {LABELLED}, names(llm_alias, llm_id) AS (VALUES {_ALIAS_ROWS})
SELECT llm_alias, classifier, count(*) AS failed, 'Error: no answer' AS example FROM pred, names
WHERE stage_pred = 'Action' GROUP BY ALL""",
}
