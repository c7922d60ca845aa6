"""Text function queries over conversations and documents, always over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.functions.numeric import format_probability
from parley.functions.tokens import (
    GRAM_SEPARATOR,
    blank_tokens,
    labelled_grams,
    punctuation_tokens,
    word_tokens,
)
from parley.operators.context import context_of, is_supporter, with_recent
from parley.operators.positions import CELL
from parley.plans import corpus
from parley.plans.corpus_sql import LABELLED, UTT, case, normal, punct, strip, words
from parley.plans.corpus_sql import text as quoted
from parley.schema import GENERATORS, NO_SITUATION, STAGE_ALIASES


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.documents(spark, folder).select(
        "doc_id", tx.normalize_text(F.col("text")).alias("normal"), tx.valid_text(F.col("lang")).alias("lang")
    )


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.documents(spark, folder).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


def _tokens(df: DataFrame, key: list[str], tokens) -> DataFrame:
    cut = df.select(*key, tokens.alias("t"))
    return cut.select(*key, F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def tokenize_punct(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(corpus.documents(spark, folder), ["doc_id"], punctuation_tokens(F.col("text")))


def tokenize_contractions(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(corpus.documents(spark, folder), ["doc_id"], word_tokens(F.col("text")))


def tokenize_ws(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(corpus.documents(spark, folder), ["doc_id"], blank_tokens(F.col("text")))


def ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """How often each bigram and trigram occurs in the replies."""
    replies = corpus.conversations(spark, folder).filter("role = 'assistant'")
    tokens = word_tokens(F.col("text"))
    both = F.concat(*[labelled_grams(F.col("t"), n) for n in (2, 3)])
    return (
        replies.select(tokens.alias("t"))
        .select(F.inline(both))
        .groupBy("n", F.replace("gram", F.lit(GRAM_SEPARATOR), F.lit(" ")).alias("gram"))
        .agg(F.count("*").alias("times"))
    )


def render_turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_recent(corpus.utterances(spark, folder, CELL)).filter(is_supporter())
    return rows.select(
        "conv_id",
        "turn_idx",
        tx.render_turns(context_of(F.col("recent"))).alias("rendered"),
        tx.render_turns(F.concat(F.lit("Seeker : "), "text", F.lit("\n\n Supporter: "), "text")).alias("relabelled"),
        tx.render_turns(F.col("text")).alias("untagged"),
    )


def _messy(conv: str = "conv_id", turn: str = "turn") -> dict:
    """Field values of the kinds found in result files, picked by id."""
    kind = (F.col(conv) + F.col(turn)) % 8
    shown = F.col("prob_ex").cast("string")
    return {
        "prob_raw": F.when(kind == 0, "").when(kind == 1, "abc").when(kind == 2, "nan").when(kind == 3, "inf")
        .when(kind == 4, "-1.0").when(kind == 5, F.concat(F.lit(" "), shown)).when(kind == 6, F.lit(None)).otherwise(shown),
        "id_raw": F.when(kind == 0, "").when(kind == 1, "3.0").when(kind == 2, " 3 ").when(kind == 3, F.lit(None))
        .otherwise(F.col("strategy_pred_id").cast("string")),
        "llm_raw": F.when(kind < 2, "qwen3-8b").when(kind < 4, "Qwen/Qwen3-32B").when(kind < 6, " some/other model ")
        .otherwise("meta-llama/Meta-Llama-3-8B-Instruct"),
        "stage_raw": F.when(kind == 0, "Supporting").when(kind == 1, " SU ").when(kind == 2, "support")
        .when(kind == 3, "unknown").when(kind == 4, F.lit(None)).otherwise(F.upper("stage_pred")),
        "situation_raw": F.when(kind < 2, F.lit(None)).when(kind < 4, " \t\n").otherwise(F.concat(F.lit(" \n"), "text", F.lit("\t"))),
    }


def typed_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.labelled_turns(spark, folder).withColumns(_messy())
    return rows.select(
        "conv_id",
        "turn",
        format_probability(F.col("prob_raw")).alias("probability"),
        format_probability(F.col("prob_su")).alias("prob_su"),
        tx.parse_int(F.col("id_raw")).alias("strategy_id"),
        tx.short_name(F.col("llm_raw"), GENERATORS).alias("llm_alias"),
        tx.full_name(F.col("llm_raw"), GENERATORS).alias("llm_id"),
        tx.stage_name(F.col("stage_raw")).alias("stage"),
        tx.situation_or_default(F.col("situation_raw")).alias("situation"),
        tx.tidy(F.col("situation_raw")).alias("tidied"),
    )


def parse_generation(spark: SparkSession, folder: str) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit("strategy : "), "strategy_pred", F.lit("\n Response:  "), "text"))
        .when(kind == 1, F.concat(F.lit("RESPONSE: "), "text"))
        .when(kind == 2, F.concat(F.lit("Here. Strategy:"), "strategy_pred"))
        .otherwise(F.col("text"))
    )
    parsed = tx.parse_generated(answer)
    return corpus.labelled_turns(spark, folder).select(
        "conv_id", "turn", parsed["strategy"].alias("strategy"), parsed["response"].alias("response")
    )


QUERIES = {
    "normalize_text": normalize_text,
    "clean_text": clean_text,
    "tokenize_punct": tokenize_punct,
    "tokenize_contractions": tokenize_contractions,
    "tokenize_ws": tokenize_ws,
    "ngrams": ngrams,
    "render_turns": render_turns,
    "typed_predictions": typed_predictions,
    "parse_generation": parse_generation,
}


def _spread(tokens: str) -> str:
    return (
        f"WITH t AS (SELECT doc_id, {tokens} AS l FROM documents) "
        "SELECT doc_id, len(l) AS n, array_to_string(l, ' ') AS tokens FROM t"
    )


def rendered(value: str) -> str:
    """Tagged text as lines, without look-ahead: tags become control characters and are split on."""
    padded = rf"regexp_replace({strip(value)}, '(?i)\[(\s+(?:supporter|seeker)\s*|(?:supporter|seeker)\s+)\]', chr(3) || '\1]', 'g')"
    marked = rf"regexp_replace({padded}, '(?i)\[(supporter|seeker)\]', chr(1) || '\1' || chr(2), 'g')"
    body = "split_part(p, chr(2), 2)"
    bare = strip(rf"regexp_replace({body}, '^\s*(?:\[[^\]]*\]\s*)*', '')")
    line = (
        f"CASE WHEN i < n AND regexp_matches({bare}, '^\\[[^\\]]*$') OR {bare} = '' THEN NULL "
        f"ELSE CASE WHEN lower(split_part(p, chr(2), 1)) = 'supporter' THEN 'Supporter : ' ELSE 'Seeker : ' END || replace({bare}, chr(3), '[') END"
    )
    lines = f"list_filter(list_transform(string_split_regex({strip(value)}, '\\r\\n|[\\n-\\r]'), lambda x: {strip('x')}), lambda x: x <> '')"
    return (
        f"CASE WHEN regexp_matches({value}, '(?i)\\[(supporter|seeker)\\]') THEN "
        f"(SELECT coalesce(string_agg({line}, chr(10) ORDER BY i), '') FROM (SELECT unnest(l[2:]) AS p, unnest(range(1, len(l))) AS i, len(l) - 1 AS n "
        f"FROM (SELECT string_split({marked}, chr(1)) AS l))) "
        f"WHEN regexp_matches({strip(value)}, '(?i)(^|\\n)(supporter|seeker)\\s*:') THEN array_to_string({lines}, chr(10)) "
        f"ELSE {strip(value)} END"
    )


_KIND = "(conv_id + turn) % 8"
_PROB = (
    f"CASE {_KIND} WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' WHEN 4 THEN '-1.0' "
    "WHEN 5 THEN ' ' || prob_ex WHEN 6 THEN NULL ELSE CAST(prob_ex AS varchar) END"
)
_ID = f"CASE {_KIND} WHEN 0 THEN '' WHEN 1 THEN '3.0' WHEN 2 THEN ' 3 ' WHEN 3 THEN NULL ELSE CAST(strategy_pred_id AS varchar) END"
_NAME = (
    f"CASE WHEN {_KIND} < 2 THEN 'qwen3-8b' WHEN {_KIND} < 4 THEN 'Qwen/Qwen3-32B' "
    f"WHEN {_KIND} < 6 THEN ' some/other model ' ELSE 'meta-llama/Meta-Llama-3-8B-Instruct' END"
)
_STAGE = (
    f"CASE {_KIND} WHEN 0 THEN 'Supporting' WHEN 1 THEN ' SU ' WHEN 2 THEN 'support' WHEN 3 THEN 'unknown' "
    "WHEN 4 THEN NULL ELSE upper(stage_pred) END"
)
_SIT = f"CASE WHEN {_KIND} < 2 THEN NULL WHEN {_KIND} < 4 THEN chr(32) || chr(9) || chr(10) ELSE ' ' || chr(10) || text || chr(9) END"


def shown_probability(value: str) -> str:
    number = f"try_cast({value} AS double)"
    return f"CASE WHEN {number} IS NULL OR isnan({number}) OR isinf({number}) THEN '-1.000' ELSE format('{{:.3f}}', {number}) END"


ORACLES = {
    "normalize_text": f"SELECT doc_id, {normal('text')} AS normal, lang FROM documents",
    "clean_text": r"""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\x00-\x08\x0b\x0e-\x1f\x7f]', '', 'g') AS cleaned FROM documents""",
    "tokenize_punct": _spread(punct("text")),
    "tokenize_contractions": _spread(words("text")),
    "tokenize_ws": _spread(r"list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')"),
    "ngrams": f"""
WITH t AS (SELECT {words('text')} AS l FROM conversations WHERE role = 'assistant'),
g AS (SELECT 2 AS n, unnest(list_transform(range(1, len(l)), lambda i: array_to_string(l[i:i+1], ' '))) AS gram FROM t
  UNION ALL SELECT 3, unnest(list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i+2], ' '))) FROM t)
SELECT n, gram, count(*) AS times FROM g GROUP BY n, gram""",
    "render_turns": f"""
WITH {UTT}, r AS (SELECT conv_id, turn_idx, text, context5,
  'Seeker : ' || text || chr(10) || chr(10) || ' Supporter: ' || text AS again FROM ctx)
SELECT conv_id, turn_idx, {rendered('context5')} AS rendered, {rendered('again')} AS relabelled, {rendered('text')} AS untagged FROM r""",
    "typed_predictions": f"""
WITH {LABELLED}, m AS (SELECT conv_id, turn, prob_su, {_PROB} AS prob_raw, {_ID} AS id_raw, {_NAME} AS llm_raw,
  {_STAGE} AS stage_raw, {_SIT} AS situation_raw FROM pred)
SELECT conv_id, turn, {shown_probability('prob_raw')} AS probability, {shown_probability('prob_su')} AS prob_su,
  CASE WHEN regexp_matches(id_raw, '^ *[+-]?[0-9]+ *$') THEN CAST(trim(id_raw) AS bigint) END AS strategy_id,
  coalesce({case('llm_raw', {**{v: k for k, v in GENERATORS.items()}, **{k: k for k in GENERATORS}})}, replace(trim(llm_raw), '/', '_')) AS llm_alias,
  coalesce({case('llm_raw', GENERATORS)}, llm_raw) AS llm_id,
  {case(normal('stage_raw'), STAGE_ALIASES)} AS stage,
  coalesce(nullif({strip("coalesce(situation_raw, '')")}, ''), {quoted(NO_SITUATION)}) AS situation,
  {strip("coalesce(situation_raw, '')")} AS tidied FROM m""",
    "parse_generation": rf"""
WITH {LABELLED}, a AS (SELECT conv_id, turn, {strip('''CASE (conv_id + turn) % 4
    WHEN 0 THEN 'strategy : ' || strategy_pred || chr(10) || ' Response:  ' || text
    WHEN 1 THEN 'RESPONSE: ' || text WHEN 2 THEN 'Here. Strategy:' || strategy_pred ELSE text END''')} AS x FROM pred),
f AS (SELECT *, regexp_matches(x, '(?is)Strategy\s*:\s*(.*?)\s*Response\s*:\s*(.*)') AS whole FROM a)
SELECT conv_id, turn,
  CASE WHEN whole THEN {strip(r"regexp_extract(x, '(?is)Strategy\s*:\s*(.*?)\s*Response\s*:\s*(.*)', 1)")}
       WHEN regexp_matches(x, '(?is)Strategy\s*:') THEN {strip(r"regexp_extract(x, '(?is)Strategy\s*:\s*(.*?)(?:Response|$)', 1)")}
       ELSE 'N/A' END AS strategy,
  CASE WHEN whole THEN {strip(r"regexp_extract(x, '(?is)Strategy\s*:\s*(.*?)\s*Response\s*:\s*(.*)', 2)")}
       WHEN regexp_matches(x, '(?is)Response\s*:') THEN {strip(r"regexp_extract(x, '(?is)Response\s*:\s*(.*)', 1)")}
       ELSE x END AS response FROM f""",
}
