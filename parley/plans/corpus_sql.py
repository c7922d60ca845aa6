"""The derivations of ``corpus`` as SQL, to check results with another engine."""

from __future__ import annotations

from parley.schema import RAW_STRATEGY_SPELLING, STAGES, STRATEGIES


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def case(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k if isinstance(k, int) else text(k)} THEN {v if isinstance(v, int) else text(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


RAW_NAMES = {i: RAW_STRATEGY_SPELLING.get(i, name) for i, name, _, _ in STRATEGIES}
NAMES = {i: name for i, name, _, _ in STRATEGIES}
STAGE_OF = {i: stage for i, _, _, stage in STRATEGIES}
STAGE_IDS = {stage: i for i, stage in enumerate(STAGES)}
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def normal(value: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({value}, '')), '{SPACES}+', ' ', 'g'))"


def punct(value: str) -> str:
    return rf"regexp_extract_all(lower({value}), '[\p{{L}}\p{{N}}_'']+|[.,!?;]')"


def words(value: str) -> str:
    """Punctuation tokens with contractions cut."""
    out = f"' ' || array_to_string({punct(value)}, '  ') || ' '"
    steps = [
        (r"([^'' ])(''s|''m|''d|''ll|''re|''ve|n''t|'') ", r"\1 \2 "),
        (r" (can)(not) ", r" \1 \2 "),
        (r" (d)(''ye) ", r" \1 \2 "),
        (r" (gim|lem)(me) ", r" \1 \2 "),
        (r" (gon|wan)(na) ", r" \1 \2 "),
        (r" (got)(ta) ", r" \1 \2 "),
        (r" (more)(''n) ", r" \1 \2 "),
        (r" (''t)(is|was) ", r" \1 \2 "),
    ]
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({out}, ' +'), lambda t: t <> '')"


TRUE_ID = """CASE WHEN s <= 4 THEN 0 WHEN s = 5 THEN 1 WHEN s = 6 THEN 2 WHEN s = 7 THEN 3
     WHEN s <= 9 THEN 4 WHEN s <= 11 THEN 5 WHEN s = 12 THEN 6 ELSE 7 END"""
SPLIT = """CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'validation' ELSE 'test' END"""

# utterances with their labels
UTT = f"""
numbered AS (
  SELECT conv_id, turn, text, (conv_id * 7 + turn * 3) % 16 AS s,
         CASE role WHEN 'assistant' THEN 'sys' ELSE 'usr' END AS speaker,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_idx
  FROM conversations WHERE role <> 'system'),
situations AS (SELECT conv_id, max(text) AS situation FROM conversations WHERE role = 'system' GROUP BY conv_id),
utt AS (
  SELECT n.conv_id, turn, turn_idx, speaker, text, situation, {SPLIT.replace('conv_id', 'n.conv_id')} AS split,
         CASE WHEN speaker = 'sys' THEN {TRUE_ID} END AS strategy_true_id,
         CASE WHEN speaker = 'sys' THEN {case(f'({TRUE_ID})', RAW_NAMES)} END AS strategy
  FROM numbered n LEFT JOIN situations USING (conv_id)),
tagged AS (
  SELECT *, CASE WHEN speaker = 'sys' THEN '[supporter] [' || strategy || '] ' || text
                 ELSE '[seeker] ' || text END AS said
  FROM utt),
recent AS (
  SELECT *, list(said) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before
  FROM tagged),
ctx AS (
  SELECT *, CASE WHEN turn_idx = 0 THEN '<START>' ELSE array_to_string(before, ' ') END AS context5,
         CASE WHEN turn_idx = 0 THEN '<START>' ELSE before[-1] END AS context1
  FROM recent WHERE speaker = 'sys')"""

# labels and probabilities of supporter turns; needs a relation `turns` with strategy_true_id


def _share(j: int, of: list[int]) -> str:
    w = "((conv_id * 31 + turn * 17 + {} * 13) % 97 + 1)"
    total = "(" + " + ".join(w.format(i) for i in of) + ")"
    return f"(({w.format(j)} * 20000 + {total}) // (2 * {total})) / 10000.0"


def _on(condition: str, j: int, of: list[int]) -> str:
    return f"CAST(CASE WHEN {condition} THEN {_share(j, of)} ELSE -1.0 END AS double)"


def predicted(source: str, extra: str = "*") -> str:
    """CTE ``pred`` over a source with conv_id, turn and strategy_true_id."""
    beyond = "stage_pred <> 'Exploration'"
    return f"""
guessed AS (
  SELECT *, CAST(CASE WHEN (conv_id * 5 + turn * 11) % 10 < 6 THEN strategy_true_id
       ELSE (strategy_true_id + 1 + (conv_id + turn) % 7) % 8 END AS int) AS strategy_pred_id FROM {source}),
staged AS (
  SELECT *, {case('strategy_pred_id', STAGE_OF)} AS stage_pred, {case('strategy_true_id', STAGE_OF)} AS stage_true,
         {case('strategy_pred_id', NAMES)} AS strategy_pred, {case('strategy_true_id', NAMES)} AS strategy_true
  FROM guessed),
pred AS (
  SELECT {extra}, {case('stage_pred', STAGE_IDS)} AS stage_pred_id, {case('stage_true', STAGE_IDS)} AS stage_true_id,
         CAST({_share(8, [8, 9])} AS double) AS prob_ex, CAST({_share(9, [8, 9])} AS double) AS prob_su,
         {_on(beyond, 10, [10, 11, 12])} AS prob_co, {_on(beyond, 11, [10, 11, 12])} AS prob_ac,
         {_on(beyond, 12, [10, 11, 12])} AS prob_ot,
         {_on("stage_pred = 'Exploration'", 0, [0, 1])} AS prob_qu, {_on("stage_pred = 'Exploration'", 1, [0, 1])} AS prob_rp,
         {_on("stage_pred = 'Comforting'", 2, [2, 3, 4])} AS prob_rf, {_on("stage_pred = 'Comforting'", 3, [2, 3, 4])} AS prob_sd,
         {_on("stage_pred = 'Comforting'", 4, [2, 3, 4])} AS prob_ar,
         {_on("stage_pred = 'Action'", 5, [5, 6])} AS prob_ps, {_on("stage_pred = 'Action'", 6, [5, 6])} AS prob_in,
         'c' || (turn % 2) AS classifier
  FROM staged)"""


LABELLED = f"""
supporter AS (SELECT *, (conv_id * 7 + turn * 3) % 16 AS s FROM conversations WHERE role = 'assistant'),
turns AS (SELECT conv_id, turn, text, {SPLIT} AS split, {TRUE_ID} AS strategy_true_id FROM supporter),
{predicted('turns')}"""

PREDICTIONS = UTT + f""",
examples AS (
  SELECT conv_id, turn, turn_idx, strategy_true_id, split, text AS label_context, {strip('context5')} AS context
  FROM ctx),
{predicted('examples')}"""

PAIRS = """
replies AS (
  SELECT conv_id, turn, text AS reference_response,
         lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS llm_parsed_response
  FROM conversations WHERE role = 'assistant'),
pairs AS (
  SELECT *, 'm' || (conv_id % 3) AS llm_alias, 'c' || (turn % 2) AS classifier
  FROM replies WHERE llm_parsed_response IS NOT NULL)"""
