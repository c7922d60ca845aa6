"""Stage choice and prompt assembly."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.numeric import format_probability, parse_float
from parley.functions.text import normalize_text, parse_int, situation_or_default, stage_name
from parley.operators.labels import stage_of
from parley.schema import STAGES, STRATEGIES, lookup

SCORE_NAMES = {name: f"prob_{short}" for _, name, short, _ in STRATEGIES}
# the columns whose largest value scores a stage
STAGE_SCORES = {
    "Exploration": ["prob_ex"],
    "Comforting": ["prob_su", "prob_co"],
    "Action": ["prob_ac"],
    "Others": ["prob_ot"],
}

MEANING = {
    "Question": "ask something that helps the person say more about the problem",
    "Restatement or Paraphrasing": "give back in fewer words what the person said",
    "Reflection of Feelings": "put the person's feelings into words",
    "Self-disclosure": "share a like experience or feeling of your own",
    "Affirmation and Reassurance": "name the person's strengths and give courage",
    "Providing Suggestions": "offer a possible next step without pressing",
    "Information": "give facts, sources or answers that help",
    "Others": "greet, thank, say goodbye or support in another way",
}
AIM = {
    "Exploration": "find out what the problem is",
    "Comforting": "show that the person is understood",
    "Action": "help to solve the problem",
    "Others": "keep up a friendly exchange",
}
ANSWER_HEADING = "# Answer form"
ANSWER_WITH_STRATEGY = "Strategy: <one name from the list>\nResponse: <one short reply>"
ANSWER_ONLY = "Response: <one short reply>"


def _strategy_list(names: list[str]) -> str:
    return "\n".join(f"- {name}: {MEANING[name]}." for name in names)


def _score_list(names: list[str]) -> str:
    return "\n".join(f"- {name}: {{{SCORE_NAMES[name]}}}" for name in names)


def _template(aim: str, names: list[str], scored: bool) -> str:
    parts = ["You are the supporter in a talk with a person in need. Write your next reply.", aim]
    parts.append(f"\n# Strategies\n{_strategy_list(names)}")
    if scored:
        hint = "Scores a classifier gave after the last turn; -1.000 means not scored. Take them as hints."
        parts.append(f"\n# Scores\n{hint}\n{_score_list(names)}")
    parts.append(f"\n{ANSWER_HEADING}\n{ANSWER_WITH_STRATEGY if scored else ANSWER_ONLY}")
    parts.append("\n# Situation\n{situation}\n\n# Talk so far\n{input_dialog}")
    return "\n".join(parts)


def templates() -> dict[str, str]:
    """The prompt of every stage, and the flat one that offers all strategies at once."""
    everything = [name for _, name, _, _ in STRATEGIES]
    staged = {
        stage: _template(
            f"The talk is in the stage {stage}: {AIM[stage]}.",
            everything if stage == "Others" else [name for _, name, _, s in STRATEGIES if s == stage],
            scored=stage != "Others",
        )
        for stage in STAGES
    }
    return {**staged, "flat": _template("Choose the strategy that suits the talk.", everything, True)}


def strategy_scores() -> Column:
    """The eight strategy scores as an array of texts; Others only has its stage score."""
    return F.transform(F.array(*[F.col(c).cast("string") for c in SCORE_NAMES.values()]), format_probability)


def resolve_stage(allow_truth: bool = True) -> Column:
    """The stage a prompt is built for; the first source that yields one wins.

    In order: the predicted stage, the true stage (unless switched off), the strategy's name, the
    strategy's id, and the stage with the highest score, where the earlier stage wins ties.
    """
    names = {name.lower(): stage for _, name, _, stage in STRATEGIES}

    def score(stage: str) -> Column:
        values = [F.coalesce(parse_float(F.col(c)), F.lit(-1.0)) for c in STAGE_SCORES[stage]]
        best = values[0]
        for value in values[1:]:
            best = F.when(~F.isnan(value) & (value > best), value).otherwise(best)
        # NaN is never exceeded when it comes first and never exceeds another one later
        return F.when(F.isnan(best), float("inf" if stage == STAGES[0] else "-inf")).otherwise(best)

    ranked = F.array(*[F.struct(score(s), F.lit(-i), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    sources = [stage_name(F.col("stage_pred"))]
    if allow_truth:
        sources.append(stage_name(F.col("stage_true")))
    sources += [
        F.try_element_at(lookup(names), normalize_text(F.col("strategy_pred"))),
        stage_of(parse_int(F.col("strategy_pred_id")).try_cast("int")),
        F.array_max(ranked)["stage"],
        F.lit("Others"),
    ]
    return F.coalesce(*sources)


def _fill(template: str, slots: dict[str, Column]) -> Column:
    """Put columns into a template; texts are joined, so slot marks inside a text stay as they are."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.lit(p) if i % 2 == 0 else slots[p] for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*parts)


def prompt(mode: str = "staged", stage: str = "stage") -> Column:
    """The prompt of a row with ``stage, situation, input_dialog`` and ``scores`` as text."""
    slots = {column: F.get("scores", F.lit(i)) for i, column in enumerate(SCORE_NAMES.values())}
    slots["situation"] = situation_or_default(F.col("situation"))
    slots["input_dialog"] = F.coalesce("input_dialog", F.lit(""))
    texts = templates()
    if mode == "flat":
        return _fill(texts["flat"], slots)
    if mode != "staged":
        raise ValueError(f"unknown prompt mode: {mode}")
    filled = F.when(F.col(stage) == STAGES[0], _fill(texts[STAGES[0]], slots))
    for name in STAGES[1:]:
        filled = filled.when(F.col(stage) == name, _fill(texts[name], slots))
    return filled
