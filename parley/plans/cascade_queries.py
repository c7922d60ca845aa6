"""Cascade queries: over the numbers in ``embeddings`` as logits, and over trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.numeric import argmax, round_exact
from parley.operators import cascade
from parley.operators.classmetrics import class_f1, class_table, split_scores, strategy_metrics
from parley.operators.context import evaluation_examples
from parley.operators.positions import CELL
from parley.operators.training import fit_best, module_input, score_text, scorers, train_modules
from parley.plans import corpus
from parley.plans.corpus_sql import LABELLED, NAMES, PREDICTIONS, STAGE_IDS, STAGE_OF, case, strip
from parley.schema import ENCODERS, MODULES, PREDICTION_FIELDS, STAGE_PROBS, STAGES, STRATEGY_PROBS
from parley.session import durable

# every element of an embedding counts in one of twelve logits, by its place modulo twelve
PLACES = 12
# which logits (from 1) belong to a module
LOGITS = dict(zip([name for name, *_ in MODULES], [(1, 2), (3, 5), (6, 7), (8, 10), (11, 12)]))
# sizes of the modules in millions of parameters
SIZES = dict(zip(LOGITS, [66.4, 66.4, 66.4, 66.4, 66.4]))


def _logit(place: int) -> Column:
    """The sum of the elements whose place, from 0, leaves ``place`` modulo twelve."""
    mine = F.filter("embedding", lambda x, i: i % PLACES == place)
    return F.aggregate(mine, F.lit(0.0), lambda total, x: total + x.cast("double"))


def _with_logits(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.embeddings(spark, folder).select(
        "vec_id",
        (F.col("label") % 8).alias("strategy_true_id"),
        F.array(*[_logit(place) for place in range(PLACES)]).alias("logits"),
    )


def _logits(first: int, last: int) -> Column:
    return F.slice("logits", first, last - first + 1)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_logits(spark, folder)
    return cascade.with_probabilities(rows, {m: _logits(*ends) for m, ends in LOGITS.items()})


def softmax_argmax(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder)
    columns = []
    for place, module in enumerate(LOGITS):
        columns.append(argmax(F.col(module)).alias(f"best_{place}"))
        columns.append(F.round(F.array_max(module), 6).alias(f"top_{place}"))
    return rows.select("vec_id", *columns)


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.predict(_scored(spark, folder), keep=("vec_id",))


def cascade_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder).drop("context", "label_context")


def cascade_by_route(spark: SparkSession, folder: str) -> DataFrame:
    """The same predictions, each module run only on the rows that reach it."""
    rows = _with_logits(spark, folder)
    score = {
        m: (lambda df, m=m, ends=ends: cascade.with_probabilities(df, {m: _logits(*ends)}))
        for m, ends in LOGITS.items()
    }
    scored = cascade.score_by_route(rows, score)
    return cascade.predict(scored, keep=("vec_id",)).drop("context", "label_context")


def stage_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.stage_rows(_predictions(spark, folder), keep=("vec_id",)).drop("context")


def cascade_cost(spark: SparkSession, folder: str) -> DataFrame:
    costs = cascade.cost(_predictions(spark, folder), SIZES)
    return costs.select(*[F.round(c, 6).alias(c) for c in costs.columns])


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.labelled_turns(spark, folder).withColumn("classifier", corpus.classifier_name())
    scores = class_f1(rows, "strategy_true", "strategy_pred", ["classifier"])
    return scores.select("classifier", *[F.round(c, 6).alias(c) for c in ("macro_f1", "weighted_f1", "accuracy")], "rows")


def stage_prf(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.labelled_turns(spark, folder).withColumn("classifier", corpus.classifier_name())
    table = class_table(rows, "stage_true", "stage_pred", STAGES, ["classifier"])
    return table.select(F.lit(5).alias("turn"), F.col("classifier").alias("encoder"), "class", "precision", "recall", "f1")


def scores_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Macro F1 and log loss of the first identifier per split, with embeddings split by id."""
    rows = _scored(spark, folder).select(
        corpus.split_name("vec_id").alias("split"),
        F.when(F.col("strategy_true_id") < 2, 0).otherwise(1).alias("label"),
        F.col(cascade.FIRST).alias("probs"),
    )
    scores = split_scores(rows, "label", "probs", ["split"]).drop("unscored")
    return scores.select("split", F.round("macro_f1", 6).alias("macro_f1"), F.round("loss", 6).alias("loss"), "rows")


def metrics_row(spark: SparkSession, folder: str) -> DataFrame:
    scores = class_f1(_predictions(spark, folder), "strategy_true", "strategy_pred")
    return strategy_metrics(scores, sum(SIZES.values()), 5, list(ENCODERS)[0])


def train_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Train all modules on the train split, choose on validation, predict the test split."""
    turns = durable(corpus.utterances(spark, folder))
    models = {name: model for name, (model, _) in train_modules(turns).items()}
    test = (
        evaluation_examples(turns)
        .filter("split = 'test'")
        .select("conv_id", "turn_idx", "context", "current_turn", "label_context", "strategy_true_id")
    )
    scored = cascade.score_by_route(test, scorers(models))
    return cascade.predict(scored, keep=("conv_id", "turn_idx"))


def train_cascade_report(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out quality and cost of the trained cascade."""
    return cascade.report(train_cascade(spark, folder), SIZES)


def cascade_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same report by split for the cascade over the embeddings."""
    rows = _predictions(spark, folder).withColumn("split", corpus.split_name("vec_id"))
    found = cascade.report(rows, SIZES, ("split",))
    numbers = ("accuracy", "macro_f1", "weighted_f1", "total_params", "active_params", "sparsity")
    return found.select("split", "level", "rows", *[F.round(c, 6).alias(c) for c in numbers])


def _by_length(text: str, place: int, classes: int) -> Column:
    """Fixed scores of a text that follow from its length."""
    weights = [(F.length(text) * (31 + 7 * place) + 17 * i) % 97 + 1 for i in range(classes)]
    total = sum(weights[1:], weights[0])
    return F.array(*[(w / total).cast("double") for w in weights])


def cascade_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """What each module reads: the predictor of one turn the current turn, all others the full context."""
    rows = evaluation_examples(corpus.utterances(spark, folder, CELL)).select(
        "conv_id", "turn_idx", "context", "current_turn", "strategy_true_id"
    )
    score = {
        name: (lambda df, name=name, place=place, n=len(labels): df.withColumn(name, _by_length(module_input(name), place, n)))
        for place, (name, labels, *_) in enumerate(MODULES)
    }
    found = cascade.predict(cascade.score_by_route(rows, score), keep=("conv_id", "turn_idx"))
    return found.select("conv_id", "turn_idx", "strategy_pred_id", "stage_pred", *STAGE_PROBS, *STRATEGY_PROBS)


def train_language_identifier(spark: SparkSession, folder: str) -> DataFrame:
    """A classifier that can be learnt from the given data: English against the rest, by document."""
    rows = durable(
        corpus.documents(spark, folder).select(
            "doc_id",
            corpus.split_name("doc_id").alias("split"),
            F.col("text").alias("context"),
            F.when(F.col("lang") == "en", 0).otherwise(1).alias("label"),
        )
    )
    model, _ = fit_best(rows.filter("split = 'train'"), rows.filter("split = 'validation'"))
    scored = score_text(model, rows.filter("split = 'test'"), "probs")
    return scored.select(
        "doc_id", "label", argmax(F.col("probs")).alias("pred"), round_exact(F.array_max("probs"), 4).alias("confidence")
    )


QUERIES = {
    "softmax_argmax": softmax_argmax,
    "cascade_predictions": cascade_predictions,
    "cascade_by_route": cascade_by_route,
    "stage_predictions": stage_predictions,
    "cascade_cost": cascade_cost,
    "class_f1": class_scores,
    "stage_prf": stage_prf,
    "split_scores": scores_by_split,
    "strategy_metrics": metrics_row,
    "cascade_report": cascade_report,
    "cascade_inputs": cascade_inputs,
    "train_cascade": train_cascade,
    "train_cascade_report": train_cascade_report,
    "train_language_identifier": train_language_identifier,
}

_NAMES = ["id0", "id1", "ex", "co", "ac"]


def _softmax(first: int, last: int) -> str:
    part = f"logits[{first}:{last}]"
    shifted = f"list_transform({part}, lambda x: exp(x - list_max({part})))"
    return f"list_transform({shifted}, lambda x: x / list_sum({shifted}))"


def _sum(place: int) -> str:
    mine = f"list_filter(embedding, lambda x, i: (i - 1) % {PLACES} = {place})"
    return f"list_sum(list_transform({mine}, lambda x: CAST(x AS double)))"


_SUMS = ", ".join(_sum(place) for place in range(PLACES))
_PROBS = f"""sums AS (SELECT vec_id, label % 8 AS strategy_true_id, [{_SUMS}] AS logits FROM embeddings),
probs AS (SELECT vec_id, strategy_true_id, """ + ", ".join(
    f"{_softmax(*ends)} AS {name}" for name, ends in zip(_NAMES, LOGITS.values())
) + " FROM sums)"
_BEST = ", ".join(f"list_position({n}, list_max({n})) - 1 AS b_{n}" for n in _NAMES)
_CASCADE = f"""{_PROBS}, bests AS (SELECT *, {_BEST} FROM probs),
routed AS (SELECT *, CAST(CASE WHEN b_id0 = 0 THEN b_ex WHEN b_id1 = 0 THEN b_co + 2 WHEN b_id1 = 1 THEN b_ac + 5 ELSE 7 END AS int)
  AS strategy_pred_id FROM bests),
stages AS (SELECT *, {case('strategy_pred_id', STAGE_OF)} AS stage_pred, {case('strategy_true_id', STAGE_OF)} AS stage_true FROM routed),
casc AS (SELECT vec_id, {case('stage_pred', STAGE_IDS)} AS stage_pred_id, {case('stage_true', STAGE_IDS)} AS stage_true_id,
  stage_pred, stage_true, strategy_pred_id, strategy_true_id,
  {case('strategy_pred_id', NAMES)} AS strategy_pred, {case('strategy_true_id', NAMES)} AS strategy_true,
  round(id0[1], 4) AS prob_ex, round(id0[2], 4) AS prob_su,
  {", ".join(f"CASE WHEN b_id0 <> 0 THEN round(id1[{i}], 4) ELSE -1.0 END AS prob_{s}" for i, s in ((1, 'co'), (2, 'ac'), (3, 'ot')))},
  {", ".join(f"CASE WHEN b_id0 = 0 THEN round(ex[{i}], 4) ELSE -1.0 END AS prob_{s}" for i, s in ((1, 'qu'), (2, 'rp')))},
  {", ".join(f"CASE WHEN b_id0 <> 0 AND b_id1 = 0 THEN round(co[{i}], 4) ELSE -1.0 END AS prob_{s}" for i, s in ((1, 'rf'), (2, 'sd'), (3, 'ar')))},
  {", ".join(f"CASE WHEN b_id0 <> 0 AND b_id1 = 1 THEN round(ac[{i}], 4) ELSE -1.0 END AS prob_{s}" for i, s in ((1, 'ps'), (2, 'in')))}
  FROM stages)"""
_SPLIT = "CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'validation' ELSE 'test' END"
# probabilities of the modules on the route, as in the cascade above
_PROBS_OF = _CASCADE[_CASCADE.index("  round(id0[1], 4) AS prob_ex") : _CASCADE.index("  FROM stages)")].replace("round(", "round_even(")


def _weights(place: int, classes: int, length: str) -> str:
    parts = [f"(({length} * {31 + 7 * place} + {17 * i}) % 97 + 1)" for i in range(classes)]
    return "[" + ", ".join(f"CAST({p} AS double) / ({' + '.join(parts)})" for p in parts) + "]"



def f1_sql(source: str, by: str, true: str, pred: str) -> str:
    """CTEs ``f1s`` with macro and weighted F1 and accuracy per group."""
    return f"""
domain AS (SELECT {by}, {true} AS label FROM {source} UNION SELECT {by}, {pred} FROM {source}),
per_label AS (SELECT d.{by}, d.label, count_if(s.{true} = d.label AND s.{pred} = d.label) AS tp,
    count_if(s.{pred} = d.label) AS chosen, count_if(s.{true} = d.label) AS support
  FROM domain d JOIN {source} s ON d.{by} = s.{by} GROUP BY ALL),
f1s AS (SELECT {by}, avg(2.0 * tp / (chosen + support)) AS macro_f1,
    sum(2.0 * tp / (chosen + support) * support) / sum(support) AS weighted_f1,
    CAST(sum(tp) AS double) / sum(support) AS accuracy, CAST(sum(support) AS bigint) AS rows FROM per_label GROUP BY {by})"""


_A, _B, _C, _D, _E = SIZES.values()
_ACTIVE = f"CASE stage_pred WHEN 'Exploration' THEN {_A} + {_C} WHEN 'Comforting' THEN {_A} + {_B} + {_D} WHEN 'Action' THEN {_A} + {_B} + {_E} ELSE {_A} + {_B} END"
_STAGE_LIST = ", ".join(f"('{s}')" for s in STAGES)

_FIELDS = ", ".join(["vec_id", *[f for f in PREDICTION_FIELDS if f not in ("context", "label_context")]])

ORACLES = {
    "softmax_argmax": f"WITH {_PROBS} SELECT vec_id, "
    + ", ".join(
        f"list_position({n}, list_max({n})) - 1 AS best_{i}, round(list_max({n}), 6) AS top_{i}" for i, n in enumerate(_NAMES)
    )
    + " FROM probs",
    "cascade_predictions": f"WITH {_CASCADE} SELECT {_FIELDS} FROM casc",
    "cascade_by_route": f"WITH {_CASCADE} SELECT {_FIELDS} FROM casc",
    "stage_predictions": f"""WITH {_CASCADE} SELECT vec_id, stage_pred_id AS y_pred, stage_true_id AS y_true,
  CASE WHEN stage_pred = 'Exploration' THEN prob_ex ELSE -1.0 END AS prob_ex, prob_co, prob_ac, prob_ot FROM casc""",
    "cascade_report": f"""
WITH {_CASCADE}, u AS (
  SELECT {_SPLIT} || '/stage' AS g, stage_true AS t, stage_pred AS p, CASE WHEN stage_pred = 'Exploration' THEN {_A} ELSE {_A + _B} END AS active FROM casc
  UNION ALL SELECT {_SPLIT} || '/strategy', strategy_true, strategy_pred, {_ACTIVE} FROM casc),
{f1_sql('u', 'g', 't', 'p')}, costs AS (SELECT g, avg(CAST(active AS double)) AS active,
  CASE WHEN g LIKE '%/stage' THEN {_A + _B} ELSE {sum(SIZES.values())} END AS total FROM u GROUP BY g)
SELECT split_part(g, '/', 1) AS split, split_part(g, '/', 2) AS level, rows, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
  round(weighted_f1, 6) AS weighted_f1, total AS total_params, round(active, 6) AS active_params,
  round((1 - active / total) * 100, 6) AS sparsity FROM f1s JOIN costs USING (g)""",
    "cascade_inputs": f"""
WITH {PREDICTIONS}, read AS (SELECT conv_id, turn_idx, length(context) AS lc, length({strip('context1')}) AS lt FROM examples JOIN
  (SELECT conv_id, turn_idx, context1 FROM ctx) USING (conv_id, turn_idx)),
s AS (SELECT conv_id, turn_idx, {", ".join(_weights(place, len(labels), 'lt' if turns == 1 else 'lc') + f" AS {n}" for place, (n, (_, labels, _, _, turns)) in enumerate(zip(_NAMES, MODULES)))} FROM read),
b AS (SELECT *, {_BEST} FROM s),
r AS (SELECT *, CAST(CASE WHEN b_id0 = 0 THEN b_ex WHEN b_id1 = 0 THEN b_co + 2 WHEN b_id1 = 1 THEN b_ac + 5 ELSE 7 END AS int) AS strategy_pred_id FROM b)
SELECT conv_id, turn_idx, strategy_pred_id, {case('strategy_pred_id', STAGE_OF)} AS stage_pred, {_PROBS_OF} FROM r""",
    "cascade_cost": f"""WITH {_CASCADE}, c AS (SELECT CAST({_ACTIVE} AS double) AS active,
    CAST(CASE WHEN stage_pred = 'Exploration' THEN {_A} ELSE {_A + _B} END AS double) AS stage_active FROM casc)
SELECT {sum(SIZES.values())} AS total_params, round(avg(active), 6) AS active_params,
  round((1 - avg(active) / {sum(SIZES.values())}) * 100, 6) AS sparsity, {_A + _B} AS stage_total_params,
  round(avg(stage_active), 6) AS stage_active_params FROM c""",
    "class_f1": f"""WITH {LABELLED}, {f1_sql('pred', 'classifier', 'strategy_true', 'strategy_pred')}
SELECT classifier, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(accuracy, 6) AS accuracy, rows FROM f1s""",
    "stage_prf": f"""
WITH {LABELLED}, l(class) AS (VALUES {_STAGE_LIST}),
c AS (SELECT p.classifier AS encoder, class, count_if(stage_true = class AND stage_pred = class) AS tp,
    count_if(stage_pred = class) AS chosen, count_if(stage_true = class) AS support
  FROM l, pred p GROUP BY ALL)
SELECT 5 AS turn, encoder, class, CASE WHEN chosen > 0 THEN round_even(tp / chosen, 4) ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN round_even(tp / support, 4) ELSE 0 END AS recall,
  CASE WHEN chosen + support > 0 THEN round_even(2 * tp / (chosen + support), 4) ELSE 0 END AS f1 FROM c""",
    "split_scores": f"""
WITH {_PROBS}, r AS (SELECT CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN strategy_true_id < 2 THEN 0 ELSE 1 END AS label, id0, list_position(id0, list_max(id0)) - 1 AS best FROM probs),
{f1_sql('r', 'split', 'label', 'best')}, losses AS (SELECT split, avg(-ln(id0[label + 1])) AS loss FROM r GROUP BY split)
SELECT split, round(macro_f1, 6) AS macro_f1, round(loss, 6) AS loss, rows FROM f1s JOIN losses USING (split)""",
    "strategy_metrics": f"""
WITH {_CASCADE}, one AS (SELECT 1 AS g, * FROM casc), {f1_sql('one', 'g', 'strategy_true', 'strategy_pred')}
SELECT 5 AS turn, 'distilbert' AS encoder, round_even(macro_f1, 4) AS m_f1, round_even(weighted_f1, 4) AS w_f1, round_even(accuracy, 4) AS acc,
  {round(sum(SIZES.values()), 2)} AS "total_params_M" FROM f1s""",
}
