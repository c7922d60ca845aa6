"""Routing rows through the stage identifiers and strategy predictors.

Every module contributes an array column of class probabilities. The first identifier tells
Exploration from the rest, the second splits the rest, and each of the first three stages has a
predictor for its strategies; the fourth stage is a strategy itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.numeric import argmax, round_exact, softmax
from parley.operators.classmetrics import join_groups, label_scores
from parley.operators.labels import stage_id, stage_of, strategy_name
from parley.schema import MODULES, PREDICTION_FIELDS, STAGE_PROBS, STRATEGY_PROBS
from parley.session import durable

FIRST, SECOND, EXPLORE, COMFORT, ACT = [name for name, *_ in MODULES]
# strategy ids start here for each predictor
OFFSETS = {EXPLORE: 0, COMFORT: 2, ACT: 5}
SKIPPED = -1.0


def with_probabilities(df: DataFrame, logits: Mapping[str, Column]) -> DataFrame:
    """Softmax of the logits of every module, in one array column per module."""
    return df.withColumns({module: softmax(values) for module, values in logits.items()})


def _routes() -> dict[str, Column]:
    """When each module is consulted."""
    rest = argmax(F.col(FIRST)) != 0
    return {
        FIRST: F.lit(True),
        SECOND: rest,
        EXPLORE: ~rest,
        COMFORT: rest & (argmax(F.col(SECOND)) == 0),
        ACT: rest & (argmax(F.col(SECOND)) == 1),
    }


def predicted_strategy() -> Column:
    routes = _routes()
    chosen = F.lit(7)
    for module, offset in OFFSETS.items():
        chosen = F.when(routes[module], argmax(F.col(module)) + offset).otherwise(chosen)
    return chosen.cast("int")


def _probability(module: str, place: int) -> Column:
    value = round_exact(F.try_element_at(F.col(module), F.lit(place + 1)), 4)
    return F.when(_routes()[module], value).otherwise(SKIPPED)


def predict(df: DataFrame, true_id: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The wide prediction row: chosen and true stage and strategy, and every probability.

    Probabilities of modules off the route read -1. Arrays of modules off the route may be NULL,
    so rows scored branch by branch and rows scored by all modules are treated alike.
    """
    true_id = F.col("strategy_true_id") if true_id is None else true_id
    ids = df.withColumn("_pred", predicted_strategy()).withColumn("_true", true_id.cast("int"))
    columns = {
        "context": F.col("context") if "context" in df.columns else F.lit(""),
        "label_context": F.col("label_context") if "label_context" in df.columns else F.lit(""),
        "stage_pred_id": stage_id(stage_of(F.col("_pred"))),
        "stage_true_id": stage_id(stage_of(F.col("_true"))),
        "stage_pred": stage_of(F.col("_pred")),
        "stage_true": stage_of(F.col("_true")),
        "strategy_pred_id": F.col("_pred"),
        "strategy_true_id": F.col("_true"),
        "strategy_pred": strategy_name(F.col("_pred")),
        "strategy_true": strategy_name(F.col("_true")),
    }
    sources = [(FIRST, 0), (FIRST, 1), (SECOND, 0), (SECOND, 1), (SECOND, 2)]
    columns.update(zip(STAGE_PROBS, [_probability(m, i) for m, i in sources]))
    sources = [(EXPLORE, 0), (EXPLORE, 1), (COMFORT, 0), (COMFORT, 1), (COMFORT, 2), (ACT, 0), (ACT, 1)]
    columns.update(zip(STRATEGY_PROBS, [_probability(m, i) for m, i in sources]))
    return ids.select(*keep, *[columns[name].alias(name) for name in PREDICTION_FIELDS])


def stage_rows(predictions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The stage view of predictions; Exploration's probability only counts on its own route."""
    on_route = F.col("stage_pred") == "Exploration"
    return predictions.select(
        *keep,
        "context",
        F.col("stage_pred_id").alias("y_pred"),
        F.col("stage_true_id").alias("y_true"),
        F.when(on_route, F.col("prob_ex")).otherwise(SKIPPED).alias("prob_ex"),
        "prob_co",
        "prob_ac",
        "prob_ot",
    )


def score_by_route(
    df: DataFrame, score: Mapping[str, Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Run each module on the rows that reach it, as ``score[module](rows)``.

    Every scorer adds the probability column of its module. What the identifiers give is stored,
    as several branches read it: each model then runs once, and only on the rows routed to it.
    """
    first = durable(score[FIRST](df))
    unset = {m: F.lit(None).cast("array<double>") for m in (SECOND, *OFFSETS)}
    explore = first.filter(_routes()[EXPLORE])
    rest = durable(score[SECOND](first.filter(_routes()[SECOND])))
    branches = [
        (score[EXPLORE](explore), [SECOND, COMFORT, ACT]),
        (score[COMFORT](rest.filter(_routes()[COMFORT])), [EXPLORE, ACT]),
        (score[ACT](rest.filter(_routes()[ACT])), [EXPLORE, COMFORT]),
        (rest.filter(argmax(F.col(SECOND)) == 2), [EXPLORE, COMFORT, ACT]),
    ]
    columns = [*df.columns, FIRST, SECOND, *OFFSETS]
    parts = [part.withColumns({m: unset[m] for m in missing}).select(*columns) for part, missing in branches]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _active(sizes: Mapping[str, float], stage: Column, modules: tuple[str, ...]) -> Column:
    """Size of those of ``modules`` that a row with this predicted stage consults."""
    consulted = {
        FIRST: F.lit(True),
        SECOND: stage != "Exploration",
        EXPLORE: stage == "Exploration",
        COMFORT: stage == "Comforting",
        ACT: stage == "Action",
    }
    total = F.lit(0.0)
    for module in modules:
        total = total + F.when(consulted[module], float(sizes[module])).otherwise(0.0)
    return total


def report(predictions: DataFrame, sizes: Mapping[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """How well stages and strategies are told, and at what cost: one row per group and level.

    Columns: level (``stage``, ``strategy``), rows, accuracy, macro_f1, weighted_f1, total_params, active_params,
    sparsity. Predictions are read once and counted by (group, level, true, predicted, route) before anything
    moves; all later steps work on these counts. Groups may be NULL.
    """
    keep = [*by, "level"]
    levels = F.array(
        *[
            F.struct(F.lit(x).alias("level"), F.col(f"{x}_true").alias("t"), F.col(f"{x}_pred").alias("p"))
            for x in ("stage", "strategy")
        ]
    )
    counted = (
        predictions.select(*by, F.col("stage_pred").alias("route"), F.explode(levels).alias("l"))
        .groupBy(*by, F.col("l.level").alias("level"), F.col("l.t").alias("true_label"), F.col("l.p").alias("pred_label"), "route")
        .agg(F.count("*").alias("n"))
    )
    pairs = counted.groupBy(*keep, "true_label", "pred_label").agg(F.sum("n").alias("n"))
    scores = label_scores(pairs, keep).groupBy(*keep).agg(
        F.sum("support").alias("rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
    every = tuple(sizes)
    of_level = F.when(F.col("level") == "stage", _active(sizes, F.col("route"), (FIRST, SECOND))).otherwise(
        _active(sizes, F.col("route"), every)
    )
    total = F.when(F.col("level") == "stage", float(sizes[FIRST] + sizes[SECOND])).otherwise(float(sum(sizes.values())))
    costs = counted.groupBy(*keep).agg(
        F.max(total).alias("total_params"), (F.sum(of_level * F.col("n")) / F.sum("n")).alias("active_params")
    )
    columns = [*scores.columns, "total_params", "active_params"]
    return join_groups(scores, costs, keep).select(
        *columns, ((1 - F.col("active_params") / F.col("total_params")) * 100).alias("sparsity")
    )


def cost(predictions: DataFrame, sizes: Mapping[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean size of the modules a row consults, against the size of all of them."""
    stage = F.col("stage_pred")
    consulted = {
        SECOND: stage != "Exploration",
        EXPLORE: stage == "Exploration",
        COMFORT: stage == "Comforting",
        ACT: stage == "Action",
    }
    active = F.lit(float(sizes[FIRST]))
    for module, used in consulted.items():
        active = active + F.when(used, float(sizes[module])).otherwise(0.0)
    stage_active = F.lit(float(sizes[FIRST])) + F.when(consulted[SECOND], float(sizes[SECOND])).otherwise(0.0)
    total = float(sum(sizes.values()))
    return predictions.groupBy(*by).agg(
        F.lit(total).alias("total_params"),
        F.avg(active).alias("active_params"),
        ((1 - F.avg(active) / total) * 100).alias("sparsity"),
        F.lit(float(sizes[FIRST] + sizes[SECOND])).alias("stage_total_params"),
        F.avg(stage_active).alias("stage_active_params"),
    )
