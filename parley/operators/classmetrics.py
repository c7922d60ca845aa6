"""Classification metrics from a confusion table.

Rows are reduced to (group, true, predicted) counts before anything moves, so all later steps work
on label-sized data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.numeric import round_exact


def confusion(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(
        *(by or []), F.col(true).alias("true_label"), F.col(pred).alias("pred_label")
    ).agg(F.count("*").alias("n"))


def label_scores(counts: DataFrame, by: list[str] | None = None, labels: list | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each label.

    The labels are those seen as true or predicted, or the fixed list ``labels`` (absent ones
    score 0 in every group). Divisions by zero give 0.
    """
    by = by or []

    def entry(label: Column, support: Column, chosen: Column, hits: Column) -> Column:
        return F.struct(
            label.alias("label"),
            support.cast("long").alias("support"),
            chosen.cast("long").alias("chosen"),
            hits.cast("long").alias("hits"),
        )

    zero = F.lit(0)
    hit = F.when(F.col("true_label").eqNullSafe(F.col("pred_label")), F.col("n")).otherwise(0)
    parts = [
        entry(F.col("true_label"), F.col("n"), zero, hit),
        entry(F.col("pred_label"), zero, F.col("n"), zero),
    ]
    if labels is not None:
        parts += [entry(F.lit(label), zero, zero, zero) for label in labels]
    totals = (
        counts.select(*by, F.inline(F.array(*parts)))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hits")])
    )
    if labels is not None:
        totals = totals.filter(F.col("label").isin(labels))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return totals.select(
        *by,
        "label",
        ratio(F.col("hits"), F.col("chosen")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("chosen")).alias("f1"),
        "support",
        "hits",
    )


def class_f1(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Macro F1, weighted F1 and accuracy per group."""
    scores = label_scores(confusion(df, true, pred, by), by)
    return scores.groupBy(*(by or [])).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("rows"),
    )


def class_table(df: DataFrame, true: str, pred: str, labels: list, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 over a fixed label list, rounded to four decimals."""
    by = by or []
    scores = label_scores(confusion(df, true, pred, by), by, labels)
    return scores.select(
        *by,
        F.col("label").alias("class"),
        *[round_exact(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")],
    )


LEAST_PROBABILITY = 1e-15


def join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two results of one row per group; a NULL group meets a NULL group."""
    other = right.withColumnsRenamed({name: f"_by_{i}" for i, name in enumerate(by)})
    same = F.lit(True)
    for i, name in enumerate(by):
        same = same & F.col(name).eqNullSafe(F.col(f"_by_{i}"))
    return left.join(other, same).drop(*[f"_by_{i}" for i in range(len(by))])


def split_scores(df: DataFrame, true: str, probs: str, by: list[str]) -> DataFrame:
    """Macro F1 of the most probable class and mean log loss per group.

    ``probs`` is the array of class probabilities and ``true`` the class's place in it. Probabilities
    below ``LEAST_PROBABILITY`` count as that, so that a sure mistake has a finite loss. Rows whose class
    has no probability, or one that is none (NULL, NaN, below 0 or above 1), take no part in the loss and are
    counted as ``unscored``. ``NULL`` is a group like any other.
    """
    own = F.try_element_at(F.col(probs), (F.col(true) + 1).cast("int"))
    own = F.when(own.between(0.0, 1.0), own)
    scored = df.withColumn("_pred", (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))
    loss = scored.groupBy(*by).agg(
        F.avg(F.when(own.isNotNull(), -F.log(F.greatest(own, F.lit(LEAST_PROBABILITY))))).alias("loss"),
        F.count_if(own.isNull()).alias("unscored"),
    )
    scores = join_groups(class_f1(scored, true, "_pred", by), loss, by)
    return scores.select(*by, "macro_f1", "loss", "rows", "unscored")


def strategy_metrics(scores: DataFrame, total_params: float, turn: int, encoder: str) -> DataFrame:
    """The one-line report of a run."""
    return scores.select(
        F.lit(turn).alias("turn"),
        F.lit(encoder).alias("encoder"),
        round_exact(F.col("macro_f1"), 4).alias("m_f1"),
        round_exact(F.col("weighted_f1"), 4).alias("w_f1"),
        round_exact(F.col("accuracy"), 4).alias("acc"),
        F.lit(round(total_params, 2)).alias("total_params_M"),
    )


def leaderboard(generation: DataFrame, classes: DataFrame, model: str = "model") -> DataFrame:
    """Generation and label metrics side by side as text, ``-`` where a model generates nothing."""
    text = {
        "B-1": "bleu_1",
        "B-2": "bleu_2",
        "R-L": "rouge_l",
        "D-1": "distinct_1",
        "D-2": "distinct_2",
        "soft_match": "soft_match",
    }

    def shown(column: str, digits: int) -> Column:
        value = round_exact(F.col(column), digits)
        return F.coalesce(F.format_string(f"%.{digits}f", value), F.lit("-"))

    # format_string writes NULL as text, so absence is told apart first
    def cell(column: str, digits: int) -> Column:
        return F.when(F.col(column).isNull(), "-").otherwise(shown(column, digits))

    return generation.join(classes, model, "full").select(
        model,
        *[cell(source, 2).alias(name) for name, source in text.items()],
        cell("macro_f1", 4).alias("macro-F1"),
        cell("weighted_f1", 4).alias("weighted-F1"),
    )
