"""Strategy, stage and module labels.

The vocabularies are fixed and tiny, so they are literal maps inside the row expression; the
rows of all modules come out of one pass, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.context import context_of, is_supporter, with_recent
from parley.schema import (
    MODULES,
    RAW_STRATEGY_SPELLING,
    STAGE_ABBREV,
    STAGES,
    STRATEGIES,
    TEST_MODULE,
    lookup,
)


def strategy_id(name: Column) -> Column:
    """The id of a raw strategy label; an unknown label fails the job with its name."""
    known = lookup({RAW_STRATEGY_SPELLING.get(i, label): i for i, label, _, _ in STRATEGIES})
    unknown = F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce(name, F.lit("NULL"))))
    return F.coalesce(F.try_element_at(known, name), unknown.cast("int"))


def strategy_name(strategy: Column) -> Column:
    return F.try_element_at(lookup({i: name for i, name, _, _ in STRATEGIES}), strategy.cast("int"))


def raw_strategy_name(strategy: Column) -> Column:
    names = {i: RAW_STRATEGY_SPELLING.get(i, name) for i, name, _, _ in STRATEGIES}
    return F.try_element_at(lookup(names), strategy.cast("int"))


def stage_of(strategy: Column) -> Column:
    return F.try_element_at(lookup({i: stage for i, _, _, stage in STRATEGIES}), strategy.cast("int"))


def stage_id(stage: Column) -> Column:
    return F.try_element_at(lookup({name: i for i, name in enumerate(STAGES)}), stage)


def abbreviation(label: Column) -> Column:
    """The two-letter name of a stage or strategy, in either spelling."""
    short = dict(STAGE_ABBREV)
    for i, name, letters, _ in STRATEGIES:
        short[name] = short.get(name, letters)
        short[RAW_STRATEGY_SPELLING.get(i, name)] = letters
    return F.try_element_at(lookup(short), label)


def module_rows(strategy: Column, include_test: bool = False) -> Column:
    """``array<struct<module, label, turns>>``: the modules that train on a strategy."""
    entries = []
    for i, *_ in STRATEGIES:
        rows = [
            F.struct(
                F.lit(module).alias("module"), F.lit(label).alias("label"), F.lit(turns).alias("turns")
            )
            for module, _, members, _, turns in MODULES
            for label, group in enumerate(members)
            if i in group
        ]
        if include_test:
            rows.append(
                F.struct(F.lit(TEST_MODULE).alias("module"), F.lit(i).alias("label"), F.lit(5).alias("turns"))
            )
        entries += [F.lit(i), F.array(*rows)]
    return F.element_at(F.create_map(*entries), strategy.cast("int"))


def module_examples(
    utterances: DataFrame, include_labels: bool = True, include_test: bool = False
) -> DataFrame:
    """The training examples of every module in one table.

    A strategy outside a module gives no row for it. All modules share one window of five turns,
    of which the module's own width is taken.
    """
    recent = with_recent(utterances, 5, include_labels).filter(is_supporter())
    rows = module_rows(strategy_id(F.col("strategy")), include_test)
    return recent.withColumn("_m", F.explode(rows)).select(
        "conv_id",
        "turn_idx",
        *[c for c in ("turn", "split") if c in utterances.columns],
        F.col("_m.module").alias("module"),
        F.col("_m.label").alias("label"),
        F.when(F.col("_m.turns") == 1, context_of(F.col("recent"), 1))
        .otherwise(context_of(F.col("recent"), 5))
        .alias("context"),
    )
