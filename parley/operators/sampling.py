"""Class balance, seeded order, slices and caps; every choice follows from keys and a seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import strip
from parley.operators.positions import with_position
from parley.schema import START
from parley.session import stored

COPIES_PER_ROW = 1000
PRIME = 1_000_003
SEED = 42
#: Rounds of the network behind an epoch's order, and the factor that scrambles within a round.
ROUNDS, SCRAMBLE = 6, 73_244_475
WALK = 64


def seeded_key(seed: int = 42, conv: str = "conv_id", turn: str = "turn") -> Column:
    """A scattered integer per row that any engine can compute; ids may have any size."""
    return (F.pmod(F.col(conv), F.lit(PRIME)) * 7919 + F.pmod(F.col(turn), F.lit(PRIME)) * 104729 + F.lit(seed)) % PRIME


def class_histogram(examples: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return examples.groupBy(*by, label).agg(F.count("*").alias("n"))


def balance_plan(
    examples: DataFrame, by: list[str], label: str = "label", second: bool = False
) -> DataFrame:
    """Per class: its size, the size to reach, the whole copies and the extra rows to take.

    The size to reach is that of the largest class, or with ``second`` of the second largest.
    """
    counts = class_histogram(examples, by, label)
    sizes = F.sort_array(F.collect_list("n").over(Window.partitionBy(*by)), asc=False)
    if second:
        lone = F.raise_error(F.lit("balancing to the second largest class needs two classes"))
        target = F.when(F.size(sizes) < 2, lone.cast("bigint")).otherwise(F.try_element_at(sizes, F.lit(2)))
    else:
        target = F.try_element_at(sizes, F.lit(1))
    return (
        counts.withColumn("target", target)
        .withColumn("reps", F.expr("target div n"))
        .withColumn("extra", F.expr("target % n"))
    )


def balance(
    examples: DataFrame,
    by: list[str],
    keys: list[str],
    order: Column | None = None,
    label: str = "label",
    second: bool = False,
) -> DataFrame:
    """Bring all classes of a group to one size; adds ``copy`` (1 for the first).

    Smaller classes get whole copies plus the first ``extra`` rows in seeded order; a larger class
    keeps the first ``target`` rows of that order. Only classes with a remainder are ranked, on
    their keys alone; the largest class never is. The class counts are stored once; the planner
    decides how to join them. Copies are made in chunks of ``COPIES_PER_ROW`` that are spread over
    tasks, so one row cannot swell one task. ``keys`` must be unique within a group.
    """
    order = seeded_key() if order is None else order
    plan = stored(balance_plan(examples, by, label, second), "balance")
    row_key = list(dict.fromkeys([*by, label, *keys]))
    unfinished = plan.filter("extra > 0").select(*by, label, "extra")
    ranked = with_position(
        examples.select(*row_key, order.alias("_order")).join(unfinished, [*by, label]),
        [*by, label],
        ["_order", *keys],
        "_rank",
    )
    chosen = ranked.filter("_rank <= extra").select(*row_key, F.lit(1).alias("_plus"))
    copies = (
        examples.join(plan.select(*by, label, "reps"), [*by, label])
        .join(chosen, row_key, "left")
        .withColumn("_copies", F.col("reps") + F.coalesce("_plus", F.lit(0)))
        .filter("_copies > 0")
    )
    chunks = F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES_PER_ROW}"))
    copies = copies.withColumn("_chunk", F.explode(chunks)).repartition(*row_key, "_chunk")
    first = F.col("_chunk") * COPIES_PER_ROW + 1
    numbers = F.sequence(first, F.least(F.col("_copies"), first + (COPIES_PER_ROW - 1)))
    return copies.withColumn("copy", F.explode(numbers)).select(*examples.columns, "copy")


def shuffled(df: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Add ``shuffle_pos``, the place of each row in a seeded order."""
    order = seeded_key() if order is None else order
    return with_position(df.withColumn("_order", order), [], ["_order", *keys], "shuffle_pos").drop("_order")


def hash_fraction(df: DataFrame, buckets: int = 10, order: Column | None = None) -> DataFrame:
    """About one row in ``buckets``, the same rows each time."""
    order = seeded_key() if order is None else order
    return df.filter(order % buckets == 0)


def with_ordinal(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number all rows from 0 in the given order."""
    return with_position(df, [], order, name).withColumn(name, F.col(name) - 1)


def slice_rows(df: DataFrame, order: list[str], start: int = 0, end: int = -1) -> DataFrame:
    """Rows ``start`` to before ``end`` of the given order; -1 means to the end."""
    numbered = with_ordinal(df, order, "_ordinal")
    kept = numbered.filter(F.col("_ordinal") >= max(0, start))
    if end != -1:
        kept = kept.filter(F.col("_ordinal") < end)
    if kept.isEmpty():
        raise ValueError(f"no rows between {start} and {end}")
    return kept.drop("_ordinal")


def slice_requests(df: DataFrame, order: list[str], start: int = 0, end: int = -1, context: str = "context") -> DataFrame:
    """:func:`slice_rows` of what is asked for: rows of a first turn are out before anything is numbered."""
    return slice_rows(df.filter(~strip(F.col(context)).eqNullSafe(F.lit(START))), order, start, end)


def _scrambled(value: Column, salt: int) -> Column:
    """A number below 2**32 from one below 2**31, in whole-number arithmetic that any engine repeats."""
    mixed = value * 2 + salt
    for _ in range(2):
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, 16)) * SCRAMBLE % (1 << 32)
    return mixed.bitwiseXOR(F.shiftright(mixed, 16))


def epoch_salts(epoch: int, seed: int) -> list[int]:
    return [(seed * 1_000_003 + epoch * 7_919 + step * 104_729) % (1 << 31) for step in range(ROUNDS)]


def epoch_order(df: DataFrame, number: str, rows: int, epoch: int, seed: int = SEED) -> DataFrame:
    """Add ``epoch_pos``: a place of its own from 0 to ``rows`` - 1 for each ``number`` of the same range.

    Each epoch has another order, and none needs a sort or a shuffle: places follow from the number alone,
    by a Feistel network over pairs of remainders (Black and Rogaway 2002). The pairs are at most the square
    root of ``rows`` more than the rows; a number that lands beyond the rows goes round again, which is
    a permutation of the rows still. Rows are numbered once, by :func:`with_ordinal`.
    """
    if not 0 <= rows < 1 << 61:
        raise ValueError(f"rows must be from 0 to 2**61, got {rows}")
    wide = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    high = max(1, -(-rows // wide))
    salts = epoch_salts(epoch, seed)

    def step(turn: int):
        def mixed(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            if turn % 2:
                return F.struct(a.alias("a"), ((b + _scrambled(a, salts[turn])) % high).alias("b"))
            return F.struct(((a + _scrambled(b, salts[turn])) % wide).alias("a"), b.alias("b"))

        return mixed

    def walked(place: Column) -> Column:
        pair = F.array(F.struct((place % wide).alias("a"), F.call_function("div", place, F.lit(wide)).alias("b")))
        for turn in range(ROUNDS):
            pair = F.transform(pair, step(turn))
        return F.transform(pair, lambda p: p["b"] * wide + p["a"])[0]

    start = F.col(number).cast("long")
    # fewer places than ``wide`` lie beyond the rows, so up to WALK**2 rows this many turns always do; with more
    # rows a place is beyond them once in more than WALK times, and WALK times in a row practically never
    turns = F.sequence(F.lit(1), F.lit(WALK))
    done = F.aggregate(turns, walked(start), lambda place, _: F.when(place < rows, place).otherwise(walked(place)))
    stray = F.raise_error(F.lit("a place was not found"))
    return df.withColumn("epoch_pos", done).withColumn(
        "epoch_pos", F.when(F.col("epoch_pos") < rows, F.col("epoch_pos")).otherwise(stray.cast("long"))
    )


def cap_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group; 0 keeps all. Positions are counted in pieces."""
    if n <= 0:
        return df
    return with_position(df, by, order, "_place").filter(F.col("_place") <= n).drop("_place")
