"""Ordered context of every turn.

Input is one row per utterance: ``conv_id, turn_idx, speaker, text, strategy`` plus any other
columns, with ``turn_idx`` counting from 0 and ``speaker`` either ``sys`` (supporter) or ``usr``
(seeker). Conversations are cut into pieces of turns so that a very long one is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import strip, valid_text
from parley.operators.positions import CELL
from parley.schema import START

HISTORY_CELL = 256


def is_supporter() -> Column:
    return F.col("speaker") == "sys"


def tagged_utterance(include_labels: bool = True) -> Column:
    """``[supporter] [strategy] text`` or ``[seeker] text``."""
    text = valid_text(F.col("text"))
    mark = F.lit("[supporter] ")
    if include_labels:
        mark = F.concat(F.lit("[supporter] ["), F.coalesce("strategy", F.lit("")), F.lit("] "))
    return F.when(is_supporter(), F.concat(mark, text)).otherwise(F.concat(F.lit("[seeker] "), text))


def labelled_line() -> Column:
    """``Supporter : text``, ``Seeker : text`` or ``<other> : text``; NULL for blank utterances."""
    text = strip(F.coalesce("text", F.lit("")))
    who = (
        F.when(is_supporter(), "Supporter")
        .when(F.col("speaker") == "usr", "Seeker")
        .otherwise(F.coalesce("speaker", F.lit("")))
    )
    return F.when(text != "", F.concat(who, F.lit(" : "), text))


def with_earlier(utterances: DataFrame, value: Column, name: str, most: int | None, cell: int) -> DataFrame:
    """Add the array of ``value`` over the ``most`` turns before each row, or over all; NULLs are left out.

    Rows see their own piece of the conversation through a window. The last row of a piece has all that
    the pieces after it need; these rows are joined to the later pieces, so that only they move. Pieces
    are those that ``with_turn_index`` kept, by which rows lie together already; else ``cell`` turns, where
    only a full piece has turns after it. Short conversations send nothing.
    """
    kept = "_piece" in utterances.columns
    rows = utterances if kept else utterances.withColumn("_piece", F.floor(F.col("turn_idx") / cell).cast("long"))
    piece = Window.partitionBy("conv_id", "_piece").orderBy("turn_idx")
    first = Window.unboundedPreceding if most is None else -most

    def last(values: Column) -> Column:
        return values if most is None else F.when(F.size(values) > most, F.slice(values, -most, most)).otherwise(values)

    # rows without a value hold their place until the end
    rows = rows.withColumn("_said", F.struct(value.alias("v"))).withColumn(
        "_own", F.collect_list("_said").over(piece.rowsBetween(first, -1))
    )
    ends = F.col("turn_idx") % cell == cell - 1
    if kept:
        rows = rows.withColumn("_last", F.lead("turn_idx").over(piece).isNull())
        ends = F.col("_last") & F.col("_several")
    seams = rows.filter(ends).select(
        "conv_id", "_piece", last(F.concat("_own", F.array("_said"))).alias("_tail")
    )
    # a piece has a row at least, so as many pieces hold ``most`` of them
    reach = (first, -1) if kept else (first if most is None else 1 - most, 0)
    so_far = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(*reach)
    carried = seams.select(
        "conv_id",
        (F.col("_piece") if kept else F.col("_piece") + 1).alias("_piece"),
        F.flatten(F.collect_list("_tail").over(so_far)).alias("_earlier"),
    )
    whole = F.when(F.col("_earlier").isNull(), F.col("_own")).otherwise(last(F.concat("_earlier", "_own")))
    return (
        rows.join(carried, ["conv_id", "_piece"], "left")
        .withColumn(name, F.transform(F.filter(whole, lambda s: s["v"].isNotNull()), lambda s: s["v"]))
        .drop("_said", "_piece", "_several", "_last", "_own", "_earlier")
    )


def with_recent(utterances: DataFrame, turns: int = 5, include_labels: bool = True) -> DataFrame:
    """Add ``recent``: the tagged utterances of up to ``turns`` turns before each row, in order."""
    if turns not in (1, 2, 3, 4, 5):
        raise ValueError(f"turns must be 1 to 5, got {turns}")
    return with_earlier(utterances, tagged_utterance(include_labels), "recent", turns, CELL)


def context_of(recent: Column, turns: int = 5) -> Column:
    """The last ``turns`` utterances as one string; a first turn reads ``<START>``."""
    kept = F.when(F.size(recent) > turns, F.slice(recent, -turns, turns)).otherwise(recent)
    return F.when(F.col("turn_idx") == 0, START).otherwise(F.array_join(kept, " "))


def split_context(recent: Column) -> tuple[Column, Column]:
    """All but the last utterance of the window, and the last one."""
    last = F.try_element_at(recent, F.lit(-1))
    before = F.when(F.size(recent) > 1, F.array_join(F.slice(recent, 1, F.size(recent) - 1), " "))
    return F.coalesce(before, F.lit("")), F.when(F.col("turn_idx") == 0, START).otherwise(last)


def full_context(t1: Column, t2: Column) -> Column:
    return strip(F.concat_ws(" ", t1, t2))


def evaluation_examples(utterances: DataFrame, include_labels: bool = True) -> DataFrame:
    """One row per supporter turn with its two-part context, the joined ones and the reply."""
    recent = with_recent(utterances, 5, include_labels).filter(is_supporter())
    t1, t2 = split_context(F.col("recent"))
    return (
        recent.withColumn("context_t1", t1)
        .withColumn("context_t2", t2)
        .withColumn("context", full_context(F.col("context_t1"), F.col("context_t2")))
        .withColumn("current_turn", strip(F.col("context_t2")))
        .withColumn("label_context", valid_text(F.col("text")))
        .drop("recent")
    )


def with_history(utterances: DataFrame, value: Column, name: str, cell: int = HISTORY_CELL) -> DataFrame:
    """Add the array of ``value`` over all earlier turns of the conversation (NULLs left out).

    A row holds its whole history, so a conversation has to fit a row in any case; what grows
    with the square of its length is the output. That output is spread over pieces of ``cell``
    turns.
    """
    return with_earlier(utterances, value, name, None, cell)


def transcripts(utterances: DataFrame) -> DataFrame:
    """One row per supporter turn with ``input_dialog``, the labelled lines of all earlier turns."""
    return (
        with_history(utterances, labelled_line(), "_lines")
        .filter(is_supporter())
        .withColumn("input_dialog", strip(F.array_join("_lines", "\n")))
        .drop("_lines")
    )


def history_arrays(utterances: DataFrame) -> DataFrame:
    """One row per supporter turn with ``dialogue``, all earlier turns as structs."""
    turn = F.struct("speaker", valid_text(F.col("text")).alias("text"), "strategy")
    return with_history(utterances, turn, "dialogue").filter(is_supporter())


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many NULLs each column has; pair with :func:`fill_nulls`."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]))
    )


def fill_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL text reads as empty."""
    return df.fillna("", subset=columns)
