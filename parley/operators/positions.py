"""Row positions that hold up when one group has a large share of all rows.

A plain ``row_number`` window sends each group to one task. Here a group is cut into pieces,
rows are numbered within their piece, and each piece is told how many rows came before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import durable

CELL = 4096


def with_turn_index(
    turns: DataFrame, counted: Column | None = None, cell: int = CELL, keep: bool = False
) -> DataFrame:
    """Keep the ``counted`` rows of each conversation, number them from 0, attach the situation.

    ``turns`` is ``(conv_id, turn, role, text)``; ``system`` rows give the situation, all others
    are counted unless told otherwise. Rows move once, by (conversation, piece of ``cell`` turns); what a
    piece carries over is summed up by the same key, and only conversations that reach beyond one piece
    carry anything, so that table is small. With ``keep`` the rows
    keep ``_piece``, by which they lie together, and ``_several``, true where there are other pieces.
    """
    system = F.col("role") == "system"
    counted = ~system if counted is None else counted
    pieces = turns.withColumn("_piece", F.floor(F.col("turn") / cell).cast("long")).repartition("conv_id", "_piece")
    # ordered by the first turn, not by the piece: both branches then need the same columns of the exchange
    conversation = Window.partitionBy("conv_id")
    carried = (
        pieces.groupBy("conv_id", "_piece")
        .agg(
            F.count_if(counted).alias("_n"),
            F.max(F.when(system, F.col("text"))).alias("_situation"),
            F.min("turn").alias("_first"),
        )
        .withColumn(
            "_before",
            F.sum("_n").over(conversation.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn("_carried_situation", F.max("_situation").over(conversation))
        .withColumn("_pieces", F.count("*").over(conversation))
        .filter("_pieces > 1")
        .select("conv_id", "_piece", "_before", "_carried_situation", F.lit(True).alias("_several"))
    )
    piece = Window.partitionBy("conv_id", "_piece").orderBy("turn")
    seen = piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        pieces.withColumn("_seen", F.count_if(counted).over(seen) - 1)
        .withColumn("_own_situation", F.max(F.when(system, F.col("text"))).over(whole))
        .filter(counted)
        .join(carried, ["conv_id", "_piece"], "left")
        .select(
            *turns.columns,
            (F.col("_seen") + F.coalesce("_before", F.lit(0))).cast("int").alias("turn_idx"),
            F.coalesce("_carried_situation", "_own_situation").alias("situation"),
            *(["_piece", F.coalesce("_several", F.lit(False)).alias("_several")] if keep else []),
        )
    )


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first, whether it differs from the one before; NULLs and NaNs equal themselves."""
    n = max((len(c) for c in columns), default=1) - 1
    changed = np.zeros(max(n, 0), dtype=bool)
    for column in columns:
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            changed |= np.array([x != y for x, y in zip(values, values[1:])], dtype=bool)
            continue
        # equal values get equal codes, NULL and NaN codes of their own
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return changed


def _group_of(columns: list[pa.Array], row: int) -> tuple:
    """A row's group as values that compare like those of Spark."""
    values = (column[row].as_py() for column in columns)
    return tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in values)


def whole_groups(batches: Iterator[pa.RecordBatch], places: list[int]) -> Iterator[pa.Table]:
    """The rows of each group, by the columns at ``places``, where groups lie together.

    A group may go on over batches; no more than the batches of one group are held.
    """
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) for i in places]
        cuts = [0, *(np.flatnonzero(_changes(keys)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and (start or _group_of(keys, 0) != now):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
        now = _group_of(keys, batch.num_rows - 1)
    if held:
        yield pa.Table.from_batches(held)


def _edges(ranged: DataFrame, group: list[str]) -> dict[int, int]:
    """What the first group of each part counts in the parts before it.

    Each part tells its first and its last group and what they count there, two rows whatever its size.
    Groups lie in neighbouring parts, so one look at these rows in the order of the parts is enough.
    """
    kinds = [ranged.schema[c] for c in group]
    shape = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("n", T.LongType())]
        + [T.StructField(f"g{i}", field.dataType) for i, field in enumerate(kinds)]
    )
    places = [ranged.columns.index(c) for c in (*group, "_step", "_part")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, types = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in places]
            *keys, steps, parts = columns
            part, types = parts[0].as_py(), [c.type for c in keys]
            ends = [*(np.flatnonzero(_changes(keys)) + 1).tolist(), batch.num_rows]
            sums = np.concatenate([[0], np.cumsum(steps.to_numpy())])
            for start, end in ((0, ends[0]), (([0] + ends)[-2], ends[-1])) if len(ends) > 1 else ((0, ends[0]),):
                here, n = _group_of(keys, start), int(sums[end] - sums[start])
                raw = [k[start].as_py() for k in keys]
                if last is not None and last[0] == here and start == 0:
                    last = (here, raw, last[2] + n)
                else:
                    first = first or last
                    last = (here, raw, n)
        if last is not None:
            rows = [(False, first), (True, last)] if first else [(True, last)]
            arrays = [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows])]
            arrays.append(pa.array([r[1][2] for r in rows], pa.int64()))
            arrays += [pa.array([r[1][1][i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, shape_names)

    shape_names = shape.names
    rows = ranged.mapInArrow(told, shape).orderBy("part", "last").collect()
    carried: dict[int, int] = {}
    open_group, open_count = None, 0
    for row in rows:
        key = tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row[3:])
        if open_group == key:
            if row["part"] not in carried:
                carried[row["part"]] = open_count
            open_count += row["n"]
        else:
            carried.setdefault(row["part"], 0)
            open_group, open_count = key, row["n"]
    return {part: n for part, n in carried.items() if n}


def with_position(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str,
    counted: Column | None = None,
    finer: tuple[list[str], str] | None = None,
    native: bool = False,
) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without one task per group.

    With ``counted`` only such rows raise the number. ``finer = (columns, name)`` adds a second
    number within ``group + columns``. With ``native`` no Python runs, but rows move once more.

    Rows are range-partitioned by (group, order), so a hot group spans many parts, and sorted there. The
    sampled range bounds must not move between the uses of the parts, hence the checkpoint; hand in narrow
    rows. After that nothing moves: rows are numbered as they lie, and only the first group of a part
    goes on from earlier ones, with a count that two rows from each part tell (see ``_edges``). The
    finer number is shuffled by part and group, and its carried counts are left to the planner.
    """
    steps = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    dealt = df.withColumn("_step", steps).repartitionByRange(*group, *order)
    if not native:
        dealt = dealt.sortWithinPartitions(*group, *order)
    ranged = durable(dealt.withColumn("_part", F.spark_partition_id()))
    if native:
        result = _finer(ranged, ranged, group, order, name, small=True)
    else:
        result = _as_they_lie(ranged, group, name)
    columns = [*df.columns, name]
    if finer is not None:
        result = _finer(ranged, result, [*group, *finer[0]], order, finer[1])
        columns.append(finer[1])
    return result.select(*columns)


def _as_they_lie(ranged: DataFrame, group: list[str], name: str) -> DataFrame:
    """The sorted rows of each part numbered within ``group``, going on from the parts before."""
    carried = _edges(ranged, group)
    places = [ranged.columns.index(c) for c in group]
    step, part = ranged.columns.index("_step"), ranged.columns.index("_part")
    names = [*ranged.columns, name]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in places]
            first = _group_of(keys, 0)
            if now is None:
                count = carried.get(batch.column(part)[0].as_py(), 0)
            elif first != now:
                count = 0
            starts = np.concatenate([[0], np.flatnonzero(_changes(keys)) + 1])
            sums = np.concatenate([[0], np.cumsum(batch.column(step).to_numpy())])
            before = np.repeat(sums[starts], np.diff(np.append(starts, batch.num_rows)))
            numbers = sums[1:] - before
            if len(starts) > 1:
                numbers[: starts[1]] += count
                count = int(numbers[-1])
            else:
                numbers += count
                count = int(numbers[-1])
            now = _group_of(keys, batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names)

    shape = T.StructType([*ranged.schema.fields, T.StructField(name, T.LongType())])
    return ranged.mapInArrow(number, shape)


def _finer(
    ranged: DataFrame, rows: DataFrame, keys: list[str], order: list[str], column: str, small: bool = False
) -> DataFrame:
    """``rows`` numbered within ``keys`` by windows over the parts, going on from the parts before.

    ``small``: ``keys`` are those the parts were cut by, so that at most one group a part is carried on.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy("_part", *[F.col(k).alias(n) for k, n in zip(keys, names)])
        .agg(F.sum("_step").alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .filter("_before > 0")
        .select(F.col("_part").alias("_p"), *names, "_before")
    )
    same = F.col("_part") == F.col("_p")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    seen = (
        Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_seen", F.sum("_step").over(seen))
        .join(F.broadcast(carried) if small else carried, same, "left")
        .withColumn(column, F.col("_seen") + F.coalesce("_before", F.lit(0)))
        .drop("_seen", "_p", "_before", *names)
    )
