"""Packing of token sequences by bounded-space online best fit.

Every task keeps a fixed number of open bins. Their free space is held in a bitset, one bit for every
amount of space that some open bin has left, so that the tightest bin that still takes a piece and the
fullest bin are both found with a shift. A piece goes to the tightest bin; where none takes it, a
new bin is opened, and if that is one too many, the fullest is closed first.

What is still in open bins when a task ends is not given out: those pieces go to the next round, with as
many tasks as keep their own open bins few, and so on until one task closes everything. Rounds shrink by
``SHRINK`` each time, whatever the size of the first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from parley.llm.periodic_runs import sliced
from parley.llm.word_memory import shared_memory
from parley.session import scratch_path

CAPACITY = 4096
#: Open bins of a task.
BINS = 64
#: A task of a later round gets pieces for so many times its open bins.
SHRINK = 16
END = 1
#: Rows that leave a task together.
BATCH = 4096


class OpenBins:
    """Bins by free space; ``mask`` has bit ``f`` set where some open bin has ``f`` left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask, self.count, self.opened = 0, 0, 0
        self.free: dict[int, list[tuple[int, list]]] = {}

    def _take(self, least: int) -> tuple[int, tuple[int, list]] | None:
        """The bin with the least free space of ``least`` or more."""
        above = self.mask >> least
        if not above:
            return None
        space = least + (above & -above).bit_length() - 1
        same = self.free[space]
        taken = same.pop()
        if not same:
            self.mask ^= 1 << space
        self.count -= 1
        return space, taken

    def add(self, length: int, row) -> list[tuple[int, list]]:
        """Place a row of ``length`` and return the bins that this closed, as (number, [(row, offset)])."""
        closed = []
        found = self._take(length)
        if found is None:
            if self.count == self.most:
                closed.append(self._take(0)[1])
            found = self.capacity, (self.opened, [])
            self.opened += 1
        space, taken = found
        taken[1].append((row, self.capacity - space))
        left = space - length
        if left:
            self.free.setdefault(left, []).append(taken)
            self.mask |= 1 << left
            self.count += 1
        else:
            closed.append(taken)
        return closed

    def rest(self) -> list[tuple[int, list]]:
        """What is still open."""
        return [taken for same in self.free.values() for taken in same]


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = True,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): every text as token ids with the id ``END`` behind them.

    Only sequences of more than ``capacity`` ids are cut, into pieces of ``capacity`` and a last one of what is
    left. ``ids`` are little-endian 32-bit numbers, NULL unless ``with_ids``; ``ids_crc32`` is theirs. NULL and
    empty texts are the id ``END`` alone.
    """
    spark: SparkSession = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    with open(vocabulary, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast({"definition": file.read()})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = shared_memory(definition.value)
        end, width = END.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()).to_pylist(), 0
            for part in sliced(texts, 4 << 20):
                whose, number, found = [], [], []
                for row, ids in enumerate(memory.ids(part)):
                    ids += end
                    cut = [ids[a : a + width] for a in range(0, len(ids), width)]
                    whose += [at + row] * len(cut)
                    number += range(len(cut))
                    found += cut
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(whose, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array([capacity * n for n in number], pa.int64()),
                        pa.array([len(ids) // 4 for ids in found], pa.int64()),
                        pa.array([zlib.crc32(ids) for ids in found], pa.int64()),
                        pa.array(found if with_ids else [None] * len(found), pa.binary()),
                    ],
                    [field.name for field in shape],
                )

    shape = StructType(
        [
            StructField("key", docs.schema[key].dataType),
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids_crc32", LongType()),
            StructField("ids", BinaryType()),
        ]
    )
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(encoded, shape)


def _round(rows: DataFrame, size: str, number: int, capacity: int, most: int, last: bool) -> DataFrame:
    """One round: ``rows`` with sequence_id, offset and whether the sequence is closed."""
    place = rows.columns.index(size)
    names = [*rows.columns, "sequence_id", "offset", "closed"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of their own for every round and task
        base = (number << 59) + (TaskContext.get().partitionId() << 35)
        bins, kinds, out = OpenBins(capacity, most), None, []

        def given() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(names)
            record = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(record, names)

        def leave(some: list[tuple[int, list]], closed: bool) -> None:
            for bin_number, held in some:
                out.extend((*row, base + bin_number, offset, closed) for row, offset in held)

        for batch in batches:
            kinds = kinds or [*batch.schema.types, pa.int64(), pa.int64(), pa.bool_()]
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                leave(bins.add(row[place], row), True)
                if len(out) >= BATCH:
                    yield given()
        leave(bins.rest(), last)
        if out:
            yield given()

    extra = [StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("closed", BooleanType())]
    return rows.mapInArrow(packed, StructType([*rows.schema.fields, *extra]))


def packed(rows: DataFrame, size: str = "length", capacity: int = CAPACITY, bins: int = BINS) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: sizes of a sequence add up to ``capacity`` at most.

    Sizes must lie between 1 and ``capacity``. Sequence ids are any numbers, offsets go from 0 without a gap.
    Equal rows are packed each for itself; an empty table gives no rows; other columns are kept, but for
    ``sequence_id``, ``offset`` and ``closed``, which must not be there. Nothing is shuffled: each round reads the
    open pieces that the one before it has stored, in fewer tasks.
    """
    spark = rows.sparkSession
    done: list[DataFrame] = []
    last = False
    while not last:
        number = len(done)
        # a round that one task can end is the last
        tasks = None
        if done:
            total = rows.agg(F.sum(size)).first()[0] or 0
            tasks = max(1, total // (capacity * bins * SHRINK))
            rows = rows.coalesce(tasks)
        last = tasks == 1
        placed = _round(rows, size, number, capacity, bins, last)
        path = scratch_path(spark, f"packed-{number}")
        placed.write.partitionBy("closed").parquet(path)
        stored = spark.read.schema(placed.schema).parquet(path)
        done.append(stored.filter("closed").drop("closed"))
        rows = stored.filter("not closed").drop("closed", "sequence_id", "offset")
    return reduce(DataFrame.unionByName, done)
