"""BPE encoding of whole texts, long ones as a tree of pieces that are encoded in parallel.

A text longer than ``piece`` characters is halved until no part is longer. The parts are encoded by
different tasks and concatenated up the tree. Where two parts meet, a window around the join is
encoded anew; it grows until a run of its tokens agrees with the left part and a run agrees with the
right part, in id and place, and then the window's tokens in between replace what both parts had
there. A window that covers both parts is the plain encoding.

Agreement is proof for two reasons. Texts and windows are cut only where no normalisation reaches across
(before a starter that composes with nothing before it) and never within a special token, so that
every stretch is normalised as it is in the whole text. And a row of tokens is the encoding of its word part
exactly if each two neighbours are the encoding of what they spell together: every two neighbours of the
result are neighbours in one of the three encodings.

Within a part, each distinct word part is encoded once (``word_memory``); common words cost a look-up.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from parley.llm.common import staged
from parley.llm.periodic_runs import sliced
from parley.llm.word_memory import WordMemory, shared_memory

PIECE = 1 << 15
WINDOW = 64
AGREE = 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def seconds() -> frozenset[str]:
    """Characters that compose with one before them: seconds of canonical pairs, and Korean vowels and finals."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(found.union(map(chr, range(0x1161, 0x1176)), map(chr, range(0x11A8, 0x11C3))))


class Cuts:
    """Where a text may be cut without changing how either side is normalised."""

    def __init__(self, text: str, marks: list[str], seconds: frozenset[str]):
        self.text = text
        self.seconds = seconds
        found = re.finditer("|".join(map(re.escape, marks)), text) if marks else ()
        self.inside = {p for m in found for p in range(m.start() + 1, m.end())}

    def fits(self, at: int) -> bool:
        if at in (0, len(self.text)):
            return True
        c = self.text[at]
        plain = c < "̀" or (
            not unicodedata.combining(c) and c not in self.seconds and unicodedata.category(c) != "Cn"
        )
        return plain and at not in self.inside

    def before(self, at: int, least: int) -> int:
        while at > least and not self.fits(at):
            at -= 1
        return max(at, least)

    def after(self, at: int, most: int) -> int:
        while at < most and not self.fits(at):
            at += 1
        return min(at, most)


def tokens(tokenizer, text: str, at: int = 0) -> np.ndarray:
    """Rows (id, start, end, number among the tokens of that place) of a text that begins at ``at``."""
    found = tokenizer.encode(text, add_special_tokens=False)
    rows = np.zeros((len(found.ids), 4), dtype=np.int64)
    if len(rows):
        rows[:, 0] = found.ids
        rows[:, 1:3] = np.array(found.offsets, dtype=np.int64) + at
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)
        order = np.arange(len(rows))
        rows[:, 3] = order - np.maximum.accumulate(np.where(fresh, order, 0))
    return rows


def _runs(a: np.ndarray, b: np.ndarray, agree: int) -> list[tuple[int, int]]:
    """(i, j) where ``agree`` rows of ``a`` from i equal those of ``b`` from j; places identify rows."""
    places = {tuple(row): j for j, row in enumerate(b.tolist())}
    pairs = [(i, places[tuple(row)]) for i, row in enumerate(a.tolist()) if tuple(row) in places]
    return [
        pairs[k]
        for k in range(len(pairs) - agree + 1)
        if pairs[k + agree - 1] == (pairs[k][0] + agree - 1, pairs[k][1] + agree - 1)
    ]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays of ids."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _end_rows(tokenizer, cuts: Cuts, start: int, middle: int, low: int, ids: np.ndarray) -> np.ndarray:
    """Rows of the last of ``ids``, which encode ``text[start:middle]``, as far as ``low`` and beyond.

    A shorter end of the text is encoded; ids that agree with the last of ``ids`` spell the same end.
    """
    reach = 2 * (middle - low)
    while True:
        at = cuts.before(max(start, middle - reach), start)
        rows = tokens(tokenizer, cuts.text[at:middle], at)
        if at == start:
            return rows
        same = _common(rows[::-1, 0], ids[::-1])
        if same and rows[len(rows) - same, 1] <= low:
            return rows[len(rows) - same :]
        reach *= 2


def _first_rows(tokenizer, cuts: Cuts, middle: int, end: int, high: int, ids: np.ndarray) -> np.ndarray:
    """Rows of the first of ``ids``, which encode ``text[middle:end]``, as far as ``high`` and beyond."""
    reach = 2 * (high - middle)
    while True:
        at = cuts.after(min(end, middle + reach), end)
        rows = tokens(tokenizer, cuts.text[middle:at], middle)
        if at == end:
            return rows
        same = _common(rows[:, 0], ids)
        if same and rows[same - 1, 2] >= high:
            return rows[:same]
        reach *= 2


def join(
    tokenizer,
    cuts: Cuts,
    start: int,
    middle: int,
    end: int,
    left: np.ndarray,
    right: np.ndarray,
    window: int = WINDOW,
    agree: int = AGREE,
) -> np.ndarray:
    """Ids of ``text[start:end]`` from those of its two parts, which meet at ``middle``."""
    reach = window
    while True:
        low = cuts.before(max(start, middle - reach), start)
        high = cuts.after(min(end, middle + reach), end)
        around = tokens(tokenizer, cuts.text[low:high], low)
        if low == start and high == end:
            return around[:, 0].astype(np.uint32)
        head, tail = (0, 0), (len(right), len(around))
        found = True
        if low > start:
            rows = _end_rows(tokenizer, cuts, start, middle, low, left)
            near = int(np.searchsorted(rows[:, 1], low))
            runs = _runs(rows[near:], around, agree)
            # the middle of the first run: what is before it is the left part's, what follows the window's
            found = bool(runs)
            if found:
                head = (len(left) - len(rows) + near + runs[0][0] + 1, runs[0][1] + 1)
        if found and high < end:
            rows = _first_rows(tokenizer, cuts, middle, end, high, right)
            far = int(np.searchsorted(rows[:, 1], high))
            runs = [r for r in _runs(rows[:far], around, agree) if r[1] >= head[1]]
            found = bool(runs)
            if found:
                tail = (runs[-1][0] + agree - 1, runs[-1][1] + agree - 1)
        if found:
            return np.concatenate([left[: head[0]], around[head[1] : tail[1], 0].astype(np.uint32), right[tail[0] :]])
        reach *= 2


def bounds(cuts: Cuts, piece: int) -> list[tuple[int, int]]:
    """The leaves of the tree over a text: halves of halves, none longer than ``piece`` that can be cut."""

    def halves(a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= max(piece, 1):
            return [(a, b)]
        middle = cuts.after((a + b) // 2, b)
        if middle == b:
            middle = cuts.before((a + b) // 2, a)
        return [(a, b)] if middle == a else [*halves(a, middle), *halves(middle, b)]

    return halves(0, len(cuts.text))


def merge(tokenizer, cuts: Cuts, parts: list[tuple[int, int]], ids: list[np.ndarray], **options) -> np.ndarray:
    """Concatenate neighbours level by level until one part is left."""
    while len(parts) > 1:
        above, merged = [], []
        for k in range(0, len(parts) - 1, 2):
            (start, middle), (_, end) = parts[k], parts[k + 1]
            above.append((start, end))
            merged.append(join(tokenizer, cuts, start, middle, end, ids[k], ids[k + 1], **options))
        if len(parts) % 2:
            above.append(parts[-1])
            merged.append(ids[-1])
        parts, ids = above, merged
    return ids[0]


FOUND = [
    StructField("n_tokens", LongType()),
    StructField("ids_sha256", StringType()),
    StructField("decoded_sha256", StringType()),
    StructField("ids", BinaryType()),
]


def results(memory: WordMemory, keys: pa.Array, found: list[bytes], with_ids: bool) -> pa.RecordBatch:
    """Rows of keys and ids with digests of the ids and of what they decode to."""
    decoded = [hashlib.sha256(memory.decoded(ids)).hexdigest() for ids in found]
    columns = [
        pa.array([len(ids) // 4 for ids in found], pa.int64()),
        pa.array([hashlib.sha256(ids).hexdigest() for ids in found], pa.string()),
        pa.array(decoded, pa.string()),
        pa.array(found if with_ids else [None] * len(found), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays([keys, *columns], ["key", *[field.name for field in FOUND]])


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    piece: int = PIECE,
    with_ids: bool = True,
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, ids) for every row of ``docs``.

    ``vocabulary`` is the path of a tokenizer definition that the driver can read; its text travels
    to the tasks. One that does not cut words as ``word_memory`` does raises an error. ``ids`` are little-endian
    32-bit numbers, NULL unless ``with_ids``. Empty and NULL texts have no tokens. Rows with equal keys stay
    apart, keys are not looked at and may be NULL; an empty table gives no rows; other columns are not
    looked at. Special tokens spelled in a text are found as the library finds them.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast({"definition": file.read(), "seconds": seconds()})
    kind = StructField("key", docs.schema[key].dataType)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    long = F.coalesce(F.length("t"), F.lit(0)) > piece
    whole = rows.filter(~long).mapInArrow(_short(definition, with_ids), StructType([kind, *FOUND]))
    return whole.unionByName(_long(rows.filter(long), kind, definition, piece, with_ids)).withColumnRenamed("key", key)


def _short(definition, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = shared_memory(definition.value)
        for batch in batches:
            at = 0
            for part in sliced(batch.column(1).cast(pa.binary()).to_pylist(), 4 << 20):
                yield results(memory, batch.column(0).slice(at, len(part)), memory.ids(part), with_ids)
                at += len(part)

    return run


def _long(rows: DataFrame, kind: StructField, definition, piece: int, with_ids: bool) -> DataFrame:
    """Leaves as rows, encoded wherever they lie; then one group for each document concatenates them."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    names = ["key", "row", "start", "t"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared_memory(definition.value).specials
        for batch in batches:
            for place, text in enumerate(batch.column(1).to_pylist()):
                leaves = bounds(Cuts(text, marks, definition.value["seconds"]), piece)
                same = pa.array([place] * len(leaves), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(same),
                        batch.column(2).take(same),
                        pa.array([a for a, _ in leaves], pa.int64()),
                        pa.array([text[a:b] for a, b in leaves], pa.string()),
                    ],
                    names,
                )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = shared_memory(definition.value)
        for batch in batches:
            at = 0
            for part in sliced(batch.column(3).cast(pa.binary()).to_pylist(), 4 << 20):
                ids = pa.array(memory.ids(part), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns, ids], [*names, "ids"])
                at += len(part)

    def tree(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        memory = shared_memory(definition.value)
        texts = group.column("t").to_pylist()
        ends = np.cumsum([len(t) for t in texts]).tolist()
        parts = list(zip(group.column("start").to_pylist(), ends))
        encoded = [np.frombuffer(b, dtype="<u4") for b in group.column("ids").to_pylist()]
        cuts = Cuts("".join(texts), memory.specials, definition.value["seconds"])
        ids = merge(memory.tokenizer, cuts, parts, encoded)
        one = group.column("key").combine_chunks().slice(0, 1)
        return pa.Table.from_batches([results(memory, one, [ids.astype("<u4").tobytes()], with_ids)])

    shape = StructType([kind, *[StructField(n, k) for n, k in zip(names[1:], (LongType(), LongType(), StringType()))]])
    # stored: the number of a row must not change if a task is run again
    leaves = staged(numbered.mapInArrow(cut, shape), "bpe-leaves")
    dealt = leaves.repartition(F.col("row"), F.col("start"))
    encoded = dealt.mapInArrow(leaf, StructType([*shape.fields, StructField("ids", BinaryType())]))
    return encoded.groupBy("row").applyInArrow(tree, StructType([kind, *FOUND]))
