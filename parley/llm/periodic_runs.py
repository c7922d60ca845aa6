"""Periodic runs of words, found with a grammar that recompression builds.

The words of a slice of texts become one sequence of numbers, with a number of its own around every
text. Recompression alternates two steps on it: blocks of one repeated symbol become one symbol, then
the symbols are dealt into two classes and every pair (first class, second class) becomes one symbol,
until each text is a single symbol. The levels are a run-length grammar in which equal stretches are
parsed alike but for their ends, so that the common extension of two places is found by climbing while
both stand at the border of equal symbols and descending where they part: a number of steps that grows
with the logarithm of its length.

A run of period ``q`` and at least ``4 q`` words holds two places ``i`` and ``i + q`` where ``i`` is a
multiple of ``3 q``. These are the candidates, about ``n / 3 (1 + 1/2 + 1/3 + ...)`` of them; grammar
extensions to both sides give the exact run or show that there is none. All steps work on whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from parley.llm.common import let

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are one sequence, or one text if that is longer.
SLICE = 4 << 20
#: Extensions that are asked for at once.
ASKED = 1 << 19

NAMES = ["key", "n_words", "runs", "collapsed"]
_RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
FOUND = [
    StructField("n_words", LongType()),
    StructField("runs", ArrayType(_RUN)),
    StructField("collapsed", StringType()),
]


@dataclass
class Level:
    """Symbols of one level; ``parent`` are places in the next one, ``first`` the first child of each
    symbol in the level below, with the end of that level as one more entry."""

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    blocks: bool = False


def _named(symbols: np.ndarray, joins: np.ndarray, keys: np.ndarray, starts: np.ndarray, free: int) -> np.ndarray:
    """The next level's symbols: those at ``starts``, new ones where ``joins`` says so, equal for equal keys."""
    above = symbols[starts]
    _, names = np.unique(keys, return_inverse=True)
    above[joins] = free + names
    return above


def grammar(words: np.ndarray, ends: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar of ``words``; symbols marked by ``ends`` are never joined to others."""
    levels = [Level(words)]
    free, turn = int(words.max(initial=0)) + 1, 0
    while True:
        below = levels[-1]
        s, n = below.symbols, len(below.symbols)
        same = s[1:] == s[:-1]
        if same.any():
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes = np.diff(np.append(starts, n))
            joins = sizes > 1
            above = _named(s, joins, s[starts[joins]] << 32 | sizes[joins], starts, free)
            blocks = True
        else:
            inner = ~ends[1:] & ~ends[:-1]
            if not inner.any():
                return levels
            # classes by a bit of the scrambled symbol, another one each time
            turn += 1
            scrambled = (s.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            left = (scrambled >> np.uint64(61)) & np.uint64(1) == 0
            forth, back = inner & left[:-1] & ~left[1:], inner & ~left[:-1] & left[1:]
            pairs = forth if forth.sum() >= back.sum() else back
            if not pairs.any():
                continue
            starts = np.flatnonzero(np.concatenate([[True], ~pairs]))
            joins = np.append(pairs, False)[starts]
            at = starts[joins]
            above = _named(s, joins, s[at] << 32 | s[at + 1], starts, free)
            blocks = False
        free = int(above.max()) + 1 if joins.any() else free
        below.blocks = blocks
        below.parent = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        levels.append(Level(above, first=np.append(starts, n)))
        ends = ends[starts]


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray, onward: bool) -> np.ndarray:
    """How many words agree from places ``a`` and ``b`` on, to the right or to the left.

    The places differ, and both ways lead to a word that no other place has.
    """
    begun = a

    def step(level: Level, first, a, b) -> np.ndarray:
        """Words of a block at once, else one symbol."""
        if not level.blocks:
            return np.ones(len(a), dtype=np.int64)
        pa_, pb = level.parent[a], level.parent[b]
        if onward:
            return np.minimum(first[pa_ + 1] - a, first[pb + 1] - b)
        return np.minimum(a - first[pa_], b - first[pb]) + 1

    sign = 1 if onward else -1
    ask = np.arange(len(a))
    parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for height, level in enumerate(levels):
        out = []
        if height + 1 == len(levels):
            parted.append((ask, a, b))
            break
        first, above = levels[height + 1].first, levels[height + 1].symbols
        up = []
        while len(ask):
            pa_, pb = level.parent[a], level.parent[b]
            if onward:
                border = (first[pa_] == a) & (first[pb] == b)
            else:
                border = (first[pa_ + 1] - 1 == a) & (first[pb + 1] - 1 == b)
            agree = above[pa_] == above[pb]
            climbs = border & agree
            up.append((ask[climbs], pa_[climbs], pb[climbs]))
            goes = ~border & (level.symbols[a] == level.symbols[b])
            stops = ~climbs & ~goes
            out.append((ask[stops], a[stops], b[stops]))
            ask, a, b = ask[goes], a[goes], b[goes]
            moved = step(level, first, a, b) * sign
            a, b = a + moved, b + moved
        parted.append(tuple(np.concatenate(x) for x in zip(*out)) if out else (ask, a, b))
        ask, a, b = (np.concatenate(x) for x in zip(*up)) if up else (ask, a, b)
        if not len(ask):
            break
    ask = a = b = np.empty(0, dtype=np.int64)
    for height in range(len(parted) - 1, -1, -1):
        level = levels[height]
        ask, a, b = (np.concatenate(x) for x in zip((ask, a, b), parted[height]))
        going = np.arange(len(ask))
        first = levels[height + 1].first if height + 1 < len(levels) else None
        while len(going):
            going = going[level.symbols[a[going]] == level.symbols[b[going]]]
            moved = step(level, first, a[going], b[going]) * sign
            a[going] += moved
            b[going] += moved
        if height:
            a, b = (level.first[x] if onward else level.first[x + 1] - 1 for x in (a, b))
    found = np.empty(len(begun), dtype=np.int64)
    found[ask] = (a - begun[ask]) * sign
    return found


def runs(words: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in ``words``, by start, then period.

    ``ends`` marks the words around the texts, each different from all others; ``longest`` is the number of
    words of the longest text. Periods are taken from short to long, doubling; a candidate inside of a
    known run whose period divides its own can only give that run again and is not asked.
    """
    levels = grammar(words, ends)
    n = len(words)
    within = np.zeros(n, dtype=np.int64)
    until = np.zeros(n, dtype=np.int64)
    found: list[np.ndarray] = []
    low, most = 1, longest // LEAST_PERIODS
    while low <= most:
        high = min(2 * low, most + 1)
        places, periods = [], []
        for q in range(low, high):
            grid = 3 * q
            hits = np.flatnonzero(words[0 : n - q : grid] == words[q:n:grid]) * grid
            if len(hits):
                known = within[hits]
                hits = hits[(known == 0) | (until[hits] <= hits + q) | (q % np.maximum(known, 1) != 0)]
                places.append(hits)
                periods.append(np.full(len(hits), q))
        low = high
        i, q = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (places, periods))
        fresh = [np.empty((0, 3), dtype=np.int64)]
        for at in range(0, len(i), ASKED):
            a, p = i[at : at + ASKED], q[at : at + ASKED]
            onward = extension(levels, a, a + p, True)
            back = extension(levels, a - 1, a + p - 1, False)
            size = back + onward + p
            good = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            fresh.append(np.stack([a[good] - back[good], size[good], p[good]], axis=1))
        fresh = np.unique(np.concatenate(fresh), axis=0)
        found.append(fresh)
        for start, size, period in fresh[np.argsort(fresh[:, 1], kind="stable")].tolist():
            if size > until[start] - start:
                within[start : start + size] = period
                until[start : start + size] = start + size
    rows = np.concatenate([np.empty((0, 3), dtype=np.int64), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # of equal stretches the least period is the run's
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[keep]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def texts_with_runs(texts: list[bytes | None]) -> pa.Array:
    """(n_words, runs, collapsed) of every text."""
    split = [t.split() if t else [] for t in texts]
    number: dict[bytes, int] = {}
    sizes = np.array([len(ws) for ws in split], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # a text's first word, after the mark before it
    words = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int64)
    ends = np.zeros(len(words), dtype=bool)
    ends[np.append(starts - 1, len(words) - 1)] = True
    words[~ends] = [number.setdefault(w, len(number)) for ws in split for w in ws]
    words[ends] = len(number) + np.arange(len(sizes) + 1)
    start, length, period = runs(words, ends, int(sizes.max(initial=0)))
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    kept = np.cumsum(dropped) == 0
    owner = np.searchsorted(starts, start, side="right") - 1
    some = set(owner.tolist())
    collapsed = [
        b" ".join([w for w, k in zip(ws, kept[at : at + len(ws)].tolist()) if k] if d in some else ws)
        for d, (ws, at) in enumerate(zip(split, starts.tolist()))
    ]
    offsets = np.searchsorted(owner, np.arange(len(split) + 1))
    parts = {"start": start - starts[owner], "length": length, "period": period}
    structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts.values()], list(parts))
    return pa.StructArray.from_arrays(
        [
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        ["n_words", "runs", "collapsed"],
    )


def sliced(texts: list[bytes | None], budget: int) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or b"") + 1
        if size >= budget:
            yield part
            part, size = [], 0
    if part:
        yield part


def periodic(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = SLICE) -> DataFrame:
    """(key, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` are (start, length, period), by start, then period: stretches whose words ``period`` apart
    are equal, with no smaller period, of at least ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words,
    that neither neighbouring word extends. ``collapsed`` is the text without the words that a run has
    beyond its first period, words joined by a blank. NULL and texts without a word have no words, no
    runs and an empty ``collapsed``. Rows with equal keys stay apart, keys are not looked at and may be
    NULL; an empty table gives no rows; other columns are not looked at. Nothing is shuffled, and keys stay
    in their Arrow type.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            at = 0
            for part in sliced(texts, budget):
                columns = texts_with_runs(part).flatten()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns], NAMES)
                at += len(part)

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    shape = StructType([StructField("key", docs.schema[key].dataType), *FOUND])
    return rows.mapInArrow(found, shape).withColumnRenamed("key", key)


def planted(key: Column, text: Column) -> Column:
    """``text`` with a period put into one in ten: where crc32 of the key's digits is divisible by ten, the
    words from a place on repeat a stretch. Both follow from the same number; NULL keys change nothing."""
    crc = F.crc32(key.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def changed(given: Column) -> Column:
        n = F.size(given)
        g = F.floor(crc / 10)

        def repeated(bounds: Column) -> Column:
            a, p = bounds["a"], bounds["p"]
            other = F.transform(given, lambda w, i: F.when(i < a, w).otherwise(F.get(given, a + (i - a) % p)))
            return F.array_join(other, " ")

        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), repeated)).otherwise(text)

    return F.when(crc % 10 == 0, let(words, changed)).otherwise(text)
