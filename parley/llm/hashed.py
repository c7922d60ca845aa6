"""Hashed n-gram features of whole texts, and what two trained classifiers share on Spark.

Features of a text are sorted distinct numbers below ``1 << bits``. All hashing is arithmetic on
whole arrays, so a text of any length costs a few passes over its characters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from parley.llm.common import beside, remainder, unit

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = 0x100000001B3


def _fold(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Mix 64-bit numbers and keep ``bits`` of them."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD
    return ((mixed ^ (mixed >> np.uint64(32))) * _ODD >> np.uint64(64 - bits)).astype(np.uint32)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(found) if found else np.empty(0, dtype=np.uint32)
    flat.sort()
    return flat[np.flatnonzero(np.diff(flat, prepend=flat[:1] + np.uint32(1)))] if len(flat) else flat


def char_ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Distinct hashed character n-grams of the lower-cased text, blanks evened, with a blank at each end."""
    even = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(even.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    known = {1: codes * np.uint32(0x85EBCA6B)}

    def of(n: int) -> np.ndarray:
        """Hashes of n characters from those of a power of two and of the rest."""
        if n not in known:
            head = 1 << (n - 1).bit_length() - 1
            first, rest = of(head), of(n - head)
            power = np.uint32(pow(0x01000193, n - head, 1 << 32))
            known[n] = first[: len(codes) - n + 1] * power + rest[head:]
        return known[n]

    found = []
    for n in orders:
        if n <= len(codes):
            mixed = of(n) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
            found.append(mixed >> np.uint32(32 - bits))
    return _distinct(found)


# kinds of bytes: 0 blank, 1 letter or digit or part of a longer character, 2 mark
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1


def _powers(length: int, factor: int) -> np.ndarray:
    steps = np.full(length, factor & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_TABLE: dict[str, np.ndarray] = {}


def word_ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Distinct hashed n-grams of tokens, which are runs of letters and digits or runs of marks.

    The hash of a token is a difference of running sums, made independent of its place by the
    inverse of the power there.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = _KIND[raw]
    edge = np.flatnonzero(np.diff(kinds, prepend=np.uint8(0), append=np.uint8(0)))
    starts = edge[:-1] if len(edge) else edge
    ends = edge[1:] if len(edge) else edge
    inside = kinds[starts] > 0 if len(starts) else np.empty(0, dtype=bool)
    starts, ends = starts[inside], ends[inside]
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _MULTIPLIER), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(len(raw), _INVERSE)[starts]
        found, rolling = [_repetition(hashes, bits)], np.zeros(len(hashes), dtype=np.uint64)
        for n in range(1, max(orders) + 1):
            if n > len(hashes):
                break
            rolling = rolling[: len(hashes) - n + 1] * _ODD + hashes[n - 1 :]
            if n in orders:
                found.append(_fold(rolling + np.uint64(n << 40), bits))
    return _distinct(found)


def _repetition(hashes: np.ndarray, bits: int) -> np.ndarray:
    """N-grams that only say "again": how often a token follows itself, how many pairs come back.

    Both as a share of the tokens, in steps of halves from 1/2 to 1/128.
    """
    pairs = hashes[:-1] * _ODD + hashes[1:]
    shares = (np.count_nonzero(hashes[:-1] == hashes[1:]), len(pairs) - len(np.unique(pairs)))
    steps = [int(np.clip(7 + np.log2(max(s, 1e-9) / len(hashes)), -1, 6)) + 1 for s in shares]
    marks = [(kind << 48) + step for kind, last in enumerate(steps, 1) for step in range(1, last + 1)]
    return _fold(np.array(marks, dtype=np.uint64), bits)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learn: Column,
    rows: int,
    seed: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """About ``rows`` labelled texts (t, label) that may be learned from, chosen by a hash of the key.

    Keys with several labels take the highest. The share to take comes from a count of the labels,
    so the sample is bounded however large the tables are.
    """
    known = labels.filter(learn & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("label"))
    known = known.groupBy("k").agg(F.max("label").cast("int").alias("label"))
    total = known.count()
    share = min(1.0, rows / total) if total else 0.0
    # at most about ``rows`` pairs of numbers, whatever the size of the tables
    chosen = F.broadcast(known.filter(unit(F.col("k"), seed=seed) < share))
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k").select("t", "label")


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], bytes]) -> bytes:
    """Fit on a bounded sample in one task and return the model as bytes."""

    def run(frames):
        parts = list(frames)
        rows = pd.concat(parts) if parts else pd.DataFrame({"t": [], "label": []})
        # the order of rows in a shuffle varies between runs; a fit must not
        rows = rows.sort_values(["t", "label"], na_position="first")
        texts = rows["t"].fillna("").tolist()
        yield pd.DataFrame({"model": [fit(texts, rows["label"].to_numpy(dtype=np.float64))]})

    found = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit([], np.empty(0))


def scored(
    docs: DataFrame,
    model,
    score: Callable[[bytes, list[str]], np.ndarray],
    by: int,
    held: int,
    threshold: float,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, held_out, score, predicted) for every row, the model being a broadcast variable."""
    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(score(model.value, [t or "" for t in texts]), pa.float64())]

    held_out = F.coalesce(remainder(F.col(key), by) == held, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("t"))
    done = beside(rows, "t", [StructField("score", DoubleType())], run)
    return done.select(
        F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
