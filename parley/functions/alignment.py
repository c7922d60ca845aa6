"""Row-wise comparisons of two token lists that SQL expressions cannot do in good time.

Each works on one row at a time inside an Arrow batch; no row depends on another.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 512


def common_subsequence(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004)."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        match = row & places.get(token, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b)], dtype="int32")


ORDERS = (1, 2, 3, 4)


def shared_grams(a, b) -> list[int]:
    """Per order, how many n-grams two lists share, each as often as in the list with fewer."""
    shared = []
    for n in ORDERS:
        counts = [Counter(zip(*(side[i:] for i in range(n)))) for side in (a, b)]
        shared.append(sum((counts[0] & counts[1]).values()))
    return shared


@F.pandas_udf(T.StructType([T.StructField(f"m{n}", T.IntegerType()) for n in ORDERS]))
def clipped_matches(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [shared_grams(h.tolist(), r.tolist()) for h, r in zip(hyp, ref)]
    return pd.DataFrame(rows, columns=[f"m{n}" for n in ORDERS], dtype="int32")


def best_match_f1(similar, left_counts, right_counts) -> float:
    """F1 of the mean best similarity from either side.

    ``similar(i, j)`` gives the similarity block of two slices of distinct tokens.
    """
    n, m = len(left_counts), len(right_counts)
    if n == 0 or m == 0:
        return 0.0
    best_left, best_right = np.zeros(n), np.zeros(m)
    for i in range(0, n, BLOCK):
        for j in range(0, m, BLOCK):
            block = similar(slice(i, i + BLOCK), slice(j, j + BLOCK))
            best_left[i : i + BLOCK] = np.maximum(best_left[i : i + BLOCK], block.max(axis=1))
            best_right[j : j + BLOCK] = np.maximum(best_right[j : j + BLOCK], block.max(axis=0))
    precision = float(best_left @ left_counts) / float(left_counts.sum())
    recall = float(best_right @ right_counts) / float(right_counts.sum())
    return 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def trigram_profile(token: str) -> tuple[list[str], list[int]]:
    padded = f" {token} "
    counts = Counter(padded[i : i + 3] for i in range(len(padded) - 2))
    return list(counts), list(counts.values())


def trigram_match(hyp, ref, profiles: dict) -> float:
    """Soft match where two tokens are as similar as their character trigrams.

    ``profiles`` remembers the trigrams of the tokens met so far.
    """
    sides = [Counter(hyp), Counter(ref)]
    for token in (*sides[0], *sides[1]):
        if token not in profiles:
            profiles[token] = trigram_profile(token)
    columns: dict[str, int] = {}
    for token in (*sides[0], *sides[1]):
        for gram in profiles[token][0]:
            columns.setdefault(gram, len(columns))

    def entries(side: Counter):
        """Row, column and value of every trigram of a side, and where each token's entries start."""
        found = [profiles[token] for token in side]
        sizes = [len(grams) for grams, _ in found]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        rows = np.repeat(np.arange(len(found)), sizes)
        places = np.fromiter((columns[g] for grams, _ in found for g in grams), int, starts[-1])
        values = np.fromiter((c for _, counts in found for c in counts), float, starts[-1])
        norms = np.bincount(rows, values * values, len(found))
        return rows, places, values, starts, norms

    data = [entries(side) for side in sides]

    def dense(side: int, part: slice) -> np.ndarray:
        rows, places, values, starts, norms = data[side]
        stop = min(part.stop, len(norms))
        inside = slice(starts[part.start], starts[stop])
        table = np.zeros((stop - part.start, len(columns)))
        table[rows[inside] - part.start, places[inside]] = values[inside]
        return table

    def similar(left: slice, right: slice) -> np.ndarray:
        dots = dense(0, left) @ dense(1, right).T
        return dots / np.sqrt(np.outer(data[0][4][left], data[1][4][right]))

    counts = [np.array(list(side.values()), dtype=float) for side in sides]
    return best_match_f1(similar, *counts)


@F.pandas_udf(T.DoubleType())
def trigram_match_f1(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    profiles: dict = {}
    return pd.Series([trigram_match(h, r, profiles) for h, r in zip(hyp, ref)], dtype="float64")


def vector_table(vectors: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list array as rows of length 1, or 0 where there is none."""
    sizes = pc.list_value_length(vectors)
    known = sizes.is_valid().to_numpy(zero_copy_only=False)
    sizes = sizes.drop_null().to_numpy()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    table = np.zeros((len(vectors), sizes.max(initial=0) if len(sizes) else 1))
    if (sizes == table.shape[1]).all():
        table[known] = values.reshape(len(sizes), table.shape[1])
    else:
        for i, vector in zip(np.flatnonzero(known), np.split(values, np.cumsum(sizes)[:-1])):
            table[i] = vector
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norms, out=np.zeros_like(table), where=norms > 0)


def vector_match(hyp: tuple[pa.Array, pa.Array], ref: tuple[pa.Array, pa.Array]) -> float:
    """Soft match over the ``(counts, vectors)`` of two sides; tokens without a vector match nothing."""
    if len(hyp[0]) == 0 or len(ref[0]) == 0:
        return 0.0
    (left_counts, left), (right_counts, right) = [
        (counts.to_numpy().astype(float), vector_table(vectors)) for counts, vectors in (hyp, ref)
    ]
    if left.shape[1] != right.shape[1]:
        return 0.0
    return best_match_f1(lambda i, j: left[i] @ right[j].T, left_counts, right_counts)
