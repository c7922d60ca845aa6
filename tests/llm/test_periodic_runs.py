"""Periodic runs against a plain search over all periods, in the operator and in its query."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from parley.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """(start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(chance, count):
    for _ in range(count):
        n = chance.choice([0, 1, 5, 6, 20, 60, 200])
        letters = "abcdefghijklmnopqrstuvwxyzäöü"[: chance.choice([1, 2, 3, 6, 29])]
        words = [chance.choice(letters) for _ in range(n)]
        if words and chance.random() < 0.6:
            a = chance.randrange(n)
            p = 1 + (n - a) // chance.randint(3, 9)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        yield words


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_plain_search(seed):
    chance = random.Random(seed)
    texts = list(some_texts(chance, 80))
    for at in range(0, len(texts), 16):
        part = texts[at : at + 16]
        for words, row in zip(part, periodic_runs.texts_with_runs([" ".join(w).encode() for w in part]).to_pylist()):
            want = plain(words)
            assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == want
            assert row["n_words"] == len(words) and row["collapsed"] == collapsed(words, want)


def test_extensions_against_plain_comparison():
    chance = np.random.default_rng(3)
    words = np.concatenate([[90], chance.integers(0, 2, 400), np.zeros(50, dtype=int), [91]]).astype(np.int64)
    ends = words >= 90
    levels = periodic_runs.grammar(words, ends)
    assert len(levels[-1].symbols) == 3
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, 451), np.arange(1, 451)))
    a, b = a[a < b], b[a < b]
    for onward in (True, False):
        got = periodic_runs.extension(levels, a, b, onward)
        for x, y, n in list(zip(a.tolist(), b.tolist(), got.tolist()))[::7]:
            step, m = (1 if onward else -1), 0
            while words[x + step * m] == words[y + step * m]:
                m += 1
            assert m == n


def test_long_texts_are_searched_whole():
    words = [f"w{i}" for i in range(50_000)] + ["x", "y", "z"] * 3_000 + ["x"]
    row = periodic_runs.texts_with_runs([" ".join(words).encode()])[0].as_py()
    assert row["runs"] == [{"start": 50_000, "length": 9_001, "period": 3}]
    same = periodic_runs.texts_with_runs([b"a " * 60_000])[0].as_py()
    assert same["runs"] == [{"start": 0, "length": 60_000, "period": 1}] and same["collapsed"] == "a"


def test_rows_nulls_ties_and_extra_columns(spark):
    big = 2**53
    rows = [(None, "a " * 9), (big + 1, None), (big + 3, ""), (5, " \n"), (5, "b c " * 4), (5, "b c " * 4)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, runs int, _0 string, found int")
    got = periodic_runs.periodic(docs, budget=10).collect()
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in got) == sorted(
        [(0, 1, "a"), (big + 1, 0, ""), (big + 3, 0, ""), (5, 0, ""), (5, 1, "b c"), (5, 1, "b c")]
    )
    assert periodic_runs.periodic(docs.filter("false")).collect() == []


def test_query_against_plain_search(spark, tmp_path):
    chance = random.Random(8)
    keys = [None, *range(-3, 90), 2**53 + 1, 2**60 + 7]
    texts = [None, "", " \t"] + ["\n".join(w) for w in some_texts(chance, len(keys) - 3)]
    os.makedirs(tmp_path / "documents.parquet")
    pq.write_table(
        pa.table({"doc_id": pa.array(keys, pa.int64()), "text": texts}), tmp_path / "documents.parquet" / "a.parquet"
    )
    got = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(keys)
    changed = 0
    for key, text in zip(keys, texts):
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(key).encode()), len(words)
        if key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs = plain(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = {
            "doc_id": key,
            "n_runs": len(runs),
            "start": best and best[0],
            "length": best and best[1],
            "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        }
        assert got[key] == want
    assert changed > 4
