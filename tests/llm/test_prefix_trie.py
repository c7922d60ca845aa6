"""The trie against a plain one, from planted conversations, and its query against SQL."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import oracle
from parley.llm import prefix_trie, queries


def plain(sequences):
    """Rows of the trie of {conv: tuple of (role, text)}."""
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    rows = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        row = (min(convs), len(node), parent, len(convs), children.get(node, 0), leaves[node], saved[node], digest)
        rows.append(row)
    return sorted(rows, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def turns_of(seed, convs, most):
    """Conversations with shared beginnings, exact copies and prefixes of others."""
    chance = random.Random(seed)
    rows = []
    for conv in convs:
        said = []
        for _ in range(chance.randint(1, most)):
            word = chance.choice(["a", "bb", "ccc", ""]) if chance.random() < 0.8 else str(chance.random())
            said.append((chance.choice(["user", None]) if chance.random() < 0.3 else "x", chance.choice([word, None, "é😀"])))
        if chance.random() < 0.3:
            said = [("x", "a")] * len(said)
        rows += [(conv, None if at == 0 and chance.random() < 0.2 else at, r, t) for at, (r, t) in enumerate(said)]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [4096, 3])
def test_trie_against_plain(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "PIECE", size)
    monkeypatch.setattr(prefix_trie, "LISTED", 2)
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", 10)
    rows = turns_of(size, [*range(-5, 40), 2**53 + 1, 2**53 + 3], 11)
    sequences = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        sequences[conv].append((role or "", text or ""))
    sequences = {c: tuple(s) for c, s in sequences.items()} | {77: ()}
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(prefix_trie.numbered(turns), spark.createDataFrame([(c,) for c in sequences], "conv long"))
    assert collected(got) == plain(sequences)


def test_query_against_plain(spark, tmp_path):
    rows = turns_of(5, [*range(100, 125), 3, 5, *range(200, 206), 400], 9)
    rows += [(207, 0, "x", "a"), (None, 0, "user", "nobody's"), (400, 90, "x", "z"), (400, 90, "x", "z")]
    os.makedirs(tmp_path / "conversations.parquet")
    columns = dict(zip(("conv_id", "turn", "role", "text"), (list(c) for c in zip(*rows))))
    columns |= {name: [1] * len(rows) for name in ("conv", "place", "a", "size", "piece", "h", "_part", "_step")}
    pq.write_table(pa.table(columns), tmp_path / "conversations.parquet" / "a.parquet")
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    rebuilt = {}
    for conv, said in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = tuple(own.get(conv - conv % 100, [])[:h] + said[h:])
    assert any(not said for said in rebuilt.values()) and any(s != tuple(own[c]) for c, s in rebuilt.items())
    assert collected(queries.op13_prefix_trie(spark, str(tmp_path))) == plain(rebuilt)


def test_long_and_equal_conversations(spark):
    """One conversation has a third of all turns, another third starts alike, and many are copies."""
    long = spark.range(9000).selectExpr("7 as conv_id", "id as turn", "'r' as role", "'t' || id as text")
    like = spark.range(3000).selectExpr("10 + id as conv_id", "0 as turn", "'r' as role", "'t0' as text")
    rows = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(prefix_trie.numbered(long.unionAll(like))).collect()}
    assert len(rows) == 9001
    assert rows[7, 1]["n_convs"] == 3001 and rows[7, 2]["n_convs"] == 1 and rows[7, 0]["saved_tokens"] == 6000
    ends = ",".join(str(10 + i) for i in range(3000))
    assert rows[7, 1]["ends_sha256"] == hashlib.sha256(ends.encode()).hexdigest()
    assert {rows[7, d]["n_leaves"] for d in range(9001)} == {1} and rows[7, 9000]["parent_conv_id"] == 7


def test_no_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(*prefix_trie.spliced(prefix_trie.numbered(empty))).collect() == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    sql = queries.ORACLES["op13_prefix_trie"]
    assert oracle.difference(spark, oracle.connect(folder), folder, queries.op13_prefix_trie, sql) is None
