"""States, problems, places and messages of tool links against a plain loop."""

import json
import random
import re

from parley.llm import tool_links

TOOLS = {"look": {"n": ("integer", True), "q": ("string", False)}, "find": {"q": ("string", True)}}
CALLS = "conv long, id string, at long, tool string, arguments string, needs array<string>"
RESULTS = "conv long, id string, at long, content string"
ARGUMENTS = ['{"n":1}', '{"n":"x"}', '{"q":"z"}', "{", '{"q":"z","u":1}', None]


def plain(calls, results):
    """(conv, id, at, state, level) of every row."""
    rows, firsts, answers = [], {}, {}
    def order(values):
        return [(v is not None, v if v is not None else "") for v in values]

    for call in sorted(calls, key=lambda c: (c[2], order(c[3:5]), order(c[5]))):
        key = call[:2]
        if None in key:
            rows.append((*key, call[2], "unanswered"))
        elif key in firsts:
            rows.append((*key, call[2], "repeated"))
        else:
            firsts[key] = call
    for result in sorted(results, key=lambda r: (r[2], order(r[3:]))):
        key = result[:2]
        if None in key:
            rows.append((*key, result[2], "orphan"))
        elif key in answers:
            rows.append((*key, result[2], "repeated"))
        else:
            answers[key] = result
    level, left = {}, dict(firsts)
    while True:
        ready = [
            key for key, call in left.items()
            if all((key[0], n) in level or (key[0], n) not in firsts for n in call[5])
        ]
        if not ready:
            break
        for key in ready:
            known = [level[key[0], n] for n in left[key][5] if (key[0], n) in level]
            level[key] = 1 + max(known, default=-1)
        for key in ready:
            del left[key]
    for key, call in firsts.items():
        state = "cycle" if key not in level else "linked" if key in answers else "unanswered"
        rows.append((*key, call[2], state))
    rows += [(*key, r[2], "orphan") for key, r in answers.items() if key not in firsts]
    return rows, level


def test_states_against_a_plain_loop(spark):
    chance = random.Random(4)
    calls, results = [], []
    for conv in [*range(12), None]:
        names = [f"c{i}" for i in range(9)] + [None]
        for at in range(14):
            needs = chance.sample([n for n in names if n], chance.choice([0, 0, 1, 2, 3]))
            call = (conv, chance.choice(names), at, chance.choice(["look", "find", "none"]), chance.choice(ARGUMENTS), needs)
            calls += [call] * chance.choice([1, 1, 1, 2])
            results.append((conv, chance.choice([*names, "other"]), at, chance.choice(["ok", "", None])))
    want, levels = plain(calls, results)
    got = tool_links.linked(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), TOOLS).collect()
    assert len(got) == len(want)
    have = sorted(str((r["conv"], r["id"], r["state"])) for r in got)
    assert have == sorted(str((w[0], w[1], w[3])) for w in want)
    states = {r["state"] for r in got}
    assert states == {"linked", "unanswered", "orphan", "cycle", "repeated"}
    rank = {"linked": 0, "unanswered": 0, "cycle": 0, "orphan": 1, "repeated": 2}
    by_conv = {}
    for r in got:
        by_conv.setdefault(r["conv"], []).append(r)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
        assert [rank[r["state"]] for r in rows] == sorted(rank[r["state"]] for r in rows)
        if conv is not None:
            order = [levels.get((conv, r["id"]), 1 << 62) for r in rows if rank[r["state"]] == 0 and r["id"] is not None]
            assert order == sorted(order)
    for r in got:
        told = json.loads(r["message"])
        assert told["state"] == r["state"] and told.get("id") == r["id"]
        assert json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]


def test_no_python_runs(spark):
    calls = spark.createDataFrame([(1, "a", 1, "look", '{"n":1}', ["b"]), (1, "b", 2, "find", "{", [])], CALLS)
    rows = tool_links.linked(calls, spark.createDataFrame([(1, "a", 3, "ok")], RESULTS), TOOLS)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Arrow|Pandas|Python", plan), plan
    assert [r["id"] for r in rows.orderBy("place").collect()] == ["b", "a"]
