import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.operators import context as cx
from parley.operators import positions


def test_position_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice("abc"), rng.choice("xy"), i, rng.random() < 0.4) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, s string, k int, c boolean").repartition(5)
    assert df.repartitionByRange("g", "k").select(F.spark_partition_id()).distinct().count() > 3
    got = positions.with_position(df, ["g"], ["k"], "n", finer=(["s"], "m")).collect()
    seen, finer = {}, {}
    for r in sorted(got, key=lambda r: r["k"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        finer[r["g"], r["s"]] = finer.get((r["g"], r["s"]), 0) + 1
        assert (r["n"], r["m"]) == (seen[r["g"]], finer[r["g"], r["s"]])
    assert len(got) == 900
    counted = positions.with_position(df, [], ["k"], "n", counted=F.col("c")).collect()
    total = 0
    for r in sorted(counted, key=lambda r: r["k"]):
        total += r["c"]
        assert r["n"] == total


def test_position_groups_may_be_null(spark):
    df = spark.createDataFrame([(None, i) for i in range(40)] + [("a", i) for i in range(5)], "g string, k int")
    got = positions.with_position(df, ["g"], ["k"], "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in got) and len(got) == 45


@pytest.mark.parametrize("kind", ["string", "long", "double", "struct<x:int>", "none"])
def test_positions_of_many_groups_and_parts(spark, kind):
    """Groups within a part, over a border, over several parts; NULL and NaN groups; no group at all."""
    rng = random.Random(len(kind))
    makes = {
        "string": lambda g: None if g == 0 else f"g{g}",
        "long": lambda g: None if g == 0 else 2**53 + g,
        "double": lambda g: None if g == 0 else float("nan") if g == 1 else g / 2,
        "struct<x:int>": lambda g: None if g == 0 else (None if g == 1 else g,),
        "none": lambda g: 0,
    }
    sizes = [1, 2, 40, 400, 3, 1, 250, 7]
    rows = [(makes[kind](g), i, rng.random() < 0.5, g) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"g {'int' if kind == 'none' else kind}, k int, c boolean, own int").repartition(7)
    group, order = ([], ["g", "k", "own"]) if kind == "none" else (["g"], ["k"])
    for counted in (None, F.col("c")):
        got = positions.with_position(df, group, order, "n", counted=counted).collect()
        seen = {}
        for r in sorted(got, key=lambda r: (0 if kind == "none" else r["own"], r["k"], r["own"])):
            own = 0 if kind == "none" else r["own"]
            seen[own] = seen.get(own, 0) + (1 if counted is None else r["c"])
            assert r["n"] == seen[own]
        assert len(got) == len(rows)
    assert positions.with_position(df.filter("false"), group, order, "n").collect() == []


def test_positions_move_rows_once(spark, capsys):
    """After the checkpoint of the ranges nothing is shuffled."""
    df = spark.range(1000).selectExpr("id % 3 as g", "id as k")
    numbered = positions.with_position(df, ["g"], ["k"], "n")
    numbered.collect()
    capsys.readouterr()
    numbered.explain()
    assert "Exchange" not in capsys.readouterr().out


def _conversation(conv, n, start=0):
    roles = ["system"] if conv % 2 == 0 else []
    roles += ["assistant" if i % 3 == 0 else "user" for i in range(n)]
    return [(conv, start + t, role, f"c{conv} t{t}") for t, role in enumerate(roles)]


def test_turn_index_across_pieces(spark):
    rows = _conversation(0, 47) + _conversation(1, 30) + _conversation(2, 1) + _conversation(3, 12, start=90)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = positions.with_turn_index(df, cell=7).collect()
    want = {}
    for conv in range(4):
        mine = [r for r in rows if r[0] == conv]
        said = [r for r in mine if r[2] != "system"]
        situation = next((r[3] for r in mine if r[2] == "system"), None)
        for i, r in enumerate(said):
            want[conv, r[1]] = (i, situation)
    assert {(r["conv_id"], r["turn"]): (r["turn_idx"], r["situation"]) for r in got} == want
    replies = positions.with_turn_index(df, counted=F.col("role") == "assistant", cell=7).collect()
    assert sorted(r["turn_idx"] for r in replies if r["conv_id"] == 0) == list(range(16))


SCHEMA = "conv_id long, turn_idx int, speaker string, text string, strategy string, situation string"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (1, 0, "sys", "Hello", "Question", None),
        (1, 1, "sys", " ", "Others", None),
        (1, 2, "usr", "I am sad", None, None),
        (1, 3, "bot", "beep", None, None),
        (1, 4, "sys", None, "Information", None),
        (1, 5, "sys", "Try this", "Others", None),
    ]
    rows += [(2, i, "usr" if i % 2 else "sys", f"u{i}", "Question", "s") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


def _said(rows, i):
    r = rows[i]
    text = r["text"] or ""
    return f"[supporter] [{r['strategy']}] {text}" if r["speaker"] == "sys" else f"[seeker] {text}"


@pytest.mark.parametrize("cell", [6, 4096])
def test_context_against_a_plain_loop(spark, talk, monkeypatch, cell):
    monkeypatch.setattr(cx, "CELL", cell)
    source = {(r["conv_id"], r["turn_idx"]): r for r in talk.collect()}
    got = cx.evaluation_examples(talk).collect()
    assert len(got) == 24
    for r in got:
        rows = {i: source[r["conv_id"], i] for i in range(r["turn_idx"] + 1)}
        window = [_said(rows, j) for j in range(max(0, r["turn_idx"] - 5), r["turn_idx"])]
        t1, t2 = " ".join(window[:-1]), (window[-1] if window else "<START>")
        assert (r["context_t1"], r["context_t2"]) == (t1, t2)
        assert r["context"] == f"{t1} {t2}".strip() and r["current_turn"] == t2.strip()
    wide = cx.with_recent(talk, 5).select("conv_id", "turn_idx", cx.context_of(F.col("recent"), 2).alias("c")).collect()
    narrow = cx.with_recent(talk, 2).select("conv_id", "turn_idx", cx.context_of(F.col("recent"), 2).alias("c")).collect()
    assert sorted(wide) == sorted(narrow)


@pytest.mark.parametrize("cell", [4, 9, 4096])
def test_kept_pieces_against_plain_lists(spark, cell):
    """Gaps in turns, pieces of a single row, rows without text: the same as without pieces."""
    chance = random.Random(cell)
    rows = []
    for conv in range(6):
        turns = sorted(chance.sample(range(300), 25 if conv else 60))
        for t in turns:
            role = "system" if chance.random() < 0.2 else chance.choice(["assistant", "user"])
            rows.append((conv, t, role, None if chance.random() < 0.1 else f"c{conv} t{t}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = positions.with_turn_index(df, cell=cell, keep=True).withColumn("strategy", F.lit("Others"))
    kept = kept.withColumn("speaker", F.when(F.col("role") == "assistant", "sys").otherwise("usr"))
    recent = {(r["conv_id"], r["turn"]): r for r in cx.with_recent(kept, 3).collect()}
    lines = {(r["conv_id"], r["turn"]): r["lines"] for r in cx.with_history(kept, F.col("text"), "lines").collect()}
    assert "_piece" not in cx.with_recent(kept, 3).columns
    for conv in range(6):
        said = [r for r in rows if r[0] == conv and r[2] != "system"]
        for i, (_, turn, _, _) in enumerate(said):
            tags = ["[supporter] [Others] " if r[2] == "assistant" else "[seeker] " for r in said]
            want = [tags[j] + (said[j][3] or "") for j in range(max(0, i - 3), i)]
            assert recent[conv, turn]["recent"] == want and recent[conv, turn]["turn_idx"] == i
            assert lines[conv, turn] == [r[3] for r in said[:i] if r[3] is not None]
    assert len(recent) == len(lines) == sum(r[2] != "system" for r in rows)


def scans(df, capsys):
    """How often the plan that ran read files."""
    df.collect()
    capsys.readouterr()
    df.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan
    return plan.count("FileScan")


def test_conversations_are_read_once(spark, capsys):
    """Where every conversation fits a piece, the branches for the seams fall away at run time."""
    from parley.plans import context_queries, matching_queries

    folder = "/root/testdata/sf0.001"
    assert scans(context_queries.ctx_window5(spark, folder), capsys) == 1
    assert scans(context_queries.ctx_transcript(spark, folder), capsys) <= 2
    assert scans(matching_queries.build_prompts(spark, folder), capsys) <= 2


def test_window_width_is_checked(talk):
    with pytest.raises(ValueError, match="1 to 5"):
        cx.with_recent(talk, 6)


@pytest.mark.parametrize("cell", [3, 256])
def test_history_against_a_plain_loop(spark, talk, cell):
    source = {(r["conv_id"], r["turn_idx"]): r for r in talk.collect()}
    lines = cx.with_history(talk, cx.labelled_line(), "lines", cell).collect()
    names = {"sys": "Supporter", "usr": "Seeker"}
    assert len(lines) == len(source)
    for r in lines:
        earlier = [source[r["conv_id"], j] for j in range(r["turn_idx"])]
        want = [f"{names.get(e['speaker'], e['speaker'])} : {e['text'].strip()}" for e in earlier if (e["text"] or "").strip()]
        assert r["lines"] == want


def test_transcripts_and_arrays(talk):
    rows = {(r["conv_id"], r["turn_idx"]): r for r in cx.transcripts(talk).collect()}
    assert rows[1, 0]["input_dialog"] == ""
    assert rows[1, 5]["input_dialog"] == "Supporter : Hello\nSeeker : I am sad\nbot : beep"
    arrays = {(r["conv_id"], r["turn_idx"]): r["dialogue"] for r in cx.history_arrays(talk).collect()}
    assert [u["text"] for u in arrays[1, 5]] == ["Hello", " ", "I am sad", "beep", ""]


def test_nulls(talk):
    report = {r["column_name"]: r["nulls"] for r in cx.null_report(talk, ["text", "situation"]).collect()}
    assert report == {"text": 1, "situation": 6}
    assert cx.fill_nulls(talk, ["text"]).filter("text is null").isEmpty()


def test_whole_groups_hold_one_group():
    drawn = []

    def batches():
        for i, keys in enumerate([[1, 1, 2], [], [2, 2], [2, None], [None, 5]]):
            drawn.append(i)
            yield pa.RecordBatch.from_pydict({"v": pa.array(range(len(keys))), "k": pa.array(keys, pa.int64())})

    found = positions.whole_groups(batches(), [1])
    assert next(found).to_pydict() == {"v": [0, 1], "k": [1, 1]} and drawn == [0]
    rest = [(g["k"].to_pylist(), g["v"].to_pylist()) for g in found]
    assert rest == [([2] * 4, [2, 0, 1, 0]), ([None] * 2, [1, 0]), ([5], [1])]


def test_native_positions_of_odd_groups(spark):
    chance = random.Random(12)
    groups = [None, float("nan"), 0.0, 1.5]
    rows = [(chance.choice(groups) if i % 3 else 1.5, i, chance.choice("xy"), chance.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "g double, k long, s string, c boolean").repartition(7)
    for counted in (None, F.col("c")):
        found = positions.with_position(df, ["g"], ["k"], "n", counted=counted, finer=(["s"], "m"), native=True)
        assert "Arrow" not in found._jdf.queryExecution().optimizedPlan().toString()
        n, m = {}, {}
        got = sorted(found.collect(), key=lambda r: r["k"])
        assert len(got) == 600
        for r in got:
            step, g = 1 if counted is None or r["c"] else 0, str(r["g"])
            n[g], m[g, r["s"]] = n.get(g, 0) + step, m.get((g, r["s"]), 0) + step
            assert (r["n"], r["m"]) == (n[g], m[g, r["s"]])
