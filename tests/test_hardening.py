"""Inputs that once broke an operator: very uneven text, sure mistakes, NULL groups, moved columns."""

import math
import time

import pytest
from pyspark.sql import functions as F

from parley.functions.numeric import format_probability, round_exact
from parley.functions.text import render_turns, strip
from parley.operators.classmetrics import split_scores
from parley.operators.genmetrics import evaluate_generation
from parley.operators.matching import attach_context
from parley.operators.sampling import seeded_key
from parley.sources.readers import flatten_dialogues, parse_dialogues, read_predictions, unreadable


def test_long_runs_of_blanks_and_brackets(one):
    for value, function in (("a" + " " * 100_000 + "b", strip), ("[seeker]" + "[x]" * 100_000 + " hi", render_turns)):
        start = time.time()
        assert one(function, value).endswith(("b", "hi"))
        assert time.time() - start < 20  # compilation included; it was minutes, or a crash


def test_strip_takes_all_kinds_of_blanks(one):
    assert one(strip, "　\x1c\x85 a b \xa0\r\n") == "a b"


def test_sure_mistakes_have_a_finite_loss(spark):
    rows = spark.createDataFrame([("g", 0, [0.0, 1.0]), ("g", 1, [0.0, 1.0]), (None, 1, [0.5, 0.5])], "g string, t int, p array<double>")
    found = {r["g"]: r["loss"] for r in split_scores(rows, "t", "p", ["g"]).collect()}
    assert math.isclose(found["g"], -math.log(1e-15) / 2) and math.isclose(found[None], math.log(2))


def test_null_groups_and_no_groups(spark):
    pairs = spark.createDataFrame([("a", 1, "x y", "x y"), (None, 2, "x", "y")], "g string, k long, reference_response string, llm_parsed_response string")
    assert {r["g"]: r["pairs"] for r in evaluate_generation(pairs, ["g"], ["k"]).collect()} == {"a": 1, None: 1}
    assert evaluate_generation(pairs, [], ["k"]).first()["pairs"] == 2


def test_context_of_a_turn_in_two_groups(spark):
    requests = spark.createDataFrame([("c0", 1, "own"), ("c1", 1, "own")], "classifier string, turn long, context string")
    matches = spark.createDataFrame([("c0", 1, 7, 2, "pair"), ("c1", 1, None, None, "none")], "classifier string, turn long, corpus_conv long, corpus_turn int, match_kind string")
    corpus = spark.createDataFrame([(7, 2, "Seeker : hi", "s")], "conv_id long, turn_idx int, input_dialog string, situation string")
    rows = attach_context(requests, matches, corpus, ["turn"], group=["classifier"]).collect()
    assert sorted((r["classifier"], r["input_dialog"]) for r in rows) == [("c0", "Seeker : hi"), ("c1", "own")]


def test_seeded_key_of_large_ids(spark):
    row = spark.range(1).select(F.lit(1577836800000000000).alias("conv_id"), F.lit(3).cast("long").alias("turn"))
    assert 0 <= row.select(seeded_key().alias("k")).first()["k"] < 1_000_003


def test_prediction_columns_by_name(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("label_context,context,strategy_pred\nl,hello,Question\nl,<START>,Question\n")
    rows = read_predictions(spark, str(path)).collect()
    assert [(r["context"], r["label_context"], r["strategy_pred"], r["prob_ex"]) for r in rows] == [("hello", "l", "Question", None)]


def test_dialogue_literals(spark):
    texts = ["my plan: None, really", "caf\xe9\xa0 ​", "it's \\ \"so\"", 'say &quot;hi&quot;', "a\nb \U000e0001 \\x41", "True"]
    dialogs = [{"situation": None, "dialog": [{"speaker": "usr", "text": t, "strategy": None}]} for t in texts]
    rows = [(i, ascii(d)) for i, d in enumerate(dialogs)] + [(i + 10, repr(d)) for i, d in enumerate(dialogs)] + [(99, "{no")]
    parsed = parse_dialogues(spark.createDataFrame(rows, "conv_id long, raw string"), clean=False)
    got = {r["conv_id"]: r["text"] for r in flatten_dialogues(parsed).collect()}
    assert got == {i + k: t for i, t in enumerate(texts) for k in (0, 10)}
    assert [r["conv_id"] for r in unreadable(parsed).collect()] == [99]
    clean = parse_dialogues(spark.createDataFrame(rows[3:4], "conv_id long, raw string"))
    assert flatten_dialogues(clean).first()["text"] == 'say "hi"'


def test_rounding_of_large_numbers(spark):
    values = [1000000000.125, 999999999.125, 1000000000.0625, 999999999.0625, 0.1235, 4503599627370495.5, 1e15 + 0.125]
    values += [9007199254740.9935, 2.5e18, 0.9999, 0.0005, -1000000000.125, 12.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", round_exact(F.col("v"), 2).alias("r"), format_probability(F.col("v")).alias("f")).collect():
        assert r["r"] == round(r["v"], 2) and r["f"] == f"{r['v']:.3f}", r


def test_large_numbers_are_written_out(spark):
    values = [2.0**63, 2.0**64, 2.0**64 + 2**12, 3e20, 1e22, 1.7e31, 2.0**100, 2.0**125 * 1.9, -(2.0**77)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", format_probability(F.col("v")).alias("f")).collect():
        assert r["f"] == f"{r['v']:.3f}"


def test_rows_without_probability_take_no_part(spark):
    rows = [(0, [0.9, 0.1]), (1, [0.9, None]), (1, [0.2, 1.5]), (0, None), (5, [0.5, 0.5]), (0, [float("nan"), 0.1])]
    df = spark.createDataFrame(rows, "t int, p array<double>")
    [got] = split_scores(df, "t", "p", []).collect()
    assert got["unscored"] == 5 and got["loss"] == pytest.approx(0.105360515)
