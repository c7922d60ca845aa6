import pytest
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.functions.numeric import argmax, format_probability, round_exact, softmax
from parley.functions.tokens import blank_tokens, grams, punctuation_tokens, word_tokens
from parley.schema import ENCODERS, GENERATORS, NO_SITUATION


@pytest.mark.parametrize(
    "raw, want",
    [(None, ""), ("", ""), ("  A \t\n b  ", "a b"), ("x  Y", "x y"), ("a b", "a b"), (" \n", "")],
)
def test_normalize(one, raw, want):
    assert one(tx.normalize_text, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, "-1.000"), ("", "-1.000"), ("abc", "-1.000"), ("nan", "-1.000"), ("inf", "-1.000"), ("-inf", "-1.000"),
        ("-1.0", "-1.000"), ("0.1235", f"{0.1235:.3f}"), ("0.0005", f"{0.0005:.3f}"), ("0.0625", f"{0.0625:.3f}"),
        ("1.0d", "-1.000"), (" 0.5 ", "0.500"), ("1e-3", "0.001"), ("12345.6789", "12345.679"), ("-0.0", "-0.000"),
    ],
)
def test_format_probability(one, raw, want):
    assert one(format_probability, raw) == want


def test_rounding_is_that_of_the_binary_value(spark):
    values = [0.65625, 0.1235, 2.675, 1.005, 0.5, -2.675, 99.995, 0.0, 12.3456789]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4):
        got = [r[0] for r in rows.select(round_exact(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


@pytest.mark.parametrize("raw, want", [(None, None), ("", None), ("3.0", None), (" 3 ", 3), ("-7", -7), ("x", None)])
def test_parse_int(one, raw, want):
    assert one(tx.parse_int, raw) == want


def test_names(one):
    assert one(lambda c: tx.short_name(c, GENERATORS), "Qwen/Qwen3-8B") == "qwen3-8b"
    assert one(lambda c: tx.short_name(c, GENERATORS), " some/model ") == "some_model"
    assert one(lambda c: tx.full_name(c, GENERATORS), "qwen3-32b") == "Qwen/Qwen3-32B"
    assert one(lambda c: tx.full_name(c, ENCODERS), "own/encoder") == "own/encoder"


def test_situation_and_stage(one):
    assert one(tx.situation_or_default, " \n\t") == NO_SITUATION
    assert one(tx.situation_or_default, " a\n") == "a"
    assert [one(tx.stage_name, s) for s in (" SU ", "Support", "ACTION", "none", None)] == [
        "Comforting", "Comforting", "Action", None, None,
    ]


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("  ", ""),
        ("[supporter] [Question] hi [seeker] yes", "Supporter : hi\nSeeker : yes"),
        ("[SUPPORTER] [a] [b] hi", "Supporter : hi"),
        ("before [seeker] [x] [supporter] y", "Supporter : y"),
        ("[supporter] [a [seeker] b] c", "Seeker : b] c"),
        ("[supporter] [ seeker ] kept", "Supporter : [ seeker ] kept"),
        ("[supporter] [open end", "Supporter : [open end"),
        ("[seeker] two\nlines ", "Seeker : two\nlines"),
        ("Seeker: a\n\n  Supporter : b  ", "Seeker: a\nSupporter : b"),
        (" plain text ", "plain text"),
        ("see Seeker: a", "see Seeker: a"),
    ],
)
def test_render_turns(one, raw, want):
    assert one(tx.render_turns, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Strategy: Question\nResponse: How are\nyou?", ("Question", "How are\nyou?")),
        ("strategy :  A b  RESPONSE:x", ("A b", "x")),
        ("Response: only", ("N/A", "only")),
        ("Strategy: lonely", ("lonely", "Strategy: lonely")),
        ("Response: r Strategy: s", ("s", "r Strategy: s")),
        ("nothing", ("N/A", "nothing")),
        (None, ("N/A", "")),
    ],
)
def test_parse_generated(one, raw, want):
    got = one(tx.parse_generated, raw)
    assert (got["strategy"], got["response"]) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Don't stop, it's 5pm!", ["don't", "stop", ",", "it's", "5pm", "!"]),
        ("Été à l'école (oui)…", ["été", "à", "l'école", "oui"]),
        ("", []),
        (None, []),
        ("a_b -- c;", ["a_b", "c", ";"]),
    ],
)
def test_punctuation_tokens(one, raw, want):
    assert one(punctuation_tokens, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Don't! It's we've cannot cannot", ["do", "n't", "!", "it", "'s", "we", "'ve", "can", "not", "can", "not"]),
        ("gonna wanna gimme lemme gotta", ["gon", "na", "wan", "na", "gim", "me", "lem", "me", "got", "ta"]),
        ("'tis the dogs' I'm I'd they'll you're", ["'t", "is", "the", "dogs", "'", "i", "'m", "i", "'d", "they", "'ll", "you", "'re"]),
        ("plain words", ["plain", "words"]),
    ],
)
def test_word_tokens(one, raw, want):
    assert one(word_tokens, raw) == want


def test_blank_tokens(one):
    assert one(blank_tokens, " A b,\n c ") == ["A", "b,", "c"]
    assert one(blank_tokens, None) == []


def test_grams(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in rows.select(grams(F.col("t"), 2)).collect()]
    assert got == [["a\u0001b", "b\u0001c"], [], []]


def test_softmax_and_argmax(spark):
    rows = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, 1.0, 1.0],)], "l array<double>")
    got = rows.select(softmax(F.col("l")).alias("p"), argmax(F.col("l")).alias("a")).collect()
    assert got[0]["p"] == [0.5, 0.5] and [r["a"] for r in got] == [0, 1]


def test_clean_text(one):
    assert one(tx.clean_text, "a &amp;lt; b\u0000\u0007\tc &quot;d&#39;") == "a &lt; b\tc \"d'"
