import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from parley.operators import generation as gen
from parley.operators import matching, prompts
from parley.schema import NO_SITUATION, RECORD_FIELDS, STAGES


def _corpus(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id long, turn_idx int, speaker string, text string, strategy string, situation string, split string"
    )


def _serve(corpus, requests):
    """The queues, one request after the other."""
    pairs, replies = defaultdict(deque), defaultdict(deque)
    order = {"train": 0, "validation": 1, "test": 2}
    for r in sorted(corpus, key=lambda r: (order[r[6]], r[0], r[1])):
        if r[2] == "sys":
            pairs[r[4].lower(), r[3].lower()].append((r[0], r[1]))
            replies[r[3].lower()].append((r[0], r[1]))
    served = {}
    for group, key, strategy, reply in sorted(requests):
        q = pairs.get((strategy.lower(), reply.lower().strip()))
        if reply.strip() and q:
            served[key] = (*q.popleft(), "pair")
        elif reply.strip() and replies.get(reply.lower().strip()):
            served[key] = (*replies[reply.lower().strip()].popleft(), "response")
        else:
            served[key] = (None, None, "none")
    return served


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_against_queues(spark, seed):
    rng = random.Random(seed)
    texts = ["Ok"] * 6 + ["thanks", "why?", "see you", "unseen"]
    corpus = []
    for conv in range(25):
        split = rng.choice(["train", "validation", "test"])
        for turn in range(rng.randint(1, 6)):
            speaker = "sys" if rng.random() < 0.7 else "usr"
            corpus.append((conv, turn, speaker, rng.choice(texts[:-1]), rng.choice(["Question", "Others"]), None, split))
    requests = [("g", i, rng.choice(["question", "OTHERS", "Information"]), rng.choice([*texts, "", " ok "])) for i in range(120)]
    df = spark.createDataFrame(requests, "g string, k int, strategy_true string, label_context string")
    lookup = matching.lookup_keys(_corpus(spark, corpus))
    got = matching.match_requests(df.repartition(3), lookup, ["k"]).collect()
    assert {r["k"]: (r["corpus_conv"], r["corpus_turn"], r["match_kind"]) for r in got} == _serve(corpus, requests)
    # two groups of requests are served independently of each other
    both = df.unionByName(df.withColumn("g", F.lit("h")))
    twice = matching.match_requests(both, lookup, ["k"], group=["g"]).collect()
    for name in "gh":
        mine = {r["k"]: (r["corpus_conv"], r["corpus_turn"], r["match_kind"]) for r in twice if r["g"] == name}
        assert mine == _serve(corpus, requests)


def test_context_is_attached(spark):
    corpus = _corpus(
        spark,
        [(1, 0, "usr", "I am sad", None, " why ", "train"), (1, 1, "sys", "Ok", "Question", " why ", "train")],
    )
    requests = spark.createDataFrame(
        [(1, "Question", "ok", "own"), (2, "Question", "no", "[seeker] hi [supporter] [Others] bye"), (3, "Others", "", None)],
        "k int, strategy_true string, label_context string, context string",
    )
    lookup = matching.build_lookup(corpus)
    matches = matching.match_requests(requests, lookup, ["k"])
    rows = {r["k"]: r for r in matching.attach_context(requests, matches, lookup, ["k"]).collect()}
    assert (rows[1]["input_dialog"], rows[1]["context_source"], rows[1]["situation"]) == ("Seeker : I am sad", "corpus", "why")
    assert (rows[2]["input_dialog"], rows[2]["context_source"]) == ("Seeker : hi\nSupporter : bye", "context")
    assert (rows[3]["input_dialog"], rows[3]["situation"]) == ("", "")


STAGE_COLUMNS = "stage_pred stage_true strategy_pred strategy_pred_id prob_ex prob_su prob_co prob_ac prob_ot".split()


@pytest.mark.parametrize(
    "values, want",
    [
        (("SU", "Action", "Question", "0", "1", "1", "1", "1", "1"), "Comforting"),
        (("?", "ACTION", "Question", "0", "1", "1", "1", "1", "1"), "Action"),
        ((None, None, " others ", "0", "1", "1", "1", "1", "1"), "Others"),
        ((None, None, "?", " 5 ", "1", "1", "1", "1", "1"), "Action"),
        ((None, None, None, "9", "0.2", "0.3", "-1", "0.3", "0.1"), "Comforting"),
        ((None, None, None, None, "0.2", "x", "", "0.1", None), "Exploration"),
        ((None, None, None, "", "x", "", None, "-1", "-1.0"), "Exploration"),
        ((None, None, None, "3.0", "nan", "0.9", "0.1", "0.1", "0.1"), "Exploration"),
        ((None, None, None, "3.0", "0.1", "0.2", "nan", "0.15", "nan"), "Comforting"),
    ],
)
def test_stage_resolution(spark, values, want):
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in STAGE_COLUMNS))
    assert df.select(prompts.resolve_stage()).first()[0] == want


def _requests(spark):
    row = {
        "context": "c", "label_context": " the reply ", "stage_pred": "Action", "stage_true": None,
        "strategy_pred": "Information", "strategy_pred_id": "6", "strategy_true": "Others", "strategy_true_id": None,
        "situation": None, "input_dialog": "Seeker : {situation} is\nSeeker : here", "classifier": "distilbert", "context_source": "context",
        **{c: "-1.0" for c in prompts.SCORE_NAMES.values()}, "prob_ex": "0.1", "prob_su": "0.9", "prob_co": "0.1", "prob_ac": "0.8",
        "prob_ps": "0.4", "prob_in": "0.6",
    }
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))


def test_prompts_and_records(spark):
    asked = gen.with_prompts(_requests(spark))
    text = asked.first()["prompt"]
    assert "- Providing Suggestions: 0.400\n- Information: 0.600" in text and "Question" not in text
    assert NO_SITUATION in text and text.endswith("Seeker : {situation} is\nSeeker : here")
    made = gen.generate_text(gen.with_combinations(asked, ["qwen3-8b", "x/y"]))
    rows = gen.records(made).collect()
    assert rows[0].__fields__ == RECORD_FIELDS
    assert {(r["llm_alias"], r["llm_id"]) for r in rows} == {("qwen3-8b", "Qwen/Qwen3-8B"), ("x_y", "x/y")}
    assert rows[0]["llm_predict_strategy"] == "Information" and rows[0]["llm_parsed_response"] == "I hear you say: here"
    assert rows[0]["reference_response"] == "the reply" and rows[0]["reference_id"] == ""


def test_others_prompt_has_no_scores(spark):
    texts = prompts.templates()
    assert set(texts) == {*STAGES, "flat"}
    assert "Scores" not in texts["Others"] and texts["flat"].count("{prob_") == 8
    with pytest.raises(ValueError, match="unknown prompt mode"):
        prompts.prompt("other")


def test_failures_stay_in_their_row(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no " + texts[0])
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a", "m", "c"), ("bad", "m", "c"), (None, "m", "d")], "prompt string, llm_alias string, classifier string")
    done = gen.generate_text(df.coalesce(1), picky)
    assert [r["llm_raw_output"] for r in done.collect()] == ["A", "Error: no bad", ""]
    assert [tuple(r) for r in gen.failures(done).collect()] == [("m", "c", 1, "Error: no bad")]
