"""Generation that goes on where an earlier run ended."""

from pyspark.sql import functions as F

from parley.operators import generation as g


def failing(name, word=None):
    """A generator that fails on prompts with a word, and answers with its own name."""

    def run(prompts):
        if word and any(word in p for p in prompts):
            raise RuntimeError("down")
        return [f"{name}:{p}" for p in prompts]

    return run


def runs(spark, ledger):
    rows = g.read_ledger(spark, ledger).groupBy("run").agg(F.count("*").alias("n"), F.count_if("failed").alias("f")).collect()
    return {r["run"]: (r["n"], r["f"]) for r in rows}


def test_only_failed_and_unseen_prompts_are_asked(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([(i, f"p{i % 4}", "m") for i in range(12)] + [(12, None, "m")], "k int, prompt string, who string")
    answers = {r["k"]: r["llm_raw_output"] for r in g.resume_generation(first, ledger, failing("a", "p3")).collect()}
    assert answers[0] == answers[4] == "a:p0" and answers[3].startswith(g.ERROR) and answers[12] == "a:"
    assert runs(spark, ledger) == {1: (5, 1)}
    more = first.unionByName(spark.createDataFrame([(20, "new", "m")], first.schema))
    answers = {r["k"]: r["llm_raw_output"] for r in g.resume_generation(more, ledger, failing("b")).collect()}
    assert (answers[0], answers[3], answers[20]) == ("a:p0", "b:p3", "b:new") and len(answers) == 14
    assert runs(spark, ledger) == {1: (5, 1), 2: (2, 0)}
    g.resume_generation(more, ledger, failing("c", "p")).collect()
    assert set(runs(spark, ledger)) == {1, 2}


def test_a_failure_stays_until_it_is_answered(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "x")], "k int, prompt string")
    for name in "ab":
        [row] = g.resume_generation(df, ledger, failing(name, "x")).collect()
        assert row["llm_raw_output"].startswith(g.ERROR)
    assert runs(spark, ledger) == {1: (1, 1), 2: (1, 1)}
    [row] = g.resume_generation(df, ledger, failing("c")).collect()
    assert row["llm_raw_output"] == "c:x"


def test_generators_are_asked_apart(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([("m", "x"), ("n", "x"), ("n", "x")], "who string, prompt string")
    rows = g.resume_generation(df, ledger, failing("a"), asked_of=("who",)).collect()
    assert len(rows) == 3 and runs(spark, ledger) == {1: (2, 0)}
    assert g.resume_generation(df.filter("false"), ledger, failing("a")).collect() == []
