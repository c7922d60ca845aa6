import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.functions.alignment import common_subsequence, shared_grams, trigram_match
from parley.operators import classmetrics as cm
from parley.operators import genmetrics as gm

SCHEMA = "g string, k int, reference_response string, llm_parsed_response string"


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def _grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def _bleu(pairs, k):
    num = {n: sum(sum((_grams(h, n) & _grams(r, n)).values()) for r, h in pairs) for n in (1, 2, 3, 4)}
    den = {n: sum(max(1, len(h) - n + 1) for _, h in pairs) for n in (1, 2, 3, 4)}
    hyp, ref = sum(len(h) for _, h in pairs), sum(len(r) for r, _ in pairs)
    if num[1] == 0:
        return 0.0
    p, step = [], 1
    for n in (1, 2, 3, 4):
        if num[n] == 0 and hyp > 1:
            p.append(1 / (2**step * 5 / math.log(hyp)) / den[n])
            step += 1
        else:
            p.append(num[n] / den[n])
    if min(p) == 0:
        return 0.0
    brevity = 1.0 if hyp > ref else math.exp(1 - ref / hyp)
    return brevity * math.exp(sum(math.log(x) / k for x in p[:k]))


def _cosine(a, b):
    x, y = (Counter(f" {t} "[i : i + 3] for i in range(len(t))) for t in (a, b))
    dot = sum(x[g] * y[g] for g in x)
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def _soft(hyp, ref):
    if not hyp or not ref:
        return 0.0
    p = sum(max(_cosine(h, r) for r in ref) for h in hyp) / len(hyp)
    r = sum(max(_cosine(h, r) for h in hyp) for r in ref) / len(ref)
    return 2 * p * r / (p + r) if p + r else 0.0


def _random_pairs(seed):
    rng = random.Random(seed)
    words = "a b c dog dogs cat . ,".split()
    rows = []
    for k in range(60):
        text = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 12]))) for _ in range(2)]
        rows.append(("hot" if k % 3 else "cold", k, *text))
    rows.append(("hot", 60, None, "a a a"))
    rows.append(("nothing", 61, "x y", "dog"))
    rows.append(("short", 62, "a b c", "a b"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_plain_loops(spark, seed):
    rows = _random_pairs(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["g"]: r for r in gm.evaluate_generation(df.repartition(4), ["g"], ["k"]).collect()}
    assert set(got) == {"hot", "cold", "nothing", "short"}
    for g, r in got.items():
        pairs = [((a or "").split(), (b or "").split()) for name, _, a, b in rows if name == g]
        assert r["pairs"] == len(pairs)
        assert r["length"] == pytest.approx(sum(len(h) for _, h in pairs) / len(pairs))
        for k in (1, 2):
            assert r[f"bleu_{k}"] == pytest.approx(100 * _bleu(pairs, k))
            runs = [x for _, h in pairs for x in _grams(h, k).elements()]
            assert r[f"distinct_{k}"] == pytest.approx(100 * len(set(runs)) / max(1, len(runs)))
        f1, rouge, soft = [], [], []
        for ref, hyp in pairs:
            both = sum((Counter(ref) & Counter(hyp)).values())
            f1.append(2 * both / (len(ref) + len(hyp)) if both else 0.0)
            n = _lcs(ref, hyp)
            p, q = (n / len(hyp), n / len(ref)) if n else (0, 0)
            rouge.append(2.44 * p * q / (q + 1.44 * p) if n else 0.0)
            soft.append(_soft(hyp, ref))
        for name, values in (("f1", f1), ("rouge_l", rouge), ("soft_match", soft)):
            assert r[name] == pytest.approx(100 * sum(values) / len(values))


def test_identical_texts_score_full(spark):
    df = spark.createDataFrame([("g", i, f"one two three four five {i}", f"one two three four five {i}") for i in range(4)], SCHEMA)
    row = gm.evaluate_generation(df, ["g"], ["k"]).first()
    for name in ("bleu_1", "bleu_2", "f1", "rouge_l", "soft_match"):
        assert row[name] == pytest.approx(100)
    assert row["distinct_1"] <= 100
    assert gm.summary(gm.evaluate_generation(df, ["g"], ["k"]), "g").columns[0] == "model"


def test_alignment_helpers():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in range(2))
        assert common_subsequence(a, b) == _lcs(a, b)
        assert shared_grams(a, b) == [sum((_grams(a, n) & _grams(b, n)).values()) for n in (1, 2, 3, 4)]
    long = [f"w{i}" for i in range(700)]
    assert trigram_match(long, long[::-1], {}) == pytest.approx(1.0)
    assert trigram_match([], ["a"], {}) == 0.0


def test_soft_match_with_vectors(spark):
    df = spark.createDataFrame([(1, "cat dog", "cat cat"), (2, "", "cat"), (3, "unknown", "dog")], "k int, r string, h string")
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [1.0, 1.0])], "token string, vector array<double>")
    got = {r["k"]: r["soft_match"] for r in gm.soft_match_with_vectors(df, vectors, ["k"], "r", "h").collect()}
    recall = (1 + math.sqrt(0.5)) / 2
    assert got[1] == pytest.approx(2 * recall / (1 + recall))
    assert got[2] == 0.0 and got[3] == 0.0


def _soft_vectors(hyp, ref, vectors):
    """Greedy soft match of two token lists with given vectors, token by token."""
    def alike(a, b):
        x, y = vectors.get(a), vectors.get(b)
        if x is None or y is None:
            return 0.0
        return sum(i * j for i, j in zip(x, y)) / math.sqrt(sum(i * i for i in x) * sum(j * j for j in y))

    if not hyp or not ref:
        return 0.0
    p = sum(max(alike(a, b) for b in ref) for a in hyp) / len(hyp)
    r = sum(max(alike(a, b) for a in hyp) for b in ref) / len(ref)
    return 2 * p * r / (p + r) if p + r else 0.0


def test_soft_match_takes_tokens_one_by_one(spark):
    chance = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    vectors = {w: [chance.random() + 0.1 for _ in range(5)] for w in words[:50]}
    texts = {}
    for key in [(a, b) for a in (None, 1, 2**60 + 1) for b in (None, "x", "y")]:
        texts[key] = [chance.choices(words, k=chance.choice([0, 1, 40, 90])) for _ in range(2)]
    texts[3, "empty"] = [[], []]
    df = spark.createDataFrame(
        [(*key, " ".join(r), " ".join(h)) for key, (r, h) in texts.items()], "a long, b string, r string, h string"
    )
    table = spark.createDataFrame([(w, v) for w, v in vectors.items()], "token string, vector array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = gm.soft_match_with_vectors(df, table, ["a", "b"], "r", "h")
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {(row["a"], row["b"]): row["soft_match"] for row in rows}
    assert len(rows) == len(texts)
    assert got == {key: pytest.approx(_soft_vectors(h, r, vectors)) for key, (r, h) in texts.items()}
    # no row that goes to Python holds all tokens of a text
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_missing_results(spark):
    df = spark.createDataFrame([("a", "x")], "llm_alias string, classifier string")
    rows = gm.missing_results(df, [("a", "x"), ("a", "y")]).collect()
    assert [tuple(r) for r in rows] == [("a", "y", "a/y: missing or empty")]


def _f1(rows, label):
    tp = sum(t == p == label for t, p in rows)
    total = sum(t == label for t, _ in rows) + sum(p == label for _, p in rows)
    return 2 * tp / total if total else 0.0


def test_class_metrics_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice("abd")) for _ in range(80)] + [("", "a"), ("e", "e")]
    df = spark.createDataFrame(rows, "t string, p string")
    r = cm.class_f1(df, "t", "p").first()
    labels = {x for pair in rows for x in pair}
    assert r["macro_f1"] == pytest.approx(sum(_f1(rows, x) for x in labels) / len(labels))
    assert r["weighted_f1"] == pytest.approx(sum(_f1(rows, t) for t, _ in rows) / len(rows))
    assert r["accuracy"] == pytest.approx(sum(t == p for t, p in rows) / len(rows))
    perfect = cm.class_f1(df.withColumn("p", F.col("t")), "t", "p").first()
    assert perfect["macro_f1"] == perfect["weighted_f1"] == perfect["accuracy"] == 1.0
    table = {x["class"]: x for x in cm.class_table(df, "t", "p", ["a", "c", "absent"]).collect()}
    assert set(table) == {"a", "c", "absent"} and table["absent"]["f1"] == 0.0
    assert table["a"]["f1"] == round(_f1(rows, "a"), 4)
    assert table["c"]["precision"] == 0.0


def test_split_scores_and_strategy_row(spark):
    df = spark.createDataFrame([("x", 0, [0.75, 0.25]), ("x", 1, [0.5, 0.5])], "s string, y int, p array<double>")
    r = cm.split_scores(df, "y", "p", ["s"]).first()
    assert r["loss"] == pytest.approx(-(math.log(0.75) + math.log(0.5)) / 2)
    assert r["macro_f1"] == pytest.approx(1 / 3)
    scores = cm.class_f1(df.withColumn("q", F.col("y")), "y", "q")
    assert tuple(cm.strategy_metrics(scores, 12.345678, 5, "e").first()) == (5, "e", 1.0, 1.0, 1.0, 12.35)


def test_leaderboard(spark):
    texts = spark.createDataFrame([("m", 1.005, 2.0, 3.0, 4.0, 5.0, 6.0)], "model string, bleu_1 double, bleu_2 double, rouge_l double, distinct_1 double, distinct_2 double, soft_match double")
    classes = spark.createDataFrame([("m", 0.5, 0.25), ("n", 0.12345, 1.0)], "model string, macro_f1 double, weighted_f1 double")
    rows = {r["model"]: tuple(r)[1:] for r in cm.leaderboard(texts, classes).collect()}
    assert rows["m"] == ("1.00", "2.00", "3.00", "4.00", "5.00", "6.00", "0.5000", "0.2500")
    assert rows["n"] == ("-",) * 6 + (f"{0.12345:.4f}", "1.0000")


def test_report_moves_rows_once(spark, capsys):
    """One scan, one wide shuffle, one of sums; no join."""
    df = spark.createDataFrame([("a", i, f"the cat {i} sat", f"a cat {i} sat down") for i in range(50)], "g string, k int, r string, h string")
    report = gm.evaluate_generation(df, ["g"], ["k"], "r", "h")
    report.collect()
    capsys.readouterr()
    report.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 2 and "Join" not in plan and plan.count("Scan ExistingRDD") == 1
