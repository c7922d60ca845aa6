import json
import random

import pytest
from pyspark.sql import functions as F

from parley.functions.numeric import softmax
from parley.operators import cascade, genmetrics
from parley.operators.training import fit_best, load_models, macro_f1, save_models, score_text
from parley.plans import corpus
from parley.schema import MODULES, PREDICTION_FIELDS, RECORD_FIELDS
from parley.session import durable, shared_folder
from parley.sources import readers, writers

NAMES = [name for name, *_ in MODULES]
WIDTHS = dict(zip(NAMES, (2, 3, 2, 3, 2)))


def _rows(spark, n=80):
    rng = random.Random(4)
    rows = [(i, i % 8, *[[rng.uniform(-2, 2) for _ in range(w)] for w in WIDTHS.values()]) for i in range(n)]
    schema = "k int, strategy_true_id int, " + ", ".join(f"l{i} array<double>" for i in range(5))
    return spark.createDataFrame(rows, schema)


def test_routes(spark):
    df = _rows(spark)
    logits = {m: F.col(f"l{i}") for i, m in enumerate(NAMES)}
    scored = cascade.with_probabilities(df, logits)
    all_at_once = {r["k"]: r for r in cascade.predict(scored, keep=("k",)).collect()}
    source = {r["k"]: r for r in df.collect()}
    best = lambda values: values.index(max(values))
    for k, r in all_at_once.items():
        a, b, c, d, e = (source[k][f"l{i}"] for i in range(5))
        if best(a) == 0:
            want, stage = best(c), "Exploration"
        elif best(b) == 0:
            want, stage = best(d) + 2, "Comforting"
        elif best(b) == 1:
            want, stage = best(e) + 5, "Action"
        else:
            want, stage = 7, "Others"
        assert (r["strategy_pred_id"], r["stage_pred"]) == (want, stage)
        assert (r["prob_co"] == -1.0) == (stage == "Exploration") and r["prob_ex"] > 0
        assert (r["prob_qu"] != -1.0) == (stage == "Exploration")
        assert (r["prob_sd"] != -1.0) == (stage == "Comforting")
        assert (r["prob_in"] != -1.0) == (stage == "Action")
    seen = []

    def scorer(module):
        def score(rows):
            seen.append(module)
            return rows.withColumn(module, softmax(logits[module]))

        return score

    routed = cascade.score_by_route(df, {m: scorer(m) for m in NAMES})
    by_route = {r["k"]: r for r in cascade.predict(routed, keep=("k",)).collect()}
    assert by_route == all_at_once and seen == [NAMES[0], NAMES[1], *NAMES[2:]]
    stages = {r["k"]: r for r in cascade.stage_rows(cascade.predict(scored, keep=("k",)), ("k",)).collect()}
    assert all((stages[k]["prob_ex"] == -1.0) == (r["stage_pred"] != "Exploration") for k, r in all_at_once.items())
    sizes = dict(zip(NAMES, (1, 2, 4, 8, 16)))
    active = {"Exploration": 5, "Comforting": 11, "Action": 19, "Others": 3}
    mean = sum(active[r["stage_pred"]] for r in all_at_once.values()) / len(all_at_once)
    cost = cascade.cost(cascade.predict(scored), sizes).first()
    assert cost["active_params"] == pytest.approx(mean) and cost["sparsity"] == pytest.approx((1 - mean / 31) * 100)


def test_report_against_plain_counts(spark):
    names = {0: "Exploration", 1: "Exploration", 7: "Others"} | dict.fromkeys((2, 3, 4), "Comforting") | dict.fromkeys((5, 6), "Action")
    rows = [(None if i % 5 == 0 else "g", f"s{i * 7 % 8}", f"s{i * 3 % 8}", names[i * 7 % 8], names[i * 3 % 8]) for i in range(41)]
    df = spark.createDataFrame(rows, "split string, strategy_true string, strategy_pred string, stage_true string, stage_pred string")
    sizes = dict(zip(NAMES, (1, 2, 4, 8, 16)))
    found = {(r["split"], r["level"]): r for r in cascade.report(df, sizes, ("split",)).collect()}
    assert len(found) == 4
    for (split, level), r in found.items():
        own = [(x[1:3] if level == "strategy" else x[3:5]) + (x[4],) for x in rows if x[0] == split]
        labels = {x for t, p, _ in own for x in (t, p)}
        f1 = {}
        for label in labels:
            hits = sum(t == p == label for t, p, _ in own)
            f1[label] = 2 * hits / (sum(t == label for t, _, _ in own) + sum(p == label for _, p, _ in own))
        assert r["rows"] == len(own) and r["accuracy"] == pytest.approx(sum(t == p for t, p, _ in own) / len(own))
        assert r["macro_f1"] == pytest.approx(sum(f1.values()) / len(f1))
        assert r["weighted_f1"] == pytest.approx(sum(f1[t] for t, _, _ in own) / len(own))
        more = {"Exploration": 4, "Comforting": 8, "Action": 16, "Others": 0}
        stage = [1 if s == "Exploration" else 3 for *_, s in own]
        active = stage if level == "stage" else [n + more[s] for n, (*_, s) in zip(stage, own)]
        assert r["total_params"] == (3 if level == "stage" else 31)
        assert r["active_params"] == pytest.approx(sum(active) / len(active))
        assert r["sparsity"] == pytest.approx((1 - r["active_params"] / r["total_params"]) * 100)
    assert cascade.report(df.filter("false"), sizes).collect() == []


def test_classifier_beats_the_majority(spark, tmp_path):
    rows = durable(
        corpus.documents(spark, "/root/testdata/sf0.001").select(
            corpus.split_name("doc_id").alias("split"), F.col("text").alias("context"),
            F.when(F.col("lang") == "en", 0).otherwise(1).alias("label"),
        )
    )
    model, score = fit_best(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), features=1 << 10)
    test = rows.filter("split = 'test'")
    assert score > 0.8 and macro_f1(score_text(model, test, "p"), "p") > 0.8
    save_models(dict.fromkeys(NAMES, model), str(tmp_path / "m"))
    assert macro_f1(score_text(load_models(str(tmp_path / "m"))[NAMES[0]], test, "p"), "p") > 0.8
    with pytest.raises(ValueError, match="grid is empty"):
        fit_best(rows, rows, grid=())


def test_shared_folder_is_read_from_the_session(spark):
    folder = shared_folder(spark)
    assert folder and spark.sparkContext.getCheckpointDir()


def test_prediction_csv(spark, tmp_path):
    head = ",".join(PREDICTION_FIELDS)
    cells = ["7"] * (len(PREDICTION_FIELDS) - 2)
    body = "\n".join(
        ",".join([context, reply, *cells])
        for context, reply in [(" <START> ", "a"), ('"two\nlines, ""quoted"""', "b"), ("", "c")]
    )
    (tmp_path / "p.csv").write_text("﻿" + head + "\n" + body + "\n", encoding="utf-8")
    rows = readers.read_predictions(spark, str(tmp_path / "p.csv")).orderBy("label_context").collect()
    assert [(r["context"], r["label_context"]) for r in rows] == [('two\nlines, "quoted"', "b"), (None, "c")]
    assert rows[0]["prob_in"] == "7"


def _result(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("﻿" + "\n".join([header, *rows]) + "\n", encoding="utf-8")


def test_result_tree(spark, tmp_path):
    root = tmp_path / "res ults"
    _result(root / "g1/distilbert/b.csv", "reference_response,llm_parsed_response", ["later,x"])
    _result(root / "g1/distilbert/a.csv", " llm_parsed_response ,reference_response,extra", ['"h1\n.",r1,e', "h2,r2,e", "h3,r3,e"])
    _result(root / "g1/roberta/a.csv", "reference_response,other", ["r,o"])
    _result(root / "g2/roberta/a.csv", "reference_response,llm_parsed_response", ["r4,h4"])
    _result(root / "g2/unknown/a.csv", "reference_response,llm_parsed_response", ["r5,h5"])
    _result(root / ".hidden/roberta/a.csv", "reference_response,llm_parsed_response", ["r6,h6"])
    _result(root / "g2/roberta/deep/a.csv", "reference_response,llm_parsed_response", ["r7,h7"])
    rows = readers.read_result_tree(spark, str(root)).select("llm_alias", "classifier", "reference_response", "llm_parsed_response").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("g1", "distilbert", "r1", "h1\n."), ("g1", "distilbert", "r2", "h2"), ("g1", "distilbert", "r3", "h3"), ("g2", "roberta", "r4", "h4"),
    ]
    capped = readers.read_result_tree(spark, str(root), max_rows=2)
    assert sorted(r["reference_response"] for r in capped.collect()) == ["r1", "r2", "r4"]
    warned = genmetrics.missing_results(capped, [(g, c) for g in ("g1", "g2") for c in ("distilbert", "roberta")])
    assert sorted((r["llm_alias"], r["classifier"]) for r in warned.collect()) == [("g1", "roberta"), ("g2", "distilbert")]


def test_json_arrays_and_ablation(spark, tmp_path):
    rows = [{"reference_response": "r", "generated_response": None, "true_strategy": "Question"}, {"predicted_strategy": "Others"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    got = readers.read_baseline_generation(spark, str(tmp_path / "a.json")).collect()
    assert [tuple(r) for r in got] == [("r", "", "Question", ""), ("", "", "", "Others")]
    (tmp_path / "b.json").write_text(json.dumps([{"reference": "Question", "prediction": None}]))
    assert tuple(readers.read_baseline_classes(spark, str(tmp_path / "b.json")).first()) == ("Question", "")
    (tmp_path / "c.csv").write_text("﻿index,llm_response,reference_response\n1,,r\n2,h,r\n", encoding="utf-8")
    got = readers.read_ablation(spark, str(tmp_path / "c.csv")).orderBy("index").collect()
    assert [r["llm_parsed_response"] for r in got] == ["", "h"]


def test_dialogue_literals(spark):
    raw = [
        (1, "{'situation': 'so', 'dialog': [{'speaker': 'sys', 'text': 'it\\'s None', 'strategy': 'Question'}, {'speaker': 'usr', 'text': 'x', 'strategy': None}]}"),
        (2, '{"situation": null, "dialog": []}'),
        (3, "not a dialogue"),
    ]
    parsed = readers.parse_dialogues(spark.createDataFrame(raw, "conv_id long, raw string"))
    assert {r["conv_id"]: r["parsed"] for r in parsed.collect()} == {1: True, 2: True, 3: False}
    rows = readers.flatten_dialogues(parsed).orderBy("turn_idx").collect()
    assert [(r["turn_idx"], r["speaker"], r["text"], r["strategy"], r["situation"]) for r in rows] == [
        (0, "sys", "it's None", "Question", "so"), (1, "usr", "x", None, "so"),
    ]


def test_record_sinks(spark, tmp_path):
    row = {name: f"{name}, \"x\"\ny" for name in RECORD_FIELDS} | {"llm_alias": "a", "classifier": "c", "situation": ""}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in RECORD_FIELDS))
    writers.save_records(df, str(tmp_path / "out"))
    csv = readers.csv_reader(spark).option("recursiveFileLookup", True).csv(str(tmp_path / "out/csv")).first()
    js = spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "out/json")).first()
    for name in RECORD_FIELDS:
        assert (csv[name] or "") == row[name] == js[name]


def test_corpus_reader(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "{}"), (2, "test", "{}")], "conv_id long, split string, raw string")
    df.write.partitionBy("split").parquet(str(tmp_path / "c"))
    assert [r["conv_id"] for r in readers.read_dialogues(spark, str(tmp_path / "c"), "test").collect()] == [2]
    with pytest.raises(ValueError, match="split must be"):
        readers.read_dialogues(spark, str(tmp_path / "c"), "dev")
