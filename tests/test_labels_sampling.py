from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.operators import labels, sampling
from parley.schema import MODULES, STRATEGIES, module_labels, strategies


def test_vocabularies(spark):
    rows = strategies(spark).collect()
    assert [r["strategy_id"] for r in rows] == list(range(8))
    assert Counter(r["stage"] for r in rows) == {"Exploration": 2, "Comforting": 3, "Action": 2, "Others": 1}
    assert Counter(r["module"] for r in module_labels(spark).collect()) == {
        "exploration_support_identifier": 8, "comforting_action_identifier": 6, "exploration_predictor": 2,
        "comforting_predictor": 3, "action_predictor": 2,
    }


def test_labels(one, spark):
    assert one(labels.strategy_id, "Reflection of feelings") == 2
    assert one(labels.abbreviation, "Reflection of Feelings") == "rf" == one(labels.abbreviation, "Reflection of feelings")
    assert one(labels.abbreviation, "Supporting") == "su"
    assert one(labels.stage_of, 7, "int") == "Others"
    for name in ("Reflection of Feelings", "nonsense", None):
        with pytest.raises(Exception, match="unknown strategy"):
            one(labels.strategy_id, name)


def _examples(spark, sizes):
    rows = [("m", label, c, t) for label, n in sizes.items() for c in range(n) for t in [label]]
    return spark.createDataFrame(rows, "module string, label int, conv_id long, turn long")


@pytest.mark.parametrize("chunk", [3, 1000])
def test_oversampling(spark, monkeypatch, chunk):
    monkeypatch.setattr(sampling, "COPIES_PER_ROW", chunk)
    df = _examples(spark, {0: 23, 1: 7, 2: 1})
    got = sampling.balance(df, ["module"], ["conv_id", "turn"]).collect()
    assert Counter(r["label"] for r in got) == {0: 23, 1: 23, 2: 23}
    assert len({tuple(r) for r in got}) == 69
    copies = Counter((r["label"], r["conv_id"]) for r in got)
    assert sorted(n for (label, _), n in copies.items() if label == 1) == [3] * 5 + [4] * 2
    assert copies[2, 0] == 23
    assert sorted(got) == sorted(sampling.balance(df.repartition(4), ["module"], ["conv_id", "turn"]).collect())


def test_second_largest(spark):
    df = _examples(spark, {0: 23, 1: 7, 2: 2})
    got = sampling.balance(df, ["module"], ["conv_id", "turn"], second=True).collect()
    assert Counter(r["label"] for r in got) == {0: 7, 1: 7, 2: 7}
    assert len({(r["label"], r["conv_id"]) for r in got if r["label"] == 0}) == 7
    with pytest.raises(Exception, match="two classes"):
        sampling.balance(_examples(spark, {0: 3}), ["module"], ["conv_id", "turn"], second=True).collect()


def test_order_slices_and_caps(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(50)], "conv_id long, turn long")
    places = [r["shuffle_pos"] for r in sampling.shuffled(df, ["conv_id", "turn"]).collect()]
    assert sorted(places) == list(range(1, 51))
    assert {r["turn"] for r in sampling.slice_rows(df, ["turn"], 3, 6).collect()} == {3, 4, 5}
    assert sampling.slice_rows(df, ["turn"], 45).count() == 5
    with pytest.raises(ValueError, match="no rows"):
        sampling.slice_rows(df, ["turn"], 60)
    assert sampling.cap_rows(df, ["conv_id"], ["turn"], 0).count() == 50
    assert {r["turn"] for r in sampling.cap_rows(df, ["conv_id"], ["turn"], 2).collect()} == {0, 1, 2, 3}


def test_large_caps_are_counted_in_pieces(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"))
    got = sampling.cap_rows(df, ["conv_id"], ["turn"], 1500)
    assert got.groupBy("conv_id").count().collect()[0]["count"] == 1500
    assert got.agg(F.max("turn")).first()[0] == 2999


def test_module_examples(spark):
    rows = [(1, i, "usr" if i % 2 else "sys", f"t{i}", labels_name) for i, labels_name in enumerate(
        ["Question", None, "Self-disclosure", None, "Others", None, "Information"])]
    df = spark.createDataFrame(rows, "conv_id long, turn_idx int, speaker string, text string, strategy string")
    got = {(r["turn_idx"], r["module"]): r for r in labels.module_examples(df, include_test=True).collect()}
    assert {m for t, m in got if t == 2} == {"exploration_support_identifier", "comforting_action_identifier", "comforting_predictor", "test"}
    assert got[2, "comforting_predictor"]["context"] == "[seeker] t1"
    assert got[2, "comforting_action_identifier"]["context"] == "[supporter] [Question] t0 [seeker] t1"
    assert got[0, "exploration_predictor"]["context"] == "<START>"
    assert got[4, "comforting_action_identifier"]["label"] == 2
    want = sum(strategy in group for _, _, members, _, _ in MODULES for group in members for strategy in (0, 3, 7, 6)) + 4
    assert len(got) == want and len(STRATEGIES) == 8


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 255, 256, 257, 1023, 1024, 1025, 4096, 5000])
def test_epoch_orders_are_permutations(spark, rows):
    numbers = spark.range(rows).withColumnRenamed("id", "idx")
    orders = [[r["epoch_pos"] for r in sampling.epoch_order(numbers, "idx", rows, e).orderBy("idx").collect()] for e in (0, 1)]
    for order in orders:
        assert sorted(order) == list(range(rows))
    if rows > 60:
        assert orders[0] != orders[1]
        # neighbours do not stay together
        steps = [abs(a - b) for a, b in zip(orders[0], orders[0][1:])]
        assert sum(steps) / len(steps) > rows / 5


def test_epoch_order_of_very_many_rows(spark):
    rows = (1 << 60) + 12345
    numbers = spark.range(rows - 500, rows).withColumnRenamed("id", "idx")
    found = [r["epoch_pos"] for r in sampling.epoch_order(numbers, "idx", rows, 3).collect()]
    assert len(set(found)) == 500 and 0 <= min(found) and max(found) < rows
    with pytest.raises(ValueError, match="rows must be"):
        sampling.epoch_order(numbers, "idx", 1 << 61, 0)


def test_slices_leave_out_first_turns(spark):
    df = spark.createDataFrame([(i, " <START> " if i % 3 == 0 else f"c{i}") for i in range(12)] + [(12, None)], "k int, context string")
    assert sorted(r["k"] for r in sampling.slice_requests(df, ["k"], 2, 5).collect()) == [4, 5, 7]
    assert 12 in {r["k"] for r in sampling.slice_requests(df, ["k"]).collect()}
