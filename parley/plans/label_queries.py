"""Label mapping, balancing and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import sampling
from parley.operators.labels import (
    abbreviation,
    module_examples,
    module_rows,
    raw_strategy_name,
    stage_of,
    strategy_id,
    strategy_name,
)
from parley.plans import corpus
from parley.plans.corpus_sql import LABELLED, NAMES, PREDICTIONS, STAGE_OF, UTT, case
from parley.schema import MODULES, RAW_STRATEGY_SPELLING, STAGE_ABBREV, STRATEGIES
from parley.session import stored


def label_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Raw label to id, display name, stage and short names, for every labelled turn."""
    rows = corpus.labelled_turns(spark, folder).withColumn("raw", raw_strategy_name(F.col("strategy_true_id")))
    known = strategy_id(F.col("raw"))
    return rows.select(
        "conv_id",
        "turn",
        "raw",
        known.alias("strategy_id"),
        strategy_name(known).alias("display_name"),
        stage_of(known).alias("stage"),
        abbreviation(F.col("raw")).alias("abbrev"),
        abbreviation(stage_of(known)).alias("stage_abbrev"),
    )


def examples_of_modules(spark: SparkSession, folder: str) -> DataFrame:
    rows = module_examples(corpus.utterances(spark, folder), include_test=True)
    return rows.select("conv_id", "turn_idx", "split", "module", "label", "context")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """The label rows of all modules, where the context is not needed."""
    rows = corpus.labelled_turns(spark, folder)
    return rows.withColumn("_m", F.explode(module_rows(F.col("strategy_true_id")))).select(
        "conv_id", "turn", "split", F.col("_m.module").alias("module"), F.col("_m.label").alias("label")
    )


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return _labels(spark, folder).filter("split = 'train'").drop("split")


def class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.class_histogram(_labels(spark, folder), ["split", "module"])


def oversample_max(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.balance(_train(spark, folder), ["module"], ["conv_id", "turn"])


def balance_second(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.balance(_train(spark, folder), ["module"], ["conv_id", "turn"], second=True)


def class_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The balanced predictors and the plain identifiers, put together again as one training set."""
    train = _train(spark, folder)
    balanced = [name for name, _, _, oversample, _ in MODULES if oversample]
    chosen = F.col("module").isin(balanced)
    parts = sampling.balance(train.filter(chosen), ["module"], ["conv_id", "turn"])
    return train.filter(~chosen).withColumn("copy", F.lit(1).cast("long")).unionByName(parts).groupBy(
        "module", "label"
    ).agg(F.count("*").alias("n"), F.max("copy").alias("most_copies"))


def shuffle_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.conversations(spark, folder).filter("role = 'assistant'").select("conv_id", "turn")
    return sampling.shuffled(rows, ["conv_id", "turn"])


EPOCHS = (0, 1)


def epoch_order(spark: SparkSession, folder: str) -> DataFrame:
    """Supporter turns in the order of two epochs; they are numbered once."""
    rows = corpus.conversations(spark, folder).filter("role = 'assistant'").select("conv_id", "turn")
    numbered = stored(sampling.with_ordinal(rows, ["conv_id", "turn"]), "numbered")
    total = numbered.count()
    orders = [sampling.epoch_order(numbered, "idx", total, e).withColumn("epoch", F.lit(e)) for e in EPOCHS]
    return orders[0].unionByName(orders[1]).select("conv_id", "turn", "epoch", "epoch_pos")


def slice_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A slice of what is asked for; first turns do not count."""
    rows = corpus.predictions(spark, folder).select("conv_id", "turn", "context", "strategy_pred")
    return sampling.slice_requests(rows, ["conv_id", "turn"], 5, 60).drop("context")


def demo_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.hash_fraction(_labels(spark, folder))


def slice_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.labelled_turns(spark, folder).select("conv_id", "turn", "strategy_pred")
    return sampling.slice_rows(rows, ["conv_id", "turn"], 20, 90)


def cap_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.labelled_turns(spark, folder).select(
        corpus.generator_name().alias("llm_alias"), corpus.classifier_name().alias("classifier"), "conv_id", "turn"
    )
    return sampling.cap_rows(rows, ["llm_alias", "classifier"], ["conv_id", "turn"], 15)


QUERIES = {
    "label_vocabulary": label_vocabulary,
    "module_examples": examples_of_modules,
    "class_histogram": class_histogram,
    "oversample_max": oversample_max,
    "balance_second": balance_second,
    "training_set_sizes": class_parts,
    "shuffle_order": shuffle_order,
    "epoch_order": epoch_order,
    "demo_sample": demo_sample,
    "slice_requests": slice_requests,
    "slice_rows": slice_rows,
    "cap_rows": cap_rows,
}



def _epochs_sql() -> str:
    """The network of ``sampling.epoch_order`` in SQL; places beyond the rows go round again."""
    query = "SELECT conv_id, turn, epoch, n, wide, high, place % wide AS a, place // wide AS b FROM walk WHERE place >= n OR NOT begun"
    for turn in range(sampling.ROUNDS):
        mine, other, size = ("b", "a", "high") if turn % 2 else ("a", "b", "wide")
        salts = " ".join(f"WHEN {e} THEN {sampling.epoch_salts(e, sampling.SEED)[turn]}" for e in EPOCHS)
        query = f"SELECT *, CAST({other} * 2 + CASE epoch {salts} END AS bigint) AS u FROM ({query})"
        for _ in range(2):
            query = f"SELECT * REPLACE (CAST(xor(u, u >> 16) * {sampling.SCRAMBLE} % 4294967296 AS bigint) AS u) FROM ({query})"
        query = f"SELECT * EXCLUDE (u) REPLACE (({mine} + xor(u, u >> 16)) % {size} AS {mine}) FROM ({query})"
    return f"""WITH RECURSIVE numbered AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, count(*) OVER () AS n
  FROM conversations WHERE role = 'assistant'),
sized AS (SELECT *, CAST(floor(sqrt(n - 1)) AS bigint) + 1 AS wide FROM numbered),
walk AS (SELECT conv_id, turn, epoch, n, wide, (n + wide - 1) // wide AS high, idx AS place, false AS begun
  FROM sized, (SELECT unnest({list(EPOCHS)}) AS epoch)
  UNION ALL SELECT conv_id, turn, epoch, n, wide, high, b * wide + a, true FROM ({query}))
SELECT conv_id, turn, epoch, place AS epoch_pos FROM walk WHERE begun AND place < n"""


_EPOCHS = _epochs_sql()
_RAW = {i: RAW_STRATEGY_SPELLING.get(i, name) for i, name, _, _ in STRATEGIES}
_SHORT = {i: short for i, _, short, _ in STRATEGIES}
# module, strategy, label
_MODULES = ", ".join(
    f"('{module}', {strategy}, {label}, {turns})"
    for module, _, members, _, turns in MODULES
    for label, group in enumerate(members)
    for strategy in group
)
_VOCABULARY = f"m(module, sid, label, turns) AS (VALUES {_MODULES})"
_TEST = ", ".join(f"('test', {i}, {i}, 5)" for i in range(8))
_KEY = "(conv_id * 7919 + turn * 104729 + 42) % 1000003"
_LABELS = f"""{LABELLED}, {_VOCABULARY},
labels_of AS (SELECT conv_id, turn, split, module, label FROM turns JOIN m ON strategy_true_id = sid),
train AS (SELECT conv_id, turn, module, label FROM labels_of WHERE split = 'train'),
sizes AS (SELECT module, label, count(*) AS n FROM train GROUP BY ALL)"""


def _balanced(target: str) -> str:
    return f"""WITH {_LABELS},
goal AS (SELECT module, {target} AS target FROM sizes GROUP BY module),
ranked AS (SELECT t.*, n, target, row_number() OVER (PARTITION BY module, label ORDER BY {_KEY}, conv_id, turn) AS r
  FROM train t JOIN sizes USING (module, label) JOIN goal USING (module)),
copies AS (SELECT *, target // n + CASE WHEN r <= target % n THEN 1 ELSE 0 END AS c FROM ranked)
SELECT conv_id, turn, module, label, unnest(range(1, CAST(c + 1 AS bigint))) AS copy FROM copies WHERE c > 0"""


ORACLES = {
    "label_vocabulary": f"""
WITH {LABELLED} SELECT conv_id, turn, {case('strategy_true_id', _RAW)} AS raw, strategy_true_id AS strategy_id,
  {case('strategy_true_id', NAMES)} AS display_name, {case('strategy_true_id', STAGE_OF)} AS stage,
  {case('strategy_true_id', _SHORT)} AS abbrev, {case(case('strategy_true_id', STAGE_OF), STAGE_ABBREV)} AS stage_abbrev FROM turns""",
    "module_examples": f"""
WITH {UTT}, m(module, sid, label, turns) AS (VALUES {_MODULES}, {_TEST})
SELECT conv_id, turn_idx, split, module, label, CASE WHEN turns = 1 THEN context1 ELSE context5 END AS context
FROM ctx JOIN m ON strategy_true_id = sid""",
    "class_histogram": f"WITH {_LABELS} SELECT split, module, label, count(*) AS n FROM labels_of GROUP BY ALL",
    "oversample_max": _balanced("max(n)"),
    "balance_second": _balanced("list(n ORDER BY n DESC)[2]"),
    "training_set_sizes": f"""
WITH {_LABELS}, goal AS (SELECT module, max(n) AS target FROM sizes GROUP BY module)
SELECT module, label, CASE WHEN module LIKE '%predictor' THEN target ELSE n END AS n,
  CASE WHEN module LIKE '%predictor' THEN target // n + CASE WHEN target % n > 0 THEN 1 ELSE 0 END ELSE 1 END AS most_copies
FROM sizes JOIN goal USING (module)""",
    "shuffle_order": f"""
SELECT conv_id, turn, row_number() OVER (ORDER BY {_KEY}, conv_id, turn) AS shuffle_pos
FROM conversations WHERE role = 'assistant'""",
    "epoch_order": _EPOCHS,
    "slice_requests": f"""WITH {PREDICTIONS} SELECT conv_id, turn, strategy_pred FROM pred WHERE context <> '<START>'
  ORDER BY conv_id, turn LIMIT 55 OFFSET 5""",
    "demo_sample": f"WITH {_LABELS} SELECT conv_id, turn, split, module, label FROM labels_of WHERE {_KEY} % 10 = 0",
    "slice_rows": f"WITH {LABELLED} SELECT conv_id, turn, strategy_pred FROM pred ORDER BY conv_id, turn LIMIT 70 OFFSET 20",
    "cap_rows": f"""
WITH {LABELLED}, r AS (SELECT 'm' || (conv_id % 3) AS llm_alias, classifier, conv_id, turn,
  row_number() OVER (PARTITION BY conv_id % 3, classifier ORDER BY conv_id, turn) AS place FROM pred)
SELECT llm_alias, classifier, conv_id, turn FROM r WHERE place <= 15""",
}
