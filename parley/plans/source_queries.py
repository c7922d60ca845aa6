"""Sources and sinks: the given rows written in every supported format and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import genmetrics as gm
from parley.plans import corpus
from parley.plans.corpus_sql import LABELLED, PAIRS, PREDICTIONS, UTT
from parley.plans.matching_queries import ORACLES as MATCHING_ORACLES
from parley.plans.matching_queries import QUERIES as MATCHING
from parley.plans.metric_queries import ORACLES as METRIC_ORACLES
from parley.schema import PREDICTION_FIELDS, RECORD_FIELDS, RECORDS
from parley.session import scratch_path
from parley.sources import readers, writers

CLASSIFIERS = ("c0", "c1")
JSON_ARRAY = 64


def corpus_split(spark: SparkSession, folder: str) -> DataFrame:
    """Raw dialogues of the validation split, parsed and flattened.

    The corpus is written by split, so a reader of one split touches only its files.
    """
    turn = F.struct("turn_idx", F.struct("speaker", "text", "strategy").alias("u"))
    raw = F.to_json(F.struct("situation", F.transform("t", lambda x: x["u"]).alias("dialog")), {"ignoreNullFields": "false"})
    nested = (
        corpus.utterances(spark, folder)
        .groupBy("conv_id", "split")
        .agg(F.max("situation").alias("situation"), F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", "split", raw.alias("raw"))
    )
    path = scratch_path(spark, "dialogues")
    nested.write.partitionBy("split").parquet(path)
    parsed = readers.parse_dialogues(readers.read_dialogues(spark, path, "validation"), clean=False)
    return readers.flatten_dialogues(parsed).select("conv_id", "turn_idx", "speaker", "text", "strategy")


def prediction_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    rows = corpus.predictions(spark, folder).select(*PREDICTION_FIELDS)
    writers.save_predictions(rows, path, csv=True)
    read = readers.read_predictions(spark, path)
    numbers = [c for c in PREDICTION_FIELDS if c.startswith("prob_")]
    whole = [c for c in PREDICTION_FIELDS if c.endswith("_id")]
    return read.select(
        *[
            F.col(c).try_cast("double" if c in numbers else "int").alias(c) if c in numbers + whole else F.col(c)
            for c in PREDICTION_FIELDS
        ]
    )


def _result_rows(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.reply_pairs(spark, folder).select(
        F.col("llm_alias").alias("by_llm_alias"),
        F.col("classifier").alias("by_classifier"),
        "conv_id",
        "turn",
        "reference_response",
        "llm_parsed_response",
    )


def _result_tree(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "results")
    writers.csv_writer(_result_rows(spark, folder)).partitionBy("by_llm_alias", "by_classifier").csv(path)
    return path


def result_tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = _result_tree(spark, folder)
    rows = readers.read_result_tree(spark, path, classifiers=CLASSIFIERS, first=False)
    return rows.select(
        "llm_alias",
        "classifier",
        F.col("conv_id").try_cast("long").alias("conv_id"),
        F.col("turn").try_cast("long").alias("turn"),
        "reference_response",
        "llm_parsed_response",
    )


def result_tree_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The text metrics computed from a tree of result files."""
    rows = result_tree_scan(spark, folder)
    scores = gm.evaluate_generation(rows, ["llm_alias", "classifier"], ["conv_id", "turn"])
    return gm.summary(scores, "classifier", keep=("llm_alias",))


def json_array_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and replies as JSON arrays of at most 64 turns of one conversation."""
    rows = corpus.labelled_turns(spark, folder).withColumn("part", F.floor(F.col("turn") / JSON_ARRAY))
    entry = F.struct(
        F.col("text").alias("reference_response"),
        F.when(F.col("turn") % 3 == 0, F.col("strategy_pred")).alias("predicted_strategy"),
        F.col("strategy_true").alias("true_strategy"),
    )
    path = scratch_path(spark, "baseline")
    rows.groupBy("conv_id", "part").agg(F.to_json(F.collect_list(entry)).alias("value")).select(
        "value"
    ).write.text(path)
    return readers.read_baseline_generation(spark, path, lines=True)


def quoted_csv_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, line breaks and quotes included, as quoted CSV of few large files and back."""
    path = scratch_path(spark, "documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "source", "text")
    writers.csv_writer(docs).csv(path)
    [(_, rows)] = readers.read_quoted_csv(spark, [path])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")


def _dealt(spark: SparkSession, column: Column, parts: int) -> Column:
    """Numbers that ``repartition`` sends to parts 0, 1, ... by the value of ``column``."""
    homes = spark.range(64).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("home"))
    found = {r["home"]: r["id"] for r in homes.groupBy("home").agg(F.min("id").alias("id")).collect()}
    return F.element_at(F.array(*[F.lit(found[i]).cast("long") for i in range(parts)]), (column + 1).cast("int"))


FIRST_ROWS = 3


def result_tree_first(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three files per result folder, of which the first by name is read, and its first rows."""
    path = scratch_path(spark, "results")
    rows = _result_rows(spark, folder).withColumn("part", _dealt(spark, F.col("conv_id") % 5 % 3, 3))
    keys = ["by_llm_alias", "by_classifier"]
    dealt = rows.repartition(3, "part").sortWithinPartitions(*keys, "conv_id", "turn").drop("part")
    writers.csv_writer(dealt).partitionBy(*keys).csv(path)
    found = readers.read_result_tree(spark, path, FIRST_ROWS, CLASSIFIERS)
    numbers = [F.col(c).try_cast("long").alias(c) for c in ("conv_id", "turn")]
    return found.select("llm_alias", "classifier", *numbers, "reference_response", "llm_parsed_response")


def result_tree_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Result sets of which one lacks a column, one has a header only and one is not there."""
    path = scratch_path(spark, "results")
    rows = _result_rows(spark, folder)

    def save(name: str, classifier: str, columns: list, kept: str) -> None:
        own = rows.filter((F.col("by_llm_alias") == name) & (F.col("by_classifier") == classifier) & F.expr(kept))
        writers.csv_writer(own.select(*columns)).csv(f"{path}/{name}/{classifier}")

    both = ["conv_id", "reference_response", "llm_parsed_response"]
    save("m0", "c0", both, "true")
    save("m0", "c1", ["conv_id", F.col("llm_parsed_response").alias("reply")], "true")
    save("m1", "c0", both, "false")
    save("m2", "c0", both[:2], "true")
    save("m2", "c1", both, "true")
    found, report = readers.scan_result_tree(spark, path, classifiers=CLASSIFIERS, first=False)
    expected = [(g, c) for g in ("m0", "m1", "m2") for c in CLASSIFIERS]
    warned = readers.result_warnings(report, expected).select("llm_alias", "classifier", "reason")
    read = found.groupBy("llm_alias", "classifier").agg(F.count("*").alias("rows"))
    keys = ["llm_alias", "classifier"]
    return warned.join(read, keys, "full").select(*keys, "reason", F.coalesce("rows", F.lit(0)).alias("rows"))


def _save_array(rows: DataFrame, path: str, indent: bool) -> None:
    """Every task writes one array: an opening bracket, its elements with commas between, a closing one."""

    def framed(batches):
        names, first = ["value"], True
        for batch in batches:
            if batch.num_rows:
                texts = [("[" if first and i == 0 else ",") + t for i, t in enumerate(batch.column(0).to_pylist())]
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(texts)], names)
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names)

    written = F.to_json(F.struct("*"), {"pretty": str(indent).lower()})
    # without line ends between them unless indented, an array is one line
    rows.select(written.alias("value")).mapInArrow(framed, "value string").write.option("lineSep", "\n" if indent else " ").text(path)


def _array_files(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Replies with both labels as indented arrays, and labels alone as arrays of one line."""
    path = scratch_path(spark, "arrays")
    turns = corpus.labelled_turns(spark, folder)
    replies = corpus.reply_pairs(spark, folder).select("conv_id", "turn", "reference_response", "llm_parsed_response")
    both = turns.join(replies, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.coalesce("reference_response", "text").alias("reference_response"),
        F.col("llm_parsed_response").alias("generated_response"),
        F.col("strategy_true").alias("true_strategy"),
        F.when(F.col("turn") % 3 == 0, F.col("strategy_pred")).alias("predicted_strategy"),
    )
    _save_array(both, f"{path}/replies", True)
    labels = turns.select(F.col("stage_true").alias("reference"), F.col("stage_pred").alias("prediction"))
    _save_array(labels, f"{path}/labels", False)
    return f"{path}/replies", f"{path}/labels"


def json_array_files(spark: SparkSession, folder: str) -> DataFrame:
    """Array files of both forms, each cut into its elements by many tasks."""
    replies, labels = _array_files(spark, folder)
    full = readers.read_baseline_generation(spark, replies)
    alone = readers.read_baseline_classes(spark, labels).select(
        F.lit("").alias("reference_response"), F.lit("").alias("generated_response"), "true_strategy", "predicted_strategy"
    )
    return full.select(*alone.columns).unionByName(alone)


def record_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """Generated records written as table, CSV and JSON; the CSV and the JSON must agree."""
    path = scratch_path(spark, "records")
    writers.save_records(MATCHING["generate_records"](spark, folder), path)
    as_csv = readers.csv_reader(spark).option("recursiveFileLookup", True).schema(RECORDS).csv(f"{path}/csv")
    as_json = spark.read.option("recursiveFileLookup", True).schema(RECORDS).json(f"{path}/json")
    hashed = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in RECORD_FIELDS])
    both = as_csv.select("llm_alias", "classifier", hashed.alias("h"), F.lit(1).alias("csv"), F.lit(0).alias("json")).unionByName(
        as_json.select("llm_alias", "classifier", hashed.alias("h"), F.lit(0).alias("csv"), F.lit(1).alias("json"))
    )
    per_row = both.groupBy("llm_alias", "classifier", "h").agg(F.sum("csv").alias("csv"), F.sum("json").alias("json"))
    return per_row.groupBy("llm_alias", "classifier").agg(
        F.sum("csv").alias("csv_rows"),
        F.sum("json").alias("json_rows"),
        F.sum(F.least("csv", "json")).alias("equal_rows"),
    )


def summary_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The report of all result sets written to one CSV file and read back."""
    path = scratch_path(spark, "summary")
    scores = gm.evaluate_generation(corpus.reply_pairs(spark, folder), ["llm_alias", "classifier"], ["conv_id", "turn"])
    writers.save_summary(gm.summary(scores, "classifier", keep=("llm_alias",)), path, ["llm_alias", "model"])
    rows = readers.csv_reader(spark).csv(path)
    return rows.select(
        "llm_alias", "model", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns[2:]]
    )


def ablation_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "ablation")
    rows = corpus.reply_pairs(spark, folder).select(
        F.concat_ws("-", "conv_id", "turn").alias("index"),
        F.col("llm_parsed_response").alias("llm_response"),
        "reference_response",
    )
    writers.csv_writer(rows).csv(path)
    return readers.read_ablation(spark, path)


QUERIES = {
    "corpus_split": corpus_split,
    "prediction_csv_scan": prediction_csv_scan,
    "result_tree_scan": result_tree_scan,
    "result_tree_quality": result_tree_quality,
    "json_array_scan": json_array_scan,
    "quoted_csv_documents": quoted_csv_documents,
    "result_tree_first": result_tree_first,
    "result_tree_warnings": result_tree_warnings,
    "json_array_files": json_array_files,
    "record_sinks": record_sinks,
    "summary_sink": summary_sink,
    "ablation_scan": ablation_scan,
}

ORACLES = {
    "corpus_split": f"WITH {UTT} SELECT conv_id, turn_idx, speaker, text, strategy FROM utt WHERE split = 'validation'",
    "prediction_csv_scan": f"WITH {PREDICTIONS} SELECT {', '.join(PREDICTION_FIELDS)} FROM pred WHERE context <> '<START>'",
    "result_tree_scan": f"WITH {PAIRS} SELECT llm_alias, classifier, conv_id, turn, reference_response, llm_parsed_response FROM pairs",
    "result_tree_quality": METRIC_ORACLES["generation_quality_summary"],
    "json_array_scan": f"""WITH {LABELLED} SELECT text AS reference_response, '' AS generated_response, strategy_true AS true_strategy,
  CASE WHEN turn % 3 = 0 THEN strategy_pred ELSE '' END AS predicted_strategy FROM pred""",
    "quoted_csv_documents": "SELECT doc_id, lang, source, text FROM documents",
    "result_tree_first": f"""WITH {PAIRS}, f AS (SELECT *, conv_id % 5 % 3 AS part,
  min(conv_id % 5 % 3) OVER (PARTITION BY llm_alias, classifier) AS least FROM pairs)
SELECT llm_alias, classifier, conv_id, turn, reference_response, llm_parsed_response FROM f WHERE part = least
QUALIFY row_number() OVER (PARTITION BY llm_alias, classifier ORDER BY conv_id, turn) <= {FIRST_ROWS}""",
    "result_tree_warnings": f"""WITH {PAIRS}, s(llm_alias, classifier, reason) AS (VALUES ('m0', 'c0', NULL),
  ('m0', 'c1', 'no column llm_parsed_response, reference_response'), ('m1', 'c0', 'empty'), ('m1', 'c1', 'missing'),
  ('m2', 'c0', 'no column llm_parsed_response'), ('m2', 'c1', NULL))
SELECT s.llm_alias, s.classifier, reason, count(p.turn) AS rows FROM s LEFT JOIN pairs p
  ON s.llm_alias = p.llm_alias AND s.classifier = p.classifier AND reason IS NULL GROUP BY ALL HAVING reason IS NOT NULL OR count(p.turn) > 0""",
    "json_array_files": f"""WITH {LABELLED}, {PAIRS}
SELECT coalesce(reference_response, text) AS reference_response, coalesce(llm_parsed_response, '') AS generated_response,
  strategy_true AS true_strategy, CASE WHEN turn % 3 = 0 THEN strategy_pred ELSE '' END AS predicted_strategy
FROM pred LEFT JOIN pairs USING (conv_id, turn) UNION ALL SELECT '', '', stage_true, stage_pred FROM pred""",
    "record_sinks": f"""WITH r AS ({MATCHING_ORACLES['generate_records']})
SELECT llm_alias, classifier, count(*) AS csv_rows, count(*) AS json_rows, count(*) AS equal_rows FROM r GROUP BY ALL""",
    "summary_sink": METRIC_ORACLES["generation_quality_summary"],
    "ablation_scan": f"""WITH {PAIRS} SELECT conv_id || '-' || turn AS index, llm_parsed_response AS llm_response, reference_response,
  llm_parsed_response FROM pairs""",
}
