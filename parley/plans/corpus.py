"""The given tables as dialogue data.

The tables hold no strategies, predictions or generated replies, so those are derived from ids by
integer arithmetic that any SQL engine repeats exactly (see ``corpus_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.context import evaluation_examples, with_earlier
from parley.operators.labels import raw_strategy_name, stage_id, stage_of, strategy_name
from parley.operators.positions import CELL, with_turn_index
from parley.schema import STAGES

CONVERSATIONS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
EMBEDDINGS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)
# where the remainder of the label rule falls, for ids 0 to 7
STRATEGY_LIMITS = [4, 5, 6, 7, 9, 11, 12, 15]


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CONVERSATIONS).parquet(f"{folder}/conversations.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(f"{folder}/embeddings.parquet")


def _true_strategy() -> Column:
    rest = (F.col("conv_id") * 7 + F.col("turn") * 3) % 16
    chosen = F.when(rest <= STRATEGY_LIMITS[0], 0)
    for i, limit in enumerate(STRATEGY_LIMITS[1:], start=1):
        chosen = chosen.when(rest <= limit, i)
    return chosen.cast("int")


def _predicted_strategy() -> Column:
    conv, turn, true = F.col("conv_id"), F.col("turn"), F.col("strategy_true_id")
    shifted = (true + 1 + (conv + turn) % 7) % 8
    return F.when((conv * 5 + turn * 11) % 10 < 6, true).otherwise(shifted).cast("int")


def split_name(conv: str = "conv_id") -> Column:
    rest = F.col(conv) % 10
    return F.when(rest < 8, "train").when(rest == 8, "validation").otherwise("test")


def utterances(spark: SparkSession, folder: str, cell: int | None = None) -> DataFrame:
    """``conv_id, turn, turn_idx, speaker, text, strategy, strategy_true_id, situation, split``.

    With ``cell`` the rows keep the pieces of ``cell`` turns by which they lie together.
    """
    turns = with_turn_index(conversations(spark, folder), cell=cell or CELL, keep=cell is not None)
    speaker = F.when(F.col("role") == "assistant", "sys").otherwise("usr")
    return turns.select(
        "conv_id",
        "turn",
        "turn_idx",
        speaker.alias("speaker"),
        "text",
        F.when(speaker == "sys", raw_strategy_name(_true_strategy())).alias("strategy"),
        F.when(speaker == "sys", _true_strategy()).alias("strategy_true_id"),
        "situation",
        split_name().alias("split"),
        *(["_piece", "_several"] if cell else []),
    )


def share(j: int, of: list[int]) -> str:
    """A weight over a sum of weights at four decimals, in integers until the last step."""
    weight = "((conv_id * 31 + turn * 17 + {} * 13) % 97 + 1)"
    total = "(" + " + ".join(weight.format(i) for i in of) + ")"
    return f"double(({weight.format(j)} * 20000 + {total}) div (2 * {total})) / 10000"


def with_predictions(examples: DataFrame) -> DataFrame:
    """Predicted labels and probabilities for rows with ``conv_id, turn, strategy_true_id``."""
    rows = examples.withColumn("strategy_pred_id", _predicted_strategy())
    rows = rows.withColumn("stage_pred", stage_of(F.col("strategy_pred_id")))
    route = F.col("stage_pred")

    def on(condition: str, j: int, of: list[int]) -> Column:
        return F.expr(f"if({condition}, {share(j, of)}, -1.0D)")

    beyond = "stage_pred <> 'Exploration'"
    explore, comfort, act = [f"stage_pred = '{stage}'" for stage in STAGES[:3]]
    return rows.withColumns(
        {
            "stage_true": stage_of(F.col("strategy_true_id")),
            "stage_pred_id": stage_id(route),
            "stage_true_id": stage_id(stage_of(F.col("strategy_true_id"))),
            "strategy_pred": strategy_name(F.col("strategy_pred_id")),
            "strategy_true": strategy_name(F.col("strategy_true_id")),
            "prob_ex": F.expr(share(8, [8, 9])),
            "prob_su": F.expr(share(9, [8, 9])),
            "prob_co": on(beyond, 10, [10, 11, 12]),
            "prob_ac": on(beyond, 11, [10, 11, 12]),
            "prob_ot": on(beyond, 12, [10, 11, 12]),
            "prob_qu": on(explore, 0, [0, 1]),
            "prob_rp": on(explore, 1, [0, 1]),
            "prob_rf": on(comfort, 2, [2, 3, 4]),
            "prob_sd": on(comfort, 3, [2, 3, 4]),
            "prob_ar": on(comfort, 4, [2, 3, 4]),
            "prob_ps": on(act, 5, [5, 6]),
            "prob_in": on(act, 6, [5, 6]),
        }
    )


def labelled_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Supporter turns with true and predicted labels, without any context."""
    turns = conversations(spark, folder).filter("role = 'assistant'")
    rows = turns.withColumn("strategy_true_id", _true_strategy()).withColumn("split", split_name())
    return with_predictions(rows)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Supporter turns with context, labels, probabilities and the result group they belong to."""
    return with_predictions(evaluation_examples(utterances(spark, folder, CELL))).withColumn(
        "classifier", classifier_name()
    )


def generator_name() -> Column:
    return F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))


def classifier_name() -> Column:
    return F.concat(F.lit("c"), (F.col("turn") % 2).cast("string"))


def requests(rows: DataFrame) -> DataFrame:
    """Rows of predictions as requests for a context, which name a strategy and a whole reply.

    Whole replies never repeat in the given data, so ids decide what a request asks for: some ask
    for another strategy, some for a reply that is blank, spaced otherwise or longer than said, and
    some turns are asked for twice (``attempt`` 0 and 1).
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    said = F.col("label_context")
    reply = (
        F.when((conv * 3 + turn) % 7 == 0, "")
        .when((conv + turn) % 9 == 4, F.concat(F.lit("  "), said, F.lit("\t")))
        .when((conv + turn) % 11 == 5, F.concat(said, F.lit(" again")))
        .otherwise(said)
    )
    strategy = F.when((conv + turn) % 4 == 1, F.col("strategy_pred")).otherwise(F.col("strategy_true"))
    attempts = F.when((conv + turn) % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumns({"label_context": reply, "strategy_true": strategy, "attempt": F.explode(attempts)})


def reply_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each supporter turn against the supporter turn before it in the same conversation.

    Supporter turns are numbered in pieces like all turns, and a piece gets the last one before it, so a
    long conversation needs no task of its own and rows move once.
    """
    replies = with_turn_index(conversations(spark, folder), counted=F.col("role") == "assistant", keep=True)
    narrow = replies.select("conv_id", "turn", "turn_idx", "text", "_piece", "_several")
    return (
        with_earlier(narrow, F.col("text"), "before", 1, CELL)
        .withColumn("llm_parsed_response", F.try_element_at("before", F.lit(1)))
        .filter(F.col("llm_parsed_response").isNotNull())
        .select(
            "conv_id",
            "turn",
            generator_name().alias("llm_alias"),
            classifier_name().alias("classifier"),
            F.col("text").alias("reference_response"),
            "llm_parsed_response",
        )
    )
