"""Batch text generation over prompts, and the records that come out of it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import full_name, parse_generated, short_name, tidy
from parley.operators.prompts import ANSWER_HEADING, prompt, resolve_stage, strategy_scores
from parley.schema import GENERATORS, RECORD_FIELDS
from parley.session import stored

Generator = Callable[[list[str]], list[str]]

_SCORE = re.compile(r"^- ([^:\n]+): (-?\d+\.\d{3})$", re.MULTILINE)
_SEEKER = re.compile(r"^Seeker : (.*)$", re.MULTILINE)
ERROR = "Error: "


def echo_generator(prompts: list[str]) -> list[str]:
    """The offline stand-in for a model: names the best scored strategy and quotes the seeker."""
    answers = []
    for text in prompts:
        scores = _SCORE.findall(text.partition(ANSWER_HEADING)[0])
        said = _SEEKER.findall(text)
        response = f"Response: I hear you say: {said[-1] if said else 'nothing yet'}"
        if scores:
            best = max(scores, key=lambda pair: float(pair[1]))[0]
            response = f"Strategy: {best}\n{response}"
        answers.append(response)
    return answers


def _answers(generate: Generator, prompts: list[str]) -> list[str]:
    """One answer per prompt; a failing batch is asked again one by one, and failures become text."""
    try:
        answers = generate(prompts)
        if len(answers) == len(prompts):
            return [(a or "").strip() for a in answers]
    except Exception:  # the rows are tried singly below
        pass
    singly = []
    for text in prompts:
        try:
            singly.append((generate([text])[0] or "").strip())
        except Exception as error:
            singly.append(f"{ERROR}{error}")
    return singly


def generate_text(
    df: DataFrame,
    generate: Generator = echo_generator,
    prompt_column: str = "prompt",
    output: str = "llm_raw_output",
    batch: int = 256,
) -> DataFrame:
    """Add the generator's answer to every row.

    ``generate`` takes a list of prompts and returns as many answers; options such as temperature
    or length are bound into it by the caller. Only prompts go to Python, ``batch`` at a time and
    partitions side by side. A NULL prompt is asked as an empty one. Answers may differ from call to
    call, so the column is marked as such and is never asked for twice for a row.
    """

    @F.pandas_udf(T.StringType())
    def answer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in prompts:
            answers: list[str] = []
            texts = part.fillna("").tolist()
            for start in range(0, len(texts), batch):
                answers += _answers(generate, texts[start : start + batch])
            yield pd.Series(answers, dtype=object)

    return df.withColumn(output, answer.asNondeterministic()(F.col(prompt_column)))


LEDGER = "digest string, answer string, failed boolean"


def prompt_digest(prompt_column: str = "prompt", asked_of: tuple[str, ...] = ()) -> Column:
    """What a prompt is known by: its text and the columns that say who is asked."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*asked_of, prompt_column)]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(digest, answer, failed, run) of all runs so far; without a run, no rows."""
    shape = f"{LEDGER}, run int"
    try:
        return spark.read.schema(shape).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def settled(runs: DataFrame) -> DataFrame:
    """(digest, answer, failed): the last answer to each prompt, or if none succeeded the last failure."""
    rank = F.struct(~F.col("failed"), F.col("run"))
    return runs.groupBy("digest").agg(F.max_by("answer", rank).alias("answer"), F.min("failed").alias("failed"))


def resume_generation(
    df: DataFrame,
    ledger: str,
    generate: Generator = echo_generator,
    prompt_column: str = "prompt",
    asked_of: tuple[str, ...] = (),
    output: str = "llm_raw_output",
    batch: int = 256,
) -> DataFrame:
    """:func:`generate_text`, asking only what no earlier run has an answer to.

    Every run writes its answers to a folder of ``ledger``, keyed by the digest of the prompt and of
    the columns ``asked_of``. A later run asks for prompts that are not there, or that only ever failed; equal
    prompts are asked once. A run that is lost leaves answers that count or none, so it can simply be
    started again; a run with nothing to ask writes nothing. Two runs at the same time may ask twice. Rows
    get the last good answer, or the last failure.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_digest", prompt_digest(prompt_column, asked_of))
    wanted = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.min(prompt_column).alias("prompt"))
    runs = read_ledger(spark, ledger)
    good = runs.filter("NOT failed").select("digest").distinct()
    # stored, so that the question whether there is anything to ask is not worked out twice
    open_prompts = stored(wanted.join(good, "digest", "left_anti"), "open-prompts")
    if open_prompts.limit(1).count():
        run = (runs.agg(F.max("run")).first()[0] or 0) + 1
        answered = generate_text(open_prompts, generate, "prompt", "answer", batch)
        failed = F.col("answer").startswith(ERROR)
        answered.select("digest", "answer", failed.alias("failed")).write.parquet(f"{ledger.rstrip('/')}/run={run}")
    answers = settled(read_ledger(spark, ledger)).select(F.col("digest").alias("_digest"), F.col("answer").alias(output))
    return keyed.join(answers, "_digest", "left").drop("_digest")


def with_combinations(requests: DataFrame, generators: list[str]) -> DataFrame:
    """One copy of every request per generator (a short list given by the caller)."""
    names = F.array(*[F.lit(g) for g in generators])
    return requests.withColumn("_generator", F.explode(names)).select(
        "*",
        short_name(F.col("_generator"), GENERATORS).alias("llm_alias"),
        full_name(F.col("_generator"), GENERATORS).alias("llm_id"),
    ).drop("_generator")


def with_prompts(requests: DataFrame, mode: str = "staged", allow_truth: bool = True) -> DataFrame:
    """Add ``stage`` and ``prompt``."""
    ready = requests.withColumns({"stage": resolve_stage(allow_truth), "scores": strategy_scores()})
    return ready.withColumn("prompt", prompt(mode)).drop("scores")


def records(generated: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 15 record columns, with the answer taken apart."""
    parsed = parse_generated(F.col("llm_raw_output"))
    named = {
        "prediction": tidy(F.col("strategy_pred")),
        "prediction_id": F.coalesce(F.col("strategy_pred_id").cast("string"), F.lit("")),
        "reference": tidy(F.col("strategy_true")),
        "reference_id": F.coalesce(F.col("strategy_true_id").cast("string"), F.lit("")),
        "reference_response": tidy(F.col("label_context")),
        "llm_predict_strategy": parsed["strategy"],
        "llm_parsed_response": parsed["response"],
    }
    return generated.select(
        *keep, *[named.get(name, F.col(name)).alias(name) for name in RECORD_FIELDS]
    )


def failures(record_rows: DataFrame) -> DataFrame:
    """How many rows of each generator and classifier failed, with one of the messages."""
    return (
        record_rows.filter(F.col("llm_raw_output").startswith(ERROR))
        .groupBy("llm_alias", "classifier")
        .agg(F.count("*").alias("failed"), F.min("llm_raw_output").alias("example"))
    )
