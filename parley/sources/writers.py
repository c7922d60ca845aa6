"""Sinks: a table for further work, and CSV or JSON for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.schema import RECORD_FIELDS


def csv_writer(df: DataFrame):
    # emptyValue keeps "" apart from NULL, and both read back as they were
    return df.write.options(header=True, quote='"', escape='"', emptyValue='""', nullValue="")


def save_predictions(predictions: DataFrame, path: str, csv: bool = False) -> None:
    if csv:
        csv_writer(predictions).csv(path)
    else:
        predictions.write.parquet(path)


def save_records(record_rows: DataFrame, path: str) -> None:
    """Records as a table, as CSV and as JSON, each by generator and classifier.

    The table is written first and the other two are made from it: the generator runs once, and all
    three hold the same rows even if tasks are repeated.
    """
    spark = record_rows.sparkSession
    keys = ["llm_alias", "classifier"]
    record_rows.select(*RECORD_FIELDS).write.partitionBy(*keys).parquet(f"{path}/table")
    stored = spark.read.schema(record_rows.select(*RECORD_FIELDS).schema).parquet(f"{path}/table")
    # folder names use copies, so the files keep all 15 columns
    rows = stored.select(
        *[F.col(k).alias(f"by_{k}") for k in keys], *RECORD_FIELDS
    )
    folders = [f"by_{k}" for k in keys]
    csv_writer(rows).partitionBy(*folders).csv(f"{path}/csv")
    rows.write.partitionBy(*folders).option("ignoreNullFields", False).json(f"{path}/json")


def save_summary(summary: DataFrame, path: str, order: list | None = None) -> None:
    """A summary has one row per result set; it goes to a single CSV file in the given order."""
    ordered = summary.orderBy(*order) if order else summary
    csv_writer(ordered.coalesce(1)).csv(path)
