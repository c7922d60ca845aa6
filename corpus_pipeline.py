"""From raw documents to token ids: filter, deduplicate, hide secrets, mix sources, encode.

Every stage takes the rows that the one before it kept and returns them with the columns of
``documents``, but for the last, which returns token ids. ``run`` stores each stage in the shared
folder and goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe_tree, pareto_mix, quality_ledger, secret_scan, simhash_grid
from parley.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_ledger.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_grid.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that are not widely copied examples are hidden; all documents stay."""
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return pareto_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document, decoded text included."""
    return bpe_tree.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

#: SQL cannot express fingerprints and token ids; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
