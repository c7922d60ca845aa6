"""Keys, columns and rows that pipelines really have: large and NULL keys, clashing names, empty tables, no package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from parley.llm import bpe_tree, cross_parse, ftrl_quality, nb_toxicity, pareto_mix
from parley.llm import periodic_runs, quality_ledger, secret_scan, simhash_grid

BIG = 2**53
KEYS = [None, BIG + 1, BIG + 3]
NAMES = ["_key", "_label", "_copy", "_copies", "_source", "_text", "_hide", "key", "k", "s", "t", "row", "hide", "label"]
TEXTS = ["some words and token = 'abcdef123456' here", "other words, quite different from these", None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s1") for k, t in zip(KEYS, TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, 0) for k in KEYS], "doc_id long, quality int, toxic int")


KEYED = {
    "secrets": lambda d, y: secret_scan.judged(d).withColumnRenamed("key", "doc_id"),
    "toxicity": nb_toxicity.toxicity,
    "quality": ftrl_quality.quality,
    "ledger": lambda d, y: quality_ledger.ledger(d),
    "simhash": lambda d, y: simhash_grid.near_duplicates(d),
    "bpe": lambda d, y: bpe_tree.encode(d),
    "language": lambda d, y: cross_parse.language(d),
    "runs": lambda d, y: periodic_runs.periodic(d),
    "redacted": lambda d, y: secret_scan.redacted(d),
    "deduplicated": lambda d, y: simhash_grid.deduplicated(d),
    "mix": lambda d, y: pareto_mix.mix(d).withColumnRenamed("key", "doc_id"),
}


@pytest.mark.parametrize("name", KEYED)
def test_large_and_null_keys(name, docs, labels):
    rows = KEYED[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, KEYS))


def test_component_ids_of_large_keys(docs):
    same = docs.withColumn("text", F.lit("a b c d e f g"))
    found = simhash_grid.near_duplicates(same).collect()
    assert {r["component_id"] for r in found} == {BIG + 1}


@pytest.mark.parametrize("name", KEYED)
def test_clashing_columns_and_empty_tables(name, docs, labels):
    wide = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    found = KEYED[name](wide, labels).collect()
    assert len(found) == len(KEYS)
    if name in ("redacted", "deduplicated"):
        assert all(r[n] == f"own {n}" for r in found for n in NAMES)
    assert KEYED[name](wide.filter("false"), labels).collect() == []


def test_mixed_keeps_columns(docs):
    wide = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    rows = pareto_mix.mixed(wide).collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES) and {r["doc_id"] for r in rows} <= set(KEYS)


def test_deduplicated_keeps_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base + " more"), (5, "something else entirely, with other words"), (9, base), (9, base)]
    rows += [(7, "again and again"), (7, "again and again"), (None, base), (None, base)]
    kept = simhash_grid.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(
        map(str, [rows[0], (3, base + " more"), rows[2], rows[5], rows[7], rows[8]])
    )


def test_workers_need_no_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from parley.session import local_session
from parley.llm import best_fit, bpe_tree, cross_parse, periodic_runs
spark = local_session("2")
alone = spark.range(1).mapInArrow(lambda it: (__import__("parley") and b for b in it), "id long")
try:
    alone.collect()
except Exception as e:
    assert "No module named" in str(e)
else:
    raise SystemExit("the package is on the workers' path")
docs = spark.range(20).select(F.col("id").alias("doc_id"), F.expr("repeat('one two ', int(id))").alias("text"), F.lit("en").alias("lang"))
for rows in (bpe_tree.encode(docs, piece=50), cross_parse.language(docs), periodic_runs.periodic(docs), best_fit.packed(best_fit.pieces(docs))):
    assert rows.count() == 20
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PARLEY_LOCAL_CHECKPOINTS")}
    found = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stderr[-3000:]
