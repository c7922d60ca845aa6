"""What the operators of this subpackage share: stored steps, seeded numbers, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parley.session import durable, scratch_path

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write rows once as Parquet in the shared folder and go on from the file.

    What is read more than once, or is dear to compute, is kept this way: the file outlives lost
    executors, and later readers get column pruning and filters on it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit(*parts: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the values alone, so that reruns agree."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    head = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (head.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def remainder(key: Column, by: int) -> Column:
    """crc32 of a key's text, modulo ``by``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % by


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda inside the body uses it."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long) as (node, component = least node).

    Alternating large-star and small-star steps: every step replaces edges by edges to the least
    neighbour, so no node's neighbourhood is ever gathered in a row and the number of edges does not
    grow. It takes a number of rounds that grows with the logarithm of the longest path; each round
    is kept by a reliable checkpoint. Loops and repeated edges are allowed; no edges, no rows.
    """

    def least(pairs: DataFrame) -> DataFrame:
        lowest = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(lowest, "u")

    links = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v")
        .distinct()
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            least(both)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        tops = least(large)
        links = durable(
            tops.select("u", F.col("m").alias("v"))
            .unionByName(tops.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def beside(
    rows: DataFrame,
    text: str,
    fields: list[StructField],
    found: Callable[[list[str | None]], list[pa.Array]],
    budget: int = 4_000_000,
) -> DataFrame:
    """``rows`` with what ``found`` tells from the column ``text``, which goes.

    All other columns pass in their Arrow form and are never looked at, so that keys stay exactly what they
    are, NULL or large. ``found`` gets the texts of a slice of about ``budget`` bytes, or one text.
    """
    place = rows.columns.index(text)
    kept = [field for field in rows.schema.fields if field.name != text]
    names = [field.name for field in [*kept, *fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.coalesce(pc.binary_length(batch.column(place).cast(pa.large_binary())), 0).to_numpy()
            part = (np.cumsum(sizes) - sizes) // budget
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    some = batch.slice(start, end - start)
                    told = found(some.column(place).to_pylist())
                    keep = [column for at, column in enumerate(some.columns) if at != place]
                    yield pa.RecordBatch.from_arrays([*keep, *told], names)

    return rows.mapInArrow(run, StructType([*kept, *fields]))
