"""SimHash near-duplicates: fingerprints in a grid of bit counts, joined by Manhattan distance.

A 64-bit fingerprint is cut in segments of two bits, and each segment is replaced by how many of its
bits are set. Two fingerprints differ in at least as many bits as their counts differ in sum, so the
Manhattan distance of the counts is a lower bound. The counts are two halves of 16: fingerprints
within 4 bits are within distance 2 in the first half or within 1 in the second, which makes each
half a grid range join. Both sides of it put a fingerprint in its own cell and in the cells one step
off; cells at distance 2 then meet half way, and nobody has to list a ball of radius 2. What shares
a cell is verified on the exact bits.

Only distinct fingerprints take part, so copies cost nothing. A cell with more than ``dense``
fingerprints is not paired at all: its members are tied to the bit patterns within 2 bits of them,
and two of them share such a pattern exactly if they are within 4 bits. That is linear in the
members and gives the same components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from parley.llm.common import beside, components, staged

SHINGLE = 4
SEED = 42
BITS = 4
#: Largest difference of counts to look for in each half: (2 + 1) + (1 + 1) is one more than 4.
REACH = ((0, 2), (32, 1))
DENSE = 4096
_BLOCK = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as a signed 64-bit number; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        pairs = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        # sums of up to 248 rows fit a byte, which is added many at a time
        whole = len(bits) // 248 * 248
        set_bits += bits[:whole].reshape(-1, 248, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        set_bits += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([fingerprint(t) for t in texts], pa.int64())]

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return beside(rows, "t", [StructField("fp", LongType())], run)


def counts(fp: Column, first: int) -> Column:
    """Bits set in each of the 16 segments from bit ``first`` on, kept in the two bits of the segment."""
    half = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(0xFFFFFFFF))
    odd = F.lit(0x55555555)
    return half.bitwiseAND(odd) + F.shiftrightunsigned(half, 1).bitwiseAND(odd)


def cells(fps: DataFrame, reach=REACH) -> DataFrame:
    """(half, cell, own, fp): where each fingerprint is found, one step off included.

    A half of reach 0 would need its own cell only; both halves here have 1 or more.
    """
    cases = []
    for half, (first, _) in enumerate(reach):
        mine = F.col(f"counts_{half}")
        steps = [F.struct(F.lit(half).alias("half"), mine.alias("cell"), F.lit(True).alias("own"))]
        for place in range(0, 32, 2):
            one = F.lit(1 << place)
            count = F.shiftrightunsigned(mine, place).bitwiseAND(F.lit(3))
            for possible, cell in ((count < 2, mine + one), (count > 0, mine - one)):
                steps.append(
                    F.when(
                        possible, F.struct(F.lit(half).alias("half"), cell.alias("cell"), F.lit(False).alias("own"))
                    )
                )
        cases += steps
    return (
        fps.withColumns({f"counts_{half}": counts(F.col("fp"), first) for half, (first, _) in enumerate(reach)})
        .select("fp", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull())).alias("c"))
        .select("c.half", "c.cell", "c.own", "fp")
    )


def close_pairs(fps: DataFrame, bits: int = BITS, reach=REACH, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of ``fps`` (fp) within ``bits`` bits.

    Every edge holds a verified pair, but for dense cells, where members point at the least member
    that shares a pattern half way with them, which is within ``bits`` as well.
    """
    if sum(r + 1 for _, r in reach) <= bits or any(r > 2 for _, r in reach):
        raise ValueError("the reach of the halves does not cover the distance")
    found = staged(cells(fps, reach), "simhash-cells")
    crowded = found.groupBy("half", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > dense)
    crowded = staged(crowded, "simhash-crowded")
    left = found.select("half", "cell", F.col("own").alias("own_a"), F.col("fp").alias("a"))
    right = found.select("half", "cell", F.col("own").alias("own_b"), F.col("fp").alias("b"))
    met = F.col("own_a") | F.col("own_b")
    for half, (first, far) in enumerate(reach):
        if far > 1:  # two cells one step off meet half way, unless they come from the same cell
            met = met | ((F.col("half") == half) & (counts(F.col("a"), first) != counts(F.col("b"), first)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    sparse = left
    if crowded.limit(1).count():
        sparse = left.join(crowded.select("half", "cell"), ["half", "cell"], "left_anti")
    pairs = sparse.join(right, ["half", "cell"]).filter((F.col("a") < F.col("b")) & met & near).select("a", "b")
    if crowded.limit(1).count():
        pairs = pairs.unionByName(half_way(found.join(crowded.select("half", "cell"), ["half", "cell"]), bits))
    return pairs.distinct()


def half_way(members: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) from members (half, cell, fp) through the patterns within ``bits / 2`` of them."""
    masks = [0]
    for size in range(1, bits // 2 + 1):
        masks += [sum(1 << p for p in places) for places in combinations(range(64), size)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    patterns = F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col("fp").bitwiseXOR(m))
    tied = members.select("fp").distinct().select("fp", F.explode(patterns).alias("pattern"))
    least = tied.groupBy("pattern").agg(F.min("fp").alias("a"), F.max("fp").alias("last"))
    least = least.filter("a < last").select("pattern", "a")
    return tied.join(least, "pattern").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest key reachable through fingerprints that differ in 4 or fewer
    bits, the row's own included. NULL and empty texts and those of blanks have fingerprint 0 and
    are linked like any other; rows with equal keys stay separate rows; NULL keys are never the
    smallest, and a component of NULL keys has NULL. An empty table gives no rows. Other columns of
    ``docs`` are not looked at.
    """
    rows = staged(fingerprints(docs, key, text), "simhash-rows")
    distinct = staged(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-fps")
    joined = components(close_pairs(distinct.select("fp"), dense=dense))
    grouped = distinct.join(joined, distinct["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group")
    )
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "group").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest key.

    Keys are expected to be unique; rows that repeat a key stay together if one of them is to stay, once for
    each text. Rows with a NULL key cannot be named and stay as they are. Columns
    stay as they are, whatever their names. Texts are shuffled only where a key is repeated; else
    the keys that go are sent to where the rows are.
    """
    groups = staged(near_duplicates(docs, key, text, **options).select(F.col(key).alias("k"), "component_id"), "simhash-groups")
    each = groups.filter("k IS NOT NULL").groupBy("k")
    each = each.agg(F.count("*").alias("n"), F.bool_or(F.col("k") == F.col("component_id")).alias("stays"))
    gone, again = each.filter("NOT stays").select("k"), each.filter("stays AND n > 1").select("k")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    # merged at any size: a table of keys that is broadcast while it is small would change the plan as it grows
    kept = rows.join(gone.hint("merge"), "k", "left_anti")
    if again.limit(1).count():
        once = kept.join(again, "k", "left_semi").withColumn("digest", F.sha2("t", 256)).dropDuplicates(["k", "digest"])
        kept = kept.join(again, "k", "left_anti").unionByName(once.drop("digest"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
