"""Prefix trie of conversations by whole-sequence collapse.

Equal conversations are first collapsed into one weighted sequence with the list of those that end
there. Only one conversation of each sequence is then spelled out into its prefixes, and prefixes of the
same turns are one node. Sequences that are a proper prefix of another one fall out of an anti-join; what
is left are the leaves. Weights are summed over the prefixes.

A prefix is known by its length and two 64-bit sums (exclusive or) over hashes of (place, turn), which
run along the conversation. No array of turns is ever built: sums run within pieces of ``PIECE`` turns, and a
piece is told the sum of those before it, so that a conversation of any length spreads over tasks.

Every node is owned by the sequence of its smallest member. What a sequence owns are its deepest
prefixes, so a subtree's sum is what the node's owner has from there on, plus everything that the other
sequences through the node own. Both come from sums that need no walk along the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import staged
from parley.operators.positions import with_position

PIECE = 4096
#: Ids of a list that travel as one text.
LISTED = 4096
#: A parent with more than this share of all nodes as children is looked up by broadcast: fewer than 1,000 rows.
HOT_SHARE = 1000
NODE = ["depth", "ka", "kb"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def piece(place: str) -> Column:
    return F.floor(F.col(place) / PIECE).cast("long")


def xor(*parts: Column) -> Column:
    result = F.coalesce(parts[0], F.lit(0))
    for part in parts[1:]:
        result = result.bitwiseXOR(F.coalesce(part, F.lit(0)))
    return result


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, a, b, size): turns as two hashes of role and text, numbered from 1 within their conversation.

    Ordered by turn, NULL first; equal turns by the hashes, so that repeated rows keep a fixed order. NULL
    roles and texts are empty. ``size`` is the number of code points of the text. Rows without a
    conversation belong to none and are left out. Only hashes move.
    """
    said = [F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    narrow = turns.select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("a"),
        F.xxhash64(F.lit(2), *said).alias("b"),
        F.length(said[1]).cast("long").alias("size"),
    ).filter("conv IS NOT NULL")
    return with_position(narrow, ["conv"], ["turn", "a", "b"], "place").select("conv", "place", "a", "b", "size")


def sequences(whole: DataFrame) -> DataFrame:
    """(depth, ka, kb, weight, conv, ends_sha256): one row for each distinct conversation.

    ``whole`` is (conv, depth, ka, kb), a row for each conversation; ``conv`` of a sequence is its smallest, and
    ``ends_sha256`` the digest of all, ascending and comma-joined. Ids are sorted over ranges, so that a
    sequence of very many conversations is listed by many tasks; the digest then runs over the parts
    of its list as a stream.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NODE, "first", "n", "ids"]
        key, ids = None, []

        def part(out: list[tuple]) -> None:
            if ids:
                out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            out: list[tuple] = []
            for *this, conv in zip(*[batch.column(n).to_pylist() for n in (*NODE, "conv")]):
                if this != key or len(ids) == LISTED:
                    part(out)
                    key = this
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        last: list[tuple] = []
        part(last)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*last)], names)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NODE, "weight", "conv", "ends_sha256"]
        key, digest, count, least = None, None, 0, None
        for batch in batches:
            out = []
            for *this, first, n, ids in zip(*[column.to_pylist() for column in batch.columns]):
                if this != key:
                    if key is not None:
                        out.append((*key, count, least, digest.hexdigest()))
                    key, digest, count, least = this, hashlib.sha256(ids.encode()), n, first
                else:
                    digest.update(b"," + ids.encode())
                    count += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        if key is not None:
            row = (*key, count, least, digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row], names)

    shape = "depth long, ka long, kb long"
    order = [*NODE, "conv"]
    parts = whole.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.mapInArrow(listed, f"{shape}, first long, n long, ids string")
    together = parts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return together.mapInArrow(digested, f"{shape}, weight long, conv long, ends_sha256 string")


def prefixes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, depth, ka, kb, pa, pb, size, weight): all prefixes of the conversations that stand for a sequence.

    ``pa`` and ``pb`` are the keys of the prefix that is one turn shorter; the empty prefix has none.
    """
    spelled = found.select(
        "conv", "weight", F.explode(F.sequence(F.lit(0).cast("long"), piece("depth"))).alias("piece")
    )
    cut = rows.withColumn("piece", piece("place"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy("conv", "piece")
        .agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
        .select("conv", "piece", F.bit_xor("xa").over(earlier).alias("ca"), F.bit_xor("xb").over(earlier).alias("cb"))
        .filter("piece > 0")
    )
    so_far = (
        Window.partitionBy("conv", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        cut.join(spelled, ["conv", "piece"])
        .join(carried, ["conv", "piece"], "left")
        .withColumn("ka", xor(F.bit_xor("ha").over(so_far), F.col("ca")))
        .withColumn("kb", xor(F.bit_xor("hb").over(so_far), F.col("cb")))
    )
    inner = running.select(
        "conv", F.col("place").alias("depth"), "ka", "kb",
        xor(F.col("ka"), F.col("ha")).alias("pa"), xor(F.col("kb"), F.col("hb")).alias("pb"), "size", "weight",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = found.select(
        "conv", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"),
        zero.alias("size"), "weight",
    )
    return inner.unionByName(top)


def trie(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are (conv, place, a, b, size), places from 1 without a gap (see ``numbered``); ``convs`` (conv) names
    all conversations, those without a turn too, and may be left out where each has a turn. A node
    is a distinct sequence of first turns; its members start with it. ``conv_id`` is its smallest member,
    ``parent_conv_id`` that of the node one turn above (NULL for the root), ``n_leaves`` counts childless
    nodes in its subtree, itself included, ``saved_tokens`` sums (n_convs - 1) times ``size`` of the last turn over
    its subtree, ``ends_sha256`` is the digest of the members that end there (of nothing, if none). No
    conversation, no rows. Equality is that of 128 bits of hashes.
    """
    hashed = staged(
        rows.select(
            "conv", "place", "size",
            *[F.xxhash64(F.lit(salt), "place", "a", "b").alias(name) for salt, name in ((3, "ha"), (4, "hb"))],
        ),
        "trie-turns",
    )
    ended = hashed.groupBy("conv").agg(
        F.count("*").alias("depth"), F.bit_xor("ha").alias("ka"), F.bit_xor("hb").alias("kb")
    )
    if convs is not None:
        ended = convs.join(ended, "conv", "left").select("conv", *[xor(F.col(c)).alias(c) for c in NODE])
    found = staged(sequences(staged(ended, "trie-conversations")), "trie-sequences")
    spelled = staged(prefixes(hashed, found), "trie-prefixes")
    nodes = staged(
        spelled.groupBy(*NODE).agg(
            F.sum("weight").alias("n_convs"),
            F.min("conv").alias("conv_id"),
            F.min("pa").alias("pa"),
            F.min("pb").alias("pb"),
            F.max("size").alias("size"),
        ),
        "trie-nodes",
    )
    children = (
        nodes.filter("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
        .agg(F.count("*").alias("n_children"))
    )
    leaves = found.join(children, NODE, "left_anti").select("conv", F.lit(1).alias("leaf"))

    # what each sequence owns, and from each of its nodes on
    own = nodes.withColumn("worth", (F.col("n_convs") - 1) * F.col("size")).withColumn("piece", piece("depth"))
    all_of = Window.partitionBy("conv_id")
    later = all_of.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    owned = (
        own.groupBy("conv_id", "piece")
        .agg(F.sum("worth").alias("worth"), F.min("depth").alias("first"))
        .select(
            "conv_id", "piece",
            F.coalesce(F.sum("worth").over(later), F.lit(0)).alias("later"),
            F.sum("worth").over(all_of).alias("total"),
            F.min("first").over(all_of).alias("first"),
        )
    )
    from_here = (
        Window.partitionBy("conv_id", "piece")
        .orderBy(F.desc("depth"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        own.join(owned, ["conv_id", "piece"])
        .withColumn("below", F.sum("worth").over(from_here) + F.col("later") - F.col("total"))
        .select(*NODE, "conv_id", "n_convs", "pa", "pb", "below", (F.col("depth") == F.col("first")).alias("tops"))
    )
    totals = own.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("worth").alias("total"))
    each = (
        found.join(totals, "conv", "left")
        .join(leaves, "conv", "left")
        .select(
            "conv", "total", "leaf",
            F.explode(F.sequence(F.lit(0).cast("long"), piece("depth"))).alias("piece"),
        )
    )
    through = (
        spelled.select("conv", *NODE, piece("depth").alias("piece"))
        .join(each, ["conv", "piece"])
        .groupBy(*NODE)
        .agg(
            F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
            F.sum(F.coalesce("total", F.lit(0))).alias("passing"),
        )
    )
    full = staged(
        placed.join(through, NODE)
        .join(children, NODE, "left")
        .join(found.select(*NODE, "ends_sha256"), NODE, "left")
        .select(
            *NODE, "conv_id", "pa", "pb", "tops", "n_convs", "n_leaves",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            (F.col("below") + F.col("passing")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        ),
        "trie-full",
    )
    return _with_parents(full)


def _with_parents(full: DataFrame) -> DataFrame:
    """``parent_conv_id``: a node that is not the first of its owner has a parent of the same owner; the others
    look it up, children of parents with very many by broadcast."""
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    same = full.filter(~F.col("tops")).select(*columns, F.col("conv_id").alias("parent_conv_id"))
    root = full.filter("depth = 0").select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    first = full.filter("tops AND depth > 0").withColumn("up", F.col("depth") - 1)
    parents = full.filter("n_children > 0").select(
        F.col("depth").alias("up"), F.col("ka").alias("pa"), F.col("kb").alias("pb"),
        F.col("conv_id").alias("parent_conv_id"), "n_children",
    )
    limit = full.count() // HOT_SHARE + 1
    by = ["up", "pa", "pb"]
    # children add up to all nodes but one, so these are fewer than HOT_SHARE parents
    hot = F.broadcast(parents.filter(F.col("n_children") > limit).drop("n_children"))
    cold = parents.filter(F.col("n_children") <= limit).drop("n_children")
    ready = [*columns, "parent_conv_id"]
    return (
        same.unionByName(root)
        .unionByName(first.join(hot, by).select(*ready))
        .unionByName(first.join(hot, by, "left_anti").join(cold, by).select(*ready))
        .select("conv_id", "depth", "parent_conv_id", *columns[2:])
    )


def spliced(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of another one: (rows, convs) for ``trie``.

    Conversation ``c`` takes its first ``h`` turns (crc32 of its digits modulo ``most``) from conversation
    ``c - c % every`` (all, if that has fewer; none, if it is not there), then goes on with its own turns
    after its first ``h``. ``rows`` as ``numbered`` gives them.
    """
    rows = staged(rows, "trie-numbered")
    convs = rows.groupBy("conv").agg(F.count("*").alias("n"))
    heads = rows.filter((F.col("place") < most) & (F.col("conv") % every == 0))
    known = heads.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("heads"))
    convs = staged(
        convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
        .withColumn("base", F.col("conv") - F.col("conv") % every)
        .join(known, "base", "left")
        .select("conv", "n", "h", "base", F.least("h", F.coalesce("heads", F.lit(0))).alias("taken")),
        "trie-spliced",
    )
    taken = (
        convs.filter("taken > 0")
        .join(heads.withColumnRenamed("conv", "base"), "base")
        .filter("place <= taken")
        .select("conv", "place", "a", "b", "size")
    )
    shifts = convs.select(
        "conv", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), piece("n"))).alias("piece")
    )
    own = (
        rows.withColumn("piece", piece("place"))
        .join(shifts, ["conv", "piece"])
        .filter("place > h")
        .select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "size")
    )
    return own.unionByName(taken), convs.select("conv")
