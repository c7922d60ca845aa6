"""Mix sources to target weights by Pareto order sampling.

Every document is due an expected number of copies. Its whole part is certain; the fraction is an
inclusion chance, and who gets the further copy is decided by Pareto order sampling (Rosén 1997):
documents are ranked by the odds of a random number over the odds of their inclusion chance, and
those with the smallest ratios are taken until the source's words are full. Samples are of fixed
size (in words), chances are unequal, and a rerun gives the same sample, because the random numbers
are hashes of the key.

No source is ever sorted. The rank is cut by a histogram of the ratio per source, refined once
within the bin where the cut falls; only the rows of the refined bin are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import staged, unit
from parley.operators.positions import with_position
from parley.session import durable

WEIGHTS = (5, 2, 1)
CAP = 3
#: Preferences are whole numbers up to this.
LEVELS = 64
LEAST_LEVEL = 16
BINS = 4096
SEED = 1


def n_words(text: Column) -> Column:
    """Number of runs of anything but blanks; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """Add ``target`` to ``sizes`` (source, source_size: long), the weight being dealt by the order of sources.

    The targets add up to ``share`` of all sizes. A target stops at ``cap`` times its source's size;
    the excess is dealt to the others by weight until none is above. Each round stops all that are
    above at once, and asks one aggregated row. NULL is a source and comes last.
    """
    numbered = with_position(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    rows = durable(numbered.withColumn("weight", weight.cast("long")).drop("_last", "_place"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    goal = min(float(total) * share, float(total * cap))
    full = F.lit(False)
    while True:
        left = rows.agg(
            F.sum(F.when(full, F.col("source_size") * cap)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if not left["weight"]:
            return rows.withColumn("target", (F.col("source_size") * cap).cast("double"))
        rest = goal - float(left["given"] or 0)
        due = F.col("weight") * F.lit(rest) / F.lit(float(left["weight"]))
        above = full | (due > F.col("source_size") * cap)
        if not rows.filter(above & ~full).limit(1).count():
            limit = F.col("source_size") * cap
            return rows.withColumn("target", F.when(full, limit.cast("double")).otherwise(due))
        full = above


def expected(levels: DataFrame, cap: int = CAP) -> DataFrame:
    """The scale that turns a preference level into expected copies, per source.

    ``levels`` holds (source, target, level, level_size), a few rows for each source. Copies are
    ``min(cap, scale * level)``; the scale is such that they add up to the target in words. The
    highest levels are the first to reach the cap, so it is enough to look at each number of them.
    """
    falling = Window.partitionBy("source").orderBy(F.desc("level"))
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    onward = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("level_size").over(before), F.lit(0))
    weighed = F.sum(F.col("level") * F.col("level_size")).over(onward)
    scale = F.when(weighed > 0, (F.col("target") - cap * capped) / weighed).otherwise(F.lit(0.0))
    tried = levels.withColumn("scale", scale)
    fits = tried.filter(F.col("scale") * F.col("level") <= cap * (1 + 1e-9))
    return fits.groupBy("source").agg(F.max_by("scale", "level").alias("scale"))


def sample(docs: DataFrame, cap: int = CAP, seed: int = SEED, bins: int = BINS) -> DataFrame:
    """Add ``copies`` to rows (key, size, level, source, source_size, target) so that words come near the targets.

    Rows of a source are taken whole in the order of (ratio, key) while that brings the words nearer
    to the target; rows that tie in both are taken together or not at all. Sources are compared
    null-safe. Rows of size 0 get their certain copies only by chance of their own fraction, which
    costs no words.
    """
    levels = docs.groupBy("source", "target", "level").agg(F.sum("size").alias("level_size"))
    scales = staged(expected(levels, cap), "pareto-scales").withColumnRenamed("source", "_s")
    due = docs.join(scales, docs["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    copies = F.least(F.lit(float(cap)), F.coalesce("scale", F.lit(0.0)) * F.col("level"))
    due = due.withColumn("due", copies).withColumn("certain", F.floor("due").cast("long"))
    chance = F.col("due") - F.col("certain")
    random = unit(F.col("key"), seed=seed)
    ratio = (random / (1 - random)) / (chance / (1 - chance))
    ranked = staged(
        due.withColumn("rank", F.when(chance > 0, ratio / (1 + ratio)))
        .withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)).cast("int"))
        .select("key", "size", "source", "source_size", "target", "certain", "rank", "bin"),
        "pareto-rows",
    )
    certain = ranked.groupBy("source").agg(
        (F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("open")
    )

    def cut(rows: DataFrame, name: str, open_words: DataFrame) -> DataFrame:
        """(source, open, name): the bin where the words of a source run full, and what is left for it."""
        filled = rows.groupBy("source", name).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy(name)
        before = F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        filled = filled.withColumn("before", before)
        other = open_words.select(F.col("source").alias("_s"), "open")
        return (
            filled.join(other, filled["source"].eqNullSafe(F.col("_s")))
            .filter(F.col("before") < F.col("open"))
            .groupBy("source")
            .agg(F.max_by(F.col("open") - F.col("before"), name).alias("open"), F.max(name).alias(name))
        )

    ranks = ranked.filter("rank is not null")
    first = staged(cut(ranks, "bin", certain), "pareto-bins")
    edge = first.select(F.col("source").alias("_s"), F.col("bin").alias("edge"))
    within = ranks.join(edge, ranks["source"].eqNullSafe(F.col("_s"))).filter("bin = edge").drop("_s", "edge")
    fine = (F.col("rank") * bins - F.col("bin")) * bins
    within = within.withColumn("fine", F.greatest(F.lit(0), F.least(F.floor(fine), F.lit(bins - 1))).cast("int"))
    second = staged(cut(within, "fine", first.select("source", "open")), "pareto-fine-bins")
    last = second.select(F.col("source").alias("_s"), F.col("fine").alias("edge"), "open")
    tail = within.join(last, within["source"].eqNullSafe(F.col("_s"))).filter("fine = edge")
    ordered = Window.partitionBy("source").orderBy("rank", "key")
    run = F.sum("size").over(ordered)
    start = run - F.sum("size").over(Window.partitionBy("source", "rank", "key"))
    tail = tail.withColumn("run", run).withColumn("start", start)
    # the row at which the words run full is taken if that misses the target by less
    taken = tail.filter((F.col("run") <= F.col("open")) | (F.col("run") + F.col("start") < 2 * F.col("open")))
    ends = taken.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("last"))
    cuts = (
        first.select("source", "bin")
        .join(second.select(F.col("source").alias("_a"), "fine"), same_as("source", "_a"), "left")
        .join(ends.select(F.col("source").alias("_b"), "last"), same_as("source", "_b"), "left")
        .select(F.col("source").alias("_s"), F.col("bin").alias("edge"), F.col("fine").alias("fine_edge"), "last")
    )
    cuts = staged(cuts, "pareto-cuts")
    # nothing below: no word is open; a bin below the edge: taken; in it: by the finer bins, then by row
    at = F.greatest(F.lit(0), F.least(F.floor(fine), F.lit(bins - 1))).cast("int")
    here = F.struct("rank", "key")
    chosen = (
        F.when(F.col("rank").isNull() | F.col("edge").isNull(), False)
        .when(F.col("bin") != F.col("edge"), F.col("bin") < F.col("edge"))
        .when(at != F.col("fine_edge"), at < F.col("fine_edge"))
        .otherwise(F.coalesce(here <= F.col("last"), F.lit(False)))
    )
    return ranked.join(cuts, ranked["source"].eqNullSafe(F.col("_s")), "left").select(
        "key",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("certain") + F.when(chosen, 1).otherwise(0)).alias("copies"),
    )


def same_as(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    level: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """(key, size, source_size, source, target, copies, taken) for every row of ``docs``.

    ``level`` is a preference from 1 to 64 over ``docs`` and the columns ``_size``, ``_source_size``
    and ``_source_rows``; the default lowers it, to 16 at least, for texts longer than their
    source's average, so that a few long texts don't fill a source. Expected copies are in
    proportion to it within a source. NULL texts have size 0 and a NULL source is a source. Repeated
    rows get the same copies. An empty table gives no rows. Extra columns are not looked at.
    """
    named = {"key": F.col(key), "source": F.col(source), "size": n_words(F.col(text))}
    if level is not None:
        named["level"] = level.cast("long")
    rows = staged(docs.select(*[column.alias(name) for name, column in named.items()]), "pareto-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goals = staged(targets(sizes, weights, share, cap), "pareto-targets").withColumnRenamed("source", "_s")
    rows = rows.join(goals, rows["source"].eqNullSafe(F.col("_s")))
    if level is None:
        rows = rows.withColumn("level", shorter_first())
    chosen = sample(rows.select("key", "size", "source", "source_size", "target", "level"), cap, seed)
    return chosen.withColumn("taken", F.col("copies") * F.col("size"))


def shorter_first() -> Column:
    """The default preference: the source's average size over the row's own, in 64ths from 16 to 64."""
    own = F.col("source_rows") * F.col("size")
    level = F.when(own > 0, F.expr(f"{LEVELS} * source_size div (source_rows * size)")).otherwise(LEVELS)
    return F.greatest(F.lit(LEAST_LEVEL), F.least(F.lit(LEVELS), level)).cast("long")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns stay as they are.

    Keys are expected to be unique within a source; rows that share both get the largest of their
    numbers of copies. A NULL key or source is a value like any other.
    """
    copies = mix(docs, key, text, source, **options).groupBy("key", "source").agg(F.max("copies").alias("copies"))
    copies = copies.filter("copies > 0")
    # a row goes along as one value, so that its columns may have any name
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.col(source).alias("s"))
    taken = rows.join(copies, same_as("k", "key") & same_as("s", "source"))
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
