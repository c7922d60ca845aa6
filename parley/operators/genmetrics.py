"""Corpus-level quality of generated text against references, per group.

Input is one row per (reference, hypothesis) pair. Scores of a pair are computed where the row is,
and only partial sums travel to the groups, so one group with a large share of the rows is no hot
spot. Distinct k-grams are the one thing that needs a shuffle; equal ones are combined before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.functions.alignment import (
    ORDERS,
    clipped_matches,
    lcs_length,
    trigram_match_f1,
    vector_match,
)
from parley.functions.numeric import round_exact
from parley.functions.text import present
from parley.functions.tokens import blank_tokens, labelled_grams, punctuation_tokens, word_tokens
from parley.operators.positions import whole_groups
from parley.schema import SUMMARY_FIELDS

TOKENIZERS = {"words": word_tokens, "punctuation": punctuation_tokens, "blanks": blank_tokens}
SMOOTHING = 5
BETA = 1.2
# rows whose scores go on together
SCORED = 1024


def tokenized(
    pairs: DataFrame,
    by: list[str],
    key: list[str],
    ref: str = "reference_response",
    hyp: str = "llm_parsed_response",
    tokenizer: str = "words",
) -> DataFrame:
    """Group and row key with both token arrays; NULL text reads as empty."""
    cut = TOKENIZERS[tokenizer]
    return pairs.select(
        *by, *key, cut(F.col(hyp)).alias("hyp"), cut(F.col(ref)).alias("ref")
    )


def row_scores(tokens: DataFrame, rouge: bool = True, soft: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per pair: lengths, clipped n-gram matches ``m1..m4``, unigram F1, ROUGE-L and soft match.

    Tokens go unless ``keep`` names them. All of it is computed within the row in one Arrow pass, so nothing is shuffled. Clipping by
    exploding n-grams instead costs a move of all tokens and eight hashed rows per token.
    """
    rows = tokens.withColumns(
        {"h_len": F.size("hyp"), "r_len": F.size("ref"), "_m": clipped_matches("hyp", "ref")}
    )
    if rouge:
        rows = rows.withColumn("lcs", lcs_length("hyp", "ref"))
    if soft:
        rows = rows.withColumn("soft", trigram_match_f1("hyp", "ref"))
    gone = {"hyp", "ref", "_m"} - set(keep)
    rows = rows.select(*[c for c in rows.columns if c not in gone], "_m.*")
    rows = rows.withColumn("f1", overlap_f1(F.col("m1"), F.col("h_len"), F.col("r_len")))
    if rouge:
        rows = rows.withColumn("rouge_l", rouge_l(F.col("lcs"), F.col("h_len"), F.col("r_len")))
    return rows


def overlap_f1(matched: Column, hyp_len: Column, ref_len: Column) -> Column:
    precision = matched / F.greatest(hyp_len.cast("double"), F.lit(1e-10))
    recall = matched / F.greatest(ref_len.cast("double"), F.lit(1e-10))
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-10))


def rouge_l(lcs: Column, hyp_len: Column, ref_len: Column) -> Column:
    precision = lcs / F.greatest(hyp_len.cast("double"), F.lit(1e-10))
    recall = lcs / F.greatest(ref_len.cast("double"), F.lit(1e-10))
    weighted = recall + BETA**2 * precision
    return F.when(lcs > 0, (1 + BETA**2) * precision * recall / weighted).otherwise(0.0)


def bleu_parts() -> list[Column]:
    """Aggregates over pairs: matches ``N1..4``, totals ``D1..4`` (at least 1 per pair), lengths."""
    parts = []
    for n in ORDERS:
        parts.append(F.sum(f"m{n}").alias(f"N{n}"))
        parts.append(F.expr(f"sum(greatest(h_len - {n - 1}, 1))").alias(f"D{n}"))
    return [*parts, F.sum("h_len").alias("H"), F.sum("r_len").alias("R")]


def bleu_of(k: int) -> Column:
    """Corpus BLEU of order ``k`` with weights 1/k over :func:`bleu_parts` (Papineni et al. 2002).

    Orders without a match are smoothed (Chen and Cherry 2014, method 4) as long as there is more
    than one hypothesis token; all four orders take part in the smoothing whatever ``k`` is. An
    order that stays at zero makes the score zero.
    """
    precisions = []
    for n in ORDERS:
        empty_before = " + ".join(f"int(N{m} = 0)" for m in range(1, n + 1))
        smoothed = f"ln(H) / (pow(2, {empty_before}) * {SMOOTHING})"
        precisions.append(f"(if(N{n} = 0 and H > 1, {smoothed}, double(N{n})) / D{n})")
    usable = " and ".join(["N1 > 0", *[f"{p} > 0" for p in precisions[1:]]])
    logs = " + ".join(f"ln({p})" for p in precisions[:k])
    brevity = "if(H > R, 1.0D, exp(1 - R / double(H)))"
    return F.expr(f"if({usable}, {brevity} * exp(({logs}) / {k}), 0.0D)")


def distinct_k(tokens: DataFrame, by: list[str], orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Exact share of distinct k-grams per group, one column ``distinct_k`` for each order.

    Equal k-grams are combined before they move and then meet by (group, k-gram).
    """
    entries = [labelled_grams(F.col("hyp"), n) for n in orders]
    counted = (
        tokens.select(*by, F.explode_outer(F.concat(*entries)).alias("_e"))
        .groupBy(*by, F.col("_e.n").alias("n"), F.col("_e.gram").alias("gram"))
        .agg(F.count("_e").alias("times"))
    )
    shares = []
    for n in orders:
        own = F.col("n") == n
        shares.append(
            (
                F.count_if(own) / F.greatest(F.coalesce(F.sum(F.when(own, F.col("times"))), F.lit(0)), F.lit(1))
            ).alias(f"distinct_{n}")
        )
    return counted.groupBy(*by).agg(*shares)


def evaluate_generation(
    pairs: DataFrame,
    by: list[str],
    key: list[str],
    ref: str = "reference_response",
    hyp: str = "llm_parsed_response",
    tokenizer: str = "words",
) -> DataFrame:
    """All text metrics per group, times 100 (the mean length is not scaled).

    ``NULL`` is a group like any other; without group columns all pairs are one group. Pairs are read, cut
    into tokens and scored once: a pair gives a row for its scores and one for each of its k-grams, tagged by
    k, and one aggregation by (group, k, k-gram) sums the scores and brings equal k-grams together. It is
    the only wide shuffle, combined before it; the second aggregation gets a few numbers for each task.
    """
    if not by:
        one = evaluate_generation(pairs.withColumn("_all", F.lit(0)), ["_all"], key, ref, hyp, tokenizer)
        return one.drop("_all")
    orders = (1, 2)
    rows = row_scores(tokenized(pairs, by, key, ref, hyp, tokenizer), keep=("hyp",))
    # a score row has no k-gram, and all of a group meet in one row of each task before they move
    own = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("gram")))
    tagged = rows.withColumn("_e", F.explode(F.concat(own, *[labelled_grams(F.col("hyp"), k) for k in orders])))
    scored = F.col("_e.n") == 0
    parts = {
        "pairs": F.lit(1),
        "length": F.col("h_len").cast("double"),
        **{c: F.col(c) for c in ("f1", "rouge_l", "soft")},
        **{f"N{n}": F.col(f"m{n}") for n in ORDERS},
        **{f"D{n}": F.greatest(F.col("h_len") - (n - 1), F.lit(1)) for n in ORDERS},
        "H": F.col("h_len"),
        "R": F.col("r_len"),
    }
    grams = tagged.groupBy(*by, F.col("_e.n").alias("_n"), F.col("_e.gram").alias("_gram")).agg(
        F.count("*").alias("_times"), *[F.sum(F.when(scored, value)).alias(name) for name, value in parts.items()]
    )

    def share(k: int) -> Column:
        own = F.col("_n") == k
        times = F.coalesce(F.sum(F.when(own, F.col("_times"))), F.lit(0))
        return F.count_if(own) / F.greatest(times, F.lit(1))

    sums = grams.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in parts], *[share(k).alias(f"distinct_{k}") for k in orders]
    )
    means = {"f1": "f1", "rouge_l": "rouge_l", "soft": "soft_match"}
    return sums.select(
        *by,
        "pairs",
        (F.col("length") / F.col("pairs")).alias("length"),
        *[(100 * F.col(f"distinct_{k}")).alias(f"distinct_{k}") for k in orders],
        *[(100 * bleu_of(k)).alias(f"bleu_{k}") for k in (1, 2)],
        *[(100 * F.col(name) / F.col("pairs")).alias(shown) for name, shown in means.items()],
    )


def soft_match_with_vectors(
    pairs: DataFrame,
    vectors: DataFrame,
    key: list[str],
    ref: str = "reference_response",
    hyp: str = "llm_parsed_response",
    tokenizer: str = "words",
    salts: int = 16,
) -> DataFrame:
    """Soft match per pair with given token vectors ``(token, vector)``.

    A row asks once for each of its distinct tokens. Common words are asked for by nearly every
    row, so the vector table is repeated ``salts`` times and rows spread over the copies. Tokens with
    their vectors then lie together by row and pass one by one: a task's Python holds a batch of them
    and the tokens of one row, however many and long the rows are.
    """
    tokens = tokenized(pairs, [], key, ref, hyp, tokenizer)
    sides = F.concat(
        labelled_grams(F.col("hyp"), 1, is_ref=0), labelled_grams(F.col("ref"), 1, is_ref=1)
    )
    asked = (
        tokens.repartition(*key)
        .select(*key, F.explode_outer(sides).alias("_e"))
        .groupBy(*key, F.col("_e.is_ref").alias("is_ref"), F.col("_e.gram").alias("token"))
        .agg(F.count("_e").alias("count"))
        .withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    )
    spread = vectors.select("token", "vector").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    )
    found = asked.join(spread, ["token", "_salt"], "left").select(*key, "is_ref", "count", "vector")
    shape = StructType([*found.select(*key).schema.fields, StructField("soft_match", DoubleType())])
    places = list(range(len(key)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = whole_groups(batches, places)
        while some := list(islice(map(one, rows), SCORED)):
            keys = pa.concat_tables([k for k, _ in some]).combine_chunks()
            columns = [column.chunk(0) for column in keys.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in some], pa.float64())], shape.names)

    def one(row: pa.Table) -> tuple[pa.Table, float]:
        """A row's key and score."""
        is_ref, count, vector = (row.column(len(places) + i).combine_chunks() for i in range(3))
        sides = [pc.equal(is_ref, side) for side in (0, 1)]
        score = vector_match(*[(count.filter(own), vector.filter(own)) for own in sides])
        # a copy, as a slice would keep the whole batch
        return row.select(places).take([0]), score

    return found.repartition(*key).sortWithinPartitions(*key).mapInArrow(scored, shape)


def summary(metrics: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The published columns, rounded to two decimals."""
    sources = ["bleu_1", "bleu_2", "rouge_l", "distinct_1", "distinct_2", "soft_match"]
    named = [round_exact(F.col(s), 2).alias(name) for s, name in zip(sources, SUMMARY_FIELDS[1:])]
    return metrics.select(*keep, F.col(model).alias("model"), *named)


def ref_hyp_pairs(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Reference and hypothesis of every row, NULL read as empty."""
    return rows.select(
        *keep,
        present(F.col("reference_response")).alias("reference_response"),
        present(F.col("llm_parsed_response")).alias("llm_parsed_response"),
    )


def missing_results(found: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """The expected (generator, classifier) pairs that have no rows, with a warning text."""
    rows = [
        F.struct(F.lit(g).alias("llm_alias"), F.lit(c).alias("classifier")) for g, c in expected
    ]
    wanted = found.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return wanted.join(
        found.select("llm_alias", "classifier").distinct(), ["llm_alias", "classifier"], "left_anti"
    ).withColumn("warning", F.concat_ws("/", "llm_alias", F.concat("classifier", F.lit(": missing or empty"))))
