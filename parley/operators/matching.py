"""Match requests to corpus turns by k-th occurrence.

Equal replies occur again and again, and each corpus turn may serve one request: the k-th request
for a (strategy, reply) gets the k-th corpus turn with that pair. What is left over is matched by
reply alone, in the same way. Ranks are part of the join keys, so a very common reply is spread
over as many keys as it has occurrences, and the ranks themselves are counted in pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import normalize_text, render_turns, tidy
from parley.operators.context import is_supporter, transcripts
from parley.operators.positions import with_position

CORPUS_SOURCE = "corpus"
CONTEXT_SOURCE = "context"
SPLIT_ORDER = {"train": 0, "validation": 1, "test": 2}


def split_rank(name: str = "split"):
    ranks = F.create_map(*[F.lit(x) for pair in SPLIT_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.col(name)), F.lit(len(SPLIT_ORDER)))


def lookup_keys(turns: DataFrame, strategy: str = "strategy", response: str = "text") -> DataFrame:
    """The narrow side of the lookup: keys, place in the corpus and both occurrence ranks."""
    keys = turns.filter(is_supporter()).select(
        normalize_text(F.col(strategy)).alias("strategy_n"),
        normalize_text(F.col(response)).alias("response_n"),
        split_rank().alias("split_ord"),
        "conv_id",
        "turn_idx",
    )
    order = ["split_ord", "conv_id", "turn_idx"]
    return with_position(
        keys, ["response_n"], order, "response_rank", finer=(["strategy_n"], "pair_rank")
    )


def build_lookup(utterances: DataFrame, strategy: str = "strategy", response: str = "text") -> DataFrame:
    """Every supporter turn of the corpus with its transcript, situation and occurrence ranks."""
    said = transcripts(utterances).select(
        "conv_id", "turn_idx", "input_dialog", tidy(F.col("situation")).alias("situation")
    )
    return lookup_keys(utterances, strategy, response).join(said, ["conv_id", "turn_idx"])


def match_requests(
    requests: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    strategy: str = "strategy_true",
    response: str = "label_context",
    group: list[str] | None = None,
) -> DataFrame:
    """For every request the corpus turn it takes, NULL where there is none.

    ``keys`` name the columns that identify a request and give the order in which requests are
    served; ``group`` names columns (such as the generator) within which serving starts afresh.
    Requests without a reply match nothing. Returns ``group, keys, corpus_conv, corpus_turn`` and
    ``match_kind`` (pair, response or none).
    """
    group = group or []
    wanted = requests.select(
        *dict.fromkeys([*group, *keys]),
        normalize_text(F.col(strategy)).alias("strategy_n"),
        normalize_text(F.col(response)).alias("response_n"),
    )
    place = [F.col("conv_id").alias("corpus_conv"), F.col("turn_idx").alias("corpus_turn")]
    corpus = lookup.filter("response_n <> ''")
    by_pair = corpus.select("strategy_n", "response_n", "pair_rank", *place)
    by_response = corpus.select(
        "response_n", "response_rank", *[c.alias(f"other_{i}") for i, c in enumerate(place)]
    )
    ranked = with_position(wanted, [*group, "strategy_n", "response_n"], keys, "pair_rank")
    first = ranked.join(by_pair, ["strategy_n", "response_n", "pair_rank"], "left")
    missed = F.col("corpus_conv").isNull()
    queued = with_position(first, [*group, "response_n"], keys, "_queue", counted=missed)
    # rows that are served already ask for ranks that do not exist, each for another one
    rank = F.when(missed, F.col("_queue")).otherwise(-F.col("pair_rank"))
    served = queued.withColumn("response_rank", rank).join(
        by_response, ["response_n", "response_rank"], "left"
    )
    return served.select(
        *dict.fromkeys([*group, *keys]),
        F.coalesce("corpus_conv", "other_0").alias("corpus_conv"),
        F.coalesce("corpus_turn", "other_1").alias("corpus_turn"),
        F.when(~missed, "pair")
        .when(F.col("other_0").isNotNull(), "response")
        .otherwise("none")
        .alias("match_kind"),
    )


def attach_context(
    requests: DataFrame,
    matches: DataFrame,
    corpus: DataFrame,
    keys: list[str],
    context: str = "context",
    group: list[str] | None = None,
) -> DataFrame:
    """Add ``input_dialog, context_source, situation`` to the requests.

    ``corpus`` holds a transcript and a situation per (conv_id, turn_idx); a request without a
    match falls back to its own context. The dialogue is rendered one line per turn. ``keys`` name a
    request within its ``group``, the columns that the matching was grouped by.
    """
    keys = [*(group or []), *keys]
    said = corpus.select(
        F.col("conv_id").alias("_conv"),
        F.col("turn_idx").cast("long").alias("_turn"),
        F.col("input_dialog").alias("_dialog"),
        F.col("situation").alias("_situation"),
    )
    # requests without a match must not all meet under one NULL key
    nowhere = -1 - F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    found = matches.withColumn("_conv", F.coalesce("corpus_conv", F.lit(-1))).withColumn(
        "_turn", F.coalesce(F.col("corpus_turn").cast("long"), nowhere)
    )
    found = found.join(said, ["_conv", "_turn"], "left")
    hit = F.col("match_kind") != "none"
    own = requests.drop("situation", "input_dialog", "context_source")
    return own.join(found, keys, "left").select(
        *own.columns,
        render_turns(F.when(hit, F.col("_dialog")).otherwise(F.col(context))).alias("input_dialog"),
        F.when(hit, CORPUS_SOURCE).otherwise(CONTEXT_SOURCE).alias("context_source"),
        F.when(hit, tidy(F.col("_situation"))).otherwise("").alias("situation"),
        "match_kind",
    )
