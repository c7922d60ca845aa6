"""Quality rules as a ledger of bits: every rule is judged once, policies only combine the bits.

``ledger`` measures each text and stores one bit per failed rule. A policy is a version with the set
of rules that it enforces; applying one is a bitwise AND on the stored long, so a new version, or
its cost, needs no second look at the texts. ``ablation`` says what every rule of a policy does.

Built of column functions only. Measuring happens within the row: a window of eight words is
compared by a hash of its words first, and texts where hashes repeat are compared word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import BLANKS, let

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutter")


@dataclass(frozen=True)
class Rule:
    """A named condition for failure, as SQL over the measurements."""

    name: str
    fails: str


#: A rule's place gives its bit; append only, so that stored ledgers keep their meaning.
RULES = (
    Rule("too_short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("shouting", "n_words >= 20 and 10 * n_upper > 6 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    Rule("stutter", "n_words >= 20 and 10 * n_stutter > 3 * n_words"),
)

#: Versioned policies: which rules a version enforces.
POLICIES = {
    "v1": ("too_short", "repeated_windows"),
    "v2": ("too_short", "repeated_windows", "symbols", "repeated_lines"),
    "v3": tuple(rule.name for rule in RULES),
}
CURRENT = "v3"


def mask(policy: str, policies: dict[str, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that a policy looks at."""
    places = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << places[name] for name in policies[policy])


def _even(text: Column) -> Column:
    """The text with every blank character made a plain blank."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Runs of anything but blanks; an empty array where there is none."""
    return F.array_remove(F.split(_even(text), " "), "")


def _next_to_equal(rows: Column, field: str) -> Column:
    """Of sorted rows, those that share ``field`` with a neighbour."""
    return let(
        rows,
        lambda m: F.filter(
            m,
            lambda x, i: ((i > 0) & (F.get(m, i - 1)[field] == x[field])) | (F.get(m, i + 1)[field] == x[field]),
        ),
    )


def _window_hashes(hashes: Column) -> Column:
    """A hash for every window of eight, by doubling: pairs, fours, eights."""

    def joined(own: Column, step: int) -> Column:
        return F.transform(own, lambda x, i: F.xxhash64(x, F.get(own, i + step)))

    eights = let(joined(hashes, 1), lambda twos: let(joined(twos, 2), lambda fours: joined(fours, 4)))
    return F.slice(eights, 1, F.size(hashes) - (WINDOW - 1))


def _repeated(tokens: Column, hashes: Column) -> Column:
    """How many words lie in windows of eight that are found twice or more.

    Only windows whose hash repeats are compared word by word, so equal hashes decide nothing.
    """
    zero = F.lit(0).cast("long")

    def exact(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        spelled = F.sort_array(
            F.transform(
                _next_to_equal(marked, "h"),
                lambda x: F.struct(F.slice(tokens, x["i"] + 1, WINDOW).alias("w"), x["i"].alias("i")),
            )
        )
        starts = F.sort_array(F.transform(_next_to_equal(spelled, "w"), lambda x: x["i"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(
                    s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")
                ),
                zero,
                lambda total, n: total + n,
            ),
        )

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), exact(windows)).otherwise(zero)

    return F.when(F.size(tokens) > WINDOW, let(_window_hashes(hashes), counted)).otherwise(zero)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements (long) of whole texts; a NULL text counts as empty.

    ``n_lines`` are the lines with a word, ``n_upper`` the characters A-Z, ``n_stutter`` the words
    whose next word is the same. Existing columns with the names of measurements are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def in_words(tokens: Column) -> Column:
        return let(
            F.transform(tokens, lambda w: F.xxhash64(w)),
            lambda hashes: F.struct(
                F.size(tokens).cast("long").alias("n_words"),
                _repeated(tokens, hashes).alias("n_repeat_words"),
                F.size(F.filter(hashes, lambda x, i: F.get(hashes, i + 1) == x)).cast("long").alias("n_stutter"),
            ),
        )

    def in_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    found = F.struct(
        let(words(whole), in_words).alias("w"),
        let(lines, in_lines).alias("l"),
        F.length(F.replace(_even(whole), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(whole, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    kept = [c for c in docs.columns if c.lower() not in MEASURES and c != "_found"]
    return docs.withColumn("_found", found).select(
        *[F.col(f"`{c}`") for c in kept],
        "_found.w.n_words",
        "_found.word_chars",
        "_found.n_symbols",
        "_found.l.n_dup_lines",
        "_found.w.n_repeat_words",
        "_found.l.n_lines",
        "_found.n_upper",
        "_found.w.n_stutter",
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measurements and ``failed_bits``: bit i is set if ``rules[i]`` fails.

    One output row for each input row, repeated rows included; empty and NULL texts have no words.
    """
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("failed_bits", bits)


def passes(policy: str = CURRENT, policies: dict[str, tuple[str, ...]] = POLICIES) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, policies)).cast("long")) == 0


def ablation(
    rows: DataFrame,
    by: list[str] | None = None,
    policies: dict[str, tuple[str, ...]] = POLICIES,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """What each rule of each policy does, from the bits alone.

    Rows are counted by bit pattern first, which is all that is shuffled. Result, per group of
    ``by``, policy and rule: ``rejected`` by the policy, ``failed`` this rule, ``only_this`` (kept
    if the rule were dropped), ``others_seen`` (OR of the other bits of its failures). An empty
    ledger has no groups with ``by`` and no rows without it.
    """
    by = by or []
    patterns = rows.groupBy(*by, "failed_bits").agg(F.count("*").alias("n"))
    cases = F.array(
        *[
            F.struct(
                F.lit(version).alias("policy"),
                F.lit(rules[place].name).alias("rule"),
                F.lit(1 << place).cast("long").alias("bit"),
                F.lit(mask(version, policies, rules)).cast("long").alias("enforced"),
            )
            for version in policies
            for place in range(len(rules))
            if rules[place].name in policies[version]
        ]
    )
    seen = F.col("failed_bits").bitwiseAND(F.col("c.enforced"))
    own = seen.bitwiseAND(F.col("c.bit")) != 0
    return (
        patterns.select("*", F.explode(cases).alias("c"))
        .groupBy(*by, F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(seen != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(own, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(seen == F.col("c.bit"), F.col("n")).otherwise(0)).alias("only_this"),
            F.coalesce(
                F.bit_or(F.when(own, seen.bitwiseAND(F.bitwise_not(F.col("c.bit"))))), F.lit(0).cast("long")
            ).alias("others_seen"),
        )
    )


def accepted(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """``docs`` without the rows that a policy rejects; columns stay as they are."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("_row"), F.col(text).alias("_text"))
    return ledger(whole, "_text").filter(passes(policy)).select("_row.*")
