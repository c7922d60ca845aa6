"""Tokenizers and n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import SPACE, present

# --- fixed values -----------------------------------------------------------------------------
WORD_OR_MARK = r"[\p{L}\p{N}_']+|[.,!?;]"
# contractions cut in two, on words set between blanks
CONTRACTIONS = [
    r"([^' ])('s|'m|'d|'ll|'re|'ve|n't|') ",
    r" (can)(not) ",
    r" (d)('ye) ",
    r" (gim|lem)(me) ",
    r" (gon|wan)(na) ",
    r" (got)(ta) ",
    r" (more)('n) ",
    r" ('t)(is|was) ",
]
# what a text must hold for any of them to apply
CONTRACTED = r"(?i)'|cannot|gimme|lemme|gonna|wanna|gotta"
# ----------------------------------------------------------------------------------------------
GRAM_SEPARATOR = "\u0001"


def punctuation_tokens(value: Column) -> Column:
    """Lower-case runs of letters, digits, ``_`` and ``'``, and single ``. , ! ? ;``."""
    return F.regexp_extract_all(F.lower(present(value)), F.lit(WORD_OR_MARK), F.lit(0))


def word_tokens(value: Column) -> Column:
    """Punctuation tokens with English contractions cut as the Penn Treebank does."""
    plain = punctuation_tokens(value)
    # every word gets a blank of its own on both sides, so neighbouring matches do not overlap
    text = F.concat(F.lit(" "), F.array_join(plain, "  "), F.lit(" "))
    for pattern in CONTRACTIONS:
        around = " " if pattern.startswith(" ") else ""
        text = F.regexp_replace(text, pattern, rf"{around}$1 $2 ")
    # most texts have no contraction and skip the replacements
    return F.when(present(value).rlike(CONTRACTED), F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))).otherwise(plain)


def blank_tokens(value: Column) -> Column:
    """Tokens between white space, as they are."""
    return F.regexp_extract_all(present(value), F.lit(f"[^{SPACE[1:]}+"), F.lit(0))


def grams(tokens: Column, k: int) -> Column:
    """All runs of ``k`` tokens, each joined to one string; none when there are fewer than ``k``."""
    if k == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - (k - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, k), GRAM_SEPARATOR))
    return F.when(F.size(tokens) >= k, runs).otherwise(F.array().cast("array<string>"))


def labelled_grams(tokens: Column, k: int, **constants: int) -> Column:
    """The ``k``-grams as ``struct(n, gram, ...constants)``."""
    extra = [F.lit(value).alias(name) for name, value in constants.items()]
    return F.transform(grams(tokens, k), lambda g: F.struct(F.lit(k).alias("n"), g.alias("gram"), *extra))
