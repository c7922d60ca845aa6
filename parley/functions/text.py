"""Text column functions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schema import NO_SITUATION, STAGE_ALIASES, lookup

# --- fixed values -----------------------------------------------------------------------------
# white space as Unicode text processing defines it (Java's own \s is ASCII only)
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# white space that is not already one single blank
# the same characters as a list
BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
UNEVEN_SPACE = rf"[\t-\r\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]{SPACE}*| {SPACE}+"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# speaker marks in tagged text and at line starts
TAG = r"\[(supporter|seeker)\]"
TAGGED_SEGMENT = r"(?is)\[(supporter|seeker)\](.*?)(?=\[(?:supporter|seeker)\]|\z)"
LABELLED_LINE = r"(?i)(?:\A|\n)(?:supporter|seeker)\s*:"
# fields of a generated answer
FULL_ANSWER = r"(?is)Strategy\s*:\s*(.*?)\s*Response\s*:\s*(.*)"
STRATEGY_FIELD = r"(?is)Strategy\s*:\s*(.*?)(?:Response|\z)"
RESPONSE_FIELD = r"(?is)Response\s*:\s*(.*)"
# character entities undone by clean_text; the ampersand comes last
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f]"
# ----------------------------------------------------------------------------------------------


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(value, F.lit(BLANK))


def present(value: Column) -> Column:
    """NULL reads as the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def tidy(value: Column) -> Column:
    """NULL to empty, then stripped: the hygiene every record field gets."""
    return strip(present(value))


def normalize_text(value: Column) -> Column:
    """Lower case with single spaces; the form in which texts are compared."""
    return F.trim(F.regexp_replace(F.lower(present(value)), UNEVEN_SPACE, " "))


def valid_text(value: Column) -> Column:
    """Replace what is not valid UTF-8; NULL reads as empty."""
    return F.make_valid_utf8(present(value))


def clean_text(value: Column) -> Column:
    """Undo the common character entities and drop control characters."""
    text = valid_text(value)
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, CONTROL, "")


def parse_int(value: Column) -> Column:
    """Whole numbers only; everything else is NULL."""
    return value.cast("string").try_cast("bigint")


def short_name(full: Column, names: dict[str, str]) -> Column:
    """The alias of a full name; unknown names keep themselves with path separators replaced."""
    aliases = {**{name: alias for alias, name in names.items()}, **{alias: alias for alias in names}}
    return F.coalesce(F.try_element_at(lookup(aliases), full), F.replace(strip(full), F.lit("/"), F.lit("_")))


def full_name(alias: Column, names: dict[str, str]) -> Column:
    """The full name behind an alias; unknown aliases are taken as full names."""
    return F.coalesce(F.try_element_at(lookup(names), alias), alias)


def situation_or_default(value: Column) -> Column:
    return F.coalesce(F.nullif(tidy(value), F.lit("")), F.lit(NO_SITUATION))


def stage_name(value: Column) -> Column:
    """The stage meant by a spelling, NULL when there is none."""
    return F.try_element_at(lookup(STAGE_ALIASES), normalize_text(value))


def render_turns(value: Column) -> Column:
    """Tagged text as one labelled line per turn.

    Bracket groups at the head of a turn (its strategy mark) are dropped, and turns left without
    text vanish. Text that is labelled by lines already only loses blank lines and outer space.
    """
    text = tidy(value)
    names = F.regexp_extract_all(text, F.lit(TAGGED_SEGMENT), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(TAGGED_SEGMENT), F.lit(2))
    last = F.size(bodies) - 1

    def turn(name: Column, body: Column) -> Column:
        label = F.when(F.lower(name) == "supporter", "Supporter : ").otherwise("Seeker : ")
        return F.when(body != "", F.concat(label, body))

    def bare(body: Column, place: Column) -> Column:
        head = rf"(?i)\A{SPACE}*(?:\[(?!{SPACE}*(?:supporter|seeker){SPACE}*\])[^\]]*\]{SPACE}*)*+"
        rest = strip(F.regexp_replace(body, head, ""))
        # a bracket left open here is closed by the next tag, and swallows the rest of this turn
        return F.when((place < last) & rest.rlike(r"\A\[[^\]]*\z"), "").otherwise(rest)

    turns = F.zip_with(names, F.transform(bodies, bare), turn)
    lines = F.transform(F.split(text, LINE_END), strip)
    return (
        F.when(text.rlike(rf"(?i){TAG}"), F.array_join(turns, "\n"))
        .when(text.rlike(LABELLED_LINE), F.array_join(F.filter(lines, lambda line: line != ""), "\n"))
        .otherwise(text)
    )


def parse_generated(value: Column) -> Column:
    """A generated answer as ``struct(strategy, response)``."""
    text = tidy(value)
    full = text.rlike(FULL_ANSWER)
    strategy = (
        F.when(full, strip(F.regexp_extract(text, FULL_ANSWER, 1)))
        .when(text.rlike(STRATEGY_FIELD), strip(F.regexp_extract(text, STRATEGY_FIELD, 1)))
        .otherwise("N/A")
    )
    response = (
        F.when(full, strip(F.regexp_extract(text, FULL_ANSWER, 2)))
        .when(text.rlike(RESPONSE_FIELD), strip(F.regexp_extract(text, RESPONSE_FIELD, 1)))
        .otherwise(text)
    )
    return F.struct(strategy.alias("strategy"), response.alias("response"))
