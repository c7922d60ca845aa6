"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Callable

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schema import NO_PROBABILITY

_SPLITTER = float(2**27 + 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rounded_units(magnitude: Column, scale: float) -> Column:
    """``magnitude * scale`` to the nearest integer, judged on the exact binary value.

    Spark rounds the shortest decimal spelling of a double (0.1235 -> 0.124); the double itself
    lies below the tie. The product is taken in two exact halves (Dekker splitting), so the sign of
    the distance to the tie is right as well; true ties go to the even neighbour.
    """

    def halves(m: Column) -> Column:
        high = m * _SPLITTER - (m * _SPLITTER - m)
        return F.struct(
            high.alias("high"), (m - high).alias("low"), F.floor(m * scale).cast("double").alias("units")
        )

    def nearest(units: Column, rest: Column) -> Column:
        up = (rest > 0) | ((rest == 0) & (units % 2 == 1))
        return units + F.when(up, 1.0).otherwise(0.0)

    def remainder(p: Column) -> Column:
        rest = (p["high"] * scale - p["units"] - 0.5) + p["low"] * scale
        return _once(rest, lambda r: nearest(p["units"], r))

    return _once(_once(magnitude, halves), remainder)


def round_exact(value: Column, digits: int) -> Column:
    """Round the binary value of a double to ``digits`` decimals, ties to even.

    From 2**53 units on, neighbouring doubles are farther apart than a unit, so a value is itself
    the double next to its rounded decimal.
    """
    scale = float(10**digits)
    magnitude = F.abs(value)
    near = F.signum(value) * _rounded_units(magnitude, scale) / scale
    return F.when(magnitude < float(2**53) / scale, near).otherwise(value)


# fixed value: how a number may be written (a cast alone would also take Java's "1.0d")
NUMBER = r"(?i)\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)\s*\z"


def parse_float(value: Column) -> Column:
    """A number from text, NULL when it is not one."""
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def format_probability(value: Column) -> Column:
    """Three decimals; anything that is not a finite number reads as not evaluated.

    Whole part and fraction of a double are exact, and only the fraction is rounded. From 2**63 on doubles
    are whole numbers that no long holds; up to 2**126 they are written out by decimals, beyond that the
    digits are those of the shortest spelling.
    """

    def large(magnitude: Column) -> Column:
        """A long times a power of two: both are exact as decimals, and so is their product."""
        shift = F.floor(F.log2(magnitude)).cast("int") - 54
        powers = F.array(*[F.lit(Decimal(1 << s)).cast("decimal(22,0)") for s in range(8, 73)])
        units = (magnitude / F.pow(F.lit(2.0), shift)).cast("long").cast("decimal(17,0)")
        whole = (units * F.try_element_at(powers, shift - 7)).cast("decimal(38,0)")
        return F.concat(whole.cast("string"), F.lit(".000"))

    def fraction(magnitude: Column) -> Column:
        rest = magnitude - F.floor(magnitude).cast("double")
        return _rounded_units(rest, 1000.0).cast("long")

    def joined(magnitude: Column) -> Column:
        def text(units: Column) -> Column:
            whole = F.floor(magnitude).cast("long") + F.when(units == 1000, 1).otherwise(0)
            return F.concat(whole.cast("string"), F.lit("."), F.lpad((units % 1000).cast("string"), 3, "0"))

        return _once(fraction(magnitude), text)

    def shown(number: Column) -> Column:
        return (
            F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), NO_PROBABILITY)
            .when(F.abs(number) < float(2**63), _once(F.abs(number), joined))
            .when(F.abs(number) < float(2**126), _once(F.abs(number), large))
            .otherwise(F.format_string("%.3f", F.abs(number)))
        )

    minus = F.ltrim(value.cast("string")).startswith("-")
    text = _once(parse_float(value), shown)
    return F.when(minus & ~text.startswith("-"), F.concat(F.lit("-"), text)).otherwise(text)


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Zero-based place of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
