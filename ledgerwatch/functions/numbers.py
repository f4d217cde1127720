"""Strict parsing of numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwatch.functions.text import strip

# A number with at least one digit, with or without exponent; NaN, Infinity and hex do not
# match. Exponents of more than four digits are refused: printed plainly, such a number would
# have more places than any text can be meant to hold.
_PLAIN = r"^[+-]?(?=\d|\.\d)\d*\.?\d*$"
_NUMBER = r"^[+-]?(?=\d|\.\d)\d*\.?\d*(?:[eE][+-]?0*\d{1,4})?$"
_EXPONENT = r"[eE](.+)$"


def _cleaned(value: Column) -> Column:
    return F.replace(strip(value), F.lit("_"), F.lit(""))


def is_decimal_text(value: Column) -> Column:
    """A finite decimal number of any length, told from its text."""
    return F.coalesce(_cleaned(value).rlike(_NUMBER), F.lit(False))


def is_negative_text(value: Column) -> Column:
    """Below zero, judged on the digits so that no precision is lost. ``-0.00`` is not."""
    return F.coalesce(_cleaned(value).rlike(r"^-[0.]*[1-9]"), F.lit(False))


def is_zero_text(value: Column) -> Column:
    return F.coalesce(_cleaned(value).rlike(r"^[+-]?[0.]+(?:[eE].*)?$"), F.lit(False))


def plain_decimal(value: Column) -> Column:
    """Plain notation with the scale of the input kept: ``170136.00`` stays ``170136.00``,
    ``+.5`` becomes ``0.5``, ``1.50e1`` becomes ``15.0``. Only meaningful where
    ``is_decimal_text`` holds."""
    text = _cleaned(value)
    # Leading plus and zeros go, a bare point gets its zero, a trailing point goes.
    simple = F.regexp_replace(text, r"^\+?(-?)0*(?=\d)|\.$|^\+(?=\.)", "$1")
    simple = F.regexp_replace(simple, r"^(?<sign>-?)(?=\.)", "${sign}0")
    moved = _point_moved(text)
    return F.when(~text.rlike(_EXPONENT), simple).otherwise(moved)


def _point_moved(text: Column) -> Column:
    """A number in exponent form in plain notation: its digits with the point moved."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_extract(text, r"^[+-]?(\d*)", 1)
    rest = F.regexp_extract(text, r"\.(\d*)", 1)
    digits = F.concat(whole, rest)
    exponent = F.coalesce(F.regexp_extract(text, _EXPONENT, 1).try_cast("int"), F.lit(0))
    # Digits before the point, with zeros on either side so that the point is among them.
    place = F.length(whole) + exponent
    before = F.repeat(F.lit("0"), F.greatest(-place, F.lit(0)) + 1)
    after = F.repeat(F.lit("0"), F.greatest(place - F.length(digits), F.lit(0)))
    padded = F.concat(before, digits, after)
    cut = F.length(before) + place
    left = F.substr(padded, F.lit(1), cut)
    right = F.substr(padded, cut + 1, F.length(padded))
    left = F.regexp_replace(left, r"^0+(?=\d)", "")
    return F.concat(sign, left, F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))


def strict_int(value: Column) -> Column:
    """Whole number or NULL; ``5.0``, ``0x1`` and text are NULL."""
    text = strip(value)
    return F.when(
        text.rlike(r"^[+-]?\d+(?:_\d+)*$"),
        F.replace(text, F.lit("_"), F.lit("")).try_cast("int"),
    )


def strict_flag(value: Column) -> Column:
    """Exactly ``"0"`` or ``"1"``; anything else is NULL."""
    return F.when(value == "0", F.lit(False)).when(value == "1", F.lit(True))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
