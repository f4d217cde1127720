"""String helpers as Column expressions (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for NULL, empty and whitespace-only text; never NULL itself."""
    return F.coalesce(strip(value) == "", F.lit(True))


def blank_to(value: Column, default: Column | str) -> Column:
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(is_blank(value), default).otherwise(value)


def first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """First failing check wins; NULL when every check passes."""
    chain = None
    for failed, reason in checks:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        chain = F.when(failed, reason) if chain is None else chain.when(failed, reason)
    return chain


def joined(separator: str, pairs: list[tuple[Column, str]]) -> Column:
    """Texts of the true conditions, in order, joined; empty text when none is true."""
    return F.concat_ws(separator, *[F.when(c, F.lit(t)) for c, t in pairs])


def csv_to_array(value: Column) -> Column:
    """``"A, B,,C"`` -> ``["A","B","C"]``; NULL or blank gives an empty array."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip)
    return F.filter(parts, lambda item: item != "")


def list_text(value: Column) -> Column:
    """Array built from an already joined text without empty items."""
    return F.when(value == "", F.array().cast("array<string>")).otherwise(
        F.split(value, ",")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    """One anchored alternation instead of a chain of prefix tests."""
    return F.coalesce(value.rlike("^(?:" + "|".join(prefixes) + ")"), F.lit(False))
