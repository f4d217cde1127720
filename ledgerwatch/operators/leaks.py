"""Leak rules: forbidden fields and raw identifiers in values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.config import (
    LABEL_FIELDS,
    RAW_ID_FIELDS,
    RAW_ID_PATTERN,
    REPORT_FORBIDDEN_FIELDS,
    SALT_FIELDS,
    SALT_SOURCE_FIELD,
)


def holds_raw_id(value: Column) -> Column:
    return F.coalesce(value.rlike(RAW_ID_PATTERN), F.lit(False))


def forbidden_kind(
    name: str, forbid_labels: bool, forbid_salt: bool, forbid_report: bool
) -> str | None:
    if name in RAW_ID_FIELDS:
        return "RAW_IDENTIFIER_FIELD"
    if forbid_labels and name in LABEL_FIELDS:
        return "LABEL_FIELD"
    salted = name in SALT_FIELDS or (
        "salt" in name.lower() and name != SALT_SOURCE_FIELD
    )
    if forbid_salt and salted:
        return "SALT_FIELD"
    if forbid_report and name in REPORT_FORBIDDEN_FIELDS:
        return "REPORT_FIELD"
    return None


def key_checks(
    keys: Column,
    forbid_labels: bool,
    forbid_salt: bool,
    forbid_report: bool,
    name_salts: bool = True,
) -> list[tuple[Column, str]]:
    """(violated, code) for names that are only known from the data: the forbidden ones by
    name, any other that speaks of salt, and names that hold an identifier. Without
    ``name_salts`` the known salt fields have the common code too."""
    checks = [
        (F.coalesce(F.array_contains(keys, name), F.lit(False)), f"{kind}:{name}")
        for name in dict.fromkeys(_known_fields())
        if (kind := forbidden_kind(name, forbid_labels, forbid_salt and name_salts, forbid_report))
    ]
    if forbid_salt:
        known = [*(SALT_FIELDS if name_salts else ()), SALT_SOURCE_FIELD]
        other = F.exists(keys, lambda k: F.lower(k).contains("salt") & ~k.isin(*known))
        checks.append((F.coalesce(other, F.lit(False)), "SALT_FIELD"))
    named = F.coalesce(F.exists(keys, holds_raw_id), F.lit(False))
    return [*checks, (named, "RAW_IDENTIFIER_VALUE")]


def leaf_checks(
    schema: T.StructType,
    forbid_labels: bool = False,
    forbid_salt: bool = False,
    forbid_report: bool = False,
    skip: tuple[str, ...] = (),
) -> list[tuple[Column, str]]:
    """(violated, code) per field, in schema order, nested fields in place.

    Keys are decided once on the schema; a forbidden field counts where it is not NULL.
    Values are tested per string leaf, so nothing is serialized to JSON first.
    """

    def walk(value: Column, dtype: T.DataType, name: str) -> list[tuple[Column, str]]:
        kind = forbidden_kind(name, forbid_labels, forbid_salt, forbid_report)
        if kind:
            return [(value.isNotNull(), f"{kind}:{name}")]
        if isinstance(dtype, T.StringType):
            return [(holds_raw_id(value), "RAW_IDENTIFIER_VALUE")]
        if isinstance(dtype, T.StructType):
            return [c for f in dtype.fields for c in walk(value[f.name], f.dataType, f.name)]
        if isinstance(dtype, T.MapType):
            values = walk(F.map_values(value), T.ArrayType(dtype.valueType), "")
            if not isinstance(dtype.keyType, T.StringType):
                return values
            return key_checks(F.map_keys(value), forbid_labels, forbid_salt, forbid_report) + values
        if isinstance(dtype, T.ArrayType):
            inner = dtype.elementType
            codes = [code for _, code in walk(F.lit(None).cast(inner), inner, "")]

            def test(i: int):
                return lambda item: walk(item, inner, "")[i][0]

            # One test per rule of the element, so that each keeps its own code.
            found = [F.exists(value, test(i)) for i in range(len(codes))]
            return [(F.coalesce(t, F.lit(False)), c) for t, c in zip(found, codes, strict=True)]
        return []

    return [
        check
        for field in schema.fields
        if field.name not in skip and not field.name.startswith("__")
        for check in walk(F.col(f"`{field.name}`"), field.dataType, field.name)
    ]


def _known_fields() -> tuple[str, ...]:
    return RAW_ID_FIELDS + LABEL_FIELDS + SALT_FIELDS + REPORT_FORBIDDEN_FIELDS


def scan_leaks(
    df: DataFrame,
    forbid_labels: bool = False,
    forbid_salt: bool = False,
    forbid_report: bool = False,
    skip: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``leaks``: the distinct codes of every violated leak rule, as an array."""
    checks = leaf_checks(df.schema, forbid_labels, forbid_salt, forbid_report, skip)
    if not checks:
        return df.withColumn("leaks", F.array().cast("array<string>"))
    codes = F.array(*[F.when(test, F.lit(code)) for test, code in checks])
    return df.withColumn("leaks", F.array_distinct(F.array_compact(codes)))


# A string of a JSON text, with the colon that follows if it is a key. Written with possessive
# repetition, so that long strings take no stack.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'


def _strings(payload: Column) -> Column:
    """The strings of a JSON text as they are written, in quotes, keys with their colon."""
    return F.regexp_extract_all(payload, F.lit(_JSON_STRING), 0)


def _decoded(strings: Column, keys: bool) -> Column:
    def decoded(item: Column) -> Column:
        rest = F.length(F.substring_index(item, '"', -1)) if keys else F.lit(0)
        text = item.substr(F.lit(2), F.length(item) - rest - 2)
        quoted = F.concat(F.lit("["), item.substr(F.lit(1), F.length(item) - rest), F.lit("]"))
        plain = F.get(F.from_json(quoted, "array<string>"), 0)
        return F.when(item.contains("\\"), F.coalesce(plain, text)).otherwise(text)

    wanted = F.filter(strings, lambda s: s.endswith(":") if keys else s.endswith('"'))
    return F.transform(wanted, decoded)


def json_strings(payload: Column, keys: bool) -> Column:
    """The decoded keys, or the decoded string values, of a JSON text at any depth."""
    return _decoded(_strings(payload), keys)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: as the only
    element of an array, it is bound to the parameter of a transform."""
    return F.get(F.transform(F.array(value), use), 0)


def scan_json_leaks(
    payload: Column,
    forbid_labels: bool = False,
    forbid_salt: bool = False,
    forbid_report: bool = False,
) -> Column:
    """Leak codes of a JSON text of unknown depth, from its decoded keys and string values:
    what is written with escapes counts as what it stands for."""

    def codes(strings: Column) -> Column:
        values = F.exists(_decoded(strings, keys=False), holds_raw_id)

        def found(keys: Column) -> Column:
            checks = key_checks(keys, forbid_labels, forbid_salt, forbid_report, name_salts=False)
            checks.append((F.coalesce(values, F.lit(False)), "RAW_IDENTIFIER_VALUE"))
            return F.array(*[F.when(test, F.lit(code)) for test, code in checks])

        return _once(_decoded(strings, keys=True), found)

    return F.array_distinct(F.array_compact(_once(payload, lambda text: _once(_strings(text), codes))))
