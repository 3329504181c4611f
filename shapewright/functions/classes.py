"""Coarse type classes: names that mean them, what widens to what, and the class of a text value."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names by class.
NAMES = {
    "int": ("int", "integer", "int8", "int16", "int32", "int64", "bigint", "smallint", "tinyint", "long", "hugeint", "ubigint", "uinteger", "usmallint", "utinyint"),
    "decimal": ("decimal", "float", "float4", "float8", "double", "numeric", "number", "real", "money"),
    "bool": ("bool", "boolean", "bit"),
    "date": ("date",),
    "timestamp": ("timestamp", "datetime", "timestamp with time zone", "timestamptz", "timestamp_s", "timestamp_ms", "timestamp_us", "timestamp_ns"),
    "text": ("text", "string", "varchar", "char", "nvarchar", "nchar", "str", "utf8", "enum"),
    "blob": ("blob", "binary", "varbinary", "bytea"),
    "any": ("any", "*", "unknown", "interval", "json", "map", "list", "struct", "union"),
}
ALIASES = {name: cls for cls, names in NAMES.items() for name in names}
CLASSES = tuple(NAMES)

# Fixed values: (declared, observed) pairs that load, but are worth a warning.
WIDENINGS = frozenset({("decimal", "int"), ("int", "bool"), ("timestamp", "date")} | {("text", c) for c in ("int", "decimal", "bool", "date", "timestamp", "blob")})


def normalize(name: str) -> str:
    return ALIASES.get(name.strip().lower().split("(", 1)[0].strip(), "any")


def compatibility(declared: str, observed: str) -> str:
    if "any" in (declared, observed) or declared == observed:
        return "identical"
    return "widening" if (declared, observed) in WIDENINGS else "breaking"


def compatibility_column(declared: Column, observed: Column) -> Column:
    widens = F.concat_ws(">", declared, observed).isin(*sorted(f"{a}>{b}" for a, b in WIDENINGS))
    same = (declared == "any") | (observed == "any") | (declared == observed)
    return F.when(same, "identical").when(widens, "widening").otherwise("breaking")


# Patterns that mean the same to Java, RE2 and Python.
INT = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"
BOOL = r"^(true|false|TRUE|FALSE|True|False)$"
DATE = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
TIMESTAMP = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
LADDER = (("int", INT), ("decimal", DECIMAL), ("bool", BOOL), ("date", DATE), ("timestamp", TIMESTAMP))
_LADDER = tuple((cls, re.compile(p)) for cls, p in LADDER)
_LONG = 1 << 63


def of_value(value: str, leading_zeros_as_text: bool = False) -> str:
    """The class of one text value that isn't empty."""
    for cls, pattern in _LADDER:
        if pattern.match(value):
            if cls == "int":
                digits = value.lstrip("+-")
                if leading_zeros_as_text and len(digits) > 1 and digits[0] == "0":
                    return "text"
                # digits beyond those of 64 bits are told by their number, as there may be any number of them
                return "int" if len(digits.lstrip("0")) <= 19 and -_LONG <= int(value) < _LONG else "decimal"
            return cls
    return "text"


def joined(classes: Iterable[str]) -> str:
    """The class of a column whose values have these; "any" for none."""
    seen = set(classes)
    if len(seen) <= 1:
        return next(iter(seen), "any")
    if seen == {"int", "decimal"}:
        return "decimal"
    return "timestamp" if seen == {"date", "timestamp"} else "text"
