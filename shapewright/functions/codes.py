"""Reason codes, severities and the other closed sets of values."""

from __future__ import annotations

from collections.abc import Callable
from enum import StrEnum
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


class Severity(StrEnum):
    ERROR = "ERROR"
    WARN = "WARN"
    INFO = "INFO"


class Mode(StrEnum):
    NAME = "name"
    POSITION = "position"


class Extra(StrEnum):
    STRICT = "strict"
    OPEN = "open"


class Bucket(StrEnum):
    PROFILED = "profiled"
    DEGRADED = "degraded"
    CATALOGUED = "catalogued"
    REFUSED = "refused"


class Verdict(StrEnum):
    CONFORMS = "conforms"
    BROKEN = "broken"


# The severity of each code, by alignment mode where it matters.
SEVERITIES: dict[str, dict[str, str]] = {
    "MISSING_COLUMN": {"name": "ERROR", "position": "ERROR"},
    "EXTRA_COLUMN": {"name": "ERROR", "position": "ERROR"},
    "TYPE_MISMATCH": {"name": "ERROR", "position": "ERROR"},
    "COLUMN_NAME_MISMATCH": {"name": "ERROR", "position": "WARN"},
    "COUNT_CHANGED": {"name": "INFO", "position": "ERROR"},
    "RAGGED_ROWS": {"": "ERROR"},
    "MULTI_RECORD": {"": "WARN"},
    "TRUNCATED": {"": "ERROR"},
    "TRAILING_SUMMARY": {"": "WARN"},
    "ENCODING_FALLBACK": {"": "WARN"},
    "FORMAT_UNRECOGNIZED": {"": "INFO"},
    "NESTED_ARCHIVE": {"": "WARN"},
    "ENCRYPTED_ARCHIVE": {"": "WARN"},
    "PERMISSION_DENIED": {"": "ERROR"},
    "DECODE_ERROR": {"": "ERROR"},
    "CORRUPT_ARCHIVE": {"": "ERROR"},
    "HEADERLESS_NAME_MODE": {"": "ERROR"},
    "FILE_COUNT_CEILING": {"": "WARN"},
    "BYTE_CEILING": {"": "WARN"},
    "RECURSION_DEPTH_CEILING": {"": "WARN"},
}


def severity(code: str, mode: str | None = None) -> str:
    """The severity of a code under a mode; a code that no mode changes has one for all."""
    by_mode = SEVERITIES[code]
    found = by_mode.get(mode or "", by_mode.get(""))
    if found is None:
        raise KeyError(f"{code} has no severity without a mode")
    return found


#: A finding as a struct.
FINDING = "struct<reason_code:string,severity:string,locus:string,expected:string,found:string,explanation:string,confidence:int>"
FINDINGS = FINDING[7:-1].replace(":", " ").replace(",", ", ")


def finding(code: str, level: str | Column, locus: str | Column, expected: str | Column | None, found: str | Column | None, explanation: str | Column, confidence: Column | int = 1) -> Column:
    """One finding; strings are values, not names of columns."""
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct(
        F.lit(code).alias("reason_code"),
        text(level).alias("severity"),
        text(locus).alias("locus"),
        text(expected).alias("expected"),
        text(found).alias("found"),
        text(explanation).alias("explanation"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("int").alias("confidence"),
    )


def findings(*some: Column) -> Column:
    """Arrays of findings as one."""
    return F.concat(*[F.coalesce(x, F.array().cast(f"array<{FINDING}>")) for x in some])


def where(condition: Column, one: Column) -> Column:
    """An array of one finding, or of none."""
    return F.when(condition, F.array(one))


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """make, whose columns are kept by its arguments: long expressions take a second to build, call by call to the JVM that holds them."""
    kept = lru_cache(maxsize=64)(lambda jvm, *args: make(*args))

    @wraps(make)
    def run(*args) -> Column:
        return kept(id(SparkContext._gateway), *args)

    return run


def let(value: Column, body) -> Column:
    """body(value), in which value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
