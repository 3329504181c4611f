"""Column names made comparable."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip and \s know.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = re.compile(r"\s+")


def canonical(name: str, strip: bool = True, lower: bool = True, collapse: bool = True) -> str:
    name = name.strip() if strip else name
    name = name.lower() if lower else name
    return _SPACES.sub(" ", name) if collapse else name


def canonical_column(name: Column, strip: bool = True, lower: bool = True, collapse: bool = True) -> Column:
    if strip:
        name = F.regexp_replace(name, f"^{SPACE}+|{SPACE}+$", "")
    if lower:
        name = F.lower(name)
    return F.regexp_replace(name, f"{SPACE}+", " ") if collapse else name


def trace(name: Column) -> Column:
    """A struct of each step's value, whether anything changed, and what did."""
    stripped = canonical_column(name, lower=False, collapse=False)
    lowered = canonical_column(name, collapse=False)
    collapsed = canonical_column(name)
    said = F.concat_ws("; ", F.when(stripped != name, F.lit("stripped")), F.when(lowered != stripped, F.lit("lower-cased")), F.when(collapsed != lowered, F.lit("white space collapsed")))
    return F.struct(name.alias("raw"), stripped.alias("stripped"), lowered.alias("lowered"), collapsed.alias("canonical"), (collapsed != name).alias("was_transformed"), said.alias("changes"))


