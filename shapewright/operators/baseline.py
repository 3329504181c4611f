"""Ways to say what files should look like: a flat schema, a result of an earlier scan, a golden file, a CREATE TABLE.

Baselines are as long as a table has columns, so they are parsed on the driver and used as literals and broadcasts."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shapewright.functions.classes import normalize
from shapewright.functions.names import canonical

#: Columns of a baseline at most.
MOST = 100_000


@dataclass(frozen=True)
class Baseline:
    """columns: (raw name, class) in order; source: a description, and the path if there is one."""

    columns: tuple[tuple[str, str], ...]
    source_description: str
    source_path: str | None = None

    def __post_init__(self):
        if not 0 < len(self.columns) <= MOST:
            raise ValueError(f"{self.source_description}: 1 to {MOST} columns are needed, not {len(self.columns)}")

    @property
    def ordered_names(self) -> list[str]:
        return [canonical(n) for n, _ in self.columns]

    @property
    def ordered_types(self) -> list[str]:
        return [c for _, c in self.columns]

    @property
    def name_set(self) -> frozenset[str]:
        return frozenset(self.ordered_names)

    @property
    def name_to_type(self) -> dict[str, str]:
        return dict(zip(self.ordered_names, self.ordered_types))

    @property
    def column_count(self) -> int:
        return len(self.columns)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, canonical(n), n, c) for i, (n, c) in enumerate(self.columns)]
        return spark.createDataFrame(rows, "position int, name string, raw_name string, type_class string")


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8-sig") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise ValueError(f"Cannot read {path}: {e}") from e


def from_flat(path: str, type_only: bool = False) -> Baseline:
    """A line for each column: a name, and after the first of comma, tab, colon or space its type. # starts a comment line."""
    lines = [x.strip() for x in _read(path).splitlines() if x.strip() and not x.strip().startswith("#")]
    if not lines:
        raise ValueError(f"{path} contains no data lines")
    if type_only:
        return Baseline(tuple((f"column{i}", normalize(x)) for i, x in enumerate(lines)), f"flat schema {path} (types)", path)
    separator = next((s for s in (",", "\t", ":", " ") if s in lines[0]), None)
    parts = [[p.strip() for p in x.split(separator, 1)] if separator else [x] for x in lines]
    return Baseline(tuple((p[0], normalize(p[1]) if len(p) > 1 and p[1] else "any") for p in parts), f"flat schema {path}", path)


def from_result(path: str) -> Baseline:
    """The layout that most files of an earlier scan or check have; the first seen of two as common."""
    text = _read(path)
    try:
        result = json.loads(text)
    except ValueError as e:
        raise ValueError(f"Invalid JSON in {path}: {e}") from e
    verdicts = (result.get("file_verdicts") or result.get("golden")) if isinstance(result, dict) else None
    layouts = [v for v in verdicts or () if v.get("normalized_column_names")]
    if not layouts:
        raise ValueError(f"{path} does not look like a result of a scan or check with columns")
    most = Counter(tuple(v["normalized_column_names"]) for v in layouts).most_common(1)[0][0]
    one = next(v for v in layouts if tuple(v["normalized_column_names"]) == most)
    types = one.get("column_types") or {}
    return Baseline(tuple((n, normalize(types.get(n) or "any")) for n in most), f"earlier result {path}", path)


def from_golden(spark: SparkSession, path: str) -> Baseline:
    """The columns of one file that is as it should be."""
    from shapewright.sources.listing import expand
    from shapewright.sources.profile import profile

    parts: dict[str, list[tuple[str, int]]] = {}
    found = expand(spark, path, parts)
    row = profile(spark, [(0, *found[0])], persist=False, parts=parts).first() if len(found) == 1 else None
    if row is None or row.bucket == "refused" or not row.norm_names:
        raise ValueError(f"Cannot use {path} as a golden file: {row.error if row and row.error else 'no columns were found'}")
    types = row.type_classes or [None] * len(row.raw_names)
    return Baseline(tuple((n, t or "any") for n, t in zip(row.raw_names, types)), f"golden file {path}", path)


_CREATE = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?:(?:\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[\w$]+)\s*\.?\s*)+\(", re.I)
_CONSTRAINT = re.compile(r"^(?:primary\s+key|foreign\s+key|constraint|unique|check|index|key|exclude)\b(?!\s+\w+\s*(?:,|$))", re.I)
_COLUMN = re.compile(r"^(\"[^\"]*\"|'[^']*'|`[^`]*`|\[[^\]]*\]|[\w$]+)\s*(.*)$", re.S)
_TYPE = re.compile(r"^(timestamp\s+with(?:out)?\s+time\s+zone|double\s+precision|character\s+varying|[a-zA-Z0-9_]+)", re.I)
# Types of two words.
_LONG_TYPES = {"timestamp without time zone": "timestamp", "double precision": "double", "character varying": "varchar"}


def from_ddl(path_or_text: str) -> Baseline:
    """The columns of the first CREATE TABLE in a file or text."""
    path = path_or_text if "\n" not in path_or_text and os.path.exists(path_or_text) else None
    text = _read(path) if path else path_or_text
    text = re.sub(r"--[^\n]*", "", re.sub(r"/\*.*?\*/", "", text, flags=re.S))
    start = _CREATE.search(text)
    if start is None:
        raise ValueError(f"No CREATE TABLE in {path or 'the text'}")
    parts, depth, now = [], 1, ""
    for c in text[start.end() :]:
        depth += (c == "(") - (c == ")")
        if depth == 0:
            break
        if c == "," and depth == 1:
            parts.append(now)
            now = ""
        else:
            now += c
    columns = []
    for part in map(str.strip, [*parts, now]):
        if not part or _CONSTRAINT.match(part):
            continue
        m = _COLUMN.match(part)
        if m is None:
            continue
        kind = _TYPE.match(m[2].strip())
        base = re.sub(r"\s+", " ", kind[1].lower()) if kind else "any"
        columns.append((m[1].strip("\"'`[]"), normalize(_LONG_TYPES.get(base, base))))
    return Baseline(tuple(columns), f"DDL {path or 'text'}", path)


def load(spark: SparkSession, path: str) -> Baseline:
    """By what the file is: a result, DDL, a flat schema, else a golden file."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".json":
        try:
            return from_result(path)
        except ValueError:
            return from_golden(spark, path)
    if ext in (".sql", ".ddl"):
        return from_ddl(path)
    if ext in (".schema", ".txt", ""):
        if re.match(r"\s*create\b", _read(path), re.I):
            return from_ddl(path)
        return from_flat(path)
    return from_golden(spark, path)
