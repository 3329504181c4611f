"""Names, and where the format declares or shows them types, of the columns of one file of each format. No Spark here."""

from __future__ import annotations

import csv
import itertools
import json
import os
import re
import sqlite3
import tempfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from shapewright.functions.classes import joined, of_value
from shapewright.sources import bytelevel as by

csv.field_size_limit(16 << 20)  # a field beyond it is taken for a quote that isn't closed


@dataclass(frozen=True)
class Bounds:
    """How much of one file is read. Where more is there, the file's row says so (partial)."""

    lines: int = 10_000  # whose delimiters are counted
    rows: int = 2_000  # typed without exception; of later ones a thinning share
    first: int = 1_000
    xml_bytes: int = 256 << 10
    xml_depth: int = 5
    zip_bytes: int = 512 << 20
    sheet_rows: int = 100
    json_bytes: int = 16 << 20  # of one object


@dataclass
class Found:
    """names None: nothing to profile; types by position, None where not known; nulls: empty values by position among the rows typed."""

    names: list[str] | None = None
    types: list[str | None] | None = None
    delimiter: str | None = None
    quote: str | None = None
    has_header: bool | None = None
    rows: int | None = None
    counts: list[int | None] = field(default_factory=list)
    nulls: list[int] | None = None
    typed: int | None = None
    partial: bool = False
    error: str | None = None
    bucket: str | None = None
    depth: int = 0


def is_typed(n: int, bounds: Bounds = Bounds()) -> bool:
    """Whether the n-th row of data is looked at: the first ones, and later ones thinned out by a fixed multiplicative rule."""
    return n <= bounds.rows or (n * 2_654_435_761 % (1 << 32)) * (n - bounds.first) < (bounds.rows - bounds.first) << 32


def delimiters_in(line: str, delimiter: str) -> int | None:
    """The delimiters of a line, None for an empty one: it has a number, but no columns."""
    return line.count(delimiter) if line else None


def header_of(rows: list[list[str]]) -> bool:
    """Whether the first row names columns: a text over values that are none; or all of it texts, with nothing below to tell."""
    first, below = rows[0], rows[1:50]
    classes = [of_value(v.strip()) if v.strip() else "any" for v in first]
    if not below:
        return all(c == "text" for c in classes)
    under = [joined(of_value(r[i].strip()) for r in below if i < len(r) and r[i].strip()) for i in range(len(first))]
    if any(c == "text" and u not in ("text", "any") for c, u in zip(classes, under)):
        return True
    return all(c in ("text", "any") for c in classes) and "text" in classes


def read_csv(file: BinaryIO, encoding: str, gzipped: bool = False, quote_aware: bool = False, leading_zeros_as_text: bool = False, types: bool = True, bounds: Bounds = Bounds()) -> Found:
    """A delimited file; counts: delimiters of each of the first lines, blank ones None."""
    lines = by.lines_from(file, encoding, gzipped)
    head = list(itertools.islice(lines, 200))
    full = [x for x in head if x.strip()]
    if not full:
        return Found()
    delimiter, _ = by.delimiter_score(full[:20])
    delimiter = delimiter or ","
    quote = '"' if any('"' in x for x in full) else None

    def parsed(source):
        return csv.reader(source, delimiter=delimiter, quotechar='"')

    counts: list[int | None] = []  # by lines
    fields: list[int | None] = []  # by rows
    physical = filled = 0

    def watched():
        nonlocal physical, filled
        for line in itertools.chain(head, lines):
            physical += 1
            if physical <= bounds.lines:
                counts.append(delimiters_in(line, delimiter))
            if line.strip():
                filled += 1
                yield line

    rest = watched()
    try:
        reader = parsed(full)
        sample = [next(reader)]
        if reader.line_num > 1:
            raise csv.Error("a quote of the header isn't closed")
        sample += itertools.islice(reader, 59)
        header = header_of(sample)
        names = [x.strip() for x in sample[0]] if header else [f"column{i}" for i in range(len(sample[0]))]
        names = [x or f"column{i}" for i, x in enumerate(names)]
        seen, nulls = [set() for _ in names], [0] * len(names)
        n, typed, ragged = 0, 0, False
        for number, row in enumerate(parsed(rest)):
            if quote_aware and number < bounds.lines:
                fields.append(len(row) - 1)
            if header and number == 0:
                continue
            n += 1
            if types and is_typed(n, bounds):
                typed += 1
                ragged = ragged or len(row) != len(names)
                for i, v in enumerate(row[: len(names)]):
                    if v := v.strip():
                        seen[i].add(of_value(v, leading_zeros_as_text))
                    else:
                        nulls[i] += 1
    except csv.Error:  # quotes that don't pair up: the first line names the columns, and lines are rows
        for _ in rest:
            pass
        names = [x.strip("\"' ") or f"column{i}" for i, x in enumerate(full[0].split(delimiter))]
        return Found(names, None, delimiter, quote, True, filled - 1, counts, partial=physical > bounds.lines)
    classes = None if ragged or not types else [joined(s) for s in seen]
    return Found(names, classes, delimiter, quote, header, n, fields if quote_aware else counts, nulls if types else None, typed if types else None, partial=physical > bounds.lines or types and typed < n)


# Parquet's logical and physical types by class.
ARROW = (("bool", "bool"), ("int", "int"), ("uint", "int"), ("float", "decimal"), ("double", "decimal"), ("halffloat", "decimal"), ("decimal", "decimal"), ("date", "date"), ("timestamp", "timestamp"), ("string", "text"), ("large_string", "text"), ("binary", "blob"), ("large_binary", "blob"), ("fixed_size_binary", "blob"))


def leaf_types(kind) -> Iterator:
    """The types of the leaves of an Arrow type, in the order of Parquet's columns."""
    import pyarrow as pa

    if pa.types.is_dictionary(kind):
        yield from leaf_types(kind.value_type)
    elif pa.types.is_map(kind):
        yield from leaf_types(kind.key_type)
        yield from leaf_types(kind.item_type)
    elif pa.types.is_nested(kind):
        for i in range(kind.num_fields):
            yield from leaf_types(kind.field(i).type)
    else:
        yield kind


def read_parquet(file: BinaryIO) -> Found:
    """From the footer alone: the leaf columns, by their own names."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(file)
    schema = meta.schema.to_arrow_schema()
    cls = lambda t: next((c for name, c in ARROW if str(t).startswith(name)), "any")
    kinds = [t for f in schema for t in leaf_types(f.type)]
    names = [meta.schema.column(i).name for i in range(meta.num_columns)]
    return Found(names, [cls(t) for t in kinds] if len(kinds) == len(names) else None, rows=meta.num_rows)


def read_json(file: BinaryIO, encoding: str, by_line: bool, bounds: Bounds = Bounds()) -> Found:
    """Top-level field names in the order of their first sight."""
    names: dict[str, None] = {}
    n = 0
    if by_line:
        for line in by.lines_from(file, encoding):
            if line.strip():
                if len(line) > bounds.json_bytes:
                    raise ValueError("a JSON object is too long")
                n += 1
                value = json.loads(line)
                if isinstance(value, dict):
                    names |= dict.fromkeys(value)
    else:
        value = json.loads(file.read().decode(encoding).lstrip("﻿"))
        rows = value if isinstance(value, list) else [value]
        n = len(rows)
        for row in rows:
            if isinstance(row, dict):
                names |= dict.fromkeys(row)
    return Found(list(names) or None, rows=n)


def read_sqlite(file: BinaryIO, path: str | None) -> Found:
    """All tables by name; with several tables, names are table.column."""
    with tempfile.TemporaryDirectory() as own:
        if path is None:
            path = os.path.join(own, "copy")
            with open(path, "wb") as out:
                while block := file.read(by.BLOCK):
                    out.write(block)
        db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name")]
            columns = [(t, r[1]) for t in tables for r in db.execute("SELECT * FROM pragma_table_info(?)", (t,))]
        finally:
            db.close()
    if not columns:
        return Found(error="the database has no tables", bucket="degraded")
    return Found([c if len(tables) == 1 else f"{t}.{c}" for t, c in columns])


def read_xml(file: BinaryIO, bounds: Bounds = Bounds()) -> Found:
    """Paths of elements down to a depth, namespaces left out, from the head of the file."""
    data = file.read(bounds.xml_bytes)
    paths: set[str] = set()
    stack: list[str] = []
    parser = ET.XMLPullParser(events=("start", "end"))

    def drain() -> None:
        for event, element in parser.read_events():
            if event == "start":
                stack.append(element.tag.rsplit("}", 1)[-1])
                if len(stack) <= bounds.xml_depth + 1:
                    paths.add("/".join(stack))
            else:
                stack.pop()
                element.clear()

    try:
        parser.feed(data)
        drain()
        if len(data) < bounds.xml_bytes:
            parser.close()
            drain()
    except ET.ParseError as e:
        if len(data) < bounds.xml_bytes or not paths:
            return Found(error=f"not well-formed: {e}", bucket="degraded")
    return Found(sorted(paths), partial=len(data) == bounds.xml_bytes) if paths else Found(error="no elements", bucket="degraded")


def read_zip(file: BinaryIO, bounds: Bounds = Bounds()) -> Found:
    """What a ZIP holds isn't opened; whether it could be is told."""
    try:
        with zipfile.ZipFile(file) as z:
            members = z.infolist()
    except (zipfile.BadZipFile, zlib.error, OSError) as e:
        return Found(error=f"bad ZIP: {e}", bucket="degraded")
    if any(m.flag_bits & 1 for m in members):
        return Found(error="ENCRYPTED_ARCHIVE: members are encrypted", bucket="refused", depth=1)
    if sum(m.file_size for m in members) > bounds.zip_bytes:
        return Found(error=f"holds more than {bounds.zip_bytes} bytes", bucket="catalogued", depth=1)
    if any(m.filename.lower().endswith((".zip", ".gz")) for m in members):
        return Found(error="NESTED_ARCHIVE: holds further archives", bucket="catalogued", depth=1)
    return Found(bucket="catalogued", depth=1)


NS = re.compile(r"^\{[^}]*\}")
# Built-in number formats of spreadsheets that show dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def read_excel(file: BinaryIO, bounds: Bounds = Bounds()) -> Found:
    """The first sheet: its first row names the columns, the next ones show their types."""
    tag = lambda e: NS.sub("", e.tag)
    with zipfile.ZipFile(file) as z:
        names = set(z.namelist())
        root = lambda n: ET.fromstring(z.read(n)) if n in names else ET.Element("none")
        shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in root("xl/sharedStrings.xml")]
        styles = root("xl/styles.xml")
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if tag(f) == "numFmt"}
        dated = lambda i: i in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", custom.get(i, "")), re.I))
        shown = [dated(int(x.get("numFmtId", 0))) for xfs in styles if tag(xfs) == "cellXfs" for x in xfs]
        sheets = [s for s in root("xl/workbook.xml").iter() if tag(s) == "sheet"]
        links = {r.get("Id"): r.get("Target") for r in root("xl/_rels/workbook.xml.rels")}
        target = next((links.get(v) for s in sheets[:1] for k, v in s.attrib.items() if k.endswith("}id")), None) or "worksheets/sheet1.xml"
        sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if sheet not in names:
            return Found(error="the workbook has no sheet", bucket="degraded")

        def cell(c) -> tuple[str, str]:
            kind = c.get("t", "n")
            value = next((v.text or "" for v in c if tag(v) == "v"), "")
            if kind == "inlineStr":
                return "text", "".join(t.text or "" for t in c.iter() if tag(t) == "t")
            if kind == "s":
                return "text", shared[int(value)] if value else ""
            if kind == "b":
                return "bool", value
            if kind in ("str", "e"):
                return "text", value
            if kind == "d":
                return "timestamp", value
            style = int(c.get("s", 0))
            if style < len(shown) and shown[style]:
                return "timestamp", value
            return ("int" if re.fullmatch(r"-?\d+", value) else "decimal"), value

        def place(c, last: int) -> int:
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            if not letters:
                return last + 1
            n = 0
            for x in letters[0]:
                n = n * 26 + ord(x) - 64
            return n - 1

        rows: list[dict[int, tuple[str, str]]] = []
        partial = False
        with z.open(sheet) as stream:
            for _, row in ET.iterparse(stream):
                if tag(row) != "row":
                    continue
                cells, at = {}, -1
                for c in row:
                    at = place(c, at)
                    cells[at] = cell(c)
                rows.append({i: v for i, v in cells.items() if v[1] != ""})
                row.clear()
                if len(rows) > bounds.sheet_rows:
                    partial = True
                    break
    if not rows or not rows[0]:
        return Found(error="the sheet is empty", bucket="degraded")
    width = max(rows[0]) + 1
    head = [rows[0].get(i, ("", ""))[1].strip() or f"column{i}" for i in range(width)]
    classes = []
    for i in range(width):
        seen = {r[i][0] for r in rows[1:] if i in r}
        classes.append("any" if not seen else "decimal" if seen == {"int", "decimal"} else next(iter(seen)) if len(seen) == 1 else "text")
    return Found(head, classes, has_header=True, rows=len(rows) - 1, partial=partial)


def profiled(file: BinaryIO, path: str | None, fmt: str, encoding: str, bounds: Bounds = Bounds(), **options) -> Found:
    """By format; formats that are only catalogued give an empty Found."""
    text = "utf-8" if fmt == "gzip" and encoding == "latin-1" else encoding
    if fmt in ("csv", "tsv"):
        return read_csv(file, encoding, bounds=bounds, **options)
    if fmt == "gzip":
        found = read_csv(file, text, gzipped=True, types=False, bounds=bounds)
        return Found(found.names, None, found.delimiter, found.quote, found.has_header, found.rows, depth=1)
    if fmt == "parquet":
        return read_parquet(file)
    if fmt in ("json", "jsonl"):
        return read_json(file, encoding, fmt == "jsonl", bounds)
    if fmt == "sqlite":
        return read_sqlite(file, path)
    if fmt == "xml":
        return read_xml(file, bounds)
    if fmt == "excel":
        return read_excel(file, bounds)
    if fmt == "zip":
        return read_zip(file, bounds)
    return Found()
