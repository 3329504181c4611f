"""Which files a path expression means, and the limits on their number, bytes and depth."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from shapewright.functions.codes import FINDINGS, severity
from shapewright.sources.readers import Bounds


@dataclass(frozen=True)
class Limits:
    """Ceilings of a scan; files beyond file_count are not looked at, the other ceilings only warn. bounds: how much of a file is read."""

    file_count: int = 10_000
    total_bytes: int = 50 * 1024**3
    depth: int = 20
    exclude: tuple[str, ...] = ()
    bounds: Bounds = Bounds()
    options: dict = field(default_factory=dict)

    def excluding(self, path: str) -> Limits:
        return replace(self, exclude=(*self.exclude, path))


@dataclass(frozen=True)
class Listing:
    """files: (file_id, path, size_bytes), ids from 0 by path; findings: of the fileset; seen: before the ceiling on files; parts: (path, bytes) of the files of a folder that is a table."""

    files: list[tuple[int, str, int]]
    findings: list[tuple]
    seen: int
    parts: dict[str, list[tuple[str, int]]] = field(default_factory=dict)


GLOB = set("*?[{")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def base_of(expression: str) -> str:
    """The folder above the first part with a wildcard; a folder itself; a file's folder."""
    parts = expression.rstrip("/").split("/")
    wild = next((i for i, p in enumerate(parts) if GLOB & set(p)), None)
    return "/".join(parts[:wild]) or "/" if wild is not None else expression.rstrip("/") or "/"


def spelled(spark: SparkSession, expression: str) -> str:
    """A path expression as listings write paths: the driver's own files without a scheme (file:/x and file:///x are /x), others with their store's scheme and authority (hdfs:/x and hdfs:///x are hdfs://host/x)."""
    expression = re.sub("^file:(//)?(?=/(?!/))", "", expression)
    if "://" not in expression and not re.match("[A-Za-z][A-Za-z0-9+.-]+:/", expression):
        return os.path.abspath(os.path.expanduser(expression))
    base = base_of(expression)
    fs, root = _filesystem(spark, base)
    return fs.makeQualified(root).toString().rstrip("/") + expression.rstrip("/").removeprefix(base)


def hidden(path: str, expression: str) -> bool:
    """A part that starts with a dot hides a path, unless the expression names that part."""
    named = set(expression.split("/"))
    return any(p.startswith(".") and p not in (".", "..") and p not in named for p in path.split("/"))


def table_of(path: str, pattern: str | None) -> str | None:
    """The folder above a file that is a table: named *.parquet, as Spark writes it, and meant by the pattern, which doesn't mean the file itself. A part of a path below it that starts with _ or a dot is none of its data."""
    if pattern is None:
        return None
    for above in PurePosixPath(path.replace("://", ":%%", 1)).parents:
        folder = str(above).replace(":%%", "://", 1)
        if above.suffix == ".parquet" and matches(folder, pattern):
            return None if any(p[0] in "_." for p in path.removeprefix(folder).strip("/").split("/")) else folder
    return None


def expand(spark: SparkSession, expression: str, parts: dict[str, list[tuple[str, int]]] | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of all files that the expression means, by path. Works on any Hadoop file system; ** means any depth.

    A folder that is a table (table_of) is one file; its parts are put into parts."""
    parts = {} if parts is None else parts
    expression = spelled(spark, expression)
    if "://" not in expression:
        return expand_local(expression, parts)
    fs, root = _filesystem(spark, base_of(expression))
    if not fs.exists(root):
        return []
    if fs.getFileStatus(root).isFile():
        return [(root.toString(), fs.getFileStatus(root).getLen())]
    out, listed = [], fs.listFiles(root, True)
    pattern = None if base_of(expression) == (expression.rstrip("/") or "/") else expression
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toString()
        if hidden(path, expression):
            continue
        if pattern is None or matches(path, pattern):
            out.append((path, status.getLen()))
        elif whole := table_of(path, pattern):
            parts.setdefault(whole, []).append((path, status.getLen()))
    return sorted(out + totals(parts))


def totals(parts: dict[str, list[tuple[str, int]]]) -> list[tuple[str, int]]:
    for files in parts.values():
        files.sort()
    return [(folder, sum(n for _, n in files)) for folder, files in parts.items()]


def expand_local(expression: str, parts: dict[str, list[tuple[str, int]]]) -> list[tuple[str, int]]:
    """expand() for the driver's own file system, without a call to the JVM for each file."""
    root = base_of(expression)
    if os.path.isfile(root):
        return [(root, os.path.getsize(root))]
    pattern = None if root == (expression.rstrip("/") or "/") else expression
    out, folders = [], [root]
    while folders:
        try:
            entries = list(os.scandir(folders.pop()))
        except FileNotFoundError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False) or e.is_dir() and e.name.endswith(".parquet") and pattern is not None and matches(e.path, pattern):
                if not e.name.startswith(".") or e.name in expression.split("/"):
                    folders.append(e.path)
            elif e.is_file() and not hidden(e.path, expression):
                if pattern is None or matches(e.path, pattern):
                    out.append((e.path, e.stat().st_size))
                elif whole := table_of(e.path, pattern):
                    parts.setdefault(whole, []).append((e.path, e.stat().st_size))
    return sorted(out + totals(parts))


def matches(path: str, pattern: str) -> bool:
    return PurePosixPath(path).full_match(pattern, case_sensitive=True)


def list_files(spark: SparkSession, expression: str, limits: Limits = Limits()) -> Listing:
    """The files within the limits, with what there is to say about the set."""
    say = lambda code, level, locus, expected, found, why: (code, level, locus, expected, found, why, 1)
    parts: dict[str, list[tuple[str, int]]] = {}
    try:
        found = expand(spark, expression, parts)
        gone = {spelled(spark, x) for x in limits.exclude}
    except Exception as e:  # an unreadable folder or a bad pattern is a finding, not a crash
        return Listing([], [say("FORMAT_UNRECOGNIZED", "ERROR", "path_expression", None, None, f"'{expression}' can't be expanded: {str(e).splitlines()[0][:300]}")], 0)
    found = [x for x in found if x[0] not in gone]
    if not found:
        return Listing([], [say("FORMAT_UNRECOGNIZED", "WARN", "path_expression", "at least one file", "0 files", f"'{expression}' matches no file.")], 0)
    return replace(within(found, spelled(spark, expression), limits), parts=parts)


def within(found: list[tuple[str, int]], expression: str, limits: Limits) -> Listing:
    """The ceilings over (path, bytes) in the order of paths."""
    say = lambda code, level, locus, expected, found, why: (code, level, locus, expected, found, why, 1)
    findings = []
    plain = expression.removeprefix("file://") if expression.startswith("file:///") else expression
    base = base_of(plain if "://" in plain else os.path.abspath(plain))
    depth = lambda p: max(len(PurePosixPath(p.removeprefix(base).lstrip("/")).parts) - 1, 0)
    deepest = max(found, key=lambda x: depth(x[0]))[0]
    if depth(deepest) > limits.depth:
        findings.append(say("RECURSION_DEPTH_CEILING", severity("RECURSION_DEPTH_CEILING"), deepest, f"depth of {limits.depth} at most", f"depth {depth(deepest)}", f"'{deepest}' lies {depth(deepest)} folders deep; the ceiling is {limits.depth}."))
    seen = len(found)
    if seen > limits.file_count:
        findings.append(say("FILE_COUNT_CEILING", severity("FILE_COUNT_CEILING"), "fileset", str(limits.file_count), str(seen), f"{seen} files match; only the first {limits.file_count} by path are looked at."))
        found = found[: limits.file_count]
    total = 0
    for path, size in found:
        total += size
        if total > limits.total_bytes:
            findings.append(say("BYTE_CEILING", severity("BYTE_CEILING"), path, f"{limits.total_bytes} bytes at most", f"{total} bytes", f"At '{path}' the files' sizes pass {limits.total_bytes} bytes."))
            break
    return Listing([(i, p, n) for i, (p, n) in enumerate(found)], findings, seen)


def findings_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FINDINGS)
