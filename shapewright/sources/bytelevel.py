"""What the bytes of a file tell: encoding, format, delimiter, whether it decodes to its end. No Spark here."""

from __future__ import annotations

import codecs
import gzip
import io
import zipfile
import zlib
from collections import Counter
from typing import BinaryIO

HEAD, BLOCK = 65_536, 1 << 20

# Byte order marks, longest first.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32-le"),
    (b"\x00\x00\xfe\xff", "utf-32-be"),
    (b"\xff\xfe", "utf-16-le"),
    (b"\xfe\xff", "utf-16-be"),
    (b"\xef\xbb\xbf", "utf-8-sig"),
)
# Formats by their first bytes.
MAGIC = (
    (b"PAR1", "parquet"),
    (b"SQLite format 3\x00", "sqlite"),
    (b"\x1f\x8b", "gzip"),
    (b"PK\x03\x04", "zip"),
    (b"PK\x05\x06", "zip"),
    (b"PK\x07\x08", "zip"),
    (b"<?xml", "xml"),
    (b"\xef\xbb\xbf<?xml", "xml"),
    (b"\xff\xfe<\x00?\x00", "xml"),
    (b"\xfe\xff\x00<\x00?", "xml"),
    (b"ARROW1", "arrow"),
    (b"ORC", "orc"),
    (b"Obj\x01", "avro"),
)
TEXTUAL = frozenset({"csv", "tsv", "json", "jsonl", "xml", "text", "fixed-width"})
# Extensions of files that describe data and are catalogued as text, whatever they hold; delimiters, the first wins ties.
NOT_DATA = frozenset(".schema .md .sql .ddl .py .sh .yml .yaml .git .gitignore .txt".split())
DELIMITERS = ("\t", "|", ";", ",")


class Corrupt(Exception):
    """A container that can't be opened to its end."""


def encoding_of(head: bytes) -> tuple[str, bool]:
    """The encoding by mark, pattern of nulls or strict UTF-8; else latin-1, as a fallback."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name, False
    some = head[:256]
    if len(some) >= 4:
        odd, even = some[1::2], some[0::2]
        if odd.count(0) >= 0.8 * len(odd):
            return "utf-16-le", False
        if even.count(0) >= 0.8 * len(even):
            return "utf-16-be", False
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        # a full sample may end inside a character
        if not (len(head) >= HEAD and e.start >= len(head) - 4):
            return "latin-1", True
    return "utf-8", False


def text_of(head: bytes, encoding: str) -> str:
    return head.decode(encoding, errors="replace").lstrip("﻿")


def delimiter_score(lines: list[str]) -> tuple[str | None, float]:
    """The delimiter with the best (share of lines with its commonest count) x that count; earlier ones win ties."""
    best, top = None, 0.0
    for d in DELIMITERS:
        counts = Counter(line.count(d) for line in lines)
        counts.pop(0, None)
        if counts:
            most, n = max(counts.items(), key=lambda x: (x[1], -x[0]))
            score = n / len(lines) * most
            if score > top:
                best, top = d, score
    return best, top


def format_of(head: bytes, encoding: str, extension: str) -> tuple[str, int]:
    """The format and how sure it is: 2 by content, 1 by shape or name, 0 not at all."""
    if not head:
        return "unknown", 0
    for magic, name in MAGIC:
        if head.startswith(magic):
            return name, 2
    if extension in NOT_DATA:
        return "text", 1
    text = text_of(head, encoding)
    lines = [line for line in text.splitlines() if line.strip()]
    if not lines:
        return "text", 1
    if text.lstrip()[:1] in ("{", "["):
        return ("jsonl" if all(line.lstrip().startswith("{") for line in lines[:5]) else "json"), 2
    delimiter, _ = delimiter_score(lines[:20])
    if delimiter:
        return ("tsv" if delimiter == "\t" else "csv"), 2
    return ("fixed-width" if len({len(line) for line in lines[:20]}) <= 2 and len(lines) > 1 else "text"), 1


def is_excel(file: BinaryIO) -> bool:
    try:
        with zipfile.ZipFile(file) as z:
            return any(n.startswith("xl/") for n in z.namelist())
    except (zipfile.BadZipFile, OSError, ValueError):
        return False


def gunzipped_head(file: BinaryIO) -> bytes:
    try:
        return gzip.GzipFile(fileobj=file).read(HEAD)
    except (OSError, EOFError, zlib.error) as e:
        # what could be read of a cut file is still a sample
        file.seek(0)
        out = zlib.decompressobj(31)
        try:
            got = out.decompress(file.read(HEAD), HEAD)
        except zlib.error:
            got = b""
        if got:
            return got
        raise Corrupt(f"Failed to decompress Gzip header: {e}") from e


def decoding_error(file: BinaryIO, encoding: str, gzipped: bool) -> str | None:
    """Reads to the end; the first thing that is wrong, or None. A character may straddle two blocks."""
    decode = None if encoding == "latin-1" else codecs.getincrementaldecoder(encoding)("strict")
    if decode is None and not gzipped:
        return None
    source: BinaryIO = gzip.GzipFile(fileobj=file) if gzipped else file  # type: ignore[assignment]
    at = 0
    try:
        while block := source.read(BLOCK):
            if decode is not None:
                decode.decode(block)
            at += len(block)
        if decode is not None:
            decode.decode(b"", final=True)
    except UnicodeDecodeError as e:
        return f"DECODE_ERROR: bytes near {at} are not valid {encoding}: {e.reason}"
    except (OSError, EOFError, zlib.error) as e:
        return f"CORRUPT_ARCHIVE: the archive breaks off after {at} bytes: {e}"
    return None


def ends_with_newline(file: BinaryIO, size: int) -> bool:
    file.seek(max(0, size - 2))
    return file.read(2)[-1:] in (b"\n", b"\r") if size else True


def newline_of(head: bytes) -> str | None:
    return "\r\n" if b"\r\n" in head else "\n" if b"\n" in head else "\r" if b"\r" in head else None


def lines_from(file: BinaryIO, encoding: str, gzipped: bool = False):
    """The file's lines, decoded, without their ends; bad bytes are replaced."""
    raw: BinaryIO = gzip.GzipFile(fileobj=file) if gzipped else file  # type: ignore[assignment]
    for i, line in enumerate(io.TextIOWrapper(io.BufferedReader(raw) if not isinstance(raw, io.BufferedIOBase) else raw, encoding=encoding, errors="replace", newline=None)):
        yield (line.lstrip("﻿") if i == 0 else line).rstrip("\n")
