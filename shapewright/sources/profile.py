"""One row of physical facts for each file, from one pass of a Python worker over its bytes."""

from __future__ import annotations

import heapq
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.functions.names import canonical
from shapewright.sources import bytelevel as by
from shapewright.sources import readers

FILES = (
    "file_id long, path string, size_bytes long, ext string, bucket string, format_detected string, format_confidence int, encoding string, "
    "encoding_is_fallback boolean, delimiter string, quote_char string, newline string, has_header boolean, column_count int, row_count_estimate long, "
    "archive_depth int, error string, raw_names array<string>, norm_names array<string>, type_classes array<string>, ends_with_newline boolean, counts array<int>, null_counts array<long>, rows_typed long, partial boolean"
)
_NAMES = [f.split()[0] for f in FILES.split(", ")]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in FILES.split(", ")])
#: Formats whose rows are counted line by line for anomalies.
INSPECTED = ("csv", "tsv")
#: Formats that are recognised, never opened.
CATALOGUED = ("arrow", "orc", "avro", "fixed-width", "text", "unknown")
#: Files whose profile stays on the driver; what opening a file costs, in bytes read.
FEW, OPENING = 2_000, 100_000
FILE_LISTS = pa.list_(pa.struct([("file_id", pa.int64()), ("path", pa.string()), ("size_bytes", pa.int64())]))


def facts(path: str, size: int, opened, bounds: readers.Bounds = readers.Bounds(), **options) -> dict:
    """What there is to say about one file; opened() gives its bytes from the start. Never raises: what is wrong becomes bucket and error."""
    ext = PurePosixPath(path).suffix.lower() or (PurePosixPath(path).name if PurePosixPath(path).name.startswith(".") else "")
    row = {"path": path, "size_bytes": size, "ext": ext, "bucket": "catalogued", "archive_depth": 0, "encoding_is_fallback": False}
    try:
        with opened() as f:
            head = f.read(by.HEAD)
    except PermissionError:
        return row | {"bucket": "refused", "error": f"Permission denied: {path}"}
    except Exception as e:
        return row | {"bucket": "refused", "error": f"File read failed: {e}"}
    gzipped = head.startswith(b"\x1f\x8b")
    if gzipped:
        try:
            with opened() as f:
                head = by.gunzipped_head(f)
        except (by.Corrupt, OSError, EOFError, zlib.error) as e:
            return row | {"bucket": "refused", "format_detected": "gzip", "format_confidence": 2, "error": f"CORRUPT_ARCHIVE: {e}"}
    encoding, fallback = by.encoding_of(head)
    fmt, sure = ("gzip", 2) if gzipped else by.format_of(head, encoding, ext)
    if fmt == "zip":
        with opened() as f:
            fmt = "excel" if by.is_excel(f) else "zip"
    textual = fmt in by.TEXTUAL or fmt == "gzip"
    row |= {"format_detected": fmt, "format_confidence": sure, "encoding": encoding if textual else None, "encoding_is_fallback": fallback and textual and fmt != "gzip", "newline": by.newline_of(head) if textual else None}
    try:
        with opened() as f:
            found = readers.profiled(f, path if os.path.exists(path) else None, fmt, encoding, bounds, **(options if fmt in INSPECTED else {}))
    except Exception as e:
        found = readers.Found(error=f"{fmt} can't be read: {e}", bucket="degraded")
    if found.names:
        row |= {"bucket": "profiled", "raw_names": found.names, "norm_names": [canonical(n) for n in found.names], "column_count": len(found.names), "type_classes": found.types if fmt != "gzip" else None}
    row |= {"delimiter": found.delimiter, "quote_char": found.quote, "has_header": found.has_header, "row_count_estimate": found.rows, "archive_depth": found.depth, "error": found.error, "counts": found.counts if fmt in INSPECTED else None, "null_counts": found.nulls, "rows_typed": found.typed, "partial": found.partial}
    if found.bucket:
        row["bucket"] = found.bucket
    if textual and fmt not in ("text", "fixed-width", "unknown") and row["bucket"] in ("profiled", "catalogued") or gzipped:
        with opened() as f:
            wrong = by.decoding_error(f, encoding, gzipped)
        if wrong:
            return row | {"bucket": "refused", "error": wrong}
    if fmt in INSPECTED:
        with opened() as f:
            row["ends_with_newline"] = by.ends_with_newline(f, size) if f.seekable() else None
    return row


def _rows(made: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _NAMES} for r in made], SCHEMA)


def dealt(files: list[tuple[int, str, int]], tasks: int) -> list[list[tuple[int, str, int]]]:
    """Files in shares of about the same work: the largest first, each to the share with the least so far. A file's opening costs like OPENING bytes."""
    shares = [(0, i, []) for i in range(max(1, min(tasks, len(files))))]
    for f in sorted(files, key=lambda f: (-f[2], f[0])):
        work, i, share = heapq.heappop(shares)
        share.append(f)
        heapq.heappush(shares, (work + f[2] + OPENING, i, share))
    return [share for _, _, share in sorted(shares, key=lambda s: s[1])]


def merged(path: str, size: int, rows: list[dict]) -> dict:
    """The row of a folder that is a table, from those of its parts by path: the first one's names and types, which all must have."""
    first = rows[0]
    row = first | {"path": path, "size_bytes": size, "ext": PurePosixPath(path).suffix.lower()}
    if all(r["row_count_estimate"] is not None for r in rows):
        row["row_count_estimate"] = sum(r["row_count_estimate"] for r in rows)
    odd = next((r for r in rows if r["bucket"] != "profiled"), None)
    if odd is not None:
        return row | {"bucket": odd["bucket"], "error": f"{PurePosixPath(odd['path']).name}: {odd['error'] or odd['format_detected']}"}
    odd = next((r for r in rows if (r["format_detected"], r["raw_names"], r["type_classes"]) != (first["format_detected"], first["raw_names"], first["type_classes"])), None)
    return row if odd is None else row | {"bucket": "degraded", "error": f"{PurePosixPath(odd['path']).name} has other columns than {PurePosixPath(first['path']).name}"}


def profile(spark: SparkSession, files: list[tuple[int, str, int]], persist: bool = True, bounds: readers.Bounds = readers.Bounds(), parts: dict[str, list[tuple[str, int]]] | None = None, **options) -> DataFrame:
    """FILES for a listing (file_id, path, size_bytes).

    Files that workers see under their path are streamed from there, block by block; those of another store are read by Spark. Up to
    FEW files are profiled at once, by one job, and their rows kept on the driver: what follows then needs no shuffle. A folder in
    parts is one of the files: each of its files is profiled, and their rows become one."""
    tables = {f[0]: f for f in files if f[1] in (parts or {})}
    few = len(files) <= FEW
    files = [x for f in files for x in ([(f[0], *part) for part in parts[f[1]]] if f[0] in tables else [f])]
    local = [f for f in files if "://" not in f[1]]
    far = [f for f in files if "://" in f[1]]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column("files").to_pylist():
                for at in range(0, len(share), 64):
                    yield _rows([facts(f["path"], f["size_bytes"], lambda p=f["path"]: open(p, "rb"), bounds, **options) | {"file_id": f["file_id"]} for f in share[at : at + 64]])

    out = None
    if local or not far:
        # a mark of its own keeps Spark from taking an earlier profile of the same names and sizes from its cache
        shares = pa.array([[dict(zip(("file_id", "path", "size_bytes"), f)) for f in share] for share in dealt(local, max(spark.sparkContext.defaultParallelism, len(local) // 1_000))], FILE_LISTS)
        out = spark.createDataFrame(pa.table({"files": shares})).withColumn("scan", F.lit(uuid.uuid4().hex)).mapInArrow(near, FILES)
    if far:
        listed = pa.table({n: pa.array(c, k) for n, c, k in zip(("file_id", "path", "size_bytes"), zip(*far), (pa.int64(), pa.string(), pa.int64()))})
        ids = F.broadcast(spark.createDataFrame(listed))  # the driver's own listing, limited by its ceiling
        content = spark.read.format("binaryFile").load([p for _, p, _ in far]).select(F.col("path").alias("p"), "content")
        same = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731  stores differ in how they write their root
        read = profile_of(ids.join(content, same("path") == same("p")), bounds, **options)
        out = read if out is None else out.unionByName(read)
    if tables:

        def whole(key: tuple, rows: pa.Table) -> pa.Table:
            _, path, size = tables.get(key[0].as_py(), (None, None, None))
            return rows if path is None else pa.Table.from_batches([_rows([merged(path, size, sorted(rows.to_pylist(), key=lambda r: r["path"]))])])

        out = out.groupBy("file_id").applyInArrow(whole, FILES)
    if few:
        return spark.createDataFrame(out.toArrow().cast(SCHEMA), FILES).coalesce(1)
    return out.persist() if persist else out


def profile_of(contents: DataFrame, bounds: readers.Bounds = readers.Bounds(), **options) -> DataFrame:
    """FILES for rows (file_id, path, size_bytes, content): files that are values of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("file_id", "path", "size_bytes")}
            for at in range(0, batch.num_rows, 64):
                made = []
                for i in range(at, min(at + 64, batch.num_rows)):
                    content = batch.column("content")[i].as_py() or b""
                    made.append(facts(cols["path"][i], cols["size_bytes"][i], lambda c=content: io.BytesIO(c), bounds, **options) | {"file_id": cols["file_id"][i]})
                yield _rows(made)

    return contents.select("file_id", "path", "size_bytes", "content", F.lit(uuid.uuid4().hex).alias("scan")).mapInArrow(run, FILES)


def columns_of(files: DataFrame) -> DataFrame:
    """(file_id, position, raw_name, norm_name, type_class, nulls, null_fraction); the last two of the rows that were typed."""
    of = F.expr("transform(norm_names, (x, i) -> named_struct('raw_name', get(raw_names, i), 'norm_name', x, 'type_class', get(type_classes, i), 'nulls', get(null_counts, i)))")
    each = files.where("norm_names IS NOT NULL").select("file_id", "rows_typed", F.posexplode(of).alias("position", "c"))
    fraction = F.when(F.col("c.nulls").isNotNull(), F.coalesce(F.try_divide("c.nulls", "rows_typed"), F.lit(0.0)))
    return each.select("file_id", "position", "c.raw_name", "c.norm_name", "c.type_class", "c.nulls", fraction.alias("null_fraction"))
