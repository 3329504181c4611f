"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are symbols. On each level runs of a symbol become one symbol; deterministic coin tossing (the lowest bit in
which a symbol differs from the one before, four times over) leaves labels below 6 whose neighbours differ; a phrase begins at each
local maximum; and phrases are named by a hash of their symbols, which are the next level's symbols. A label depends on the few
symbols before it only, so equal substrings are parsed alike inside, wherever they stand. A text is parsed until one symbol is left.
The fingerprint keeps, of all phrase names of all levels but the first, whose phrases are the two or three letters that any texts
share, the least in each of SLOTS classes; two fingerprints' likeness is the share of equal slots among those that either
fills, which estimates the likeness of the sets of phrases.

Documents are paired with the next in descending order of id: rows are dealt into ranges of ids, and each range also gets the first
document of the range after it.

Defined cases: a null text is empty; empty texts have the fingerprint of no phrase, and are alike (1.0); ties of ids go by text;
null ids come last; repeated rows are documents of their own; a single document is its own next; an empty table gives an empty one.
Memory grows with the longest text, by about 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.llm.common import partitions, read, text_batches
from shapewright.llm.textkernel import chunks, mix64, tidied

SLOTS = 64
CHUNK = 1_000_000

U = np.uint64
FIRST = np.uint8(255)
ODD = U(0x9E3779B97F4A7C15)
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def toss(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels from symbols; start: which begin a text. Neighbours of a text differ before and after."""
    differ = x[1:] ^ x[:-1]
    at = np.bitwise_count((differ & (~differ + x.dtype.type(1))) - x.dtype.type(1))
    out = np.empty(len(x), np.uint8)
    out[1:] = 2 * at + ((x[1:] >> at.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)
    out[start] = FIRST
    return out


def phrases(x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of symbols x, and the text of each; text: of each symbol, ascending."""
    same = np.zeros(len(x), bool)
    same[1:] = (x[1:] == x[:-1]) & (text[1:] == text[:-1])
    if same.any():
        at = np.flatnonzero(~same)
        runs = np.diff(np.append(at, len(x)))
        x, text = x[at], text[at]
        more = runs > 1
        x[more] = mix64(x[more] + ODD * runs[more].astype(np.uint64))
    start = np.ones(len(x), bool)
    start[1:] = text[1:] != text[:-1]
    labels = toss(x, start)
    for _ in range(3):
        labels = toss(labels, start)
    begin = start.copy()
    begin[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    # a text's last symbol has no successor to be larger than; labels of another text don't count
    begin[:-1] &= ~start[1:] | start[:-1]
    at = np.flatnonzero(begin)
    step = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    named = np.add.reduceat(mix64(x + ODD * (step.astype(np.uint64) + U(1))), at)
    return mix64(named), text[at]


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of SLOTS values for each text; 0: no phrase."""
    n = len(texts)
    least = np.full(n * SLOTS, EMPTY)
    x = mix64(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + U(1))
    text = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    for level in count():
        if not len(x):
            break
        x, text = phrases(x, text)
        if not level:
            continue  # two or three letters, which any texts share
        h = mix64(x ^ U(int(ODD) * (level + 1) % (1 << 64)))
        np.minimum.at(least, text.astype(np.int64) * SLOTS + (h & U(SLOTS - 1)).astype(np.int64), h >> U(6))
        more = np.bincount(text, minlength=n)[text] > 1
        x, text = x[more], text[more]
    out = (least % U(65_535) + U(1)).astype(np.uint16)
    out[least == EMPTY] = 0
    return out.reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    filled = ((a > 0) | (b > 0)).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    return np.where(filled > 0, equal / np.maximum(filled, 1), 1.0)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def range_of(c: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are larger; 0 for the largest values. A binary search in a literal array."""
    halves, s = [], 1
    while s <= len(cuts):
        halves.insert(0, s)
        s *= 2
    if not cuts:
        return F.lit(0)
    found = F.array(*[F.lit(int(x)).cast("bigint") for x in cuts])
    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda acc, h: acc + F.when(F.get(found, acc + h - 1) > c, h).otherwise(0))


def with_next(docs: DataFrame, id_col: str, ranges: int) -> DataFrame:
    """docs (id, text) dealt into ranges and sorted by descending id; rows with copy only follow the last row of their range."""
    cuts = sorted({int(x) for x in docs.approxQuantile(id_col, [i / ranges for i in range(1, ranges)], 0.2 / ranges)}, reverse=True) if ranges > 1 else []
    last = len(cuts) + 1
    placed = docs.withColumn("__range", F.when(F.col(id_col).isNull(), last).otherwise(range_of(F.col(id_col), cuts)))
    # a row for each range, of which there are as many as partitions
    heads = [(r["__range"], r["top"]) for r in placed.groupBy("__range").agg(F.max(id_col).alias("top")).orderBy("__range").collect()]
    before = {(heads[i][0], heads[i][1]): heads[i - 1][0] for i in range(len(heads))}
    head = F.array(*[F.struct(F.lit(k).alias("r"), F.lit(top).cast("bigint").alias("top"), F.lit(to).alias("to")) for (k, top), to in before.items()]) if before else F.array(F.struct(F.lit(0).alias("r"), F.lit(0).cast("bigint").alias("top"), F.lit(0).alias("to")))
    tops = {k: i for i, (k, _) in enumerate(before)}
    place = F.create_map(*[x for k, i in tops.items() for x in (F.lit(k), F.lit(i))]) if tops else F.create_map(F.lit(0), F.lit(0))
    mine = F.get(head, F.element_at(place, F.col("__range")))
    here = F.struct(F.col("__range").alias("at"), F.lit(False).alias("copy"))
    goes = F.when(F.col(id_col).eqNullSafe(mine["top"]), F.array(here, F.struct(mine["to"].alias("at"), F.lit(True).alias("copy")))).otherwise(F.array(here))
    dealt = placed.withColumn("__to", F.explode(goes)).select(id_col, "text", F.col("__to.at").alias("__range"), F.col("__to.copy").alias("copy"))
    return dealt.repartition(partitions(docs.sparkSession), "__range").sortWithinPartitions("__range", "copy", F.col(id_col).desc_nulls_last(), "text")


FIELDS = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, follower: str) -> str:
    """text, its last half (rounded down) replaced by as much of the start of follower as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FIELDS for each document, compared with its edited text and with the next document."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = with_next(rows, "id", 4 * partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next isn't there yet: range, copy, id, text, sketch
        for batch in chunks(batches, limit=CHUNK):
            ranges, copies, ids, texts = (batch.column(c).to_pylist() for c in ("__range", "copy", "id", "text"))
            own = sketches([t.encode() for t in texts])
            rows = list(zip(ranges, copies, ids, texts, own))
            if held is not None:
                rows.insert(0, held)
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            held = rows[-1]
            if pairs:
                yield made(pairs)

    def made(pairs) -> pa.RecordBatch:
        edited = [edit(a[3], b[3]) for a, b in pairs]
        mine, after = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs])
        changed = sketches([t.encode() for t in edited])
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array(edited, pa.string()), pa.array(map(written, mine), pa.string()), pa.array(map(written, changed), pa.string()), pa.array(likeness(mine, changed)), pa.array(likeness(mine, after))],
            names,
        )

    return ordered.mapInArrow(tidied(run), FIELDS)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    made = fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
