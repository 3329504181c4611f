"""Sharding along a Hilbert curve (DataFrame functions only).

Each row's metadata are quantised to BITS bits a dimension; the index of that cell on the Hilbert curve orders the rows, and equal
runs of that order are the shards, so that a shard's rows lie close together in every dimension and a reader can skip shards by
their bounds. Cells on the curve follow from a table of states (entry corner, direction) that is built by rule.

Law "rows": the shards' counts differ by one at most. Equal texts with equal metadata lie side by side.
Defined cases: a null text has size 1 and the checksum of the empty text; null metadata count as the least value; ties go by text
checksum, then doc_id, then size; repeated rows are rows; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.llm.common import cut, partitions, read

SHARDS = 8
BITS = 8


def steps(n: int) -> tuple[list[int], int]:
    """For each state and each choice of halves: the next state and the place on the curve, as state * 2^n + place.

    A state is an entry corner and a direction; places follow the reflected Gray code, turned and flipped by the state."""
    size, full = 1 << n, (1 << n) - 1
    turn = lambda x, k: (x << k % n | x >> (n - k % n)) & full
    gray = lambda x: x ^ x >> 1
    place_of = {gray(i): i for i in range(size)}
    ones = lambda x: ((x + 1) & ~x).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    across = lambda w: 0 if w == 0 else ones(w if w % 2 else w - 1) % n
    out = []
    for corner in range(size):
        for d in range(n):
            for halves in range(size):
                w = place_of[turn(halves ^ corner, n - (d + 1) % n)]
                new_corner, new_d = corner ^ turn(entry(w), d + 1), (d + across(w) + 1) % n
                out.append((new_corner * n + new_d) * size + w)
    return out, size


def hilbert(dims: list[Column], bits: int = BITS) -> Column:
    """The index on the curve of whole numbers from 0 to 2^bits - 1."""
    table, size = steps(len(dims))
    n = len(dims)
    look = F.array(*[F.lit(x) for x in table])

    def step(acc: Column, level: Column) -> Column:
        halves = reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.call_function("shiftright", d.cast("int"), level).bitwiseAND(F.lit(1)), F.lit(i)) for i, d in enumerate(dims)])
        found = F.get(look, acc["state"] * size + halves)
        return F.struct(F.floor(found / size).cast("int").alias("state"), (F.call_function("shiftleft", acc["at"], F.lit(n)) + found % size).alias("at"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("at"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["at"])


def linear(c: Column, low: float, high: float, bits: int = BITS) -> Column:
    top = (1 << bits) - 1
    width = (high - low) or 1
    return F.coalesce(F.least(F.lit(top), F.greatest(F.lit(0), F.floor((c - F.lit(low)) / F.lit(width) * (top + 1)))), F.lit(0)).cast("int")


def coded(c: Column, bits: int = BITS) -> Column:
    """Equal values share a code; order has no meaning for such a dimension."""
    return F.when(c.isNull(), 0).otherwise(F.crc32(c.cast("binary")) % (1 << bits)).cast("int")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with __pos, 0 to count - 1 by order: range partitions are sorted and written once, then each adds the counts before it.

    No task sees more than its own range; ties in order may fall either way, so order should end in a key."""
    n = partitions(rows.sparkSession)
    ordered = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), name)
    part, at = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))  # as many rows as partitions
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ordered.join(F.broadcast(starts), "__part").withColumn("__pos", F.col("__start") + at).drop("__part", "__start", "__id")


def shard(rows: DataFrame, dims: list[Column], shards: int, ties: list[str], name: str = "shards", bits: int = BITS) -> DataFrame:
    """rows with curve, shard and slot."""
    own = [c for c in rows.columns if c not in ("curve", "shard", "slot")]
    placed = numbered(rows.select(*own, hilbert(dims, bits).alias("curve")), ["curve", *ties], name)
    total = placed.count()
    low, over = divmod(total, shards)
    # the first shards, as many as are over, hold one row more
    edge = over * (low + 1)
    k = F.expr(f"CAST(IF(__pos < {edge}, __pos div {low + 1}, {over} + (__pos - {edge}) div {max(low, 1)}) AS INT)")
    first = F.col("shard") * low + F.least(F.col("shard"), F.lit(over))
    return placed.withColumn("shard", k).withColumn("slot", (F.col("__pos") - first).cast("bigint")).drop("__pos")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law "rows"), curve."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), coded(F.col("source")).alias("__source"), coded(F.col("lang")).alias("__lang"))
    size = linear(F.log2("size"), 0, 32)
    made = shard(docs, [size, F.col("__source"), F.col("__lang")], SHARDS, ["text_crc32", "doc_id", "size"], "op4")
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
