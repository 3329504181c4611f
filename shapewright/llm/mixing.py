"""Mixing sources to target weights with a Pfair schedule (DataFrame functions only).

Each source is a stream of blocks of block_rows rows. A stream with q parts of Q in total gives its block j the window from
floor(j*Q/q) to ceil((j+1)*Q/q); at each slot the earliest deadline among the released blocks runs. At every multiple of Q
slots all streams have exactly their share, so the schedule repeats: one period of Q slots, planned from the parameters alone,
places every block by arithmetic. When a stream runs out, the others go on by their parts in a new phase. In every phase no
stream is ever a whole block ahead of or behind its share.

Defined cases: a null or unnamed source joins the stream "other"; repeated rows each have a place of their own; texts are never
looked at; an empty table gives an empty table; own columns of the input stay, added columns have the names in ADDED, and input
columns of those names are replaced.
"""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.llm.common import literal_table, partitions, read

#: Parts of a thousand: the source with a third of the rows is held to 16 %, the rest fall off evenly.
PARTS = {"src0": 160} | {f"src{i}": 84 - 4 * i for i in range(1, 20)}
OTHER_PARTS = 4
BLOCK_ROWS = 16
#: Rows to a bucket, at most about so many on average; buckets only bound the size of a sort.
BUCKET_ROWS = 50_000
MAX_STREAMS, MAX_PARTS = 512, 20_000
ADDED = ("mix_stream", "mix_phase", "mix_block", "mix_slot", "mix_offset")


def period(parts: dict[int, int]) -> dict[int, list[int]]:
    """The slots of each stream's blocks in one period: earliest deadline first among released blocks."""
    total = sum(parts.values())
    waiting = [(0, k, 0) for k in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out: dict[int, list[int]] = {k: [] for k in parts}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), k, j))
        _, k, j = heapq.heappop(ready)
        out[k].append(t)
        if j + 1 < parts[k]:
            heapq.heappush(waiting, ((j + 1) * total // parts[k], k, j + 1))
    return out


def phases(parts: dict[int, int], blocks: dict[int, int]) -> list[dict]:
    """Rows (stream, phase, first, last, base, q, total, slots): blocks first..last-1 of the stream run in the phase."""
    done = dict.fromkeys(blocks, 0)
    active = {k: parts[k] for k, n in blocks.items() if n > 0}
    rows, base, number = [], 0, 0
    while active:
        slots, total = period(active), sum(active.values())
        place = lambda k, j: j // active[k] * total + slots[k][j % active[k]]
        length = min(place(k, blocks[k] - done[k] - 1) for k in active) + 1
        for k, q in active.items():
            whole, rest = divmod(length, total)
            ran = whole * q + sum(s < rest for s in slots[k])
            if ran:
                rows.append({"stream": k, "phase": number, "first": done[k], "last": done[k] + ran, "base": base, "q": q, "total": total, "slots": slots[k]})
            done[k] += ran
        base, number = base + length, number + 1
        active = {k: q for k, q in active.items() if done[k] < blocks[k]}
    return rows


def mix(docs: DataFrame, parts: dict[str, int], other_parts: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", seed: int = 0) -> DataFrame:
    """docs with its place in the mixture: order by (mix_slot, mix_offset). Blocks are filled in an order dealt by a hash of the id."""
    if not 0 < len(parts) <= MAX_STREAMS or min(*parts.values(), other_parts) < 1 or sum(parts.values()) + other_parts > MAX_PARTS:
        raise ValueError(f"parts: 1 to {MAX_STREAMS} sources with whole parts of 1 or more, {MAX_PARTS} in total")
    spark, names = docs.sparkSession, sorted(parts)
    shares = {i: parts[s] for i, s in enumerate(names)} | {len(names): other_parts}
    own = [c for c in docs.columns if c not in ADDED]
    number = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    stream = F.coalesce(F.try_element_at(number, F.coalesce(F.col(source_col).cast("string"), F.lit(""))), F.lit(len(names)))
    keyed = docs.select(*own, stream.alias("__stream"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("__deal"))
    rows = {r["__stream"]: r["n"] for r in keyed.groupBy("__stream").agg(F.count("*").alias("n")).collect()}  # one row for each stream: MAX_STREAMS + 1 at most
    total = sum(rows.values())
    bits = max(1, math.ceil(math.log2(max(4 * partitions(spark), total / BUCKET_ROWS))))
    keyed = keyed.withColumn("__bucket", F.shiftrightunsigned("__deal", 64 - bits))
    before = Window.partitionBy("__stream").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("__stream", "__bucket").agg(F.count("*").alias("__n")).select("__stream", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # rows that tie in all that can be hashed may change places: a task that runs again deals them as it did before
    plain = [f.name for f in docs.schema.fields if f.name in own and not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    inside = Window.partitionBy("__stream", "__bucket").orderBy("__deal", id_col, F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain))
    ranked = keyed.withColumn("__at", F.row_number().over(inside) - 1).join(starts, ["__stream", "__bucket"]).withColumn("__rank", F.col("__start") + F.col("__at"))
    ranked = ranked.withColumn("__block", F.expr(f"__rank div {block_rows}"))
    plan = phases(shares, {k: -(-n // block_rows) for k, n in rows.items()})
    table = literal_table(spark, plan, "stream int, phase int, first bigint, last bigint, base bigint, q bigint, total bigint, slots array<int>")
    table = table.select(*[F.col(c).alias(f"__p_{c}") for c in table.columns])
    # at most (MAX_STREAMS + 1)^2 rows holding MAX_PARTS slots a phase: bounded by the parameters, whatever the data
    placed = ranked.join(F.broadcast(table), (F.col("__stream") == F.col("__p_stream")) & (F.col("__block") >= F.col("__p_first")) & (F.col("__block") < F.col("__p_last")))
    j = F.col("__block") - F.col("__p_first")
    slot = F.col("__p_base") + F.expr("(__block - __p_first) div __p_q") * F.col("__p_total") + F.element_at("__p_slots", (j % F.col("__p_q") + 1).cast("int"))
    labels = F.array(*[F.lit(s) for s in names], F.lit("other"))
    return placed.select(*own, F.element_at(labels, F.col("__stream") + 1).alias("mix_stream"), F.col("__p_phase").alias("mix_phase"), F.col("__block").alias("mix_block"), slot.alias("mix_slot"), (F.col("__rank") % block_rows).cast("int").alias("mix_offset"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows dealt over partitions, and so over files, in the order of the mixture."""
    n = partitions(mixed.sparkSession)
    return mixed.repartitionByRange(n, "mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")


def written(docs: DataFrame) -> DataFrame:
    """docs, which are read from the files of in_order's rows, with mix_place: 0 for the first row of the mixture, then 1, 2, 3.

    A scan deals large files first, so the place is the row's number in its file and the rows of the files before."""
    spark, name = docs.sparkSession, F.col("_metadata.file_path")
    sizes = {r["f"]: r["n"] for r in docs.groupBy(name.alias("f")).agg(F.count("*").alias("n")).collect()}  # a row for each file, of which there are as many as partitions
    start, table = 0, []
    for f in sorted(sizes, key=lambda f: [int(x) if k % 2 else x for k, x in enumerate(re.split(r"([0-9]+)", f))]):
        table.append({"__f": f, "__start": start})
        start += sizes[f]
    own = [c for c in docs.columns if c != "mix_place"]
    rows = docs.select(*own, name.alias("__f"), F.col("_metadata.row_index").alias("__row"))
    starts = literal_table(spark, table, "__f string, __start bigint")
    return rows.join(F.broadcast(starts), "__f").select(*own, (F.col("__start") + F.col("__row")).alias("mix_place"))


def by_place(placed: DataFrame) -> DataFrame:
    """The rows dealt over partitions in the order of mix_place."""
    return placed.repartitionByRange(partitions(placed.sparkSession), "mix_place").sortWithinPartitions("mix_place")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, PARTS, OTHER_PARTS)
