"""Exact top-k inner products over norm-sorted blocks.

Vectors are whole numbers. They are dealt into blocks in the order of descending length; a group of queries meets the blocks of a
slice in that order. A block is skipped for the queries whose k-th score so far the product of lengths can't reach (Cauchy-Schwarz). For
the others the coordinates after a rotation, taken from an SVD of a bounded sample so that the first ones hold most of the length, are
multiplied up to a first cut; the lengths of what lies behind the cut bound what is missing, and pairs that can't reach the k-th score
go. So do further pairs at further cuts. What survives is scored exactly, pair by pair where few do. A first bound for each query comes
from the longest blocks. Blocks hold the narrowest integers that their numbers fit, and a task holds one group of queries and a few
blocks, however many rows there are. The rotation and the bounds only decide what is skipped: results are exact.

How much that saves depends on the vectors: much where lengths differ or few directions hold most of the length, next to nothing where
all vectors are about as long and spread over all directions; a cut that leaves nearly all pairs is not tried again for that group.

Defined cases: null vectors and ids, and vectors holding a null, NaN or infinite component, take no part; vectors of unlike lengths
don't meet; a row is never a result of a query of its own id; rows with repeated ids are candidates of their own, and a repeated
query id asks once, with the least of its vectors; ties go to the smaller id; fewer candidates than k: all of them; an empty table gives an
empty one. A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.llm.common import cut, partitions, read

K = 20
SCALE = 64
#: Bytes of a block of candidates and of a group of queries, as 64-bit integers, and blocks of a slice at most and, where there are as many, at least.
BLOCK_BYTES, GROUP_BYTES, SLICE_BLOCKS, FEW_BLOCKS = 1 << 20, 8 << 20, 64, 4
#: Blocks from which a query's first bound comes; blocks of an Arrow batch, which the JVM and Python both hold.
HEADS, BATCH_BLOCKS = 8, 8
#: Queries of a group that meet a block at once.
ROWS = 1_024
#: Shares of the squared length before each cut; the share of pairs left beyond which a cut isn't tried again; below which pairs are scored one by one.
SHARES, USELESS, SPARSE = (0.3, 0.55, 0.8), 0.8, 0.25
#: Share of pairs left beyond which small numbers are multiplied as matrices, of whose products those pairs are taken: that costs less than to gather them.
ONE_BY_ONE = 0.01
#: Lengths of vectors up to which each length's longest blocks are broadcast.
MOST_DIMS = 8
SAMPLE_ROWS = 2_000
EXACT, EXACT_32 = float(1 << 53), float(1 << 24)
LEAST = np.iinfo(np.int64).min

PACKED = "name long, dim int, n int, top double, ids binary, vectors binary"


def unpacked(vectors: bytes, n: int, dim: int) -> np.ndarray:
    """n vectors of a block; the width of their numbers is told by the bytes."""
    return np.frombuffer(vectors, f"<i{len(vectors) // (n * dim)}" if n * dim else "<i8").reshape(n, dim)


def narrow(vectors: list[bytes]) -> bytes:
    """64-bit integers in as few bytes as all of them fit."""
    x = np.frombuffer(b"".join(vectors), "<i8")
    least, most = x.min(initial=0), x.max(initial=0)
    return x.astype(next(f"<i{w}" for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= least and most < 1 << 8 * w - 1)).tobytes()


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, dim, norm, vector): floor(scale * x) as packed 64-bit integers; rows that take no part are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                ids, dims, norms, packed = [], [], [], []
                for i, v in zip(part.column("id").to_pylist(), part.column("vector")):
                    x = np.floor(np.asarray(v.values, np.float64) * scale)
                    if np.abs(x).max(initial=0) >= 2.0**62:
                        raise OverflowError("a component is beyond 64 bits")
                    ids.append(i)
                    dims.append(len(x))
                    norms.append(float(np.sqrt((x * x).sum())) * (1 + 1e-12))
                    packed.append(x.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], ["id", "dim", "norm", "vector"])

    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine).mapInArrow(run, "id long, dim int, norm double, vector binary")


def packed(rows: DataFrame, name: str, size: int, parts: int) -> DataFrame:
    """PACKED blocks of rows by descending norm, of size bytes; a block holds one dim only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, ([], [])
        now, top = None, 0.0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([now], pa.int32()), pa.array([len(held[0])], pa.int32()), pa.array([top]), pa.array([np.array(held[0], "<i8").tobytes()]), pa.array([narrow(held[1])])], ["name", "dim", "n", "top", "ids", "vectors"])

        for batch in batches:
            for i, dim, norm, vector in zip(*[batch.column(c).to_pylist() for c in ("id", "dim", "norm", "vector")]):
                if held[0] and (dim != now or len(held[0]) * 8 * max(dim, 1) >= size):
                    yield block()
                    made, held = made + 1, ([], [])
                if not held[0]:
                    now, top = dim, norm
                held[0].append(i)
                held[1].append(vector)
        if held[0]:
            yield block()

    order = ["dim", F.desc("norm"), "id"]
    return cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, PACKED), name)


def rotation(sample: np.ndarray) -> tuple[np.ndarray, tuple[int, ...]]:
    """Columns by descending share of the sample's squared length, and the cuts."""
    _, lengths, turn = np.linalg.svd(sample, full_matrices=True)
    dim = sample.shape[1]
    held = np.cumsum(np.pad(lengths**2, (0, dim - len(lengths))))
    cuts = sorted({int(np.searchsorted(held, share * held[-1])) + 1 for share in SHARES} - {dim}) if held[-1] > 0 else []
    return turn.T, tuple(c for c in cuts if c < dim)


@dataclass
class Block:
    ids: np.ndarray
    exact: np.ndarray
    norms: np.ndarray
    turned: np.ndarray
    rests: list[np.ndarray]  # the length behind each cut

    @classmethod
    def of(cls, ids: bytes, vectors: bytes, dim: int, turn: tuple[np.ndarray, tuple[int, ...]] | None) -> Block:
        i = np.frombuffer(ids, "<i8")
        x = unpacked(vectors, len(i), dim)
        f = x.astype(np.float64)
        norms = np.sqrt((f * f).sum(axis=1)) * (1 + 1e-12)
        if turn is None or len(turn[0]) != dim:
            return cls(i, x, norms, f, [])
        turned = f @ turn[0]
        rests = [np.sqrt((turned[:, cut:] ** 2).sum(axis=1)) * (1 + 1e-6) + 1e-6 for cut in turn[1]]
        kind = np.float32 if norms.max(initial=0) ** 2 < EXACT_32 else np.float64  # meet_some() allows for what 32 bits lose
        return cls(i, x, norms, turned.astype(kind), [r.astype(kind) for r in rests])


def product(a: np.ndarray, b: np.ndarray, largest: float, counts: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and of b, where counts holds."""
    if largest < EXACT_32:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = np.where(counts, a.astype(object) @ b.astype(object).T, 0)
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def pair_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the rows i of a with the rows j of b."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 100_000):
        x, y = a[i[at : at + 100_000]], b[j[at : at + 100_000]]
        if largest < EXACT:
            kind = np.float32 if largest < EXACT_32 else np.int64
            out[at : at + 100_000] = np.einsum("ij,ij->i", x.astype(kind), y.astype(kind))
        else:
            exact = (x.astype(object) * y.astype(object)).sum(axis=1)
            if len(exact) and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
                raise OverflowError("a score is beyond 64 bits")
            out[at : at + 100_000] = exact.astype(np.int64)
    return out


class Best:
    """The best k of each query so far."""

    def __init__(self, queries: Block, bound: np.ndarray, k: int, cuts: tuple[int, ...] = ()):
        self.queries, self.bound, self.k, self.cuts = queries, bound.copy(), k, cuts
        self.scores = np.full((len(queries.ids), k), LEAST)  # LEAST: no score yet
        self.ids = np.full((len(queries.ids), k), np.iinfo(np.int64).max)
        self.useful = [True] * len(cuts)
        self.pairs = self.scored = 0

    def meet(self, c: Block) -> None:
        for low in range(0, len(self.queries.ids), ROWS):
            self.meet_some(np.arange(low, min(low + ROWS, len(self.queries.ids))), c)

    def meet_some(self, live: np.ndarray, c: Block) -> None:
        q = self.queries
        self.pairs += len(live) * len(c.ids)
        bound = np.where(self.bound[live] == LEAST, -np.inf, self.bound[live].astype(np.float64))
        bound -= 1e-9 * np.abs(np.where(np.isinf(bound), 0, bound)) + 1e-6
        near = q.norms[live] * c.norms.max(initial=0) >= bound
        live, bound = live[near], bound[near]
        columns = np.flatnonzero(c.norms * q.norms[live].max(initial=0) >= bound.min(initial=np.inf))
        if not len(live) or not len(columns):
            return
        part, begin, maybe = 0.0, 0, None
        slack = (q.turned.shape[1] + 16) * 1.2e-7 if np.float32 in (q.turned.dtype, c.turned.dtype) else 1e-9
        norms = c.norms.astype(c.turned.dtype)
        least, own = bound.astype(q.turned.dtype)[:, None], (slack * q.norms[live]).astype(q.turned.dtype)
        for n, cut in enumerate(self.cuts):
            if not self.useful[n]:
                continue
            part = part + q.turned[live, begin:cut] @ c.turned[columns, begin:cut].T
            begin = cut
            reach = q.rests[n][live, None] * c.rests[n][columns]
            reach += own[:, None] * norms[columns]
            reach += part
            maybe = reach >= least
            left = float(maybe.mean())
            self.useful[n] = left <= USELESS or np.isinf(least).any()
            rows, some = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if not len(rows):
                return
            if len(rows) < len(live) or len(some) < len(columns):
                live, least, own, columns, part, maybe = live[rows], least[rows], own[rows], columns[some], part[np.ix_(rows, some)], maybe[np.ix_(rows, some)]
            if left < SPARSE:
                break
        ids = c.ids[columns]
        largest = float(q.norms[live].max() * c.norms[columns].max())
        if maybe is not None and maybe.mean() < SPARSE:
            i, j = np.nonzero(maybe & (ids != q.ids[live, None]))
            self.scored += len(i)
            if largest < EXACT_32 and len(i) > ONE_BY_ONE * maybe.size:
                scores = product(q.exact[live], c.exact[columns], largest, maybe)[i, j]
            else:
                scores = pair_products(q.exact, live[i], c.exact, columns[j], largest)
            good = scores >= self.bound[live[i]]
            i, j, scores = i[good], j[good], scores[good]
            self.add(live[i], scores, ids[j])
            return
        counts = ids != q.ids[live, None]
        self.scored += len(live) * len(columns)
        scores = product(q.exact[live], c.exact[columns], largest, counts)
        least = self.bound[live, None]
        if len(columns) > 4 * self.k:  # of ever so many beyond the bound, k and their ties matter
            least = np.maximum(least, np.partition(np.where(counts, scores, LEAST), len(columns) - self.k, axis=1)[:, len(columns) - self.k, None])
        good = (scores >= least) & counts
        i, j = np.nonzero(good)
        self.add(live[i], scores[i, j], ids[j])

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries at, which ascend."""
        rows, at = np.unique(at, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        s, i = np.concatenate([self.scores[rows].ravel(), scores]), np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((i, ~s, of))  # ~s falls as s grows, without an overflow
        of = of[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, np.arange(len(rows)))[of] < self.k]
        self.scores[rows], self.ids[rows] = s[order].reshape(-1, self.k), i[order].reshape(-1, self.k)
        self.bound[rows] = np.maximum(self.bound[rows], self.scores[rows, -1])

    def rows(self) -> pa.RecordBatch:
        there = self.scores != LEAST
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.queries.ids, there.sum(axis=1))), pa.array(self.ids[there]), pa.array(self.scores[there])], ["query_id", "vec_id", "score"])


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Inside, an Arrow batch has BATCH_BLOCKS rows at most: rows are blocks, and Spark would put 10,000 of them into one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search(rows: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that queries picks."""
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    blocks = packed(quantised(plain.select("id", "vector"), scale), "candidates", BLOCK_BYTES, partitions(spark))
    one = F.min(F.struct("dim", "norm", "vector")).alias("v")
    single = cut(quantised(plain.where("asks").select("id", "vector"), scale).groupBy("id").agg(one).select("id", "v.*"), "asked")
    size = single.agg(F.sum(F.octet_length("vector"))).first()[0] or 0
    asked = packed(single, "queries", GROUP_BYTES, size // GROUP_BYTES + 1)

    sizes = blocks.groupBy("dim").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    main = sizes.orderBy(F.desc("n"), "dim").first()
    if main is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = main.dim
    share = max(1, main.n // SAMPLE_ROWS)

    # about SAMPLE_ROWS rows of the commonest dim, evenly from all blocks
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, v in zip(*[batch.column(c).to_pylist() for c in ("name", "n", "vectors")]):
                some = unpacked(v, n, dim)[name % share :: share].astype("<i8")
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()])], ["vectors"])

    turn = None
    if dim:
        with few_rows(spark):
            got = blocks.where(F.col("dim") == dim).select("name", "n", "vectors").mapInArrow(thin, "vectors binary").limit(SAMPLE_ROWS).toArrow().column("vectors").to_pylist()
        turn = rotation(np.concatenate([np.frombuffer(v, "<i8").reshape(-1, dim) for v in got]).astype(np.float64)[: 2 * SAMPLE_ROWS]) if got else None
    shipped = spark.sparkContext.broadcast(turn)  # dim * dim numbers
    near_all = sizes.count() <= MOST_DIMS

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                best = Best(Block.of(r["ids"], r["vectors"], r["dim"], None), np.full(r["n"], LEAST), k)
                for c in r["heads"] or ():
                    best.meet(Block.of(c["ids"], c["vectors"], r["dim"], None))
                with np.errstate(divide="ignore", invalid="ignore"):
                    needs = np.where(best.bound == LEAST, -np.inf, best.bound / np.maximum(best.queries.norms, 1e-9))
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]]), pa.array([r["dim"]], pa.int32()), pa.array([r["ids"]]), pa.array([r["vectors"]]), pa.array([best.bound.astype("<i8").tobytes()]), pa.array([float(needs.min()) * (1 - 1e-9) - 1e-6])], ["name", "dim", "ids", "vectors", "bounds", "needs"])

    longest = blocks.select("dim", "name", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("top"), "name")).alias("place")).where(F.col("place") <= HEADS).select("name")
    heads = blocks.join(F.broadcast(longest) if near_all else longest, "name", "left_semi").groupBy("dim").agg(F.collect_list(F.struct("ids", "vectors")).alias("heads"))
    with few_rows(spark):
        bounded = cut(asked.join(F.broadcast(heads) if near_all else heads, "dim", "left").mapInArrow(first_bound, "name long, dim int, ids binary, vectors binary, bounds binary, needs double"), "bounds")
    groups = max(1, bounded.count())
    slices = max(1, -(-main.blocks // SLICE_BLOCKS), min(-(-main.blocks // FEW_BLOCKS), -(-2 * partitions(spark) // groups)))

    none = F.lit(None).cast("binary")
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    openers = bounded.select("name", each, F.lit(float("-inf")).alias("order"), "dim", "ids", "vectors", "bounds")
    wanted = bounded.select("name", each, "dim", "needs")
    dealt = blocks.select(F.pmod(F.xxhash64("name"), F.lit(slices)).cast("int").alias("slice"), "dim", "top", "ids", "vectors")
    met = wanted.join(dealt, ["dim", "slice"]).where(F.col("top") >= F.col("needs")).select("name", "slice", (-F.col("top")).alias("order"), "dim", "ids", "vectors", none.alias("bounds"))
    stream = openers.unionByName(met).repartition(partitions(spark), "name", "slice").sortWithinPartitions("name", "slice", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, turn_of = None, shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                block = Block.of(r["ids"], r["vectors"], r["dim"], turn_of)
                if r["bounds"] is not None:
                    if best is not None:
                        yield best.rows()
                    best = Best(block, np.frombuffer(r["bounds"], "<i8"), k, turn_of[1] if turn_of is not None and len(turn_of[0]) == r["dim"] else ())
                else:
                    best.meet(block)
        if best is not None:
            yield best.rows()

    with few_rows(spark):
        found = cut(stream.mapInArrow(run, "query_id long, vec_id long, score long"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
