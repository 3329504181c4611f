import math
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from shapewright.llm import sharding


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 1)])
def test_neighbours_on_the_curve_touch(spark, n, bits):
    cells = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    got = sorted((r[-1], tuple(r[:-1])) for r in df.withColumn("h", sharding.hilbert([F.col(f"c{i}") for i in range(n)], bits)).collect())
    assert [h for h, _ in got] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(got, got[1:]))


@pytest.mark.parametrize("rows", [0, 5, 8, 83])
def test_counts_differ_by_one_and_slots_have_no_gap(spark, tmp_path, rows):
    text = lambda i: None if i % 7 == 0 else "same" if i % 3 else "é" * i
    data = [(i, text(i), None if i % 5 == 0 else "de", f"s{i % 4}", i) for i in range(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, shard long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op4(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    counts = Counter(r.shard for r in got)
    sizes = [counts[k] for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(8))
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert all(r.size == len((text(r.doc_id) or "").encode()) + 1 and r.grown_shard is None and r.law == "rows" for r in got)


def test_a_shard_spans_few_cells(spark):
    df = spark.range(4096).selectExpr("id % 64 AS x", "id div 64 AS y")
    got = sharding.shard(df, [F.col("x").cast("int"), F.col("y").cast("int")], 16, ["x", "y"], bits=6)
    spans = got.groupBy("shard").agg(((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("area")).collect()
    assert [r.area for r in spans] == [256] * 16


def on_the_curve(point, bits):
    """The index of a point by walking the curve: each level's orthant, seen from where the curve enters and leaves, has its place in the Gray code."""
    n, h, entry, direction = len(point), 0, 0, 0
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & ((1 << n) - 1)
    for level in range(bits - 1, -1, -1):
        orthant = sum((p >> level & 1) << i for i, p in enumerate(point)) ^ entry
        orthant = left(orthant, n - (direction + 1) % n)
        place = next(i for i in range(1 << n) if i ^ i >> 1 == orthant)
        h = h << n | place
        into = 0 if place == 0 else (2 * ((place - 1) // 2)) ^ (2 * ((place - 1) // 2)) >> 1
        odd = 0 if place == 0 else place if place % 2 else place - 1
        turns = 0 if place == 0 else next(i for i in range(n + 2) if not odd >> i & 1) % n
        entry, direction = entry ^ left(into, direction + 1), (direction + turns + 1) % n
    return h


def brute(rows, shards=8):
    """{(doc_id, size, crc): (shard, slot, curve)} of rows (doc_id, text, lang, source)."""
    code = lambda v: 0 if v is None else zlib.crc32(v.encode()) % 256
    placed = []
    for doc, text, lang, source in rows:
        data = (text or "").encode()
        size = min(255, max(0, math.floor(math.log2(len(data) + 1) / 32 * 256)))
        placed.append((on_the_curve((size, code(source), code(lang)), 8), zlib.crc32(data), (doc is not None, doc), len(data) + 1))
    placed.sort()
    low, over = divmod(len(placed), shards)
    out, at = [], 0
    for k in range(shards):
        for slot in range(low + (k < over)):
            curve, crc, doc, size = placed[at]
            out.append((doc[1], size, crc, k, slot, curve))
            at += 1
    return out


def test_query_against_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    rows += [rows[3], rows[3], (rows[4][0], "other", None, None), (None, None, "en", "src0"), (None, "x", None, None), (10**12, "long " * 400_000, "en", "src1"), (10**12 + 1, rows[5][1], rows[5][2], rows[5][3])]
    spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, curve string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.curve) for r in sharding.op4(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_plan_runs_no_python(spark):
    sf = "/root/testdata/sf0.001"
    plan = sharding.op4(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_runs_prune(spark):
    """Shards' bounds leave out most shards for a query on one source, on sizes, or on both."""
    made = sharding.op4(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    sources = made.groupBy("shard").agg(F.collect_set("source").alias("s"), F.min("size").alias("low"), F.max("size").alias("high")).collect()
    rare = [s for s in {x for r in sources for x in r.s} if s != "src0"]
    assert sum(s in r.s for s in rare for r in sources) < 0.6 * len(rare) * 8
