import numpy as np
import pytest
from pyspark.sql import functions as F

from shapewright.llm import topk


def brute(rows, k=20, every=20):
    ok = [(i, np.floor(np.array(v, float) * 64).astype(object)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    asked = {}
    for i, v in ok:
        if i % every == 0 and (i not in asked or (len(v), sum(v * v), v.astype("<i8").tobytes()) < asked[i][1]):
            asked[i] = (v, (len(v), sum(v * v), v.astype("<i8").tobytes()))
    out = set()
    for i, (v, _) in asked.items():
        scored = sorted((-int(sum(v * w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    return [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, **more).collect()]


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("block", [200, 4000, 1 << 20])
@pytest.mark.parametrize("skew", [0.0, 1.5])
def test_against_brute_force(spark, monkeypatch, block, skew):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)) * rng.lognormal(0, skew, (400, 1)) * np.geomspace(4, 0.1, 8)
    rows = as_floats([(i, list(v)) for i, v in enumerate(x)])
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [0.0, 0.0]), (140, [1.0, 2.0, 3.0]), (160, []), (180, [-1.0, -2.0])]
    rows += [(i, [1.0, 2.0]) for i in range(1, 15)] + [(3, [1.0, 2.0]), (20, [1.0, 2.0]), (None, [1.0, 1.0]), (7, [9.5, -0.01])]
    got = run(spark, rows)
    want = brute(rows)
    # equal rows of one id tie in every way
    assert sorted(got) == sorted(want | set(got)) and {(q, r, s) for q, r, _, s in got} == {(q, r, s) for q, r, _, s in want}
    assert all(v is not None for row in got for v in row)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(20, [1.0])]) == []


def test_ties_go_to_smaller_ids_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64)
    rows = [(i, [1.0, 0.0]) for i in range(100)]
    got = sorted(r for r in run(spark, rows, k=5) if r[0] == 20)
    assert [r[2] for r in got] == [0, 1, 2, 3, 4]


def test_large_numbers_are_exact(spark):
    rows = [(20, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 2.0]), (3, [1.0, 2.0**9])]
    assert set(run(spark, rows)) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(20, [2.0**50]), (1, [2.0**50])])


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in topk.op6(spark, sf).collect()} == brute(rows)


def shares(x, block=256, k=20):
    """The share of pairs that are scored exactly, of the vectors of x by descending length, every 20th asking; results against all products."""
    v = np.floor(x * 64).astype(np.int64)
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    turn = topk.rotation(v[::4].astype(float))
    ids = np.arange(len(v))
    of = lambda at: topk.Block.of(ids[at].astype("<i8").tobytes(), v[at].astype("<i8").tobytes(), v.shape[1], turn)
    asked = ids[ids % 20 == 0]
    best = topk.Best(of(asked), np.full(len(asked), topk.LEAST), k, turn[1])
    for at in range(0, len(v), block):
        best.meet(of(ids[at : at + block]))
    whole = v[asked] @ v.T
    for n, q in enumerate(asked):
        whole[n, q] = topk.LEAST + 1
        order = np.lexsort((ids, -whole[n]))[:k]
        assert best.ids[n].tolist() == order.tolist() and best.scores[n].tolist() == whole[n, order].tolist()
    return best.scored / (len(asked) * len(v))


def test_bounds_prune_where_lengths_or_directions_differ():
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(4000, 32))
    flat /= np.linalg.norm(flat, axis=1)[:, None]
    assert shares(flat * rng.lognormal(0, 1.5, (4000, 1))) < 0.25
    assert shares(rng.normal(size=(4000, 32)) * np.geomspace(3, 0.03, 32)) < 0.35
    centres = rng.normal(size=(40, 32))
    assert shares(centres[rng.integers(0, 40, 4000)] + 0.1 * flat) < 0.9
    assert shares(flat) < 0.5 < shares(flat[:300], block=300)  # where all are alike, only the last cut tells, once bounds have grown


@pytest.mark.parametrize("sparse", [0.0, 1.1])
def test_both_ways_of_scoring(monkeypatch, sparse):
    monkeypatch.setattr(topk, "SPARSE", sparse)
    rng = np.random.default_rng(6)
    shares(rng.normal(size=(700, 6)) * rng.lognormal(0, 1, (700, 1)), block=64)


def test_blocks_are_as_narrow_as_their_numbers():
    for value, width in ((127, 1), (-128, 1), (128, 2), (-32769, 4), (2**31, 8), (-(2**63), 8)):
        v = np.array([[value, 1], [0, -1]], "<i8")
        packed = topk.narrow([row.tobytes() for row in v])
        assert len(packed) == 4 * width and topk.unpacked(packed, 2, 2).tolist() == v.tolist()
    assert topk.narrow([b"", b""]) == b"" and topk.unpacked(b"", 2, 0).shape == (2, 0)


def test_a_task_holds_a_few_blocks(spark, monkeypatch):
    """What a task is sent at once is bounded by blocks, and a group of queries by bytes, not by the table."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 256)
    monkeypatch.setattr(topk, "GROUP_BYTES", 512)
    rows = as_floats([(i, list(v)) for i, v in enumerate(np.random.default_rng(8).normal(size=(600, 4)))])
    df = spark.createDataFrame([(i, np.array(v).astype("<i8").tobytes(), 4, 1.0) for i, v in rows], "id long, vector binary, dim int, norm double")
    blocks = topk.packed(df, "blocks", topk.BLOCK_BYTES, 1)

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    with topk.few_rows(spark):
        sent = [r.n for r in blocks.coalesce(1).mapInArrow(counted, "n long").collect()]
    assert max(sent) <= topk.BATCH_BLOCKS < sum(sent) == blocks.count()
    assert blocks.selectExpr("max(octet_length(vectors) / n)").first()[0] == 4  # a byte a number
    assert set(run(spark, rows)) == brute(rows)
