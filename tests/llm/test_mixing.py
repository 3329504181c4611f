import struct
from collections import Counter, defaultdict

import xxhash

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from shapewright.llm import mixing


def lag_is_under_one(slots: dict[int, list[int]], parts: dict[int, int]):
    total = sum(parts.values())
    at = {t: k for k, ts in slots.items() for t in ts}
    assert sorted(at) == list(range(total))
    ran = Counter()
    for t in range(total):
        ran[at[t]] += 1
        for k, q in parts.items():
            assert abs(ran[k] * total - q * (t + 1)) < total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_period_deviates_by_less_than_a_block(shares):
    parts = dict(enumerate(shares))
    lag_is_under_one(mixing.period(parts), parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 30)), min_size=1, max_size=6))
def test_phases_place_every_block_once_and_keep_the_shares(streams):
    parts = {i: q for i, (q, _) in enumerate(streams)}
    blocks = {i: n for i, (_, n) in enumerate(streams)}
    placed, by_phase = {}, defaultdict(dict)
    for r in mixing.phases(parts, blocks):
        for b in range(r["first"], r["last"]):
            j = b - r["first"]
            slot = r["base"] + j // r["q"] * r["total"] + r["slots"][j % r["q"]]
            assert slot not in placed
            placed[slot] = r["stream"]
            by_phase[r["phase"]][slot] = r["stream"]
    assert sorted(placed) == list(range(sum(blocks.values())))
    assert Counter(placed.values()) == Counter({k: n for k, n in blocks.items() if n})
    done = Counter()
    for slots in by_phase.values():
        active = {k: parts[k] for k in parts if done[k] < blocks[k]}
        total, ran = sum(active.values()), Counter()
        for n, t in enumerate(sorted(slots), 1):
            ran[slots[t]] += 1
            assert all(abs(ran[k] * total - q * n) < total for k, q in active.items())
        done += ran


def test_mix_keeps_every_row_with_nulls_repeats_and_clashing_names(spark):
    rows = [(i, "t", ["a", "a", "b", None, "z"][i % 5], i) for i in range(200)] + [(1, "t", "a", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot long").withColumn("block", F.lit(1))
    out = mixing.mix(docs, {"a": 3, "b": 1}, 2, block_rows=4)
    got = out.collect()
    assert len(got) == 202 and "block" in out.columns
    assert len({(r.mix_slot, r.mix_offset) for r in got}) == 202
    assert {r.mix_stream for r in got} == {"a", "b", "other"}
    streams = {(r.mix_slot): r.mix_stream for r in got}
    first = [streams[t] for t in range(6)]
    assert Counter(first) == {"a": 3, "b": 1, "other": 2}
    assert [r.mix_slot for r in mixing.in_order(out).collect()] == sorted(r.mix_slot for r in got)


def test_mix_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(docs, {"a": 1}).collect() == []


def test_plan_runs_no_python(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('src', id % 3) AS source")
    plan = mixing.mix(docs, mixing.PARTS, mixing.OTHER_PARTS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute(rows, parts, other, size):
    """{doc_id: (stream, phase, block, slot, offset)}: slot by slot, the released block with the earliest deadline runs."""
    names = sorted(parts)
    shares = {i: parts[s] for i, s in enumerate(names)} | {len(names): other}
    dealt = lambda d: xxhash.xxh64_intdigest(struct.pack("<q", d), seed=xxhash.xxh64_intdigest(struct.pack("<i", 0), seed=42))
    streams = {k: sorted((dealt(d), d) for d, s in rows if (names.index(s) if s in parts else len(names)) == k) for k in shares}
    blocks = {k: -(-len(r) // size) for k, r in streams.items()}
    done, slot, phase, out = dict.fromkeys(shares, 0), 0, 0, {}
    while any(done[k] < blocks[k] for k in shares):
        active = {k: q for k, q in shares.items() if done[k] < blocks[k]}
        total, ran, t = sum(active.values()), dict.fromkeys(active, 0), 0
        while all(done[k] < blocks[k] for k in active):
            ready = [(-(-(ran[k] % q + 1) * total // q) + ran[k] // q * total, k) for k, q in active.items() if ran[k] // q * total + ran[k] % q * total // q <= t]
            k = min(ready)[1]
            for offset, (_, d) in enumerate(streams[k][done[k] * size : (done[k] + 1) * size]):
                out[d] = ((names + ["other"])[k], phase, done[k], slot, offset)
            done[k], ran[k], slot, t = done[k] + 1, ran[k] + 1, slot + 1, t + 1
        phase += 1
    return out


def test_mix_against_a_simulation(spark):
    rows = [(i * 7 - 300, ["a", "a", "a", "b", None, "z", "c"][i % 7]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = {r.doc_id: (r.mix_stream, r.mix_phase, r.mix_block, r.mix_slot, r.mix_offset) for r in mixing.mix(docs, {"a": 7, "b": 2, "c": 4}, 3, block_rows=5).collect()}
    assert got == brute(rows, {"a": 7, "b": 2, "c": 4}, 3, 5)


def test_query_against_a_simulation(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()]
    got = {r.doc_id: (r.mix_stream, r.mix_phase, r.mix_block, r.mix_slot, r.mix_offset) for r in mixing.op1(spark, sf).collect()}
    assert got == brute(rows, mixing.PARTS, mixing.OTHER_PARTS, mixing.BLOCK_ROWS)


def test_rows_that_tie_have_places_of_their_own(spark):
    rows = [(1, f"t{i}", "a") for i in range(40)] + [(None, f"t{i}", "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.text, r.mix_slot, r.mix_offset) for r in mixing.mix(docs.repartition(n), {"a": 1}, block_rows=4).collect()) for n in (1, 6))
    assert one == two and len(set(one)) == 80
