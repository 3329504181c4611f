import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapewright.llm import neardup
from shapewright.llm.components import components
from shapewright.llm.textkernel import Words, chunks, mix64, places, shingles

SPACE = " \t\n\x0b\x0c\r"


def split(text: str, lower=True) -> list[str]:
    words, now = [], ""
    for c in text + " ":
        if c in SPACE:
            if now:
                words.append("".join(chr(ord(x) + 32) if lower and "A" <= x <= "Z" else x for x in now))
            now = ""
        else:
            now += c
    return words


def sets_of(texts, width=4):
    out = []
    for t in texts:
        w = split(t or "")
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute(rows, like=80):
    """(doc_id, n_shingles, component_id) of each row, by all pairs."""
    sets = sets_of([t for _, t in rows])
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for g in s for j in by_shingle[g]}
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= like * (len(s) + len(sets[j]) - common):
                above[root(i)] = root(j)
        for g in s:
            by_shingle[g].append(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.grouped(docs, **more).collect()), key=str)


def family(rng, base, copies, most):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÄ \t\n\x0b\x0c\r\x00\x1c ", max_size=24)), min_size=1, max_size=5), st.integers(1, 5))
def test_words_and_shingles(texts, width):
    found = list(neardup.shingle_sets([None if t is None else t.encode() for t in texts], width))
    want = sets_of(texts, width)
    assert [len(f) for f in found] == [len(w) for w in want]
    for a, x in zip(found, want):
        for b, y in zip(found, want):
            assert len(np.intersect1d(a, b)) == len(x & y)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=12), st.integers(1, 400))
def test_chunks_keep_every_row_in_order(sizes, limit):
    import pyarrow as pa

    texts = [None if n % 7 == 6 else "x" * n for n in sizes]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 3], pa.string())}) for i in range(0, len(texts), 3)]
    got = list(chunks(iter(batches), limit=limit))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") + 1 for t in b.column("text").to_pylist()) <= limit for b in got)


@pytest.mark.parametrize("hub", [10_000, 3])
def test_components_of_a_chain_a_star_and_rings(spark, monkeypatch, hub):
    from shapewright.llm import components as module

    monkeypatch.setattr(module, "HUB", hub)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300, 300)]
    rng.shuffle(edges)
    key = lambda i: f"{i * 7919 % 1000:04}".encode()
    got = {r.node: r.component for r in components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")).collect()}
    for group in (range(61), range(100, 140), range(200, 217)):
        low = min(map(key, group))
        assert all(bytes(got[key(i)]) == low for i in group)


@pytest.mark.parametrize("n,few", [(1, 2), (40, 2), (40, 9), (90, 48)])
def test_pairs_inside_posts_are_those_of_all_pairs(n, few, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "FEW", few)
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**32, (4, neardup.COORDINATES), dtype=np.uint32)
    rows = base[rng.integers(0, 4, n)]
    rows[rng.random(rows.shape) < 0.2] = 1
    table = pa.table({"node": [b"%06d" % i for i in range(n)], "n": rng.integers(50, 100, n), "signature": [r.tobytes() for r in rows], "bitmap": [bytes(neardup.BITS // 8)] * n, "component": [b"%d" % (i % 7) for i in range(n)]})
    side, post = neardup.Side(table, {}), rng.integers(0, 5, n)
    i, j = neardup.inside(side, post)
    want = {(x, y) for x in range(n) for y in range(x) if post[x] == post[y] and x % 7 != y % 7 and 100 * min(side.n[x], side.n[y]) >= 80 * max(side.n[x], side.n[y]) and (rows[x] == rows[y]).sum() >= neardup.MATCHES}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


@pytest.mark.parametrize("block", [2048, 9])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiou"]
    rows, n = [], 0
    for most in (2, 9, 20):
        for t in family(rng, rng.choices(words, k=120), 60, most):
            rows.append((n, t))
            n += 3
    rows += [(n + i, rows[i % 40][1]) for i in range(50)]
    rows += [(5000 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (8, "a b c d"), (9, "a  b\tc\nd"), (None, "a b c d"), (None, "nobody else says this"), (10, long), (11, long + " tail"), (12, None), (12, "x y z w v")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1)]
    with pytest.raises(ValueError):
        neardup.grouped(spark.createDataFrame([], "doc_id long, text string"), like=50)


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = neardup.op10(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiou"]
    rows = [(i, t) for i, t in enumerate(family(rng, rng.choices(words, k=120), 40, 9))] + [(100, None), (100, None), (101, " \n"), (102, "one two"), (102, "one two"), (102, "three"), (None, "four five"), (None, "four five")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, mark string")
    got = neardup.keep_first(docs).collect()
    lows = {c for _, n, c in brute(rows) if n}
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(i, t) for i, t in rows[:40] if i in lows] + [(100, None), (100, None), (101, " \n"), (102, "one two"), (102, "three"), (None, "four five")], key=str)
    assert neardup.keep_first(docs.limit(0)).collect() == []


def test_near_copies_without_an_id(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiou"]
    base = rng.choices(words, k=120)
    edited = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    # neighbours in this chain are near copies, its ends are not; only one has an id
    chain = [(None, edited()), (None, edited(5, 40)), (None, edited(5, 40, 70, 100)), (9, edited(5, 40, 70, 100, 20, 85))]
    other = [(None, t) for t in family(rng, rng.choices(words, k=120), 6, 2)] + [(None, "nobody else says this at all")]
    assert run(spark, chain + other) == brute(chain + other)
    docs = spark.createDataFrame(chain + other, "doc_id long, text string")
    assert len({bytes(r.component) for r in neardup.grouped(docs).collect()}) == 3
    kept = [(r.doc_id, r.text) for r in neardup.keep_first(docs).collect()]
    assert len(kept) == 3 and chain[3] in kept and other[-1] in kept


@pytest.mark.parametrize("agree", [range(36), range(28, 64), range(0, 64, 2)])
def test_signatures_that_just_match_meet_in_a_prefix(spark, agree):
    """They meet whatever other lists they are in, and those that collide once less needn't."""
    a = np.arange(neardup.COORDINATES, dtype=np.uint32)
    agree = list(agree) + [i for i in range(neardup.COORDINATES) if i not in agree][: neardup.MATCHES - len(agree)]
    b = a.copy()
    b[[i for i in range(neardup.COORDINATES) if i not in agree]] += 1000
    assert (a == b).sum() == neardup.MATCHES
    rng = np.random.default_rng(1)
    others = [np.where(rng.random(neardup.COORDINATES) < 0.4, rng.choice([a, b]), a + 5000 + i).astype(np.uint32) for i in range(30)]
    classes = spark.createDataFrame([(b"%d" % i, x.tobytes()) for i, x in enumerate([a, b, *others])], "node binary, signature binary")
    key = {r.node: r.s for r in classes.selectExpr("node", "xxhash64(node) AS s").collect()}
    lists = defaultdict(set)
    for r in neardup.lists_of(classes).collect():
        lists[r.post].add(r.short)
        assert r.size > 1
    assert any({key[b"0"], key[b"1"]} <= x for x in lists.values())
    far = a.copy()
    far[agree[0]] += 2000
    alone = spark.createDataFrame([(b"a", far.tobytes()), (b"b", b.tobytes())], "node binary, signature binary")
    assert neardup.lists_of(alone).count() == 0


def test_a_template_brings_nobody_together(spark):
    """Texts that share a third of their words: rows in merged lists stay far below a row a text, however many there are."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"x{rng.randrange(10**9)}" for _ in range(70)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = neardup.signed(docs)
    assert neardup.posts(classes.select("signature", "node")).groupBy("post").count().where("count > 400").count() > 5
    assert neardup.lists_of(classes.select("signature", "node")).count() < len(rows) / 4
    assert run(spark, rows) == brute(rows)
