import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shapewright.llm import substring

W = substring.WIDTH


def brute(rows):
    """(doc_id, n_words, n_removed, sha of kept) of each row, by a table of all windows."""
    first = {}
    place = lambda d: (d is None, d or 0)
    split = lambda t: (t or "").encode().split()
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - W + 1):
            g = tuple(w[i : i + W])
            first[g] = min(first.get(g, place(d)), place(d))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - W + 1):
            if first[tuple(w[i : i + W])] < place(d):
                gone |= set(range(i, i + W))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, kept int").repartition(5)
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove(docs).collect()), key=str)


def corpus(rng, n):
    words = [f"{a}{b}{c}" for a in "bcd" for b in "aeé" for c in "xyz"]
    shared = [rng.choices(words, k=rng.randint(10, 60)) for _ in range(5)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(shared) if rng.random() < 0.5 else rng.choices(words, k=rng.randint(0, 40))
            if rng.random() < 0.2:
                w += ["same"] * rng.randint(0, 40)
        out.append((rng.randrange(10 * n), rng.choice([" ", "\n", "\t \r"]).join(w)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_least(values, width):
    x = np.array(values, np.uint64)
    if len(x) >= width:
        assert substring.sliding_least(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@given(st.lists(st.tuples(*[st.integers(-(2**63), 2**63 - 1)] * 3), max_size=20), st.binary(max_size=9))
def test_payloads_come_back(rows, tail):
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(3)]
    got, rest = substring.unpacked(substring.packed(substring.RUN, columns, tail), 3)
    assert all((a == b).all() for a, b in zip(got, columns)) and rest == tail


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5)), max_size=40))
def test_repeated_edges(rows):
    doc, edge = (np.array([r[i] for r in rows], np.int64) for i in range(2))
    e = substring.Edges(doc=doc, mark=doc * 0, pos=np.arange(len(rows)), tail=edge.astype(np.uint64), head=edge.astype(np.uint64), again=np.zeros(len(rows), bool))
    every, least, sources = substring.repeated(e)
    want = {i: min((doc[j], j) for j in range(len(rows)) if edge[j] == edge[i])[1] for i in range(len(rows)) if len(set(doc[edge == edge[i]])) > 1}
    assert dict(zip(every.tolist(), least.tolist())) == want and sorted(sources.tolist()) == sorted(set(want.values()))


def nonbranching(rows):
    """The paths (doc, start, n) of the graph of repeated windows, by tables of nodes and edges."""
    split = {d: (t or "").encode().split() for d, t in rows}
    starts = {}
    for d, w in sorted(split.items()):
        for i in range(len(w) - W + 1):
            starts.setdefault(tuple(w[i : i + W]), []).append((d, i))
    graph = {g: min(x) for g, x in starts.items() if len({d for d, _ in x}) > 1}
    into, out = {}, {}
    for g in graph:
        out.setdefault(g[:-1], []).append(g)
        into.setdefault(g[1:], []).append(g)
    after = {}
    for v in into:
        if len(into[v]) == 1 and len(out.get(v, ())) == 1:
            a, b = graph[into[v][0]], graph[out[v][0]]
            if b == (a[0], a[1] + 1):
                after[a] = b
    paths = set()
    for at in set(graph.values()) - set(after.values()):
        n, x = 1, at
        while x in after:
            n, x = n + 1, after[x]
        paths.add((*at, n))
    return paths, into, out


@pytest.mark.parametrize("size,heavy,chunk", [(10**9, 10**9, 10**7), (300, 10**9, 10**7), (300, 3, 400), (2_000, 20, 10**7)])
def test_paths_are_those_of_the_graph(spark, monkeypatch, size, heavy, chunk):
    for name, value in (("BUCKET_BYTES", size), ("HEAVY", heavy), ("LOOK", 1), ("CHUNK", chunk)):
        monkeypatch.setattr(substring, name, value)
    rng = random.Random(size + heavy)
    rows = list(dict(corpus(rng, 80)).items())
    base = [f"w{i}" for i in range(200)]
    for i in range(30):  # bubbles: the same text with one of three other words at some places
        rows.append((2_000 + i, " ".join(f"x{rng.randrange(3)}" if j % 40 == 7 and rng.random() < 0.7 else w for j, w in enumerate(base))))
    want, into, out = nonbranching(rows)
    assert sum(len(x) > 1 for x in out.values()) > 3 and sum(len(x) > 1 for x in into.values()) > 3
    docs = spark.createDataFrame([(d, 0, t) for d, t in rows], "doc long, mark long, text string").repartition(3)
    found = substring.graph_of(docs)
    if heavy < 100:
        buckets = int(max(2 * 4, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // size + 1))
        assert len(substring.heavy_buckets(docs, buckets))
    pieces = found.where("left_open IS NOT NULL").select("doc", "mark", "start", "n", "left_open", "right_open")
    made = pieces.join(substring.paths_of(pieces), ["doc", "mark", "start"]).selectExpr("doc", "path", "start + n AS stop").groupBy("doc", "path").max("stop").collect()
    assert {(d, p, stop - p) for d, p, stop in made} == want
    if size < 10**9:
        assert pieces.where("right_open").count() > 5
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits,chunk", [(40, 4_000_000), (40, 300), (4, 4_000_000), (4, 300)])
def test_against_brute_force(spark, monkeypatch, bits, chunk):
    monkeypatch.setattr(substring, "NODE_BITS", bits)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rows = list(dict(corpus(random.Random(bits + chunk), 120)).items())
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_repeated_and_missing_ids(spark):
    rows = corpus(random.Random(8), 60)
    rows += [rows[3], rows[4], (rows[5][0], rows[9][1]), (None, rows[6][1]), (None, rows[7][1]), (None, None), (rows[8][0], None), (3, ""), (2**62, "long " * 3 + " ".join(f"w{i}" for i in range(30_000)))]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "few words")]) == brute([(1, None), (2, "few words")])


def test_many_texts_without_an_id(spark):
    """They are one document of texts that are told apart, none of which is held together with the others."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=60)) for _ in range(20)]
    rows = [(None, t) for t in texts + texts[:4]] + [(3, texts[5]), (4, texts[6] + " " + texts[7]), (4, texts[5])]
    assert run(spark, rows) == brute(rows)


def test_text_without_passages_keeps_its_white_space(spark):
    p = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, p), (2, f"a\n b\n\n{p}\n\nc  d\n"), (3, f"{p}\n\te"), (4, f" x\ty \n")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substring.remove(docs, spaced=True).collect()}
    assert got == {1: p, 2: "a\n b\n\nc  d\n", 3: "\n\te", 4: " x\ty \n"}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, "x")], "doc_id long, text string, doc int, mark int, spans string")
    row = substring.remove(docs).collect()[0]
    assert (row.doc, row.mark, row.spans, row.kept) == (5, 6, "x", "a b")


def test_words_split_as_bytes_do():
    odd = "a\x1cb\x85c d\xa0e f\x0bg\x0ch"
    assert [w.decode() for w in odd.encode().split()] == ["a\x1cb\x85c d\xa0e", "f", "g", "h"]


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substring.op3(spark, sf).collect()), key=str) == brute(rows)
