import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapewright.llm import fingerprint as fp

RANDOM = random.Random(5)


def words(n: int) -> str:
    return " ".join("".join(RANDOM.choices("abcdefghé", k=RANDOM.randint(1, 9))) for _ in range(n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé \n", max_size=60), min_size=1, max_size=8))
def test_a_sketch_depends_on_its_own_text_only(texts):
    together = fp.sketches([t.encode() for t in texts])
    for t, row in zip(texts, together):
        assert (fp.sketches([t.encode()])[0] == row).all()


@pytest.mark.parametrize("offset", [0, 1, 2, 3, 7, 64])
def test_equal_substrings_share_their_interior_at_any_offset(offset):
    body = words(120).encode()
    other = "".join(RANDOM.choices("wxyz", k=offset)).encode()
    x = [fp.mix64(np.frombuffer(d, np.uint8).astype(np.uint64) + np.uint64(1)) for d in (body, other + body)]
    names = [fp.phrases(v, np.zeros(len(v), np.int32))[0] for v in x]
    for _ in range(3):
        a, b = names
        tail = min(len(a), len(b)) - 12
        assert tail > 5 and (a[-tail:] == b[-tail:]).all()
        names = [fp.phrases(v.copy(), np.zeros(len(v), np.int32))[0] for v in names]


def test_runs_are_parsed_alike():
    a, b = fp.sketches([b"a" * 5000 + b"tail of the text", b"a" * 5000 + b"tail of the text"])
    assert (a == b).all()
    assert fp.likeness(*fp.sketches([b"", b""])) == 1.0 and fp.likeness(*fp.sketches([b"", b"abc"])) == 0.0


def test_likeness_follows_what_is_shared():
    base = words(400)
    near, half, none = base[:-40] + words(8), base[: len(base) // 2] + words(200), words(400)
    s = fp.sketches([t.encode() for t in (base, near, half, none)])
    got = [float(fp.likeness(s[0], x)) for x in s]
    assert got[0] == 1 and got[1] > 0.75 and 0.2 < got[2] < 0.6 and got[3] < 0.15


@pytest.mark.parametrize("cuts", [[], [5], [9, 5], [100, 50, 20, 7, 3, 1, 0]])
def test_ranges(spark, cuts):
    got = spark.range(-2, 110).select("id", fp.range_of(F.col("id"), cuts).alias("k")).collect()
    assert all(r.k == sum(c > r.id for c in cuts) for r in got)


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(ordered):
        text, follower = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 2] + follower[: len(text) // 2]
        s = fp.sketches([text.encode(), edited.encode(), follower.encode()])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(s[0]), fp.written(s[1]), float(fp.likeness(s[0], s[1])), float(fp.likeness(s[0], s[2]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [50, 2_000_000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 700])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, n, chunk):
    monkeypatch.setattr(fp, "CHUNK", chunk)
    rows = [(i * 7 % 1000, [None, "", "a", "é" * 9, words(i % 30)][i % 5]) for i in range(n)]
    rows += [(3, "twice"), (3, "twice"), (3, "other"), (None, "no id"), (5000, words(3000))] if n > 3 else []
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, copy string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in fp.op9(spark, str(tmp_path)).collect()), key=str) == expected(rows)


def test_texts_are_parsed_until_one_symbol_is_left(monkeypatch):
    left, parse = {}, fp.phrases

    def watched(x, text):
        names, of = parse(x, text)
        left.update(enumerate(np.bincount(of, minlength=4).tolist()) if not left else ((t, n) for t, n in enumerate(np.bincount(of, minlength=4).tolist()) if n))
        return names, of

    monkeypatch.setattr(fp, "phrases", watched)
    parts = [words(400) for _ in range(60)]
    texts = ["".join(parts).encode(), "".join(reversed(parts)).encode(), b"short", b""]
    s = fp.sketches(texts)
    assert len(texts[0]) > 100_000 and left == {0: 1, 1: 1, 2: 1, 3: 0}
    assert all((fp.sketches([t])[0] == row).all() for t, row in zip(texts, s)) and (s[2] > 0).any()
