import numpy as np
import pytest
from pyspark.sql import functions as F

from shapewright.llm import langid
from shapewright.llm.textkernel import mix64

SF = "/root/testdata/sf0.01"


def brute(text: str) -> list[int]:
    data = b" " + text.lower().encode().translate(langid.PLAIN) + b" "
    out = []
    for size in langid.SIZES:
        for i in range(len(data)):
            g = size
            for b in (data + bytes(langid.PAD))[i : i + size]:
                g = (g << 8 | b) % (1 << 64)
            out.append(g)
    return out


@pytest.mark.parametrize("segment", [7, 64, 4_000_000])
def test_counts_are_those_of_the_sets(segment, monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    texts = ["Hello, World 12", "", "Über été", None, "hello hello", "z" * 40]
    rng = np.random.default_rng(1)
    langs = [f"l{i:02}" for i in range(70)]  # more than one plane
    pool = [g for t in texts if t for g in brute(t)]
    sets = [set(rng.choice(np.array(pool, np.uint64), 20).tolist()) for _ in langs]
    model = langid.Model.build(langs, {i: mix64(np.array(sorted(s), np.uint64)) for i, s in enumerate(sets)})
    counts, total = model.counts(texts)
    for i, t in enumerate(texts):
        own = brute(t or "")
        assert total[i] == len(own)
        for k, s in enumerate(sets):
            assert counts[i, k] == pytest.approx(sum(g in s for g in own), abs=1e-3)


def test_false_positives_are_taken_off():
    rng = np.random.default_rng(2)
    model = langid.Model.build(["full", "thin"], {0: rng.integers(0, 1 << 63, 400_000).astype(np.uint64)})
    text = "".join(map(chr, rng.integers(97, 123, 20_000)))
    counts, total = model.counts([text])
    assert model.false[0] > 0.2 and counts[0, 0] < 0.03 * total[0] and counts[0, 1] == 0


def test_accuracy_on_documents_held_out(spark):
    got = langid.op2(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert row.n > 250 and row.right >= 0.99
    assert got.count() == 1000 and got.where("score < 0 or score > 1").count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.langs == b.langs and all((x == y).all() for x, y in zip(a.planes, b.planes))


def test_edges(spark):
    rows = [(i, t, "de" if i % 2 else "en", "own") for i, t in enumerate(["the cat and the dog", "der hund und die katze"] * 20)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 34 !?", None, "x"), (103, "½ ²", "de", "x"), (None, "the dog", None, None), (104, "qqq", None, None), (104, "qqq", None, None), (105, "the dog " * 50_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.text and r.text[:9]): r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert {k[0] for k, r in got.items() if r.lang_pred == "und"} == {100, 101, 102, 103}
    assert got[(None, "the dog")].lang_pred == "en" == got[(105, "the dog t")].lang_pred
    assert got[(104, "qqq")].lang_pred in ("de", "en") and 0 <= got[(104, "qqq")].score <= 1
    assert langid.keep(docs).columns == docs.columns
    assert {r.doc_id for r in langid.keep(docs).collect()} >= {None, 0, 1, 105}
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
