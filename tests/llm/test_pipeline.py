import os
import random
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from shapewright.llm import bpe, langid, mixing
from tests.llm.test_neardup import brute as groups
from tests.llm.test_substring import W, brute as substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs.columns, rows_of(docs)))
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
    return [*out, (docs.columns, rows_of(docs))]


def rows_of(docs):
    """In the order of files' names and of the rows in each; Spark itself reads large files first."""
    return [tuple(r)[:-1] for r in sorted(docs.select("*", "_metadata.file_name").collect(), key=lambda r: r[-1])]


def by_id(stage):
    names, rows = stage
    return {r[names.index("doc_id")]: dict(zip(names, r)) for r in rows}


def test_columns_stay(stages):
    assert all(names == ["doc_id", "text", "lang", "source", "n_chars"] for names, _ in stages[:5])


def test_languages_keep_clean_documents(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert {d for d, r in before.items() if r["text"] and langid.LETTER.search(r["text"])} == set(after)


def test_near_duplicates_against_brute_force(stages):
    import tests.llm.test_neardup as t

    rows = [(d, r["text"]) for d, r in by_id(stages[1]).items()]
    old = t.sets_of
    try:
        t.sets_of = lambda texts, width=5: old(texts, 5)
        want = {d for d, _, c in groups(rows) if d == c}
    finally:
        t.sets_of = old
    assert set(by_id(stages[2])) == want


def test_passages_against_brute_force(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    want = {d: (n, gone) for d, n, gone, _ in substrings([(d, r["text"]) for d, r in before.items()])}
    assert set(after) == set(before)
    for d, r in after.items():
        n, gone = want[d]
        assert len(r["text"].encode().split()) == n - gone and r["n_chars"] == len(r["text"])
        assert gone or r["text"] == before[d]["text"]


def test_mixture_keeps_all_rows_and_the_weights(stages):
    before, after = stages[3], stages[4]
    assert Counter(before[1]) == Counter(after[1])
    sources = [r[before[0].index("source")] for r in after[1]]
    want = [r["stream"] for r in _slots(Counter(sources))]
    names = sorted(mixing.PARTS)
    assert sources[: len(want)] == [names[s] for s in want][: len(sources)]


def _slots(counts):
    """Streams by slot and offset, from the counts of rows alone."""
    names = sorted(mixing.PARTS)
    shares = {i: mixing.PARTS[s] for i, s in enumerate(names)} | {len(names): mixing.OTHER_PARTS}
    rows = {i: counts.get(s, 0) for i, s in enumerate(names)} | {len(names): sum(n for s, n in counts.items() if s not in mixing.PARTS)}
    out = []
    for r in mixing.phases(shares, {k: -(-n // mixing.BLOCK_ROWS) for k, n in rows.items()}):
        for b in range(r["first"], r["last"]):
            j = b - r["first"]
            slot = r["base"] + j // r["q"] * r["total"] + r["slots"][j % r["q"]]
            out += [(slot, {"stream": r["stream"]})] * min(mixing.BLOCK_ROWS, rows[r["stream"]] - b * mixing.BLOCK_ROWS)
    return [x for _, x in sorted(out, key=lambda y: y[0])]


def test_encoding_against_the_library(stages):
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = by_id(stages[4]), by_id(stages[5])
    assert set(before) == set(after)
    for d, r in after.items():
        ids = true.encode_ordinary(before[d]["text"])
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5][0] and Counter(map(str, got.collect())) == Counter(str(r) for r in spark.createDataFrame(stages[5][1], got.schema).collect())


def test_run_keeps_the_order_of_the_mixture_over_many_files(spark, tmp_path):
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "lmnrst"]
    rng = random.Random(8)
    # documents of the given table with words of their own, most of them of one source, and of lengths that differ by source
    given = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    rows = [(r.doc_id, r.text + " " + " ".join(rng.choices(words, k=400 * (i % 7))), r.lang, f"src{max(0, i % 11 - 6)}", r.n_chars) for i, r in enumerate(given)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    sources, names = [r.source for r in got], sorted(mixing.PARTS)
    assert len(got) > 150 and sources == [names[r["stream"]] for r in _slots(Counter(sources))]
    assert [r.mix_place for r in got] == list(range(len(got)))


EDGES = "doc_id long, text string, lang string, source string, n_chars long, kept string, mix_slot string, node int, doc int, mark string, lang_pred int, known string"


def test_edges(spark, tmp_path):
    """Nulls in every column, blank and long texts, ties, repeated rows, null and repeated ids, and columns of the names that stages add."""
    rng = random.Random(2)
    words = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(30).collect() if r.text]
    more = ("kept", "slot", 1, 2, "mark", 3, "known")
    base = " ".join(words[0].split()[:60] + words[1].split()[:60])
    rows = [(i, t, "en", f"src{i % 3}", len(t), *more) for i, t in enumerate(words)]
    rows += [rows[2], rows[2], (2, words[3], "en", None, None, *more), (None, base, "en", "src1", 1, *more), (None, base + " tail", None, None, None, *[None] * 7), (None, " ".join(rng.choices(" ".join(words).split(), k=90)), "en", "src9", 0, *more)]
    rows += [(900, None, None, None, None, *[None] * 7), (901, "", "en", "src0", 0, *more), (902, " \n\t", "en", "src0", 3, *more), (903, "123 456", "en", "src0", 7, *more), (904, " ".join(rng.choices(words, k=300)), "en", "src0", 9, *more)]
    docs = spark.createDataFrame(rows, EDGES).repartition(3)
    given = docs.columns
    left = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, left = left, corpus_pipeline.cut(stage(spark, left, ""), "edges")
        assert left.columns == given and 0 < left.count() <= before.count(), name
        if number == 0:
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in left.collect()} == {900, 901, 902, 903}
        if number == 1:
            assert left.where("doc_id = 2 AND source = 'src2'").count() <= 1 and left.where("doc_id IS NULL").count() == 2
        if number == 2:
            assert left.count() == before.count() and left.where("kept = 'kept'").count() == before.where("kept = 'kept'").count()
        if number == 3:
            assert Counter(map(str, left.collect())) == Counter(map(str, before.collect()))
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    assert len(corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == left.count()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert got.collect() == [] and "mix_place" in got.columns


def test_scratch_tables_go(spark):
    from shapewright.llm.common import cut, outside, scratch

    with scratch(spark):
        gone = cut(spark.range(3), "gone")
        at = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(at)
        with outside():
            stays = cut(gone, "stays")
    assert stays.count() == 3 and not os.path.exists(at)
