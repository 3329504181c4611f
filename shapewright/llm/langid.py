"""Language identification by language-bitmask n-gram filters.

Fitting takes at most SAMPLE_DOCS labelled documents a language (in expectation; picked by a hash of the id), counts in how many of
them each byte n-gram of the lower-cased text occurs, and gives a language its GRAMS most frequent ones, unless another language has
them far more often. One table of SLOTS masks holds the Bloom filters of all languages side by side, one bit a language: the AND of
an n-gram's slots names all languages that contain it. A document's count for a language, less the false positives expected from how
full that language's slice is, decides; the score is the winner's share of the corrected counts.

Defined cases: "und" with score 0 for a null text or one without a letter; where no n-gram is known, the language with the most
training documents, with score 0; ties go to that order too, then to the smaller name. A null id is not held out. Languages, sources
and ids are never inputs of a prediction. Repeated rows are rows; other columns stay, those with the names of added ones are
replaced; an empty table gives an empty one, and with nothing to learn from every document is "und".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.llm.common import cut, read, text_batches
from shapewright.llm.textkernel import chunks, mix64, tidied

SAMPLE_DOCS = 1_500
#: N-grams of a language at most: those in most documents of the sample.
GRAMS = 40_000
#: Languages of labelled rows at most; more are an error.
MOST_LANGS = 64
SIZES = (3, 5)
SLOTS = 1 << 20
HASHES = 3
#: An n-gram is left to the languages that have it at least so often, as a share of the documents, as this part of the largest share.
PART = 0.3
#: A rejected document: no language, or fewer of its n-grams known than this.
KNOWN = 0.05
PAD = max(SIZES)
SEGMENT = 1_000_000

U = np.uint64
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter is a space.
PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size and SEGMENT bytes: hashes of the n-grams of the texts one after the other, and where each text's begin and end."""
    parts = [b" " + (t or "").lower().encode().translate(PLAIN) + b" " + bytes(PAD) for t in texts]
    data = np.frombuffer(b"".join(parts) + bytes(PAD), np.uint8)
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    for low in range(0, first[-1], SEGMENT):
        high = min(low + SEGMENT, first[-1])
        begin, end = np.clip(first[:-1], low, high) - low, np.clip(first[1:] - PAD, low, high) - low
        for size in SIZES:
            g = np.full(high - low, U(size))
            for j in range(size):
                g <<= U(8)
                g |= data[low + j : high + j]
            yield mix64(g), begin, end


def slots(g: np.ndarray) -> list[np.ndarray]:
    return [((g >> U(20 * j)) & U(SLOTS - 1)).astype(np.int32) for j in range(HASHES)]


@dataclass
class Model:
    """langs in the order of ties; planes: a mask for each slot, for 64 languages at a time at most; false: each slice's rate."""

    langs: list[str]
    planes: list[np.ndarray] = field(default_factory=list)
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, langs: list[str], known: dict[int, np.ndarray]) -> Model:
        planes, rates = [], []
        for start in range(0, len(langs), 64):
            some = range(start, min(start + 64, len(langs)))
            kind = np.uint8 if len(some) <= 8 else np.uint64
            plane = np.zeros(SLOTS, kind)
            for i in some:
                bit = kind(1 << (i - start))
                for at in slots(known.get(i, np.zeros(0, np.uint64))):
                    plane[at] |= bit
                rates.append(float(((plane & bit) != 0).mean()) ** HASHES)
            planes.append(plane)
        return cls(langs, planes, np.array(rates))

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts, a row for each text and a column for each language; the number of n-grams of each text."""
        found = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for g, begin, end in grams(texts):
            total += end - begin
            sums = np.zeros(len(g) + 1, np.int64)
            at = slots(g)
            for p, plane in enumerate(self.planes):
                mask = plane[at[0]]
                for more in at[1:]:
                    mask &= plane[more]
                for i in range(p * 64, min(p * 64 + 64, len(self.langs))):
                    hit = (mask & mask.dtype.type(1 << (i - p * 64))) != 0
                    np.cumsum(hit, out=sums[1:])
                    found[:, i] += sums[end] - sums[begin]
        return np.maximum(found - total[:, None] * self.false, 0) / (1 - self.false), total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, the score, and the share of n-grams that the language knows."""
        if not texts or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts, total = self.counts(texts)
        best = counts.argmax(axis=1)
        top, whole = counts[np.arange(len(texts)), best], counts.sum(axis=1)
        letters = np.array([bool(t and LETTER.search(t)) for t in texts])
        score = np.where(letters & (whole > 0), top / np.maximum(whole, 1e-9), 0.0)
        share = np.where(letters, np.minimum(top / np.maximum(total, 1), 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], score, share


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a language that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    # as many rows as languages; then all languages share one sample size
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages are labelled; {MOST_LANGS} at most")
    if not langs:
        return Model([])
    spread = 1 << 40
    below = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(spread, spread * SAMPLE_DOCS // sizes[k])))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(spread)) < F.element_at(below, F.col("lang"))).select("lang", "text")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1_000_000):
            of = np.array([number[x] for x in batch.column("lang").to_pylist()])
            sets = [[] for _ in number]
            for g, begin, end in grams(batch.column("text").to_pylist()):
                for i, k in enumerate(of):
                    sets[k].append(np.unique(g[begin[i] : end[i]]))
            for k, found in enumerate(sets):
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "gram", "n"])

    docs_of = {number[r.lang]: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counted = sample.mapInArrow(tidied(count), "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    per = F.create_map(*[x for k, n in docs_of.items() for x in (F.lit(k), F.lit(float(n)))]) if docs_of else F.lit(None)
    known: dict[int, np.ndarray] = {}
    if docs_of:
        shared = counted.withColumn("share", F.col("n") / F.element_at(per, F.col("k"))).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
        own = cut(shared.where(F.col("share") >= PART * F.col("most")).select("k", "gram", "n"), "grams")
        # a histogram by numbers of documents, of which a language has few, tells the least number with GRAMS n-grams or fewer from there on
        least, left = {}, dict.fromkeys(docs_of, GRAMS)
        for r in own.groupBy("k", "n").agg(F.count("*").alias("grams")).orderBy(F.desc("n")).collect():
            left[r.k] -= r.grams
            if left[r.k] >= 0:
                least[r.k] = r.n
        enough = F.create_map(*[x for k in docs_of for x in (F.lit(k), F.lit(least.get(k, 1 << 60)))])
        got = own.where(F.col("n") >= F.element_at(enough, F.col("k"))).select("k", "gram").toArrow()  # GRAMS rows a language at most
        ks, gs = np.asarray(got.column("k")), np.asarray(got.column("gram")).astype(np.int64).view(np.uint64)
        known = {int(k): gs[ks == k] for k in np.unique(ks)}
    return Model.build(langs, known)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and known."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]
    text_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    given, shipped = [f.name for f in own], docs.sparkSession.sparkContext.broadcast(model)  # a MB for 8 languages, 8 for 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__of", 1_000_000):
            lang, score, known = shipped.value.predict(batch.column("__of").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in given], pa.array(lang, pa.string()), pa.array(score), pa.array(known)], [*given, *[a.name for a in added]])

    return docs.select(*given, F.col(text_col).alias("__of")).mapInArrow(tidied(run), T.StructType([*own, *added]))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are text in a learned language; their columns as they were."""
    own = docs.columns
    return predict(docs, fit(docs)).where((F.col("lang_pred") != "und") & (F.col("known") >= KNOWN)).select(*own)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "known")
