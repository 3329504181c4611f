"""From raw documents to encoded ones: language ID, near-duplicates, repeated passages, mixing, tokenizing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever they are, and of
an empty table an empty one. A stage's result is written as Parquet and read again before the next one, so a lost executor repeats one
stage at most; what a stage wrote for itself is deleted then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.llm import bpe, langid, mixing, neardup, substring
from shapewright.llm.common import cut, outside, scratch

NEAR_WORDS = 5


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns used, and the others as one, so that none is taken for a column that an operator adds."""
    return docs.select(*used, F.struct(F.lit(True).alias("row"), *[F.col(c).alias(f"of_{i}") for i, c in enumerate(docs.columns) if c not in used]).alias("__others"))


def back(made: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs, those used from made."""
    return made.select(*[F.col(c) if c in used else F.col(f"__others.of_{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in a learned language.

    Null and empty texts, and texts without a letter, go; long texts are judged as a whole; a tie goes to the language with more labelled
    rows; rows that occur again are judged alike; where no row has a language, none is learned and all go."""
    used = ("doc_id", "text", "lang")
    return back(langid.keep(aside(docs, *used)), docs, *used)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The least id stays, of rows with equal ids the one with the least hash of its text, of equal rows one; null ids come last; null texts
    and texts without words stay."""
    return neardup.keep_first(docs, NEAR_WORDS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; what stays keeps its white space.

    Null and empty texts stay as they are; rows with equal ids, and all rows without one, are one document and take nothing from each
    other; null ids count as the largest; a text that is all passages becomes empty or white space, and its row stays."""
    made = substring.remove(aside(docs, "doc_id", "text"), spaced=True).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return back(made.withColumn("n_chars", F.char_length("text").cast("bigint")), docs, "doc_id", "text", "n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture.

    Null and unknown sources are one stream; rows with equal or null ids are dealt by the hash of the id, then of the whole row."""
    used = ("doc_id", "source")
    return back(mixing.in_order(mixing.mix(aside(docs, *used), mixing.PARTS, mixing.OTHER_PARTS)), docs, *used)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and digests of the ids and of what they decode to, by mix_place: the row's number in the mixture.

    A null text is encoded as an empty one; texts of any length are encoded as a whole; every row has a result of its own."""
    placed = mixing.by_place(mixing.written(docs).select("doc_id", "lang", "source", "text", "mix_place"))
    made = bpe.encode(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return made.select("doc_id", "lang", "source", F.expr("CAST(octet_length(ids) div 4 AS BIGINT)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "mix_place")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("mixing to target weights", mixture),
    ("byte-level BPE", encoding),
]

#: Language models, MinHash and merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = kept(made, f"stage{number}")
    return STAGES[-1][1](spark, docs, sf_dir)


def kept(made: DataFrame, name: str) -> DataFrame:
    """made, written for the next stage."""
    with outside():
        return cut(made, name)
