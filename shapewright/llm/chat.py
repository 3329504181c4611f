"""Chat formatting of reply trees.

Messages form trees by their parents. Self-joins that double their reach enumerate, for every leaf, the messages up to its root: after
round k each leaf has its nearest 2^k, so a depth of d takes log2(d) rounds. Leaves are ranked by the score of their branch, and each
chosen path becomes one conversation in the template

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

with a backslash put into any "<|" of a role or text ("<\\|" becomes "<\\\\|", and so on), so that the markers can't be forged and
the texts can be read back. loss lists the spans of the assistants' texts, in code points of the formatted string.

Defined cases: null texts and roles are empty; a null tree id is a tree; a parent that isn't there makes its message a root; repeated
rows of a conversation table are turns of their own, ordered by turn, role, text (nulls first); messages whose
replies run in a circle, or lead into one, have no root and so are on no path; an empty table gives an empty one. One conversation is one value: it is put together in one task, from a sorted stream.
"""

from __future__ import annotations

import hashlib

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.llm.common import cut, partitions, read

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
LEARNED = "assistant"
#: A conversation whose texts forge the template's markers.
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def key(c: Column) -> Column:
    """A join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


#: Steps upwards from which on it is asked whether replies run in a circle.
EVEN_LOOPS = 32


def paths(messages: DataFrame) -> DataFrame:
    """Of messages (tree, msg, parent): rows (tree, leaf, msg, up), up counting from the leaf's 0 to its root."""
    nodes = messages.select("tree", "msg", "parent")
    known = nodes.select("tree", F.col("msg").alias("parent"))
    jump = cut(nodes.join(known, ["tree", "parent"]).select("tree", "msg", F.col("parent").alias("above")), "replies")
    leaves = nodes.join(known_parents(nodes), ["tree", "msg"], "left_anti")
    out, reach = leaves.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("bigint").alias("up")), 1
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"))
    while not jump.isEmpty():
        if reach >= EVEN_LOOPS:  # nothing is as far above a message as its tree has messages, unless replies run in a circle
            far = cut(jump.join(sizes, "tree").select("tree", "msg", "above", (F.col("n") <= reach).alias("endless")), "replies")
            lost = far.where("endless").select("tree", F.col("msg").alias("leaf"))
            if not lost.isEmpty():
                out = cut(out.join(lost, ["tree", "leaf"], "left_anti"), "paths")
            jump = far.where("NOT endless").drop("endless")
            if jump.isEmpty():
                break
        out = cut(out.unionByName(out.join(jump, ["tree", "msg"]).select("tree", "leaf", F.col("above").alias("msg"), (F.col("up") + reach).alias("up"))), "paths")
        further = jump.select("tree", F.col("msg").alias("above"), F.col("above").alias("top"))
        jump = cut(jump.join(further, ["tree", "above"]).select("tree", "msg", F.col("top").alias("above")), "replies")
        reach *= 2
    return out


def known_parents(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("msg")).distinct()


def choose(walked: DataFrame, messages: DataFrame, top: int | None) -> DataFrame:
    """The rows of walked of each tree's top branches: by the sum of scores (null counts 0), then length, then the smaller leaf."""
    branch = walked.join(messages.select("tree", "msg", "score"), ["tree", "msg"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    ranked = branch.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return walked.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])


FORMATTED = "tree string, leaf long, rank int, formatted string, loss array<struct<start:long,stop:long>>"


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """One row (FORMATTED) for each chosen path, from its root down."""
    n = partitions(chosen.sparkSession)
    rows = chosen.join(messages.select("tree", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "msg"])
    rows = rows.select("tree", "leaf", "rank", "up", "role", "text").repartition(n, "tree", "leaf").sortWithinPartitions("tree", "leaf", F.desc("up"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, parts, spans, at, done, held = None, None, [], [], 0, [], 0

        def close() -> None:
            done.append((*head, "".join(parts), [{"start": a, "stop": b} for a, b in spans]))

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], ["tree", "leaf", "rank", "formatted", "loss"])

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                for tree, leaf, rank, role, text in zip(*[batch.slice(start, 1000).column(c).to_pylist() for c in ("tree", "leaf", "rank", "role", "text")]):
                    if (tree, leaf) != now:
                        if now is not None:
                            close()
                            held += at
                            if held > 4_000_000 or len(done) >= 2_000:
                                yield out()
                                done.clear()
                                held = 0
                        now, head, parts, spans, at = (tree, leaf), (tree, leaf, rank), [], [], 0
                    before = f"{START}{escape_role(role)}\n"
                    body = escape(text)
                    if role == LEARNED:
                        spans.append((at + len(before), at + len(before) + len(body)))
                    parts += [before, body, END, "\n"]
                    at += len(before) + len(body) + len(END) + 1
        if now is not None:
            close()
            yield out()

    return rows.mapInArrow(run, FORMATTED)


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns of a formatted conversation, and the texts that its loss spans cover."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]
    return turns, [unescape(formatted[a:b]) for a, b in spans]


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): each row replies to the row before it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(key(F.col("conv_id")).alias("tree"), "conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order).cast("bigint"))
    return rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"), "conv_id")


def conversations_formatted(conversations: DataFrame, top: int | None = 1) -> DataFrame:
    """One formatted row for each chosen branch of each conversation, with conv_id."""
    messages = cut(linear(conversations), "messages")
    made = format_paths(choose(paths(messages), messages, top), messages)
    return made.withColumn("conv_id", F.when(F.col("tree") != "null", F.substring("tree", 2, 1 << 30)).cast(conversations.schema["conv_id"].dataType))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the formatted strings."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", LEARNED))])).alias("x")).select("x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv, text, loss in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")]):
                turns, learned = read_back(text, [(s["start"], s["stop"]) for s in loss])
                whole, covered = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for said in learned:
                    covered.update(said.encode())
                out.append((conv, len(turns), whole.hexdigest(), sum(map(len, learned)), covered.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    made = conversations_formatted(rows.unionByName(probe))
    return made.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
