"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets form a class, and classes are what is compared. A signature has COORDINATES least hashes; a link of
likeness 0.8 agrees in MATCHES of them but for about four in a million. Every class is posted under each (coordinate, value) of its
signature, and two classes collide once for each post that both are under; candidates are pairs with MATCHES collisions at least.

Skipping: posts of one class only collide with nothing, so a class with fewer than MATCHES other posts is in no candidate. Prefix: a
class's remaining posts are put in the order of their lists' lengths, rarest first; as two classes with MATCHES collisions can't miss
each other in all of their first (remaining - MATCHES + 1) posts, only those lists are merged. A page template that texts share by half
stands in the long lists behind, and brings nobody together. Merging a list counts the collisions of its pairs, coordinate by coordinate,
and drops a pair as soon as those to come can't bring it to MATCHES, or as its sizes or parity bitmaps rule the likeness out, or if it
is connected already. What is left is confirmed on the full shingle sets.

A first round merges lists, long ones in blocks, and confirms a spanning forest; a second round merges, across blocks, only what is
still in different components, so that a large group of linked copies costs in proportion to its size, and only classes outside of their
list's largest component meet all others of that list. Components come from stars over the confirmed links.

Defined cases: a null or blank text has no shingle and is linked with nothing; a text of fewer words than a shingle is one shingle;
repeated rows, also of one id, are members of one class; null ids are never a component's id unless there is no other; other columns
stay where rows are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapewright.llm.common import cut, partitions, read, text_batches
from shapewright.llm.components import components
from shapewright.llm.textkernel import Words, chunks, mix64, places, shingles, texts_of, tidied

WIDTH, LIKE = 4, 80
COORDINATES, MATCHES = 64, 36
BITS = 2048
#: Classes of a list that are merged in one task.
BLOCK = 2_048
#: Lists of so many classes are merged many at a time, in tasks of about TASK_ROWS rows.
FEW, TASK_ROWS = 48, 4_000
#: Coordinates whose collisions are counted at a time.
STRIDE = 16
#: Ids up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
CHUNK = 1_000_000

U = np.uint64
_rng = np.random.default_rng(64)
TURNS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
SALT = _rng.integers(1, 1 << 63, 2, dtype=np.uint64)


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    first = words.first
    at, text = places(first, width)
    grams = shingles(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        n = first[i + 1] - first[i]
        if n >= width:
            yield np.unique(grams[begin[i] : begin[i + 1]])
        elif n:
            yield shingles(hashes[first[i] : first[i + 1]], int(n)) ^ U(n)
        else:
            yield np.zeros(0, np.uint64)


SIGNED = "doc_id long, mark long, n long, node binary, signature binary, bitmap binary"


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """SIGNED for docs (doc_id, text); mark is a hash of the text; node is a digest of the set, and with the rest null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            sets = list(shingle_sets(texts_of(batch), width))
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            nodes, signatures, bitmaps = ([None] * len(sets) for _ in range(3))
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                start = np.concatenate(([0], np.cumsum(n[full])))[:-1]
                digest = np.stack([np.add.reduceat(mix64(every ^ s), start) for s in SALT], axis=1)
                signature = np.empty((len(full), COORDINATES), np.uint32)
                for k, turn in enumerate(TURNS):
                    signature[:, k] = np.minimum.reduceat(((every * turn) >> U(32)).astype(np.uint32), start)
                cell = np.repeat(np.arange(len(full)) * BITS, n[full]) + ((every >> U(9)) & U(BITS - 1)).astype(np.int64)
                parity = np.packbits((np.bincount(cell, minlength=len(full) * BITS) & 1).astype(np.uint8).reshape(len(full), BITS), axis=1)
                for j, i in enumerate(full):
                    nodes[i], signatures[i], bitmaps[i] = digest[j].tobytes(), signature[j].tobytes(), parity[j].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (nodes, signatures, bitmaps)]], [f.split()[0] for f in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(tidied(run), SIGNED)


def short(node: str = "node"):
    """A class's place in joins; a clash only brings a class too many to a comparison."""
    return F.xxhash64(node)


def posts(classes: DataFrame) -> DataFrame:
    """(post, short): COORDINATES rows a class, one for each coordinate with its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = mix64(np.arange(1, COORDINATES + 1).astype(np.uint64))
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mix64(x ^ coordinate).ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column("short")), COORDINATES))], ["post", "short"])

    return classes.select(short().alias("short"), "signature").mapInArrow(tidied(run), "post long, short long")


def lists_of(classes: DataFrame) -> DataFrame:
    """(post, short, size): the lists that have to be merged, each with its length. See the module's text on skipping and prefixes."""
    each = posts(classes)
    several = each.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(each.join(several, "post"), "posts")
    own = Window.partitionBy("short")  # COORDINATES rows at most
    placed = met.withColumn("shared", F.count("*").over(own)).where(F.col("shared") >= MATCHES).withColumn("place", F.row_number().over(own.orderBy("n", "post")))
    prefix = cut(placed.where(F.col("place") <= F.col("shared") - (MATCHES - 1)).select("post", "short"), "prefixes")
    sizes = prefix.groupBy("post").agg(F.count("*").alias("size")).where("size > 1")
    return cut(prefix.join(sizes, "post").select("post", "short", "size"), "lists")


class Side:
    """Classes as arrays; numbering gives equal components equal numbers on both sides."""

    def __init__(self, table: pa.Table, numbering: dict):
        self.node = np.array(table.column("node").to_pylist(), object)
        self.n = np.asarray(table.column("n")).astype(np.int64)
        self.signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        self.bitmap = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        self.component = np.array([numbering.setdefault(x, len(numbering)) for x in table.column("component").to_pylist()], np.int64)

    def take(self, at: np.ndarray) -> Side:
        out = Side.__new__(Side)
        for name, values in vars(self).items():
            setattr(out, name, values[at])
        return out


def colliding(a: Side, i: np.ndarray, b: Side, j: np.ndarray, like: int) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs, those with MATCHES collisions that sizes and bitmaps don't rule out."""
    kept = []
    for at in range(0, len(i), 50_000):
        x, y = i[at : at + 50_000], j[at : at + 50_000]
        n, m = a.n[x], b.n[y]
        fit = (100 * np.minimum(n, m) >= like * np.maximum(n, m)) & (a.component[x] != b.component[y])
        x, y = x[fit], y[fit]
        # like * union <= 100 * common, and common is (n + m - difference) / 2 with a difference of the bitmaps' at least
        fit = np.bitwise_count(a.bitmap[x] ^ b.bitmap[y]).sum(axis=1, dtype=np.int64) <= (a.n[x] + b.n[y]) * (100 - like) / (100 + like)
        x, y = x[fit], y[fit]
        collisions = np.zeros(len(x), np.int64)
        for low in range(0, COORDINATES, STRIDE):
            collisions += (a.signature[x, low : low + STRIDE] == b.signature[y, low : low + STRIDE]).sum(axis=1)
            fit = collisions + (COORDINATES - low - STRIDE) >= MATCHES
            x, y, collisions = x[fit], y[fit], collisions[fit]
        kept.append((x, y))
    return (np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept])) if kept else (np.zeros(0, np.int64),) * 2


def near(a: Side, b: Side, like: int = LIKE) -> tuple[np.ndarray, np.ndarray]:
    """colliding pairs of all of a with all of b. The first words of the bitmaps rule most of them out."""
    rows, columns = [], []
    for at in range(0, len(a.n), 128):
        n, m = a.n[at : at + 128, None], b.n[None, :]
        fit = (100 * np.minimum(n, m) >= like * np.maximum(n, m)) & (a.component[at : at + 128, None] != b.component[None, :])
        differ = np.zeros(fit.shape, np.int16)
        for w in range(4):
            differ += np.bitwise_count(a.bitmap[at : at + 128, None, w] ^ b.bitmap[None, :, w])
        fit &= differ <= (n + m) * (100 - like) / (100 + like)
        i, j = np.nonzero(fit)
        i, j = colliding(a, at + i, b, j, like)
        rows.append(i)
        columns.append(j)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64),) * 2


def inside(side: Side, post: np.ndarray, like: int = LIKE) -> tuple[np.ndarray, np.ndarray]:
    """colliding pairs of one side that share a post: short lists all at once, longer ones each by itself."""
    order = np.argsort(post, kind="stable")
    sorted_ = post[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    size = np.diff(np.append(first, len(post)))
    rows, columns = [], []
    few = order[np.repeat(size <= FEW, size)]
    for step in range(1, FEW):
        pair = np.flatnonzero(post[few[step:]] == post[few[:-step]])
        if not len(pair):
            break
        i, j = colliding(side, few[pair], side, few[pair + step], like)
        rows.append(i)
        columns.append(j)
    for at, n in zip(first[size > FEW], size[size > FEW]):
        own = order[at : at + n]
        i, j = near(side.take(own), side.take(own), like)
        rows.append(own[i[i < j]])
        columns.append(own[j[i < j]])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64),) * 2


def forest(pairs: set[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """A spanning forest that prefers the pairs with the least hashes, so that different lists choose the same ones, and no node has many."""
    above: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for a, b in sorted(pairs, key=lambda p: (zlib.crc32(p[0] + p[1]), p)):
        x, y = root(a), root(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def candidates(dealt: DataFrame, spanning: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes from rows (task, left, right, from_left, post, node, n, signature, bitmap, component).

    A task with left -1 holds whole lists, in which all meet; in others, the rows from_left meet the others of one list."""

    def run(table: pa.Table) -> pa.Table:
        numbering: dict = {}
        if table.column("left")[0].as_py() == -1:
            a = b = Side(table, numbering)
            i, j = inside(a, np.asarray(table.column("post")))
        else:
            mine = pa.array(np.asarray(table.column("from_left")))
            a, b = Side(table.filter(mine), numbering), Side(table.filter(pa.compute.invert(mine)), numbering)
            i, j = near(a, b)
        pairs = {(min(x, y), max(x, y)) for x, y in zip(a.node[i], b.node[j])}
        pairs = forest(pairs) if spanning else sorted(pairs)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return dealt.groupBy("task", "left", "right").applyInArrow(run, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, members: DataFrame, docs: DataFrame, width: int, like: int) -> DataFrame:
    """pairs (a, b), with ok: whether their full sets are alike. members: (node, doc_id, mark), a document of each class."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # pick: a hash of id and text, which a null id only leaves out; a clash only brings a text too many
    asked = cut(ends.join(members, "node").select("node", F.xxhash64("doc_id", "mark").alias("pick")), "asked")
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("pick"), "text")
    picks = asked.select("pick").distinct()
    small = asked.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(picks) if small else picks, "pick", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            found = list(shingle_sets(texts_of(batch), width))
            nodes = [b"".join(mix64(s ^ salt).sum(dtype=np.uint64).tobytes() for salt in SALT) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    full = texts.mapInArrow(tidied(sets), "node binary, shingles binary").join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"])
    full = cut(full, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ok = []
                for x, y in zip(part.column("of_a"), part.column("of_b")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= like * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    return cut(both.mapInArrow(tidied(compare), "a binary, b binary, ok boolean"), "confirmed")


def grouped(docs: DataFrame, width: int = WIDTH, like: int = LIKE) -> DataFrame:
    """doc_id, mark, n_shingles, component, component_id for each row of docs (doc_id, text); component is null for an empty set. No other size of likeness than 80 or more: MATCHES is set for it."""
    if like < LIKE:
        raise ValueError(f"like: {LIKE} at least, for which the signatures are made")
    text_batches(docs.sparkSession)
    rows = cut(signed(docs, width), "signed")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark")).alias("of"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bitmap").alias("bitmap"))
    classes = cut(classes.select("node", "of.doc_id", "of.mark", "n", "signature", "bitmap"), "classes")
    lists = lists_of(classes)
    met = cut(classes.withColumn("short", short()).join(lists.select("short").distinct(), "short", "left_semi"), "met")
    members = classes.select("node", "doc_id", "mark")
    fat = met.select("short", "node", "n", "signature", "bitmap")

    # first round: lists of one block, many to a task; each block of a longer list by itself, and with the list's first block
    tasks = max(partitions(docs.sparkSession), lists.count() // TASK_ROWS)
    task = F.pmod(F.xxhash64("post"), F.lit(tasks))
    none, yes, no = F.lit(-1), F.lit(True), F.lit(False)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = lists.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("short", F.lit(1)), F.col("blocks")).cast("int"))
    whole = placed.where("blocks = 1").select("post", task.alias("task"), none.alias("left"), none.alias("right"), yes.alias("from_left"), "short")
    large = placed.where("blocks > 1")
    alone = large.select("post", F.col("post").alias("task"), none.alias("left"), F.col("block").alias("right"), yes.alias("from_left"), "short")
    firsts = large.where("block = 0").select("post", F.col("post").alias("task"), F.lit(0).alias("left"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("right"), yes.alias("from_left"), "short")
    others = large.where("block > 0").select("post", F.col("post").alias("task"), F.lit(0).alias("left"), F.col("block").alias("right"), no.alias("from_left"), "short")
    dealt = whole.unionByName(alone).unionByName(firsts).unionByName(others).join(fat, "short").withColumn("component", F.col("node")).drop("short")
    tried = confirmed(cut(candidates(dealt, True), "pairs"), members, docs, width, like)
    links = tried.where("ok").select("a", "b")

    # second round: lists that still hold several components; those outside of the largest meet all
    found = components(links)
    labelled = cut(met.select("short", "node", "n", "signature", "bitmap").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    named = lists.select("post", "short").join(labelled.select("short", "component"), "short")
    counts = named.groupBy("post", "component").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("post").agg(F.count("*").alias("components"), F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("size"), F.max("n").alias("most")).where("components > 1")
    open_ = open_.select("post", "major", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("lefts"))
    rest = cut(named.join(open_, "post"), "open")
    block = F.pmod(F.xxhash64("short", F.lit(2)), F.col("blocks")).cast("int")
    whole = rest.where("blocks = 1").select("post", task.alias("task"), none.alias("left"), none.alias("right"), yes.alias("from_left"), "short")
    large = rest.where("blocks > 1")
    outside = large.where("component != major").select("post", F.col("post").alias("task"), F.pmod(F.xxhash64("short", F.lit(3)), F.col("lefts")).cast("int").alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"), yes.alias("from_left"), "short")
    every = large.select("post", F.col("post").alias("task"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"), block.alias("right"), no.alias("from_left"), "short")
    more = candidates(whole.unionByName(outside).unionByName(every).join(labelled, "short").drop("short"), False)
    more = cut(more.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.unionByName(confirmed(more, members, docs, width, like).where("ok").select("a", "b"))
        found = components(links)

    least = found.join(members, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("node", "doc_id").join(found, "node", "left").join(least, "component", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.select("doc_id", "mark", F.col("n").alias("n_shingles"), "node").join(of_class, "node", "left").select("doc_id", "mark", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, like: int = LIKE) -> DataFrame:
    """docs without the rows that another row of their component stands for: the one with the least id, then mark. Texts without words stay."""
    rows = cut(grouped(docs, width, like), "groups")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark")).alias("first"))
    ranked = rows.where("component IS NOT NULL").join(first, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    gone = cut(ranked.where("NOT stays").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "gone")
    twice = cut(ranked.where("stays").groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    marked = docs.withColumn("__m", F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark"))
    left = marked.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    if not twice.isEmpty():  # repeated rows of one id and text
        blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
        left = left.where(blank).unionByName(left.where(~blank).dropDuplicates(["doc_id", "__m"]))
    return left.select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    made = grouped(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
