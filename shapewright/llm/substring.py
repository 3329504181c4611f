"""Substring deduplication by De Bruijn compaction.

The graph: nodes are runs of WIDTH - 1 words, and a window of WIDTH words is an edge from its first to its last node. Only edges that
start in two documents or more are part of it. An edge's source is its least coordinate: smallest document, then first place.

1. Nodes are dealt into buckets by the least hash of their word triples, so that neighbours in a text mostly travel together, as one run
   with one coordinate; an edge goes to the buckets of both its nodes. So all edges of a node are in its bucket, which knows its
   in-degree and out-degree. Buckets that a sample shows to be large are dealt again by the nodes' own hashes.
2. A node with one edge in and one out doesn't branch. Inside a bucket, edges that meet in such a node, and whose sources follow each
   other, become a piece; a piece whose last node belongs to another bucket is open there.
3. Pieces become nonbranching paths through Spark joins: an open end shares its edge with an open beginning in another bucket.
4. Documents walk along paths: an occurrence of an edge outside of its source is joined with the edge's path, and occurrences that follow
   each other in the text and on one path become a span.
5. Every span is verified: its words, read at the document's and at the source's coordinates by joins with the documents, must be the
   same; windows of a span that fails are decided again by wider hashes over all documents. What verified spans cover goes.

A window that a task sees in two documents is decided there, and sent on for the smaller one only, marked as repeated, so that a passage
in every document costs each task one edge.

Defined cases: words are runs of bytes other than the six ASCII spaces; a null text has no words; a text of fewer words than WIDTH has
no window; ids that are null count as larger than all others; rows with the same id are one document of several texts, told apart by a
hash of the text, whose windows don't cross from one to another and never remove words of each other; equal rows get equal results;
other columns stay, those with the names of added ones are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.llm.common import cut, partitions, read, text_batches
from shapewright.llm.textkernel import Words, chunks, mix64, places, shingles, texts_of, tidied

WIDTH = 13
TRIPLE = 3
CHUNK = 2_000_000
#: Bytes of input to a bucket.
BUCKET_BYTES = 2_000_000
#: Bits of a node's hash; an edge has two. Fewer for tests.
NODE_BITS = 40
NODE_BYTES = 5
#: Windows beyond which a bucket is dealt by its nodes' own hashes, and one in how many documents is looked at for that. This only
#: decides where work is done.
HEAVY, LOOK = 16_000_000, 64
#: Windows of failed spans that are decided again at once.
SUSPECTS = 1_000_000

U = np.uint64
NO_ID = np.iinfo(np.int64).max
RUN, SPAN = b"\x00", b"\x01"
KEY = ["doc", "mark"]
SPANS = "doc long, mark long, start long, n long, source long, source_mark long, source_start long, path long"
#: What buckets find: pieces (doc, mark, start, n and the open ends), and occurrences as SPANS, path being the place where their piece starts.
FOUND = SPANS + ", left_open boolean, right_open boolean"


def packed(kind: bytes, columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, which compress well."""
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return kind + len(columns[0]).to_bytes(8, "little") + b"".join(planes) + tail


def unpacked(payload: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    n, at, out = int.from_bytes(payload[1:9], "little"), 9, []
    for _ in range(columns):
        out.append(np.ascontiguousarray(np.frombuffer(payload, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel())
        at += 8 * n
    return out, payload[at:]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    out, reach = x, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


class Edges:
    """Edges as arrays: document, mark of the text, place, nodes, whether repeated elsewhere, and more by name."""

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at: np.ndarray) -> Edges:
        return Edges(**{name: values[at] for name, values in vars(self).items()})

    def follows(self, of: str = "") -> np.ndarray:
        """Whether each edge comes right after the one before it, in its text, or with of in another one."""
        doc, mark, pos = (getattr(self, of + name) for name in ("doc", "mark", "pos"))
        out = np.zeros(len(doc), bool)
        out[1:] = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (pos[1:] == pos[:-1] + 1)
        return out


def key_of(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    return mix64(tail * U(0x9E3779B97F4A7C15) + mix64(head))


def repeated(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the edges that start in two documents, or are marked so: all their indices, that of the source for each, and the distinct sources."""
    key = key_of(e.tail, e.head)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    order = order[same[1:] | same[:-1] | e.again[order]]
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    order = order[np.lexsort((e.pos[order], e.mark[order], e.doc[order], key[order]))]
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(first, len(k)))
    least, most = order[first], order[first + size - 1]
    counts = (e.doc[most] > e.doc[least]) | np.logical_or.reduceat(e.again[order], first)
    return order[np.repeat(counts, size)], np.repeat(least, size)[np.repeat(counts, size)], least[counts]


def spans_of(e: Edges, hit: np.ndarray, source: np.ndarray, path: np.ndarray) -> list[np.ndarray]:
    """SPANS of the edges hit, those that follow each other in the text, at the source and on one path in one."""
    by_place = np.argsort(hit, kind="stable")
    hit, source, path = hit[by_place], source[by_place], path[by_place]
    here = e.take(hit)
    there = e.take(source)
    first = np.flatnonzero(~(here.follows() & there.follows() & np.concatenate((np.zeros(min(len(path), 1), bool), path[1:] == path[:-1]))))
    n = np.diff(np.append(first, len(hit)))
    return [here.doc[first], here.mark[first], here.pos[first], n, there.doc[first], there.mark[first], there.pos[first], path[first]]


def edges_of(batch: pa.RecordBatch, buckets: int, heavy: np.ndarray, bits: int) -> Edges:
    """All windows of a batch (doc, mark, text), with the buckets of both nodes."""
    words = Words(texts_of(batch))
    hashes = words.hashes()
    at, text = places(words.first, WIDTH)
    doc = np.asarray(pa.compute.fill_null(batch.column("doc"), NO_ID))[text]
    mark = np.asarray(batch.column("mark"))[text]
    if not len(at):
        none = np.zeros(0, np.uint64)
        return Edges(doc=doc, mark=mark, pos=at, tail=none, head=none, again=np.zeros(0, bool), of_tail=at, of_head=at)
    node = shingles(hashes, WIDTH - 1)
    bucket = (mix64(sliding_least(shingles(hashes, TRIPLE), WIDTH - TRIPLE)) % U(buckets)).astype(np.int64)
    if len(heavy):
        large = np.isin(bucket, heavy)
        bucket[large] = buckets + (mix64(node[large]) % U(buckets)).astype(np.int64)
    node >>= U(64 - bits)
    return Edges(doc=doc, mark=mark, pos=at - words.first[text], tail=node[at], head=node[at + 1], again=np.zeros(len(at), bool), of_tail=bucket[at], of_head=bucket[at + 1])


def runs_of(batch: pa.RecordBatch, buckets: int, heavy: np.ndarray, bits: int = NODE_BITS) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload): runs of edges, and spans that are decided here."""
    e = edges_of(batch, buckets, heavy, bits)
    if not len(e):
        return
    every, least, _ = repeated(e)
    away = e.doc[every] > e.doc[least]
    if away.any():
        hit = every[away]
        yield int(e.doc[hit[0]] % buckets), packed(SPAN, spans_of(e, hit, least[away], np.full(len(hit), -1)))
        e.again[least[away]] = True
        stay = np.ones(len(e), bool)
        stay[hit] = False
        e = e.take(stay)
    both = np.flatnonzero(e.of_tail != e.of_head)
    index = np.concatenate((np.arange(len(e)), both))
    bucket = np.concatenate((e.of_tail, e.of_head[both]))
    order = np.lexsort((index, bucket))
    bucket, e = bucket[order], e.take(index[order])
    # a run goes on over a node of this bucket only
    goes_on = e.follows()
    goes_on[1:] &= (bucket[1:] == bucket[:-1]) & (e.of_tail[1:] == bucket[1:])
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(e)) - 1
    n = last - first + 1
    own = n * 4 + (e.of_tail[first] == bucket[first]) * 2 + (e.of_head[last] == bucket[first])
    cuts = np.flatnonzero(np.concatenate(([True], bucket[first][1:] != bucket[first][:-1])))
    for low, high in zip(cuts, np.append(cuts[1:], len(first))):
        begin, end = first[low], last[high - 1] + 1
        stops = last[low:high]
        nodes = np.insert(e.tail[begin:end], stops - begin + 1, e.head[stops])
        tail = nodes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NODE_BYTES].tobytes() + np.packbits(e.again[begin:end]).tobytes()
        runs = first[low:high]
        yield int(bucket[begin]), packed(RUN, [e.doc[runs], e.mark[runs], e.pos[runs], own[low:high]], tail)


def unfolded(payloads: list[bytes]) -> tuple[Edges | None, list[list[np.ndarray]]]:
    """The edges of a bucket's runs, and the spans that were decided before."""
    parts, done = [], []
    for payload in payloads:
        if payload[:1] == SPAN:
            done.append(unpacked(payload, 8)[0])
            continue
        columns, tail = unpacked(payload, 4)
        n = columns[3] >> 2
        nodes = int(n.sum() + len(n)) * NODE_BYTES
        wide = np.zeros((nodes // NODE_BYTES, 8), np.uint8)
        wide[:, :NODE_BYTES] = np.frombuffer(tail, np.uint8, nodes).reshape(-1, NODE_BYTES)
        parts.append([*columns, wide.view("<u8").ravel(), np.unpackbits(np.frombuffer(tail, np.uint8, offset=nodes), count=int(n.sum())).astype(bool)])
    if not parts:
        return None, done
    doc, mark, start, own, node, again = (np.concatenate(x) for x in zip(*parts))
    n = own >> 2
    begin = np.cumsum(n) - n
    step = np.arange(len(again)) - np.repeat(begin, n)
    at = np.arange(len(again)) + np.repeat(np.arange(len(n)), n)  # a run has a node more than edges
    tail_in, head_in = np.ones(len(again), bool), np.ones(len(again), bool)
    tail_in[begin], head_in[begin + n - 1] = own & 2 > 0, own & 1 > 0
    return Edges(doc=np.repeat(doc, n), mark=np.repeat(mark, n), pos=np.repeat(start, n) + step, tail=node[at], head=node[at + 1], again=again, tail_in=tail_in, head_in=head_in), done


def unbranched(graph: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Of each edge of the graph, whether its tail and its head are nodes of this bucket with one edge in and one out."""
    out, into = np.flatnonzero(graph.tail_in), np.flatnonzero(graph.head_in)
    _, node = np.unique(np.concatenate((graph.tail[out], graph.head[into])), return_inverse=True)
    most = int(node.max(initial=-1)) + 1
    one = (np.bincount(node[: len(out)], minlength=most) == 1) & (np.bincount(node[len(out) :], minlength=most) == 1)
    tail, head = np.zeros(len(graph), bool), np.zeros(len(graph), bool)
    tail[out], head[into] = one[node[: len(out)]], one[node[len(out) :]]
    return tail, head


def resolved(table: pa.Table) -> pa.Table:
    """FOUND of one bucket's payloads."""
    e, spans = unfolded(table.column("payload").to_pylist())
    pieces = [np.zeros(0, np.int64)] * 6
    if e is not None:
        every, least, sources = repeated(e)
        sources = sources[np.lexsort((e.pos[sources], e.mark[sources], e.doc[sources]))]
        graph = e.take(sources)
        tail, head = unbranched(graph)
        goes_on = graph.follows()
        goes_on[1:] &= head[:-1] & tail[1:]
        first = np.flatnonzero(~goes_on)
        last = np.append(first[1:], len(graph))[: len(first)].astype(np.int64) - 1
        pieces = [graph.doc[first], graph.mark[first], graph.pos[first], last - first + 1, ~graph.tail_in[first], ~graph.head_in[last]]
        piece = np.zeros(len(e), np.int64)  # of each source, the place where its piece starts
        piece[sources] = np.repeat(graph.pos[first], last - first + 1)
        away = (e.doc[every] > e.doc[least]) & e.tail_in[every]  # the tail's bucket tells of an edge
        spans.append(spans_of(e, every[away], least[away], piece[least[away]]))
    columns = [np.concatenate(x) for x in zip(*spans)] if spans else [np.zeros(0, np.int64)] * 8
    made, walked = len(pieces[0]), len(columns[0])
    blank = lambda n, kind: pa.nulls(n, kind)
    out = [pa.chunked_array([pa.array(a, pa.int64()), pa.array(b, pa.int64())]) for a, b in zip(pieces[:4], columns[:4])]
    out += [pa.chunked_array([blank(made, pa.int64()), pa.array(c, pa.int64())]) for c in columns[4:]]
    out += [pa.chunked_array([pa.array(c.astype(bool), pa.bool_()), blank(walked, pa.bool_())]) for c in pieces[4:]]
    return pa.table(out, [f.split()[0] for f in FOUND.split(", ")])


def paths_of(pieces: DataFrame) -> DataFrame:
    """(doc, mark, start, path): the place where the nonbranching path of each piece starts.

    A piece with an open end and one with an open beginning belong together if they share that edge. As edges of a path follow each other
    at the source, what is joined lies in one text there, in order."""
    ends = pieces.where("right_open").select(*KEY, (F.col("start") + F.col("n") - 1).alias("start"), F.lit(True).alias("joined"))
    both = pieces.join(ends.hint("merge"), [*KEY, "start"], "left").withColumn("joined", F.col("left_open") & F.coalesce("joined", F.lit(False)))
    before = Window.partitionBy(*KEY).orderBy("start", "left_open").rowsBetween(Window.unboundedPreceding, 0)  # one text's pieces
    return both.withColumn("path", F.max(F.when(~F.col("joined"), F.col("start"))).over(before)).groupBy(*KEY, "start").agg(F.min("path").alias("path"))


def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPANS sorted by coordinates, joined where one goes on as the next on its path."""
    for batch in batches:
        doc, mark, start, n, source, source_mark, source_start, path = (np.asarray(batch.column(i)) for i in range(8))
        new = np.ones(len(doc), bool)
        same = [(c[1:] != c[:-1]) for c in (doc, mark, source, source_mark, path)]
        new[1:] = np.logical_or.reduce(same) | (start[1:] != start[:-1] + n[:-1]) | (source_start[1:] != source_start[:-1] + n[:-1])
        first = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first], mark[first], start[first], np.add.reduceat(n, first) if len(first) else n, source[first], source_mark[first], source_start[first], path[first])], batch.schema.names)


def heavy_buckets(rows: DataFrame, buckets: int) -> np.ndarray:
    """Buckets with more than HEAVY windows, told from one document in LOOK; with B windows in all there are B / HEAVY at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            bucket, n = np.unique(edges_of(batch, buckets, np.zeros(0, np.int64), NODE_BITS).of_tail, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int64())], ["bucket", "n"])

    some = rows.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(LOOK)) == 0).select("doc", "mark", "text")
    found = some.mapInArrow(tidied(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") * LOOK > HEAVY)
    return np.array(sorted(r.bucket for r in found.select("bucket").collect()), np.int64)


def graph_of(rows: DataFrame) -> DataFrame:
    """FOUND of rows (doc, mark, text)."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not 0 < size < 1 << 55:  # not known: count
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(2 * partitions(spark), size // BUCKET_BYTES + 1))
    heavy = heavy_buckets(rows, buckets) if size > HEAVY else np.zeros(0, np.int64)
    bits = NODE_BITS

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            made = list(runs_of(batch, buckets, heavy, bits))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([p for _, p in made], pa.binary())], ["bucket", "payload"])

    sent = rows.select("doc", "mark", "text").mapInArrow(tidied(edges), "bucket long, payload binary")
    return cut(sent.groupBy("bucket").applyInArrow(resolved, FOUND), "graph")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """SPANS of rows (doc, mark, text)."""
    found = graph_of(rows)
    names = [f.split()[0] for f in SPANS.split(", ")]
    walked = found.where("left_open IS NULL").select(*names)
    paths = paths_of(found.where("left_open IS NOT NULL").select(*names[:4], "left_open", "right_open"))
    known = paths.select(F.col("doc").alias("source"), F.col("mark").alias("source_mark"), F.col("start").alias("piece"), "path")
    on = walked.where("path >= 0").withColumnRenamed("path", "piece").join(known, ["source", "source_mark", "piece"]).select(*names)
    order = on.unionByName(walked.where("path < 0")).repartition(partitions(rows.sparkSession), *KEY).sortWithinPartitions(*KEY, "start")
    return cut(order.mapInArrow(tidied(glued), SPANS), "spans")


def joined(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """rows (doc, mark, ...) with the list of their text. Both sides are shuffled, at any size: lists grow with the corpus."""
    return rows.join(lists.hint("merge"), KEY, how)


def digests(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, mark, start, n, digest) of spans (doc, mark, start, n), in words."""
    lists = spans.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(i, 256)
                for doc, mark, text, of in zip(*[part.column(c).to_pylist() for c in ("doc", "mark", "text", "spans")]):
                    words = text.encode().split()
                    out += [(doc, mark, s["start"], s["n"], hashlib.blake2b(b" ".join(words[s["start"] : s["start"] + s["n"]]), digest_size=16).digest()) for s in of]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "mark", "start", "n", "digest"])

    return joined(rows, lists, "inner").mapInArrow(tidied(run), "doc long, mark long, start long, n long, digest binary")


def verified(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spans whose words are those at their source, and the others."""
    long = spans.withColumn("words", F.col("n") + (WIDTH - 1))
    asked = long.select(*KEY, "start", F.col("words").alias("n")).unionByName(long.select(F.col("source").alias("doc"), F.col("source_mark").alias("mark"), F.col("source_start").alias("start"), F.col("words").alias("n")))
    read_ = cut(digests(rows, asked), "digests")
    here = read_.select(*KEY, "start", F.col("n").alias("words"), "digest")
    there = read_.select(F.col("doc").alias("source"), F.col("mark").alias("source_mark"), F.col("start").alias("source_start"), F.col("n").alias("words"), F.col("digest").alias("other"))
    both = long.join(here, [*KEY, "start", "words"]).join(there, ["source", "source_mark", "source_start", "words"])
    both = cut(both.select(*KEY, "start", "n", (F.col("digest") == F.col("other")).alias("same")), "verified")
    return both.where("same").drop("same"), both.where("NOT same").drop("same")


def decided_again(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """(doc, mark, start, n) of the windows of failed spans whose words do start in a document with a smaller id, by 128-bit digests."""
    spark = rows.sparkSession
    one = failed.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("start")).withColumn("n", F.lit(WIDTH).cast("bigint"))
    asked = cut(digests(rows, one), "asked")
    if asked.count() > SUSPECTS:
        raise RuntimeError(f"more than {SUSPECTS} windows have clashing fingerprints")
    wanted = spark.sparkContext.broadcast({bytes(r.digest) for r in asked.select("digest").distinct().toLocalIterator()})  # SUSPECTS digests at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode().split()
                for i in range(len(words) - WIDTH + 1):
                    d = hashlib.blake2b(b" ".join(words[i : i + WIDTH]), digest_size=16).digest()
                    if d in wanted.value:
                        out.add((doc, d))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["doc", "digest"])

    least = rows.select("doc", "text").mapInArrow(tidied(run), "doc long, digest binary").groupBy("digest").agg(F.min("doc").alias("least"))
    return cut(asked.join(least, "digest").where("least < doc").select(*KEY, "start", F.lit(1).cast("bigint").alias("n")), "again")


ADDED = ("n_words", "n_removed", "kept")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept: the words that stay joined by one space, or with spaced the text without the removed words, each with the white space before it.

    In a table in which an id occurs again, texts are told apart by their hashes."""
    text_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ADDED]
    text, doc = F.coalesce(text_col, F.lit("")), F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID)))
    repeats = not docs.groupBy(F.col(id_col).cast("bigint").alias("doc")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    mark = F.xxhash64(text) if repeats else F.lit(0).cast("bigint")
    rows = docs.select(doc.alias("doc"), mark.alias("mark"), text.alias("text"))
    if repeats:
        rows = cut(rows.dropDuplicates(KEY), "texts")
    spans = repeated_spans(rows)
    good, failed = verified(rows, spans)
    if not failed.isEmpty():
        good = good.unionByName(decided_again(rows, failed))
    lists = good.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("__spans"))

    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    base = docs.select(*own, text.alias("__of"), doc.alias("__doc"), mark.alias("__mark"))
    here = lists.withColumnsRenamed({"doc": "__doc", "mark": "__mark"}).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                total, gone, kept = [], [], []
                for t, spans in zip(*[part.column(c).to_pylist() for c in ("__of", "__spans")]):
                    data = t.encode()
                    words = data.split()
                    n = len(words)
                    stay = bytearray(b"\x01") * n
                    for s in spans or ():
                        low, high = s["start"], s["start"] + s["n"] + WIDTH - 1
                        stay[low:high] = bytes(high - low)
                    left = list(compress(words, stay)) if spans else words
                    total.append(n)
                    gone.append(n - len(left))
                    kept.append((without(data, stay) if spans else data) if spaced else b" ".join(left))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], [*own, *ADDED])

    return base.join(here, ["__doc", "__mark"], "left").drop("__doc", "__mark").mapInArrow(tidied(run), schema)


def without(data: bytes, stay: bytearray) -> bytes:
    """data without the words that don't stay, and the white space before each of them."""
    words = Words([data])
    begins = np.concatenate(([0], words.ends))
    keep = np.append(np.frombuffer(stay, bool), True)  # what follows the last word stays
    stops = np.append(words.ends, len(data))
    return b"".join(data[a:b] for a, b, k in zip(begins.tolist(), stops.tolist(), keep.tolist()) if k)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    made = remove(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
