"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is merged by itself. A segment tree over the byte positions of a match holds, for each live
position, the rank of the pair that starts there; its root is the lowest rank, the leftmost first. A merge changes three leaves,
each in a logarithm of the match's length, so that even a match of a megabyte costs n log n.

Defined cases: a null text is empty: no ids, an empty decoding; other columns stay, and input columns with the names of added ones
are replaced; repeated rows are rows; an empty table gives an empty one. Texts are taken whole, one at a time.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.llm.common import read, text_batches
from shapewright.llm.textkernel import tidied

NONE = 1 << 62
#: Matches kept encoded by a Python worker: so many recent ones, and as many from before that.
KEPT = 300_000
#: Texts longer than this are split match by match, not into one list.
LONG = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))  # of the token at each live position; the next live position too
    before = list(range(-1, n - 1))
    get = ranks.get
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(piece[i : i + 2], NONE)
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    while (least := tree[1]) != NONE:
        i = 1
        while i < width:
            i *= 2
            if tree[i] != least:
                i += 1
        at = i - width
        gone = end[at]
        end[at] = stop = end[gone]
        if stop < n:
            before[stop] = at
        changed = [(gone, NONE)]
        if stop < n and end[stop] - at <= longest:
            changed.append((at, get(piece[at : end[stop]], NONE)))
        else:
            changed.append((at, NONE))
        left = before[at]
        if left >= 0:
            changed.append((left, get(piece[left:stop], NONE) if stop - left <= longest else NONE))
        for leaf, rank in changed:
            i = width + leaf
            tree[i] = rank
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                a = a if a <= b else b
                if tree[i] == a:
                    break
                tree[i] = a
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec(dict):
    """Matches already encoded, as little-endian unsigned 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.longest, self.pattern = ranks, max(map(len, ranks)), regex.compile(pattern)
        self.older: dict[str, bytes] = {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = merge(piece.encode(), self.ranks, self.longest)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        return b"".join(b"".join(self[m[0]] for m in some) for some in batched(self.pattern.finditer(text), 65_536))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """One for each Python worker and vocabulary; ranks: a broadcast of a vocabulary file's table (50,256 entries for the default)."""
    key = (ranks._jbid if hasattr(ranks, "_jbid") and ranks._jbid else id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def _mapped(df: DataFrame, added: list[tuple[str, T.DataType]], of: str, make) -> DataFrame:
    """df with columns made from one column; make(value) gives a tuple."""
    text_batches(df.sparkSession)
    own = [f for f in df.schema.fields if f.name not in {n for n, _ in added}]
    schema = T.StructType([*own, *[T.StructField(n, t) for n, t in added]])
    given = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                made = list(zip(*[make(v.as_py()) for v in part.column("__of")], strict=True)) or [[] for _ in added]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in given], *[pa.array(x, pa.binary()) for x in made]], [*given, *[n for n, _ in added]])

    return df.select(*given, F.col(of).alias("__of")).mapInArrow(tidied(run), schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """df with ids: binary, little-endian unsigned 32-bit; and, if asked for, decoded: those ids' bytes."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def make(text: str | None) -> tuple:
        codec = _codec(ranks, pattern)
        ids = codec.encode(text or "")
        return (ids, codec.decode(ids)) if decoded else (ids,)

    return _mapped(df, [("ids", T.BinaryType()), ("decoded", T.BinaryType())][: 1 + decoded], text_col, make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded: the bytes of the ids."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    return _mapped(df, [("decoded", T.BinaryType())], ids_col, lambda ids: (_codec(ranks, pattern).decode(ids or b""),))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    made = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return made.withColumns({"n_tokens": F.expr("CAST(octet_length(ids) div 4 AS BIGINT)"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
