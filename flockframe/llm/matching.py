"""Sequences of tokens with as few of them as large-item matching and best fit can do.

Pieces of one length are alike, so the packing is settled on the counts of the lengths, whatever the number
of documents: pieces above a third of a sequence come two at most to a sequence and are matched greedily, the
rest goes to the least gap that holds it. The plan gives ranges of ranks within a length; each piece finds its
rank by the counts of the tasks before its own, and with it its sequence and place.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpoint
from . import text as X

LENGTH = 1024
END = 2
#: Fixed values of the tokenizer: how it cuts a text before merging bytes, and its special token.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict = {}


def encoder(vocabulary: str):
    """Byte-level encoder over a vocabulary file whose ids follow the order of its merges."""
    if vocabulary not in _ENCODERS:
        import tiktoken
        names = X.byte_names()
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(names[c] for c in token): k for token, k in vocab.items() if token != SPECIAL}
        _ENCODERS[vocabulary] = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKENS, mergeable_ranks=ranks,
                                                  special_tokens={SPECIAL: len(ranks)})
    return _ENCODERS[vocabulary]


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Kinds of sequences, each its (piece length, how many) and the number of such sequences.

    ``counts`` has the number of pieces of each length. Longest first, a piece above a third of ``length`` is
    matched with the longest other that fits. Then, longest first, each other piece goes where the least gap is left.
    """
    left = {n: c for n, c in counts.items() if c}
    gaps: dict[int, list] = {}
    order: list[int] = []

    def put(kind, number, gap):
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((kind, number))

    large = sorted(n for n in left if 3 * n > length)
    while large:
        a = large[-1]
        at = bisect_left(large, length - a + 1) - 1
        if at < 0:
            put(((a, 1),), left[a], length - a)
            left[a] = 0
        elif large[at] == a:
            if left[a] > 1:
                put(((a, 2),), left[a] // 2, length - 2 * a)
                left[a] %= 2
            if left[a]:  # the last of its length goes with a shorter one, if any
                shorter = large[at - 1] if at else None
                put(((a, 1), (shorter, 1)) if shorter else ((a, 1),), 1, length - a - (shorter or 0))
                left[a] = 0
                if shorter:
                    left[shorter] -= 1
        else:
            b, n = large[at], min(left[a], left[large[at]])
            put(((a, 1), (b, 1)), n, length - a - b)
            left[a] -= n
            left[b] -= n
        large = [n for n in large if left[n]]

    for s in sorted((n for n in left if left[n]), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                gap, kind, number = length, (), n  # new sequences
            else:
                gap = order[at]
                kind, number = gaps[gap].pop()
            each = gap // s
            full = min(number, n // each)
            n -= full * each
            if full:
                put((*kind, (s, each)), full, gap - each * s)
            if n and full < number:
                some = min(n, each - 1)
                put((*kind, (s, some)), 1, gap - some * s)
                n, full = n - some, full + 1
            if kind and full < number:
                put(kind, number - full, gap)
            if gap in gaps and not gaps[gap]:
                del gaps[gap]
                order.remove(gap)
    return [entry for gap in order for entry in gaps[gap]]


def dealt(kinds) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on pieces go to which sequence, how many to each, and where in it."""
    rows, ranks, sequence = [], {}, 0
    for kind, number in kinds:
        offset = 0
        for n, each in kind:
            first = ranks.get(n, 0)
            rows.append((n, first, each, sequence, offset))
            ranks[n] = first + each * number
            offset += n * each
        sequence += number
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), columns))


_PIECES = pa.schema([("part", pa.int32()), ("local", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()),
                     ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_TYPES = "part int, local long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _cut(vocabulary: str, length: int, with_ids: bool):
    def run(batches):
        enc = encoder(vocabulary)
        seen = np.zeros(length + 1, np.int64).tolist()
        for rows, data, offsets in X.chunks(batches):
            raw = data.tobytes()
            got = {c: [] for c in _PIECES.names}
            part, docs = rows.column("part").to_pylist(), rows.column("doc_id").to_pylist()
            for k, doc in enumerate(docs):
                text = raw[offsets[k]:offsets[k + 1]].decode("utf-8", "replace")
                ids = enc.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() + END.to_bytes(4, "little")
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    size = n % length or length if start == 0 else length
                    own = ids[4 * start:4 * (start + size)]
                    for c, v in zip(_PIECES.names, (part[k], seen[size], doc, piece, start, size, zlib.crc32(own),
                                                    own if with_ids else None)):
                        got[c].append(v)
                    seen[size] += 1
                    start, piece = start + size, piece + 1
            yield X.out(_PIECES, **got)
    return run


_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _place(places):
    def run(batches):
        p = places.value
        keys = (p["length"] << 48) + p["first"]
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            inside, slot = np.divmod(rank - p["first"][at], p["each"][at])
            yield X.out(_PLACED, **{c: rows.column(c) for c in _PLACED.names[:5]}, sequence_id=p["sequence"][at] + inside,
                        offset=p["offset"][at] + slot * length, ids=rows.column("ids"))
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and an end (id 2). One of more than ``length`` is cut into pieces of ``length``, its first may be
    shorter; no other is cut. ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, ``ids_crc32``
    is their checksum. ``sequence_id`` counts from 0.

    To the driver come the counts of the lengths (``length`` numbers), back goes the plan for them. The rank of a piece
    is its place among those of its length in its task, and their count in the tasks before; so a length that
    holds a third of all pieces is one number a task, and its pieces stay where they are.

    Null, empty and blank texts are packed as what they hold, at least the end. Repeated documents, and those without an
    id (null), are packed as rows of their own. Other columns are not looked at; an empty table gives no rows. ``vocabulary``
    is a file that every executor can read.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    rows = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"))
    pieces = checkpoint(rows.mapInArrow(_cut(vocabulary, length, with_ids), _TYPES))
    counts = checkpoint(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    places = spark.sparkContext.broadcast(dealt(plan(totals, length)))
    placed = ranked.mapInArrow(_place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                               "sequence_id long, offset long, ids binary")
    return placed if with_ids else placed.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, n_tokens, ids) of pieces packed ``with_ids``; a sequence has ``length`` ids at most."""
    joined = F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"]
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.aggregate(joined, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
