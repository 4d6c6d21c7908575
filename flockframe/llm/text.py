"""Whole-batch byte work on texts inside Arrow tasks: words, their hashes, shingles.

A chunk is the UTF-8 bytes of several texts laid end to end, with their offsets. Everything
is numpy over the chunk, so the cost is a few nanoseconds a byte and memory is bounded by
the chunk (or by one text, where that is longer).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 20
_U = np.uint64
_M64 = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing): ASCII letters, digits, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: bijective, all bits depend on all bits."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random number for each byte value.
BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(CHUNK, 1 << int(n).bit_length()))


def byte_names() -> dict[str, int]:
    """The byte that each character of the vocabulary's tokens stands for: printable ones for themselves, the others
    for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def documents(df: DataFrame, *keys: str) -> DataFrame:
    """Key columns and ``text`` of a table of documents, null texts as empty ones."""
    return df.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes laid end to end and offsets (one more than texts) of a string column."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, column.offset + len(column) + 1)[column.offset:]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str = "text", limit: int = CHUNK):
    """Slices of record batches with at most ``limit`` bytes of text (a longer text: alone), with their bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        start, n = 0, len(offsets) - 1
        while start < n:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
            start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Start and end byte of each word, and the first word of each text (one more than texts)."""
    n = len(data)
    word = inside[data]
    starts, ends = word.copy(), word.copy()
    if n:
        starts[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        starts[cut] = word[cut]
        ends[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each span, by prefix sums of a polynomial."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, _U)
    prefix = np.zeros(n + 1, _U)
    np.cumsum(BYTE[data] * powers(_BASE, n)[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED):
    """Hashes of the lower-cased words, and the first word of each text."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, inside)
    return span_hashes(data, starts, ends), first


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on (k - 1 fewer than words)."""
    if len(hashes) < k:
        return np.zeros(0, _U)
    out = np.zeros(len(hashes) - k + 1, _U)
    for i in range(k):
        out = out * _U(_BASE) + hashes[i:len(hashes) - k + 1 + i]
    return mix(out + _U(k))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int):
    """Sorted distinct hashes of the k-word runs of each text.

    A text of fewer words gives its whole sequence as one; one without words the empty set.
    """
    runs = run_hashes(hashes, k)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            yield np.unique(runs[a:b - k + 1])
        else:
            yield run_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def binary(arrays: list[np.ndarray]) -> pa.Array:
    """Each array's bytes as one binary value."""
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def lists(flat: np.ndarray, width: int) -> pa.Array:
    """Rows of ``width`` numbers as a list column."""
    flat = np.ascontiguousarray(flat).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))


def out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type)
                            for k, c in columns.items()], schema=schema)


def filtered(df: DataFrame, keep, limit: int = CHUNK) -> DataFrame:
    """Rows, all columns, whose text ``keep(bytes, offsets)`` says true for; it gets chunks of ``limit`` bytes."""
    def run(batches):
        for rows, data, offsets in chunks(batches, limit=limit):
            yield rows.filter(pa.array(keep(data, offsets)))
    return df.mapInArrow(run, df.schema)
