"""Benchmark passages in documents by Wu-Manber search over words.

The strings sought are windows of ten words of the benchmark's items. A table says for each block of
two words how far a window can be shifted when its last block is that one; most places of a
text are skipped. Where the shift is zero, the hash of the window picks the strings that end so, and
their bytes are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as X

WINDOW = 10
BLOCK = 2
#: Ends of windows that one cursor runs over; many cursors advance together.
SEGMENT = 128
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes several.
PACK_BYTES = 4 << 20


class _Group:
    """Windows of one length: shift table by block, and the strings by their hash."""

    def __init__(self, data, starts, ends, hashes, windows, length):
        self.length, self.block = length, min(BLOCK, length)
        runs = X.run_hashes(hashes, length)
        self.strings: dict[int, dict[bytes, set]] = {}
        for at, item in windows:
            text = b" ".join(bytes(data[starts[i]:ends[i]]) for i in range(at, at + length))
            self.strings.setdefault(int(runs[at]), {}).setdefault(text, set()).add(item)
        self.known = np.array(sorted(self.strings), np.uint64)
        at = np.unique(np.array([w[0] for w in windows]))
        self.mask = np.uint64((1 << max(12, int(16 * len(at) * length).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, length - self.block + 1, np.int8)
        blocks = X.run_hashes(hashes, self.block)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, (blocks[at + end - self.block] & self.mask).astype(np.int64), length - end)

    def places(self, hashes, first):
        """First word and hash of each window of the texts that may be one of the strings."""
        m, b = self.length, self.block
        blocks = X.run_hashes(hashes, b)
        n = np.maximum(0, np.diff(first) - m + 1)  # windows of each text
        segments = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), segments)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments)
        at = first[:-1][text] + nth * SEGMENT
        stop = np.minimum(at + SEGMENT, first[:-1][text] + n[text])
        found = []
        while len(at):
            shift = self.shift[(blocks[at + m - b] & self.mask).astype(np.int64)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        runs = np.zeros(len(found), np.uint64)
        if len(found):
            runs = X.run_hashes(hashes, m)[found]
        near = self.known[np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)] == runs
        return found[near], runs[near]


class Matcher:
    """All windows of some items [(id or None, text)], grouped by length."""

    def __init__(self, items: list[tuple[str | None, str]]):
        data, offsets = X.utf8(pa.array([t for _, t in items], pa.large_string()))
        data = X.LOWER[data]
        starts, ends, first = X.word_spans(data, offsets, X.ALNUM)
        hashes = X.span_hashes(data, starts, ends)
        windows: dict[int, list] = {}
        for k, (name, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            if b > a:
                length = min(WINDOW, b - a)
                windows.setdefault(length, []).extend((i, name) for i in range(a, b - length + 1))
        self.groups = [_Group(data, starts, ends, hashes, w, length) for length, w in sorted(windows.items())]

    def occurrences(self, data, starts, ends, hashes, first):
        """(first word, length, items) of each occurrence."""
        for g in self.groups:
            for at, run in zip(*(x.tolist() for x in g.places(hashes, first))):
                text = b" ".join(bytes(data[starts[i]:ends[i]]) for i in range(at, at + g.length))
                if (items := g.strings[run].get(text)) is not None:
                    yield at, g.length, items


_MATCHERS: dict[int, Matcher] = {}


def _matcher(items) -> Matcher:
    """The matcher of a broadcast list of items, built once in a worker."""
    if items.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[items.id] = Matcher(items.value)
    return _MATCHERS[items.id]


class _Items:
    """A broadcast list with a number of its own."""

    def __init__(self, broadcast, number):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


_FOUND = "doc_id long, n_words long, hits array<long>, items array<string>"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                          ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _scan(items, last: bool):
    """Words hit in each text (first and end word of each run, end to end) and the items found, after those found before.

    The text goes along to the next pack of items.
    """
    def run(batches):
        matcher = _matcher(items)
        for rows, data, offsets in X.chunks(batches):
            data = X.LOWER[data]
            starts, ends, first = X.word_spans(data, offsets, X.ALNUM)
            hashes = X.span_hashes(data, starts, ends)
            hit = np.zeros(len(starts) + 1, np.int64)
            names: dict[int, set] = {}
            for at, length, found in matcher.occurrences(data, starts, ends, hashes, first):
                hit[at] += 1
                hit[at + length] -= 1
                names.setdefault(int(np.searchsorted(first, at, "right")) - 1, set()).update(found)
            covered = np.cumsum(hit) > 0
            runs, found = rows.column("hits").to_pylist(), rows.column("items").to_pylist()
            for k, own in names.items():
                inside = np.concatenate(([0], covered[first[k]:first[k + 1]].view(np.int8), [0]))
                runs[k] = [*runs[k], *np.flatnonzero(np.diff(inside)).tolist()]
                found[k] = [*found[k], *sorted(x for x in own if x is not None)]
            out = X.out(_FOUND_ARROW, doc_id=rows.column("doc_id"), n_words=np.diff(first),
                        hits=pa.array(runs, pa.list_(pa.int64())), items=pa.array(found, pa.list_(pa.string())))
            yield out if last else out.append_column("text", rows.column("text"))
    return run


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                     ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _digest(batches):
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for hits, items in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
            end = total = 0
            for a, b in sorted(zip(hits[::2], hits[1::2])):
                total += max(0, b - max(a, end))
                end = max(end, b)
            items = sorted(set(items))
            n_hit.append(total)
            n_items.append(len(items))
            sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield X.out(_DIGEST, doc_id=batch.column("doc_id"), n_words=batch.column("n_words"), n_hit=n_hit, n_items=n_items,
                    items_sha256=sha, contaminated=[n > 0 for n in n_hit])


def _packs(benchmark: DataFrame, pack_bytes: int) -> list:
    """The different items, in broadcast lists of about ``pack_bytes`` of text; at least one list."""
    sc = benchmark.sparkSession.sparkContext
    items = X.documents(benchmark, F.col("item_id").cast("string").alias("item_id")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packs, out = max(1, -(-size // pack_bytes)), []
    for k in range(packs):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(packs)) == k)
        sent = sc.broadcast(sorted((tuple(r) for r in mine.collect()), key=str))
        out.append(_Items(sent, sent._jbroadcast.id()))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items): runs of words hit by benchmark windows, and the items found.

    ``hits`` holds first and end word of each run, end to end. The items go to the workers in packs of about
    ``pack_bytes`` of text (one longer item makes a longer pack); a text passes one after the other, without an exchange.
    """
    packs = _packs(benchmark, pack_bytes)
    found = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id")).select(
        "*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hits"),
        F.array().cast("array<string>").alias("items"))
    for k, items in enumerate(packs):
        last = k == len(packs) - 1
        found = found.mapInArrow(_scan(items, last), _FOUND if last else _FOUND + ", text string")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters, digits and all beyond ASCII, A-Z lower-cased. An item's windows are all its
    runs of ten words; an item of fewer words, but not none, is one window. A document word within any
    occurrence of a window is hit.

    Null and empty texts have no words. Repeated items count once; items without an id hit words but
    are not named. Repeated documents each get their row; documents without an id keep a null one. Other columns
    are not looked at. Without documents there are no rows, without items nothing is hit.
    """
    return find_passages(docs, benchmark, pack_bytes).mapInArrow(
        _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_passages(docs: DataFrame, benchmark: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no benchmark window occurs; each row by its own text."""
    for items in _packs(benchmark, pack_bytes):
        docs = X.filtered(docs, _clean(items))
    return docs


def _clean(items):
    def keep(data, offsets):
        data = X.LOWER[data]
        starts, ends, first = X.word_spans(data, offsets, X.ALNUM)
        clean = np.ones(len(offsets) - 1, bool)
        for at, _, _ in _matcher(items).occurrences(data, starts, ends, X.span_hashes(data, starts, ends), first):
            clean[int(np.searchsorted(first, at, "right")) - 1] = False
        return clean
    return keep
