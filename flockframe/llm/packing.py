"""Sequences of tokens packed along a space-filling curve.

A document's tokens are hashed to a vector and projected to a few dimensions; its place on the Hilbert
curve through them is the key of a range sort. Cut into sequences along that order, neighbours in meaning
share sequences, and as documents are cut freely nothing is padded.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from . import text as X

LENGTH = 2048
END = 1
HASHED, DIMENSIONS, DEPTH = 64, 4, 11
#: Bits below the curve's key that deal out documents of one place.
_TIES = 63 - DIMENSIONS * DEPTH
#: Tokens in a range of the curve, which one task sorts.
RANGE_TOKENS = 4_000_000
#: Words whose ids a worker remembers, and words without the marks around them.
REMEMBERED, REMEMBERED_PARTS = 600_000, 100_000


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks that may stand around a word without changing its tokens; not "'" (contractions) or "<" (special tokens).
_MARKS_AROUND = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of texts, word by word: no token of this tokenizer spans ASCII white space.

    Ids of the words met are remembered up to a bound, then forgotten all at once. New words of letters only, without
    the marks around them, are encoded many in one text, which is taken apart where a token ends a word. Those that
    normalising leaves as they are go straight to the byte pair merging, which takes the end of a word for one more byte.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.end = np.array([END], self.dtype).tobytes()
        self.ends_word = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends_word[k] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.merging = self._merging(vocabulary)

    @staticmethod
    def _merging(vocabulary: str):
        """Byte pair merging of words that end in a zero byte: a token that ends a word has that byte, too."""
        import tiktoken
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        names, ranks = X.byte_names(), {}
        for token, k in model["vocab"].items():
            ends = token.endswith("</w>")
            token = token[:-4] if ends else token
            if all(c in names for c in token) and not token.startswith("<|"):
                ranks[bytes(names[c] for c in token) + b"\0" * ends] = k
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, the end included, as bytes."""
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts = {}
        flat = list(chain.from_iterable(words))
        ids = list(map(self.known.get, flat))
        missing = [k for k, i in enumerate(ids) if i is None]
        self._learn(list({flat[k] for k in missing}))
        for k in missing:
            ids[k] = self.known[flat[k]]
        stops = list(accumulate(map(len, words), initial=0))
        return [b"".join(ids[a:b]) + self.end for a, b in zip(stops, stops[1:])]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        cores = [t.strip(_MARKS_AROUND) for t in texts]
        cut = [k for k, c in enumerate(cores) if c.isalpha()]
        before = [texts[k][:texts[k].index(cores[k])] for k in cut]
        after = [texts[k][len(b) + len(cores[k]):] for k, b in zip(cut, before)]
        parts = self.parts
        parts[""] = b""
        self._many([c for c in {cores[k] for k in cut} if c not in parts])
        self._each([m for m in {*before, *after} if m not in parts])
        known = self.known
        for k, b, a in zip(cut, before, after):
            known[words[k]] = parts[b] + parts[cores[k]] + parts[a]
        whole = [k for k, c in enumerate(cores) if not c.isalpha()]
        for k, e in zip(whole, self._batch([texts[k] for k in whole])):
            known[words[k]] = self._ids(e)

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _ids(self, encoding) -> bytes:
        return np.array(encoding.ids, self.dtype).tobytes()

    def _each(self, texts: list[str]) -> None:
        self.parts.update((t, self._ids(e)) for t, e in zip(texts, self._batch(texts)))

    def _many(self, words: list[str]) -> None:
        plain = [w for w in words if w == w.lower() and unicodedata.is_normalized("NFC", w)]
        if plain:
            ids = self.merging.encode_to_numpy("\0".join(plain) + "\0", disallowed_special=()).astype(self.dtype)
            raw = ids.tobytes()
            stops = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.dtype.itemsize).tolist()
            self.parts.update(zip(plain, map(raw.__getitem__, map(slice, [0, *stops], stops))))
        words = [w for w in words if w not in self.parts]
        groups = [words[k:k + 1000] for k in range(0, len(words), 1000)]
        for group, e in zip(groups, self._batch([" ".join(g) for g in groups])):
            ids = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != len(group):  # a word fell apart when it was normalised
                self._each(group)
                continue
            raw, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
            self.parts.update(zip(group, map(raw.__getitem__, map(slice, [0, *stops], stops))))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def hilbert(axes: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of points (rows) with whole coordinates below 2 ** depth."""
    x = [axes[:, i].astype(np.int64) for i in range(axes.shape[1])]
    for q in (1 << k for k in range(depth - 1, 0, -1)):
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = x[0] ^ np.where(high, q - 1, swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(axes), np.int64)
    for q in (1 << k for k in range(depth - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0)
    key = np.zeros(len(axes), np.int64)
    for k in range(depth - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ flip) >> k) & 1)
    return key


@lru_cache
def _cells(bits: int) -> np.ndarray:
    """Cell of each id below 2 ** bits: the ids of negative sign first, then the others."""
    h = X.mix(np.arange(1, (1 << bits) + 1, dtype=np.uint64))
    return (h % np.uint64(HASHED) + np.uint64(HASHED) * (h >> np.uint64(63))).astype(np.int64)


def curve_keys(ids: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Curve place of each text from its ids: signed feature hashing, unit length, fixed random projection."""
    cell = text * (2 * HASHED) + _cells(int(ids.max(initial=0)).bit_length())[ids]
    counts = np.bincount(cell, minlength=2 * n * HASHED).reshape(n, 2, HASHED)
    vectors = (counts[:, 1] - counts[:, 0]).astype(np.float64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    projection = np.random.default_rng(3).standard_normal((HASHED, DIMENSIONS))
    top = 1 << DEPTH
    return hilbert(np.clip((vectors @ projection + 3) * (top / 6), 0, top - 1), DEPTH)


_TOKENS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()),
                     ("ids", pa.binary())])


def _tokenize(vocabulary: str):
    def run(batches):
        enc = encoder(vocabulary)
        for rows, data, offsets in X.chunks(batches):
            raw = data.tobytes()
            ids = enc.encode([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
            n = np.array([len(i) for i in ids]) // enc.dtype.itemsize
            flat = np.frombuffer(b"".join(ids), enc.dtype)
            key = curve_keys(flat, np.repeat(np.arange(len(n)), n), len(n))
            uid = rows.column("uid").to_numpy()
            tie = (X.mix(uid.view(np.uint64)) >> np.uint64(64 - _TIES)).astype(np.int64)
            yield X.out(_TOKENS, uid=uid, doc_id=rows.column("doc_id").cast(pa.int64()), place=(key << _TIES) | tie, n=n,
                        ids=pa.array(ids, pa.binary()))
    return run


_RANGED = pa.schema([("bucket", pa.int32()), *_TOKENS])


def _into_ranges(bounds):
    def run(batches):
        edges = np.array(bounds.value, np.int64)
        for batch in batches:
            bucket = np.searchsorted(edges, batch.column("place").to_numpy(), "right").astype(np.int32)
            yield pa.record_batch([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])
    return run


_PIECES = pa.schema([(c, pa.int64()) for c in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def tail_lengths(rest: int) -> list[int]:
    """Lengths, all powers of two, of the sequences that the last tokens make."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cut(before, total: int, length: int, itemsize: int):
    """Pieces of documents that come in curve order; ``before``: tokens ahead of each range."""
    whole = total // length * length
    tail = np.cumsum([whole, *tail_lengths(total - whole)])

    def run(batches):
        bucket, at = None, 0
        for batch in batches:
            got = {c: [] for c in _PIECES.names}
            for row_bucket, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "ids"))):
                if row_bucket != bucket:
                    bucket, at = row_bucket, before.value[row_bucket]
                ids = np.frombuffer(ids, f"<u{itemsize}").astype("<u4")
                done = 0
                while done < n:
                    if at < whole:
                        seq, offset = divmod(at, length)
                        room = length - offset
                    else:
                        k = int(np.searchsorted(tail, at, "right")) - 1
                        seq, offset, room = whole // length + k, at - int(tail[k]), int(tail[k + 1]) - at
                    piece = min(room, n - done)
                    for c, v in zip(_PIECES.names, (doc, done, piece, zlib.crc32(ids[done:done + piece].tobytes()), n, seq, offset)):
                        got[c].append(v)
                    done, at = done + piece, at + piece
            yield X.out(_PIECES, **got)
    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH,
         range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and an end (id 1). All documents lie end to end along the curve and are cut every
    ``length`` tokens; what is left at the end makes sequences of powers of two, so none is padded. Ties on the curve are
    dealt out by a hash of the row, so a place that holds many documents spreads over ranges.

    Null, empty and blank texts are one end. Repeated documents, and those without an id (null), are packed
    as rows of their own. Other columns are not looked at; an empty table gives no rows. ``vocabulary`` is a file
    that every executor can read.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    rows = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"))
    tokens = checkpoint(rows.mapInArrow(_tokenize(vocabulary), "uid long, doc_id long, place long, n long, ids binary"))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = max(32, -(-total // range_tokens))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = tokens.agg(F.percentile_approx("place", shares, max(10_000, 20 * ranges))).first()[0] or []
    ranged = tokens.mapInArrow(_into_ranges(spark.sparkContext.broadcast(sorted(set(bounds)))),
                               "bucket int, uid long, doc_id long, place long, n long, ids binary")
    # one number for each range comes to the driver: total / range_tokens of them
    sums = dict(ranged.groupBy("bucket").agg(F.sum("n")).collect())
    before, at = {}, 0
    for bucket in sorted(sums):
        before[bucket], at = at, at + sums[bucket]
    itemsize = encoder(vocabulary).dtype.itemsize
    ordered = ranged.repartition(ranges, "bucket").sortWithinPartitions("bucket", "place", "uid")
    return ordered.select("bucket", "doc_id", "n", "ids").mapInArrow(
        _cut(spark.sparkContext.broadcast(before), total, length, itemsize), ", ".join(f"`{c}` long" for c in _PIECES.names))
