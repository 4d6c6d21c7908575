"""Language of texts by prediction by partial matching over bytes.

For each language a tree of contexts of up to four bytes is counted on a sample and then frozen. A byte's code length
is that of its longest known context; where the context has not seen the byte, an escape is paid and the next
shorter one is asked, at the end one that knows all bytes alike. The shortest code tells the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from . import text as X

#: Longest context in bytes.
ORDER = 4
#: Texts a language is learned from, about.
ROWS = 800
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Each byte with the ORDER bytes before it, as one number, and the text it is in.

    Before a text lie line ends. A-Z count as lower case.
    """
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    padded = np.full(len(data) + ORDER * len(n), 10, np.uint8)
    at = np.arange(len(data)) + ORDER * (text + 1)
    padded[at] = X.LOWER[data]
    code = np.zeros(len(padded), np.uint64)
    wide = padded.astype(np.uint64)
    for back in range(ORDER + 1):
        code[back:] |= wide[:len(wide) - back] << np.uint64(8 * back)
    return code[at], text


class Table:
    """Rows of numbers by 64-bit key: open addressing in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(3 * len(keys)).bit_length())
        self.values = np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.rows = np.full(size, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.rows[at] < 0
            spot, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.rows[spot], self.keys[spot] = put, keys[put]
            left = self.rows[at] != todo
            todo, at = todo[left], (at[left] + 1) & int(self.mask)

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; -1 where there is none."""
        at = self._home(keys)
        rows = self.rows[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (rows >= 0))
        out = np.where((rows >= 0) & (self.keys[at] == keys), rows, -1)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & int(self.mask)
            rows = self.rows[at]
            hit = (rows >= 0) & (self.keys[at] == keys[wrong])
            out[wrong[hit]] = rows[hit]
            going = (rows >= 0) & ~hit
            wrong, at = wrong[going], at[going]
        return out


class Model:
    """Frozen code lengths in bits: of every gram seen in any language, and of escapes from every context."""

    def __init__(self, languages: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.languages = languages
        n_lang = len(languages)
        self.grams, self.escapes = [], []
        lengths, keys = np.full((1, n_lang), 8.0), np.zeros(1, np.uint64)  # below order 0: each byte alike
        for order in range(ORDER + 1):
            key = grams & np.uint64((1 << 8 * (order + 1)) - 1)
            own, at = np.unique(key, return_inverse=True)
            count = np.bincount(at * n_lang + lang, counts, len(own) * n_lang).reshape(-1, n_lang)
            contexts, of = np.unique(own >> np.uint64(8), return_inverse=True)
            total = np.stack([np.bincount(of, count[:, k], len(contexts)) for k in range(n_lang)], 1)
            kinds = np.stack([np.bincount(of, count[:, k] > 0, len(contexts)) for k in range(n_lang)], 1)
            escape = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
            if order:
                shorter = lengths[np.searchsorted(keys, own & np.uint64((1 << 8 * order) - 1))]
            else:
                shorter = np.broadcast_to(lengths, count.shape)
            whole = np.maximum(total + kinds, 1)[of]
            lengths = np.where(count > 0, np.log2(whole / np.maximum(count, 1)), escape[of] + shorter)
            keys = own
            self.grams.append(Table(own, lengths.astype(np.float32)))
            self.escapes.append(Table(contexts, escape.astype(np.float32)))

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """Bits of each byte, given those before it, in each language."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        todo = np.arange(len(code))
        for order in range(ORDER, -1, -1):
            key = code[todo] & np.uint64((1 << 8 * (order + 1)) - 1)
            table, escapes = self.grams[order], self.escapes[order]
            row = table.find(key)
            if order == ORDER:
                out = table.values[row]  # the last row, of zeros, where there is none
            else:
                out[todo] += table.values[row]
            missing = row < 0
            todo, key = todo[missing], key[missing]
            out[todo] += escapes.values[escapes.find(key >> np.uint64(8))]
        out[todo] += 8
        return out


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("k", pa.int64())])


def _count(batches):
    for rows, data, offsets in X.chunks(batches):
        code, text = _grams(data, offsets)
        lang = np.array(rows.column("lang").to_pylist(), object)
        for name in sorted(set(lang)):
            grams, k = np.unique(code[(lang == name)[text]], return_counts=True)
            yield X.out(_COUNTS, lang=[name] * len(grams), gram=grams.astype(np.int64), k=k)


def learning_rows() -> F.Column:
    """Rows whose language may be learned: crc32 of the id as text, modulo 4, is not 2; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """Model from about ``rows`` whole texts of each language, taken by a hash of the id; None without any.

    The grams of the sample are counted by Spark. Their distinct ones come to the driver, so the model
    is bounded by the sample whatever the size of the table.
    """
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(learning_rows())
    sizes = dict(known.groupBy("lang").count().collect())
    if not sizes:
        return None
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, int(min(1.0, rows / n) * (1 << 30))).otherwise(share)
    taken = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < share)
    counts = (taken.select("lang", "text").mapInArrow(_count, "lang string, gram long, k long")
              .groupBy("lang", "gram").agg(F.sum("k").alias("k")))
    counts = checkpoint(counts).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return None
    place = {name: k for k, name in enumerate(languages)}
    return Model(languages, np.array([place[x] for x in counts.column("lang").to_pylist()]),
                 counts.column("gram").to_numpy().astype(np.uint64), counts.column("k").to_numpy())


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("bits_per_byte", pa.float64())])


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_LETTER[data])))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(map(str.isalpha, data[offsets[k]:offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _predict(broadcast):
    def run(batches):
        model = broadcast.value
        for rows, data, offsets in X.chunks(batches):
            n = len(rows)
            letters = _has_letter(data, offsets)
            names, score, bits = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            if model:
                code, text = _grams(data, offsets)
                each = model.lengths(code)
                total = np.stack([np.bincount(text, each[:, k], n) for k in range(each.shape[1])], 1)
                least = total.min(1)
                score = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(1), 0.0)
                bits = least / np.maximum(np.diff(offsets), 1)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(total.argmin(1), letters)]
            yield X.out(_PREDICTED, doc_id=rows.column("doc_id").cast(pa.int64()), lang_pred=names, score=score, bits_per_byte=bits)
    return run


def languages(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, bits_per_byte.

    Learned from text and lang of rows whose crc32 of the id is not 2 modulo 4. ``score`` is the share of the
    predicted language in the probability all languages give to the text; ties go to the first name.

    Null and empty texts, and those without a letter, are ``und`` with score 0; so is all where nothing can be learned. Rows
    without an id are predicted but never learned from. Repeated documents get equal answers. Other
    columns are not looked at; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))
    found = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _predict(model), "doc_id long, lang_pred string, score double, bits_per_byte double")
    return found.select("doc_id", (~learning_rows()).alias("held_out"), "lang_pred", "score", "bits_per_byte")
