"""Document quality by supervised subword embeddings.

Words and character n-grams are hashed to vectors; a document's vector is the mean of theirs, a softmax
layer on it gives the classes, and all is trained together by stochastic gradient descent. As the layer
is linear, a trained model scores with one number for each bucket.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from . import text as X

#: Buckets of words, of character 3-grams and of 4-grams each; then the marks below.
BITS = 17
_MARKS = 3 << BITS
#: Marks: the word repeats the one before; it is the same as the one two before; any other word.
BUCKETS = _MARKS + 3
#: Least score of an accepted document.
ACCEPTED = 0.3
#: Rows of the sample that are shuffled together in a pass.
BLOCK = 400
#: Bytes of text looked at together: each has two n-grams, and these take some 100 bytes of memory.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Settings:
    """Bound of the labelled sample and settings of the training."""
    rows: int = 5000
    dimensions: int = 16
    epochs: int = 8
    rate: float = 0.5
    vector_rate: float = 20
    seed: int = 1


def _features(data: np.ndarray, offsets: np.ndarray):
    """(buckets, text of each) in groups: words and their marks, then 3-grams, then 4-grams.

    Case counts. A character n-gram lies within a word, or starts or ends at the white space beside it.
    """
    starts, ends, first = X.word_spans(data, offsets, X.SPACED)
    hashes = X.span_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    mark = np.full(len(hashes), _MARKS + 2)
    for back in (2, 1):
        if len(hashes) > back:
            same = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
            mark[back:][same] = _MARKS + back - 1
    yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), text
    yield mark, text
    inside = X.SPACED[data]
    code = np.where(inside, data, np.uint8(32)).astype(np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for group, n in ((1, 3), (2, 4)):
        m = len(data) - n + 1
        if m <= 0:
            continue
        grams, whole = code[:m].copy(), text[:m] == text[n - 1:]
        for i in range(1, n):
            grams = (grams << np.uint64(8)) | code[i:m + i]
            if i < n - 1:
                whole &= inside[i:m + i]
        buckets = ((grams * _ODD) >> np.uint64(64 - BITS)).astype(np.int64) + (group << BITS)
        yield buckets[whole], text[:m][whole]


def _bags(batches):
    """Distinct buckets and counts of each labelled text."""
    for rows, data, offsets in X.chunks(batches, limit=CHUNK):
        parts = list(_features(data, offsets))
        buckets, text = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, counts = np.unique(text * BUCKETS + buckets, return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(rows) + 1) * BUCKETS)
        bags = [(keys[a:b] % BUCKETS).astype(np.int32) for a, b in zip(cut, cut[1:])]
        yield pa.record_batch([rows.column("place"), rows.column("label"), X.binary(bags),
                               X.binary([counts[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])])],
                              names=["place", "label", "buckets", "counts"])


def train(bags, n: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Log-odds of label 1 by bucket, and their bias.

    ``bags(k)`` gives (label, buckets, counts) of each of ``n`` documents for pass k, in an order of its own; only one
    is held at a time.
    """
    rng = np.random.default_rng(settings.seed)
    d = settings.dimensions
    vectors = np.empty((BUCKETS, d), np.float32)
    for at in range(0, BUCKETS, 1 << 14):  # no second table of doubles
        vectors[at:at + (1 << 14)] = rng.uniform(-1 / d, 1 / d, (min(1 << 14, BUCKETS - at), d))
    layer, bias = np.zeros((2, d), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, settings.epochs * n), 0
    for k in range(settings.epochs):
        for label, buckets, counts in bags(k):
            share = (counts / max(1, counts.sum())).astype(np.float32)
            rate, step = settings.rate * (1 - step / steps), step + 1
            own = vectors[buckets]
            mean = share @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            # a vector's gradient has its share of the mean, which is small: a rate of its own
            vectors[buckets] = own - (rate * settings.vector_rate) * np.outer(share, back)
    weight = layer[1] - layer[0]
    return (vectors @ weight).astype(np.float32), float(bias[1] - bias[0])


def scores(model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text of a chunk."""
    odds, bias = model
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for buckets, text in _features(data, offsets):
        total += np.bincount(text, odds[buckets], n)
        count += np.bincount(text, minlength=n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -700, 700)))


def _fit(settings: Settings):
    """Training on the rows of a task, which wait in a file without a name: a row with the model."""
    def run(batches):
        labels, sizes = [], []
        with tempfile.TemporaryFile() as kept:
            for batch in batches:
                for label, buckets, counts in zip(*(batch.column(k) for k in ("label", "buckets", "counts"))):
                    labels.append(label.as_py())
                    sizes.append(len(buckets.as_buffer()) // 4)
                    kept.write(buckets.as_buffer())
                    kept.write(counts.as_buffer())
                batch = label = buckets = counts = None  # no batch is held while the model is trained
            if not labels:
                return
            kept.flush()
            first = np.cumsum([0, *sizes]) * 8

            def row(i):
                kept.seek(first[i])
                both = np.frombuffer(kept.read(8 * sizes[i]), np.int32)
                return labels[i], both[:sizes[i]], both[sizes[i]:]

            def bags(k):
                rng = np.random.default_rng((settings.seed, k))
                starts = range(0, len(labels), BLOCK)
                for b in rng.permutation(len(starts)):
                    for r in rng.permutation(min(BLOCK, len(labels) - starts[b])):
                        yield row(starts[b] + r)
            odds, bias = train(bags, len(labels), settings)
        yield pa.record_batch([pa.array([odds.tobytes()], pa.binary()), pa.array([bias])], names=["odds", "bias"])
    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(model):
    def run(batches):
        for rows, data, offsets in X.chunks(batches, limit=CHUNK):
            yield X.out(_SCORED, doc_id=rows.column("doc_id").cast(pa.int64()), score=scores(model.value, data, offsets))
    return run


def learning_rows(doc_id) -> F.Column:
    """Rows whose label may be learned: crc32 of the id as text, modulo 5, is not 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()):
    """Broadcast (log-odds by bucket, bias), trained on a bounded sample of the labelled documents.

    Rows are taken by a hash of the id, about ``rows`` of them. One task trains on their features; what comes to the
    driver is the model, of a fixed size (1.5 MB). Without any rows, the odds are even.
    """
    known = (labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id")
             .agg((F.avg("quality") > 0.5).cast("int").alias("label")).filter(learning_rows("doc_id"))
             .withColumn("place", F.xxhash64("doc_id", F.lit(10))))
    n = known.count()
    share = min(1.0, settings.rows / max(1, n))
    taken = checkpoint(known.filter(F.col("place") < int(share * 2 ** 64) - 2 ** 63 if share < 1 else F.lit(True)))
    sample = X.documents(docs.join(taken, "doc_id"), "place", "label").mapInArrow(
        _bags, "place long, label int, buckets binary, counts binary")
    trained = (sample.repartition(1).sortWithinPartitions("place", "label", "buckets")
               .mapInArrow(_fit(settings), "odds binary, bias double").collect())
    model = (np.frombuffer(trained[0]["odds"], np.float32), trained[0]["bias"]) if trained else (np.zeros(BUCKETS, np.float32), 0.0)
    return docs.sparkSession.sparkContext.broadcast(model)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document: doc_id, held_out, score (that quality is 1; 0 to 1), predicted (score >= 0.3).

    Labels are learned where the crc32 of the id is not divisible by 5; ids, lang and source are no inputs.
    Several labels of one document count as their majority (a tie: 0), null ones not at all. A null or empty text has no features and gets the
    odds of the bias. Repeated documents get equal scores; one without an id counts as held out by the text ''
    and is never learned from. Other columns are not looked at; an empty table gives no rows.
    """
    rows = X.documents(docs, F.col("doc_id").cast("long").alias("doc_id"))
    scored = rows.mapInArrow(_score(fit(docs.select("doc_id", "text"), labels, settings)), "doc_id long, score double")
    return scored.select("doc_id", (~learning_rows("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier predicts to be 1; each row by its own text."""
    model = fit(docs.select("doc_id", "text"), labels, settings)
    return X.filtered(docs, lambda data, offsets: scores(model.value, data, offsets) >= ACCEPTED, CHUNK)
