import os
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flockframe.llm import quality as Q, text as X


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.quality(docs, labels).join(labels, "doc_id").filter("held_out")
    n, right, bad, caught = got.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int")),
                                    F.sum(1 - F.col("quality")), F.sum((1 - F.col("quality")) * (1 - F.col("predicted")))).first()
    assert n > 40 and right / n >= 0.95 and caught / bad >= 0.8


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, None, 0), (None, 1, 0), (10, 1, 0), (4, 0, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = Q.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1  # equal texts
    kept = Q.accepted(odd, labels)
    assert kept.schema == odd.schema and kept.count() == sum(r["predicted"] for r in got)


def test_without_labels_or_documents(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.quality(odd, labels).collect()} == {0.5}
    assert Q.quality(none, labels).collect() == []


def test_linear_scores_are_those_of_the_mean_vector():
    rng = np.random.default_rng(0)
    bags = [(k % 2, rng.integers(0, 50, 8) + 50 * (k % 2), np.ones(8, np.int32)) for k in range(40)]
    odds, bias = Q.train(lambda k: bags, len(bags), Q.Settings(epochs=20))
    scores = [odds[b].mean() + bias for _, b, _ in bags]
    assert all((s > 0) == bool(y) for s, (y, _, _) in zip(scores, bags))


def test_repeats_and_n_grams():
    data = np.frombuffer(b"ab ab cd", np.uint8)
    words, marks, three, four = Q._features(data, np.array([0, 8]))
    assert (marks[0] - Q._MARKS).tolist() == [2, 0, 2] and len(words[0]) == 3
    assert len(three[0]) == 4 and len(four[0]) == 1  # "ab ", " ab", "ab ", " cd"; " ab "


def test_no_training_in_the_driver(spark, documents, monkeypatch):
    driver, train = os.getpid(), Q.train

    def spied(*args):
        assert os.getpid() != driver
        return train(*args)
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(Q, "train", spied)
    assert len({r["score"] for r in Q.quality(documents, labels).collect()}) > 10


def _batch(n: int) -> pa.RecordBatch:
    """About 3 kB of text a row."""
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(500)) for i in range(n)]
    ids = pa.array(range(n), pa.int64())
    return pa.record_batch([ids, ids, pa.array([i % 2 for i in range(n)], pa.int32()), pa.array(texts)],
                           names=["doc_id", "place", "label", "text"])


def test_memory_of_features_is_bounded():
    batch, model = _batch(1000), SimpleNamespace(value=(np.ones(Q.BUCKETS, np.float32), 0.0))
    Q.scores(model.value, np.frombuffer(b"a b", np.uint8), np.array([0, 3]))  # tables that stay
    for step in (Q._bags, Q._score(model)):
        tracemalloc.start()
        for _ in step([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40_000_000


def test_scores_do_not_depend_on_the_chunk(monkeypatch):
    batch = _batch(200)
    model = SimpleNamespace(value=(np.random.default_rng(0).normal(size=Q.BUCKETS).astype(np.float32), 0.1))

    def both():
        return [pa.Table.from_batches(list(f([batch]))).to_pylist() for f in (Q._bags, Q._score(model))]
    want = both()
    for limit in (1, 5000, 1 << 20):
        monkeypatch.setattr(Q, "CHUNK", limit)
        assert both() == want


def test_no_batch_is_held_in_training(monkeypatch):
    train, before, held = Q.train, pa.total_allocated_bytes(), []

    def spied(*args):
        held.append(pa.total_allocated_bytes() - before)
        return train(*args)
    monkeypatch.setattr(Q, "train", spied)

    def sample():
        for k in range(2):
            buckets = X.binary([np.arange(20_000, dtype=np.int32)] * 50)
            yield pa.record_batch([pa.array([k] * 50, pa.int32()), buckets, buckets], names=["label", "buckets", "counts"])
    assert len(list(Q._fit(Q.Settings(epochs=1))(sample()))) == 1
    assert held[0] < 1_000_000
