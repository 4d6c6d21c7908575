import collections
import zlib

import numpy as np

from flockframe.llm import sharding as S


def check(got, docs, shards=8):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) if r["doc_id"] is not None else (-1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [sum(r["size"] for r in got if r["shard"] == k) for k in range(shards)]


def test_odd_rows(odd, none):
    check(S.shard(odd).collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert S.shard(none).collect() == []


def test_even_bytes_with_a_group_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(0)
    docs = [(i, "hot text") if i % 3 == 0 else (i, "x" * int(rng.integers(1, 60)) + str(i % 4000)) for i in range(20_000)]
    got = S.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sizes = check(got, docs)
    assert max(sizes) / min(sizes) < 1.02
    text = dict(docs)
    places = collections.defaultdict(set)
    for r in got:
        places[text[r["doc_id"]]].add(r["shard"])
    cut = [t for t, s in places.items() if len(s) > 1]
    assert len(cut) <= 2 and len(places["hot text"]) >= 2  # small groups stay whole, the large one is cut


def test_splitters_divide_a_key_by_its_ties():
    s = S.Splitters([(5, 10), (5, 20), (9, 3)])
    key, tie = np.array([4, 5, 5, 5, 9, 9, 10]), np.array([0, -4, 19, 20, -9, 7, 0])
    assert s.place(key, tie).tolist() == [0, 1, 1, 2, 3, 3, 3]


def test_boundaries_that_come_slowly(spark, monkeypatch):
    """However many rounds it takes, offsets belong to the last boundaries and no row is lost."""
    quantiles = S._quantiles
    monkeypatch.setattr(S, "_quantiles", lambda sample, parts: quantiles(sample, 2))
    rng = np.random.default_rng(1)
    docs = [(i, "x" * int(rng.integers(1, 60)) + str(i)) for i in range(4000)]
    sizes = check(S.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert max(sizes) / min(sizes) < 1.05


def test_very_long_documents(spark):
    """A range that starts with one stays heavy in every round."""
    rng = np.random.default_rng(0)
    docs = [(i, "x" * int(rng.integers(20, 80)) + str(i)) for i in range(20_000)]
    docs += [(20_000 + k, chr(97 + k) * 60_000) for k in range(8)]
    check(S.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
