import random

import numpy as np
import pytest

from . import reference as R
from .tables import rows
from flockframe.llm import minhash as M
from flockframe.llm.components import components


def answer(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_documents_as_brute_force(documents, texts):
    assert answer(M.near_duplicates(documents)) == R.near(texts)


def test_near_copies_around_the_threshold(spark):
    """One text, many copies with more and less changed: links run through some copies only."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(w))
            if rng.random() < 0.4:
                del w[k]
            else:
                w[k] = f"new{rng.randrange(40)}" if rng.random() < 0.5 else f"v{rng.randrange(10**9)}"
        texts[i] = " ".join(w)
    for i in range(90, 120):  # texts that share one passage and little else
        texts[i] = " ".join(base[:50] + [f"o{i}_{k}" for k in range(rng.randrange(5, 40))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert answer(M.near_duplicates(df)) == R.near(texts)


def test_odd_rows(odd):
    got = M.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in (1, 2, 3, 7, 8, 9, 10, 11)] == [1, 1, 1, 7, 7, 9, 10, 10]
    assert [(by[i]["n_shingles"], by[i]["component_id"], by[i]["kept"]) for i in (4, 5, 6)] == [(0, i, True) for i in (4, 5, 6)]
    assert all(r["component_id"] is None and not r["kept"] for r in got if r["doc_id"] is None)


def test_empty_table(none):
    assert M.near_duplicates(none).collect() == []


def test_small_sets_fill_all_bins():
    for n in (1, 2, 7):
        hashes = np.unique(np.random.default_rng(n).integers(0, 2 ** 64, n, dtype=np.uint64))
        assert set(M.signature(hashes).tolist()) <= set(hashes.tolist())


def test_agreement_of_bins_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2 ** 64, 1000, dtype=np.uint64)
    y = np.concatenate([x[:850], rng.integers(0, 2 ** 64, 150, dtype=np.uint64)])
    same = (M.signature(np.unique(x)) == M.signature(np.unique(y))).mean()
    assert abs(same - 850 / 1150) < 0.12


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (4, 4), (9, 9)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {n for e in edges for n in e}
    assert rows(components(df)) == sorted(R.components(nodes, edges).items())
