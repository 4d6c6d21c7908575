import numpy as np
import pytest

from . import reference as R
from flockframe.llm import nndescent as N


def brute(vectors, threshold=0.95):
    """{id: (links, component)}: (id, vector) rows, ids different."""
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in vectors
            if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    root = R.components([i for i, _ in vectors], links)
    return {i: (sum(i in e for e in links), root[i]) for i, _ in vectors}


def answer(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_clusters_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for size in [1] * 60 + [2] * 25 + [5, 9, 12, 40, 150]:
        centre = rng.standard_normal(24)
        for _ in range(size):
            vectors.append((len(vectors), (centre + rng.standard_normal(24) * 0.08).tolist()))
    vectors += [(len(vectors) + k, vectors[-1][1]) for k in range(30)]  # equal vectors
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got, want = answer(N.near_vectors(df)), brute(vectors)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * true
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]),
               (9, [1.0, 0.0, 0.0]), (10, [0.0, 1e-300]), (11, [0.0, 1e300]), (12, [1.0, 0.01])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, label int, cid int")
    assert answer(N.near_vectors(df)) == {1: (2, 1), 2: (2, 1), 12: (2, 1), 10: (1, 10), 11: (1, 10), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9)}}


def test_missing_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((tuple(r)[:4] for r in N.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, False)], key=str)


def test_empty_table(spark):
    assert N.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("block", [3, 512])
def test_components_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "LARGE_BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = [(k, (np.ones(8) + rng.standard_normal(8) * 0.2).tolist()) for k in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert answer(N.near_vectors(df)) == brute(vectors)


def subgroups(number, size, seed=7):
    """Sub-groups of more vectors than a list holds, tight in themselves and within 0.95 of one another; and lone vectors."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(48)
    base /= np.linalg.norm(base)
    unit = lambda scale: scale * rng.standard_normal(48) / 48 ** 0.5
    centres = [base + unit(0.15) for _ in range(number)]
    vectors = [(c + unit(0.01)).tolist() for c in centres for _ in range(size)]
    vectors += [rng.standard_normal(48).tolist() for _ in range(40)]
    return list(enumerate(vectors))


@pytest.mark.parametrize("balls", [5, 4096])
def test_links_between_tight_subgroups(spark, monkeypatch, balls):
    """Lists are full of a sub-group's own; links between sub-groups are found all the same."""
    monkeypatch.setattr(N, "BALLS", balls)
    vectors = subgroups(12, 30)
    want = brute(vectors)
    assert max(v[0] for v in want.values()) == 359
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert answer(N.near_vectors(df)) == want


def test_audit_misses_a_link_of_a_full_list_to_another(spark):
    """One end full of links is not enough for a link to count as found."""
    rng = np.random.default_rng(2)
    x = np.ones(16) + rng.standard_normal((10, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(k, True, 16, bytearray(v.tobytes())) for k, v in enumerate(x)], "cid long, asked boolean, dim int, vector binary")
    lists = spark.createDataFrame([(0, b, 0.99) for b in range(1, 9)], "a long, b long, cosine double")
    assert N._audit(lists, classes, 0.95) == (90, 16)


def rare(rng, n=3000, pairs=40):
    """Lone vectors, and pairs at a cosine just above 0.95 with ids that are not divisible by 100."""
    v = rng.standard_normal((n, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(pairs):
        a, b = 100 * (k % 30) + 1 + 2 * (k // 30), 100 * (k % 30) + 2 + 2 * (k // 30)
        away = v[b] - (v[b] @ v[a]) * v[a]
        v[b] = 0.951 * v[a] + (1 - 0.951 ** 2) ** 0.5 * away / np.linalg.norm(away)
    return [(i, x.tolist()) for i, x in enumerate(v)]


def compared_whole(monkeypatch):
    """Numbers of vectors that were compared in blocks rather than found by the lists."""
    numbers, enlarged = [], N._enlarged

    def counted(classes, rooted, threshold, size):
        numbers.append(rooted.count())
        return enlarged(classes, rooted, threshold, size)
    monkeypatch.setattr(N, "_enlarged", counted)
    return numbers


def test_rare_pairs_are_found_by_the_descent(spark, monkeypatch):
    """Pairs that the ids divisible by 100 do not show are in the lists; nothing is compared whole."""
    whole = compared_whole(monkeypatch)
    vectors = rare(np.random.default_rng(4))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = answer(N.near_vectors(df))
    assert sum(v[0] for v in got.values()) >= 78 and all(got[i][0] for i in got if got[i][1] != i)
    assert whole == [0]


def test_a_missed_recall_makes_lists_longer(spark, monkeypatch):
    """One poor sign table and no rounds to mend it: the audit asks for more until the links are there."""
    monkeypatch.setattr(N, "TABLES", 1)
    monkeypatch.setattr(N, "MISSED", 1.0)
    monkeypatch.setattr(N, "_round", lambda lists, classes, k: lists)
    whole, starts, start = compared_whole(monkeypatch), [], N._start
    monkeypatch.setattr(N, "_start", lambda *a: starts.append(a[2]) or start(*a))
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 32))
    v[1::2] = v[::2] + rng.standard_normal((750, 32)) * 0.1
    vectors = list(enumerate(v.tolist()))
    rows = N.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert starts[:2] == [8, 16] and whole == [0]
    assert rows[0]["recall"] >= 0.98 and sum(r["n_links"] for r in rows) >= 0.95 * sum(n for n, _ in brute(vectors).values())


@pytest.mark.parametrize("pack", [3, 2048])
def test_audit_asks_all_ids_in_packs(spark, monkeypatch, pack):
    monkeypatch.setattr(N, "QUERIES", pack)
    rng = np.random.default_rng(2)
    x = np.ones(16) + rng.standard_normal((10, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(k, k < 7, 16, bytearray(v.tobytes())) for k, v in enumerate(x)], "cid long, asked boolean, dim int, vector binary")
    lists = spark.createDataFrame([(0, 1, 0.99)], "a long, b long, cosine double")
    assert N._audit(lists, classes, 0.95) == (63, 2)


def test_sign_tables_grow_with_the_bits():
    for bits in range(0, 25):
        together = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - together) ** N._tables(bits, 0.95) <= N.MISSED + 1e-9
