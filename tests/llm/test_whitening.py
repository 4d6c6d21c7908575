import numpy as np
import pytest

from flockframe.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string, code int"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 2, "x", None) for k, v in enumerate(vectors)], SCHEMA).repartition(4)


def plain(vectors):
    """Eigenvectors and values of the covariance of the different x-vectors, and each vector's centred entries and deviation."""
    x = np.floor(np.float32(vectors).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, e[::-1], v[:, ::-1], (n * x - s) / n, ((n * x - s) ** 2).sum(1)


def check(df, vectors, count):
    n, e, v, centred, deviation = plain(vectors)
    got = {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert set(got) == {(k, c) for k in range(len(vectors)) for c in range(1, count + 1)}
    for c in range(1, count + 1):
        white = np.array([got[k, c]["whitened"] for k in range(len(vectors))])
        want = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        sign = np.sign(white @ want)
        assert np.allclose(white, sign * want, rtol=1e-6, atol=1e-7)
        assert np.isclose(got[0, c]["explained"], e[c - 1] / e.sum(), rtol=1e-9)
    assert all(r["n"] == n and r["deviation"] == deviation[k] and r["identity_error"] <= 1e-8 for (k, _), r in got.items())
    assert len({r["identity_error"] for r in got.values()}) == 1


def test_random_vectors_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 20)) * np.geomspace(8, 0.3, 20)
    vectors = np.concatenate([vectors, vectors[:100], np.repeat(vectors[:1], 200, 0)]).astype(np.float32).tolist()
    check(W.whiten(table(spark, vectors)), vectors, 16)


def test_constant_and_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-200, 200, (300, 4)) / 64
    vectors = np.concatenate([a, a[:, :2] + a[:, 2:], np.full((300, 2), 0.5), a[:, :1]], 1).tolist()
    check(W.whiten(table(spark, vectors)), vectors, 4)


def test_far_apart_variances(spark):
    """Variances a thousand million million times apart keep their directions, which the covariance itself would lose."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    a = (rng.standard_normal((500, 3)) * [1e9, 1e5, 20]) @ q.T
    vectors = spark.createDataFrame([(k, v) for k, v in enumerate(a.tolist())], "vec_id long, embedding array<double>")
    got = W.whiten(vectors).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-6
    white = np.zeros((500, 3))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(white.T, bias=True) - np.eye(3)).max() < 1e-6
    assert abs(np.linalg.norm(white[:, 2]) - np.sqrt(500)) < 1e-3


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [1.0, 2.0]]
    odd = [None, [], [None, 1.0], [nan, 1.0], [inf, 1.0], [1e300, 1.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(good + odd)] + [(None, [1.0, 2.0], 1)],
                               "vec_id long, embedding array<double>, whitened int").repartition(3)
    out = W.whiten(df)
    check(out.filter("vec_id is not null"), good, 2)
    assert [r["n"] for r in out.filter("vec_id is null").collect()] == [3, 3]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_varies(spark, vectors):
    assert W.whiten(table(spark, vectors)).collect() == []


def test_large_sums_stay_exact():
    values = np.array([[1 << 51, -5], [-(1 << 51), 7]])
    sums = [int(values[:, 0].sum()), int(values[:, 1].sum())]
    big = W._exact(values, 10 ** 9, [10 ** 9 * s for s in sums])
    assert big.tolist() == [[10 ** 9 * (int(v) - s) for v, s in zip(r, sums)] for r in values]


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id")
    check(W.whiten(df), [r["embedding"] for r in df.collect()], 16)
