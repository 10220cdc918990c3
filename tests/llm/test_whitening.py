"""Whitening against a plain fit over all rows."""

import numpy as np
import pytest

from verseloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component string"


def plain(vectors, ids, k, weights="count"):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = x if weights == "count" else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    v = c.T @ c / n
    e, a = np.linalg.eigh(v)
    e, a = e[::-1][:k], a[:, ::-1][:, :k]
    white = (x - sums / n) @ a / np.sqrt(e)
    dev = [sum((n * int(p) - int(s)) ** 2 for p, s in zip(row, sums)) for row in x]
    return n, white, e / np.trace(v), dict(zip(ids, dev))


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 1, "a", "b") for k, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize("weights", ["count", "one"])
def test_equals_plain_fit(spark, weights):
    rng = np.random.default_rng(3)
    own = (rng.normal(size=(150, 12)) * np.linspace(3, 0.5, 12)).astype(np.float32).tolist()
    vectors = own + [own[0]] * 90 + own[:20]  # a third of all rows is one vector
    odd = [None, [], [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [1.0, 2.0]]
    out = whitening.whiten(table(spark, vectors + odd), 5, weights).toPandas()
    n, white, share, dev = plain(vectors, range(len(vectors)), 5, weights)
    assert len(out) == 5 * len(vectors) and set(out["vec_id"]) == set(range(len(vectors))) and set(out["n"]) == {n}
    got = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    got = got * np.sign((got * white).sum(axis=0))
    assert np.abs(got - white).max() < 1e-9
    assert dict(zip(out["vec_id"], out["deviation"])) == dev
    assert np.allclose(out.drop_duplicates("component").sort_values("component")["explained"], share, rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9


def test_few_and_flat_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, [float("nan")]])).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 4)).count() == 0  # no variance
    out = whitening.whiten(table(spark, [[1.0, 2.0, 0.0], [2.0, 2.0, 0.0], [2.0, 2.0, 0.0]])).toPandas()
    assert set(out["component"]) == {1} and sorted(out["vec_id"]) == [0, 1, 2]
    assert out["identity_error"].max() < 1e-9 and abs(out["explained"] - 1).max() < 1e-9


def test_large_numbers_stay_exact():
    y = np.array([[2**31, -(2**30)], [5, 2**33]])
    w = np.array([3, 10**6])
    want = [[sum(int(a[i]) * int(a[j]) * int(c) for a, c in zip(y, w)) for j in range(2)] for i in range(2)]
    assert whitening.whole_products(y, w).tolist() == want
    assert whitening.deviations(np.array([[1, -2]]), 10, np.array([3, 4])) == [7**2 + 24**2]
    assert whitening.deviations(np.array([[2**40, 0]]), 10**9, np.array([0, 0])) == [None]


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 3.0]), (None, [2.0, 1.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 1).toPandas()
    assert len(out) == 4 and out["vec_id"].isna().sum() == 2 and set(out["n"]) == {4}
