"""Whitening against a whole decomposition in memory, and its odd cases."""

import math

import numpy as np

from factloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, x int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 0, 1, 1) for k, v in enumerate(vectors)], SCHEMA)


def check(spark, data, most=32):
    got = whitening.whiten(frame(spark, data.astype(np.float32).tolist()), most).toPandas()
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in data.astype(np.float32)]
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    c = np.array(x, dtype=float) - np.array(s) / n
    e, vecs = np.linalg.eigh(c.T @ c / n)
    e, vecs = e[::-1], vecs[:, ::-1]
    real = int((e > 1e-12 * e[0]).sum())
    assert sorted(set(got.component)) == list(range(1, min(most, real) + 1)) and len(got) == n * min(most, real)
    assert all(deviation[i] == v for i, v in zip(got.vec_id, got.deviation)) and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for k in range(wide.shape[1]):
        rows = got[got.component == k + 1]
        assert abs(rows.explained.iloc[0] - e[k] / e.sum()) < 1e-11
        gap = min(abs(e[k] - e[j]) for j in (k - 1, k + 1) if 0 <= j < d) / e[0] if d > 1 else 1
        if gap > 1e-4:
            want = c @ vecs[:, k] / e[k] ** 0.5
            assert min(np.abs(wide[:, k] - want).max(), np.abs(wide[:, k] + want).max()) < 1e-8
    return got


def test_whitening(spark, monkeypatch):
    r = np.random.default_rng(1)
    check(spark, r.standard_normal((300, 12)) * np.linspace(3, 0.5, 12))
    monkeypatch.setattr(whitening, "BLOCK", 7)
    check(spark, r.standard_normal((50, 6)), most=3)
    check(spark, r.standard_normal((5, 9)) * 10)  # fewer rows than dimensions
    low = r.standard_normal((60, 2)) @ r.standard_normal((2, 8))
    check(spark, np.round(low * 8) / 64)


def test_equal_variances_are_all_found(spark):
    cross = np.concatenate([np.eye(6), -np.eye(6)]) * 10
    got = whitening.whiten(frame(spark, cross.tolist())).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3, 4, 5, 6] and np.allclose(got.explained, 1 / 6) and got.identity_error.max() < 1e-12


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [1.0, None], [1.0, nan], [inf, 1.0], [1.0], [1.0, 2.0], [3.0, -1.0], [3.0, -1.0], [0.0, 0.5]]
    df = frame(spark, odd).unionByName(spark.createDataFrame([(None, [2.0, 2.0], None, None, None)], SCHEMA))
    got = whitening.whiten(df).collect()
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in (6, 7, 8, 9, None) for c in (1, 2)} and {r.n for r in got} == {5}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0], [1.0]])).count() == 0
