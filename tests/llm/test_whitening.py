"""Operator 12: whitening, against numpy's own eigenvectors and plain sums of whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.llm import common, queries, whitening

ODD = [(1, [0.5, float("nan"), 1.0]), (2, None), (3, [1.0, None, 2.0]), (4, [float("inf"), 0.0, 0.0]), (5, [-float("inf"), 0.0, 0.0])]


def expected(rows, most=4):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)}, rows (vec_id, vector)."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not good or not (d := max(len(v) for _, v in good)):
        return [], []
    whole = [tuple([math.floor(256 * float(c)) for c in v] + [0] * (d - len(v))) for _, v in good]
    distinct = sorted(set(whole))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in distinct], float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    k = int((e > 1e-12 * e.sum()).sum()) if e.sum() > 0 else 0
    k = min(most, k)
    out = []
    for (i, _), x in zip(good, whole):
        z = [n * c - s for c, s in zip(x, sums)]
        w = (np.array(z, float) / n) @ v[:, :k] / np.sqrt(e[:k])
        out += [(i, c + 1, n, sum(t * t for t in z), w[c], e[c] / e.sum()) for c in range(k)]
    return out, e


def compare(got, want):
    order = lambda r: (r[1], r[0] is not None, r[0] or 0, abs(r[4]))
    got = sorted((tuple(r[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained")) for r in got), key=order)
    want = sorted(want, key=order)
    assert [g[:4] for g in got] == [(*w[:3], w[3] if w[3] < 1 << 63 else None) for w in want]
    for c in {w[1] for w in want}:
        a, b = (np.array([x[4] for x in side if x[1] == c]) for side in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9 * max(1, np.abs(b).max())
        assert np.allclose([x[5] for x in got if x[1] == c], [x[5] for x in want if x[1] == c], rtol=1e-10)


@pytest.mark.parametrize("kind", ["random", "clusters", "graded", "rank two", "ones", "multiple", "zero", "near multiple"])
@pytest.mark.parametrize("n", [1, 2, 5, 33])
def test_spectrum(kind, n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    x = rng.standard_normal((n, n))
    a = {"random": x @ x.T, "clusters": q @ np.diag(rng.integers(0, 3, n)) @ q.T, "graded": q @ np.diag(10.0 ** -np.arange(n)) @ q.T, "rank two": x[:, :2] @ x[:, :2].T, "ones": np.ones((n, n)), "multiple": 3 * np.eye(n), "zero": np.zeros((n, n)), "near multiple": np.eye(n) + 1e-15 * (x + x.T)}[kind]
    a = (a + a.T) / 2
    e, v = whitening.spectrum(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
    assert np.linalg.norm(a @ v - v * e) < 1e-13 * size and np.linalg.norm(v.T @ v - np.eye(n)) < 1e-13
    few, w = whitening.spectrum(a, 3)
    assert len(few) == min(3, n) and np.allclose(few, e[:3]) and np.linalg.norm(a @ w - w * few) < 1e-13 * size


def test_polar_factor():
    rng = np.random.default_rng(4)
    for low in (1, 1e-3, 1e-9, 1e-15):
        u, v = (np.linalg.qr(rng.standard_normal((20, 20)))[0] for _ in range(2))
        x = whitening.polar_factor(u @ np.diag(np.geomspace(low, 1, 20)) @ v.T)
        assert np.linalg.norm(x.T @ x - np.eye(20)) < 1e-13
        if low > 1e-6:
            assert np.linalg.norm(x - u @ v.T) < 1e-9
    with pytest.raises(np.linalg.LinAlgError):
        whitening.polar_factor(np.diag([1.0, 0.0]))


def test_query(spark, small):
    rows = [tuple(r) for r in common.table(spark, small, "embeddings").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op12_whitening"](spark, small).collect()
    compare(got, expected(rows)[0])
    (error,) = {r["identity_error"] for r in got}
    assert 0 <= error < 1e-10


def rows_of(name):
    rng = np.random.default_rng(7)
    floats = lambda n, d: [(i, [float(c) for c in rng.standard_normal(d)]) for i in range(n)]
    return {
        "odd entries": [*floats(40, 3), *ODD],
        "repeated rows and ids": [*floats(30, 5), *[(3, [0.25] * 5)] * 50, (None, [0.25] * 5), (None, [-1.0] * 5)],
        "short and empty vectors": [*floats(20, 4), (90, [1.0]), (91, []), (92, [1.0, 0.0])],
        "fewer vectors than components": floats(3, 6),
        "one vector": [(1, [1.0, 2.0])] * 3,
        "nothing but odd entries": ODD,
        "only empty vectors": [(1, []), (2, [])],
        "large entries": [(i, [c * 1e15 for c in v]) for i, v in floats(25, 3)],
        "deviations about the largest long": [(i, [c * 2.0**20, c]) for i, (c,) in floats(30, 1)] + [(50, [2.0**21 - 0.7, 0.0]), (51, [2.3e7, 0.0])],
        "one entry": floats(12, 1),
    }[name]


@pytest.mark.parametrize("name", ["odd entries", "repeated rows and ids", "short and empty vectors", "fewer vectors than components", "one vector", "nothing but odd entries", "only empty vectors", "large entries", "deviations about the largest long", "one entry"])
def test_odd_vectors(spark, name, tmp_path):
    rows = rows_of(name)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "whitened", "deviation", "k", "component", "n", "label", "i", "v")})
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/embeddings.parquet")
    compare(queries.QUERIES["op12_whitening"](spark, folder).collect(), expected(rows)[0])


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_whitening"](spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(k, [float(k % 5), float(k * k % 7)], "a") for k in range(20)], "vec_id long, embedding array<float>, label string")
    by = whitening.fit(df, 2)
    out = whitening.whitened(df, by)
    assert out.columns == ["vec_id", "embedding", "label", "whitened", "deviation"] and out.count() == 20
    assert by.identity_error < 1e-12
    with pytest.raises(Exception, match="more than 2 entries"):
        whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"), by).collect()


def test_too_many_entries(spark):
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [0.0] * 1025)], "vec_id long, embedding array<double>"), 4)
