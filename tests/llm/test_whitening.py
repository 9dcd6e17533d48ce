"""Whitening against numpy's own eigenvectors, and the parts of its method."""

import math

import numpy as np
import pytest

from relata.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 40):
        a = rng.normal(size=(n, n))
        yield a @ a.T
        yield a + a.T
    yield np.zeros((4, 4))
    yield np.ones((6, 6))
    yield np.diag([3.0, 0, 0, 3, 1])
    yield np.diag([1e-150, 1e150, 1.0])


@pytest.mark.parametrize("a", list(matrices()))
def test_symmetric_qr(a):
    values, vectors = whitening.symmetric_qr(a)
    size = np.abs(a).max() or 1
    assert np.all(np.diff(values) <= 0)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 * len(a)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size * len(a)


def test_updates_and_merges_equal_whole_sums():
    x = np.random.default_rng(2).integers(-500, 900, (400, 6))
    parts = []
    for own in np.split(x, [1, 30, 31, 250]):
        m = whitening.Moments.none(6)
        m.take(own)
        parts.append(m)
    whole = whitening.Moments.none(6)
    for m in parts:
        whole.merge(m)
    whole.merge(whitening.Moments.none(6))
    assert whole.n == 400 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


def test_sums_beyond_64_bits():
    x = np.full((5, 2), 2**62, np.int64)
    m = whitening.Moments.none(2)
    m.take(x)
    assert m.sums == [5 * 2**62] * 2


def test_packed_vectors():
    x = np.array([[0, -128], [127, 128], [-40_000, 3], [2**40, -1], [ 2**62, -(2**63)]], np.int64)
    packed = whitening.pack(x)
    assert [p[0] for p in packed] == [1, 2, 4, 8, 8] and all((whitening.unpack(p) == row).all() for p, row in zip(packed, x))


def expected(rows, components=4):
    """{id: (deviation, whitened)}, n and explained shares by plain numpy."""
    good = [(k, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for k, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and v]
    x = np.stack([v for _, v in good])
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    c = u - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, [(k, int(((n * v - sums) ** 2).sum()), ((v - sums / n) @ vectors) / np.sqrt(values)) for k, v in good], values / np.trace(c.T @ c / n)


def test_whitened_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])).astype(np.float32)
    rows = [(k, list(map(float, v))) for k, v in enumerate(base)] + [(1000 + k, list(map(float, base[0]))) for k in range(200)]  # a third are copies
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (2004, []), (2005, [-0.0, -0.0, 0.0, 0.0, -0.001, 1e-9])]
    n, whole, explained = expected(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(40)
    monkeypatch.setattr(whitening, "FAN_IN", 4)
    models = whitening.fit(df)
    found = {}
    for r in whitening.whiten(df, models).collect():
        assert r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(found) == {k for k, _, _ in whole}
    got = np.array([[found[k][c]["whitened"] for c in (1, 2, 3, 4)] for k, _, _ in whole])
    want = np.array([w for _, _, w in whole])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-9
    assert all(found[k][c]["deviation"] == d for k, d, _ in whole for c in (1, 2, 3, 4))


def test_odd_vectors(spark):
    def run(rows, schema=SCHEMA):
        df = spark.createDataFrame(rows, schema)
        return sorted(map(tuple, whitening.whiten(df, whitening.fit(df)).collect()), key=repr)

    assert run([]) == [] and run([(1, None), (2, []), (3, [math.nan])]) == []
    same = run([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])])
    assert len(same) == 6 and {r[2:] for r in same} == {(1, 0, None, None, None)}
    mixed = run([(1, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [5.0]), (4, [7.0])])
    assert [(r[0], r[1], r[2]) for r in mixed] == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 2), (4, 1, 2)]
    assert {abs(round(r[4], 9)) for r in mixed if r[1] == 1} == {1.0} and mixed[1][4] is None  # two vectors vary in one direction only
    huge = run([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])])
    assert len(huge) == 6 and huge[0][3] is None
    clashing = spark.createDataFrame([(1, [0.0, 1.0], "x", 3), (2, [1.0, 0.0], "y", 4)], SCHEMA + ", size string, `a.b` int")
    assert whitening.whiten(clashing, whitening.fit(clashing)).count() == 4
    assert len(run([(1, [0.1, 0.2]), (2, [0.3, 0.1])], "vec_id long, embedding array<double>")) == 4


def test_too_many_dimensions_are_an_error(spark):
    df = spark.createDataFrame([(1, [0.5] * (whitening.MAX_DIMENSIONS + 1))], SCHEMA)
    with pytest.raises(Exception, match="are whitened"):
        whitening.fit(df)
