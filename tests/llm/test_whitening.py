"""Whitening against exact fractions and a plain eigen-decomposition in double precision."""

import math
from fractions import Fraction

import numpy as np
import pytest

from shelfscope.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, k0 string, x string, component int, i int"


def grid(v):
    return [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]


def rows(rng, n=60, d=6):
    base = rng.normal(size=(n, d)) * np.array([1, 2, 0.5, 1, 3, 0.1]) + 0.3
    out = [(i, [float(np.float32(e)) for e in v], "k", "x", 9, 1) for i, v in enumerate(base)]
    out += [(100, out[3][1], "k", "x", 9, 1), (3, out[5][1], "k", "x", 9, 1), (None, out[4][1], None, None, None, None)] * 3
    out += [(200, None, "k", "x", 9, 1), (201, [1.0] * (d - 1) + [None], "k", "x", 9, 1),
            (202, [float("nan")] * d, "k", "x", 9, 1), (203, [float("inf")] * d, "k", "x", 9, 1),
            (204, [1.0], "k", "x", 9, 1), (205, [], "k", "x", 9, 1), (206, [1e30] * d, "k", "x", 9, 1)]
    return out


def test_values_equal_exact_sums_and_plain_eigenvectors(spark):
    data = rows(np.random.default_rng(11))
    got = W.whiten(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    used = [(r[0], grid(r[1])) for r in data if r[1] is not None and len(r[1]) == 6
            and all(e is not None and math.isfinite(e) and abs(e) < 1e12 for e in r[1])]
    distinct = sorted({tuple(x) for _, x in used})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = [[Fraction(x) - Fraction(s, n) for x, s in zip(v, sums)] for v in distinct]
    cov = np.array([[float(sum(a[i] * a[j] for a in centred) / n) for j in range(6)] for i in range(6)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 6 * len(used)
    deviations = sorted(sum((n * x - s) ** 2 for x, s in zip(v, sums)) for _, v in used)
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == deviations
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-10
    for c in range(6):
        mine = sorted((r["vec_id"] is not None, r["vec_id"] or 0, abs(r["whitened"])) for r in got if r["component"] == c + 1)
        plain = sorted((i is not None, i or 0, abs(float(
            sum(float(Fraction(a) - Fraction(s, n)) * p for a, s, p in zip(x, sums, vectors[:, c]))) / math.sqrt(values[c])))
            for i, x in used)
        assert [m[:2] for m in mine] == [p[:2] for p in plain]
        np.testing.assert_allclose([m[2] for m in mine], [p[2] for p in plain], rtol=1e-9, atol=1e-10)
        share = {r["explained"] for r in got if r["component"] == c + 1}
        assert len(share) == 1 and math.isclose(share.pop(), values[c] / values.sum(), rel_tol=1e-12)


def test_sums_do_not_depend_on_the_partitions(spark):
    df = spark.createDataFrame(rows(np.random.default_rng(3)), SCHEMA)
    one, many = (sorted(W.whiten(df.repartition(k)).where("vec_id < 5").select("vec_id", "component", "whitened").collect())
                 for k in (1, 7))
    assert one == many


def test_exact_gram_of_large_entries():
    rng = np.random.default_rng(1)
    z = rng.integers(-(1 << 45), 1 << 45, size=(50, 3))
    plain = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(3)] for i in range(3)]
    assert W.exact_gram(z).tolist() == plain
    assert W._from_limbs(W._to_limbs(np.array(plain, dtype=object).ravel())).tolist() == sum(plain, [])


@pytest.mark.parametrize("gaps", [[4, 3, 2, 1, 0.5], [1, 1 + 1e-9, 1 + 2e-9, 1 + 1e-12, 0.3],
                                  [2, 2, 2, 1, 1 + 1e-7], [1, 1e-3, 1e-6, 1e-9, 1e-11]])
def test_refined_eigenvectors(gaps):
    """Better than float32 by far, also inside clusters that float32 can't tell apart."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0].astype(np.longdouble)
    for _ in range(3):      # orthonormal in extended precision
        q = q + q @ ((np.eye(5, dtype=np.longdouble) - q.T @ q) / 2)
    gaps = np.array(gaps, np.longdouble)
    a = (q * gaps) @ q.T
    a = (a + a.T) / 2
    values, x, done = W.eigen(a)
    assert float(np.abs(x.T @ x - np.eye(5)).max()) < 1e-17
    off = x.T @ a @ x
    assert float(np.abs(off - np.diag(np.diag(off))).max()) < 1e-17
    np.testing.assert_allclose(values.astype(float), sorted(gaps.astype(float), reverse=True), rtol=1e-14, atol=1e-17)
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    raw = start.T @ a @ start
    assert float(np.abs(raw - np.diag(np.diag(raw))).max()) > 1e-9      # what refinement starts from
    for k, g in enumerate(sorted(gaps, reverse=True)):
        if min(abs(g - h) for h in np.delete(gaps, int(np.flatnonzero(gaps == g)[0]))) > 1e-13:
            mate = q[:, int(np.flatnonzero(gaps == g)[0])]
            assert 1 - abs(float(mate @ x[:, k])) < 1e-8
    if len(set(np.round(gaps.astype(float), 6))) < 5:
        assert done.clusters > 0


def test_nothing_to_whiten(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "k", "x", 9, 1)] * 3, SCHEMA)
    assert W.whiten(df).collect() == []                                   # one distinct vector: no variance
    assert W.whiten(df.limit(0)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [], "", "", 1, 1), (2, None, "", "", 1, 1)], SCHEMA)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 5.0, float(2 * i)], "k", "x", 9, 1) for i in range(9)], SCHEMA)
    got = W.whiten(flat).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9          # two directions have no variance
    assert W.whiten(flat, components=0).collect() == []
