"""Whitening against a dense eigendecomposition of the distinct vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquill.llm import whitening


def frame(spark, rows):
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    return d.select("*", *[F.lit(1).alias(c) for c in ("id", "x", "n", "v", "component")])


def brute(rows, k=4):
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in whole)
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in whole if len(v) == d]
    fit = np.array(sorted({x for _, x in xs}), np.int64)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in xs:
        dev = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, dev, (x - s / n) @ vectors[:, c] / math.sqrt(values[c]), values[c] / values.sum()))
    return out


def some_rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 8)) * [3, 2, 1.5, 1, .7, .5, .3, .2] + [0, 5, 0, 0, -3, 0, 0, 0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[3][1]) for i in range(300)] + [(5, rows[9][1]), (None, rows[11][1])]
    rows += [(600, None), (601, []), (602, [1.0, None] * 4), (603, [float("nan")] * 8), (604, [float("inf")] + [0.0] * 7),
             (605, [1.0, 2.0]), (606, [-0.0] * 8), (607, [0.001] * 8)]
    return rows


ROWS = some_rows()


def test_against_eigh(spark):
    expected = brute(ROWS)
    got = {}
    rows = whitening.whitened(frame(spark, ROWS)).collect()
    for r in rows:
        got.setdefault((r["id"], r["component"]), []).append(r)
        assert 0 <= r["identity_error"] <= 1e-9
    assert got.keys() == expected.keys()
    signs = {}
    for key in expected:
        assert len(got[key]) == len(expected[key])
        for r, (n, dev, w, share) in zip(sorted(got[key], key=lambda r: r["deviation"]), sorted(expected[key], key=lambda e: e[1])):
            assert (r["n"], r["deviation"]) == (n, dev)
            assert r["explained"] == pytest.approx(share, rel=1e-9)
            if abs(w) > 1e-3:
                sign = signs.setdefault(key[1], math.copysign(1, w * r["whitened"]))
                assert r["whitened"] == pytest.approx(sign * w, rel=1e-6)


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (9, 9), (16, 5), (40, 40)])
def test_eigen(d, rank):
    rng = np.random.default_rng(d)
    g = rng.normal(size=(d, rank)) * 10.0 ** rng.uniform(-4, 3, size=(d, 1))
    a = g @ g.T
    values, vectors = whitening.eigen(a)
    dense = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert len(values) <= rank and (len(values) == rank or dense[len(values)] < 1e-13 * dense[0])
    assert np.allclose(values, dense[:len(values)], rtol=1e-8, atol=1e-12 * dense[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    factor, order = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a[order][:, order], atol=1e-12 * np.abs(a).max())
    assert np.allclose(np.triu(factor, 1), 0)


def test_repeated_eigenvalues_and_rounds():
    values, vectors = whitening.eigen(np.eye(6) * 4)
    assert np.allclose(values, 4) and np.allclose(vectors.T @ vectors, np.eye(6))
    for m in (1, 2, 5, 8):
        met = [frozenset(p) for i, j in whitening.rounds(m) for p in zip(i.tolist(), j.tolist())]
        assert len(met) == len(set(met)) == m * (m - 1) // 2
        assert all(len(set(i) | set(j)) == 2 * len(i) for i, j in whitening.rounds(m))


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0]), (4, [3e38, 1.0])]
    got = whitening.whitened(frame(spark, rows), components=1).collect()
    assert {r["id"]: r["deviation"] is None for r in got} == {1: True, 2: True, 3: True, 4: True}
    small = whitening.whitened(frame(spark, rows[:3]), components=1).collect()
    x = {1: (256 * 10**9, 0), 2: (-256 * 10**9, 256), 3: (0, 512)}
    for r in small:
        dev = sum((3 * a - s) ** 2 for a, s in zip(x[r["id"]], (0, 768)))
        assert r["deviation"] == (dev if dev < 1 << 63 else None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_component(spark, rows):
    df = whitening.whitened(frame(spark, rows))
    assert df.collect() == [] and df.columns[0] == "id"


def test_fewer_components_than_asked(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10
    assert got[0]["explained"] == pytest.approx(1)
