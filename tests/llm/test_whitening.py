"""Whitening against fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op11_whitening


def plain(vecs, scale=1024, offset=100_000):
    """(n, mean, deviations, covariance) in fractions."""
    x = [[math.floor(Fraction(c) * scale) + offset for c in v] for v in vecs]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    cov = [[sum(Fraction(n * r[i] - s[i], n) * Fraction(n * r[j] - s[j], n) for r in x) / n for j in range(d)] for i in range(d)]
    return n, [Fraction(v, n) for v in s], x, dev, cov


def held(got, vecs, components=8):
    n, mean, x, dev, cov = plain(vecs)
    e, v = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    trace = float(sum(cov[i][i] for i in range(len(mean))))
    rows = {r["id"]: r for r in got}
    signs = np.zeros(len(e))
    for k in range(len(vecs)):
        r = rows[k]
        assert r["n"] == n and int(r["deviation"]) == dev[k]
        far = np.array([float(a - m) for a, m in zip(x[k], mean)]) @ v
        for i in range(len(e)):
            want, have = far[i] / math.sqrt(e[i]), r["whitened"][i]
            if abs(want) > 1e-3:
                signs[i] = signs[i] or (1 if want * have > 0 else -1)
                assert have == pytest.approx(signs[i] * want, rel=1e-7, abs=1e-9)
            assert r["explained"][i] == pytest.approx(e[i] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_against_fractions(spark):
    rng = np.random.default_rng(1)
    vecs = [[float(c) for c in rng.normal(0, 1, 10) * np.arange(1, 11) / 5 + 7] for _ in range(150)]
    given = spark.createDataFrame([(i, v, "x", 3, [1.0]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, dim string, n int, whitened array<double>")
    for parts in (1, 5):
        got = whitening.whiten(given.repartition(parts)).collect()
        assert len(got) == 150
        held(got, vecs)


def test_any_size_of_number(spark):
    """Components beyond a long, and a spread far smaller than the numbers, stay exact."""
    rng = np.random.default_rng(2)
    vecs = [[1e15 + float(rng.integers(0, 50)), float(rng.normal()), 1e30 * float(rng.integers(1, 9)), float(rng.normal())] for _ in range(40)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect()
    n, mean, x, dev, cov = plain(vecs)
    assert {r["id"]: int(r["deviation"]) for r in got} == dict(enumerate(dev))
    vecs = [[1e12 + float(rng.integers(0, 50)) / 64, float(rng.normal()), float(rng.normal())] for _ in range(40)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect()
    held(got, vecs)


def test_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 4.0]), (1, [1.0, 2.0, 4.0]), (None, [3.0, 2.0, 0.5]), (2, None), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, []), (7, [5.0]), (8, [2.5, 2.0, 7.0])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["id"] or 0, r["dim"], r["n"]) for r in got) == [(0, 3, 4), (1, 3, 4), (1, 3, 4), (7, 1, 1), (8, 3, 4)]
    alone = next(r for r in got if r["id"] == 7)
    assert alone["whitened"] == [None] and alone["deviation"] == "0" and alone["identity_error"] is None and alone["explained"] == [None]
    three = next(r for r in got if r["id"] == 8)
    assert three["whitened"][2] is None and three["whitened"][0] is not None and three["identity_error"] < 1e-9
    long = [(i, [float((i * k) % 7) for k in range(300)]) for i in range(20)]
    assert {len(r["whitened"]) for r in whitening.whiten(spark.createDataFrame(long, kind)).collect()} == {8}


def test_query(spark):
    got = op11_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    ok = {r["vec_id"]: r["embedding"] for r in rows if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    n, _, _, dev, _ = plain(list(ok.values()))
    found = got.collect()
    assert len(found) == 8 * len(ok) and max(r["identity_error"] for r in found) < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in found} == dict(zip(ok, dev)) and {r["n"] for r in found} == {n}
