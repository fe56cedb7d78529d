"""Whitening against numpy's dense solver over exact whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest

from foilframe.llm import whitening


def plain(vectors, wanted=16):
    """x of each row, n, exact deviations, variances, components and the trace, from the definition."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    cov = centred.T @ centred / n
    values, parts = np.linalg.eigh(cov)
    return x, n, sums, values[::-1][:wanted], parts[:, ::-1][:, :wanted], np.trace(cov)


def test_rows_follow_the_definition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150 + [vectors[1]]  # a third are copies
    odd = [None, [], [None] * 24, [float("nan")] * 24, vectors[2][:-1] + [float("inf")], vectors[3][:-1], vectors[4][:-1] + [3e38]]
    rows = [(k if k % 40 else None, v, 1, "b") for k, v in enumerate(vectors + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, block string").repartition(7)
    x, n, sums, values, parts, trace = plain(vectors)
    found = whitening.whiten(df).collect()
    assert len(found) == len(vectors) * 16 and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-9
    sign = {}
    got = defaultdict(list)
    for r in found:
        got[r.vec_id].append(r)
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        assert r.residual < 1e-13 * values[0]
    for k, v in enumerate(x):
        if k % 40 == 0:
            continue
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        assert sorted(r.component for r in got[k]) == list(range(1, 17))
        for r in got[k]:
            want = np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ parts[:, r.component - 1] / math.sqrt(values[r.component - 1])
            turned = sign.setdefault(r.component, math.copysign(1, want * r.whitened))
            assert r.deviation == deviation and r.whitened == pytest.approx(turned * want, abs=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_is_nothing(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_short_vectors_and_large_numbers(spark):
    rows = [(k, [float(k) * 2.0**40, 1.0, float(k % 3)]) for k in range(9)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1} and all(r.identity_error < 1e-9 for r in found)
    assert all(r.deviation is None for r in found if r.vec_id != 4)


@pytest.mark.parametrize("spectrum", [np.ones(40), 1 + np.random.default_rng(1).random(90) / 10, 0.8 ** np.arange(150), np.repeat(1 / np.arange(1, 51), 2), np.r_[np.ones(5), np.zeros(60)], np.array([2.0, 1.0])])
def test_largest_pairs_reach_double_precision(spectrum):
    d = len(spectrum)
    turn, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    a = (turn * spectrum) @ turn.T
    a = (a + a.T) / 2
    values, vectors, residuals = whitening.largest_pairs(lambda v: a @ v, d)
    k = min(16, d)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1][:k]).max() < 1e-13
    assert residuals.max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_minres_solves_indefinite_systems_in_step():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    right, at = rng.normal(size=(30, 4)), np.array([0.0, 0.3, -1.0, 2.0])
    x = whitening.minres(lambda z: a @ z - z * at, right, steps=60, tolerance=1e-12)
    assert np.abs(a @ x - x * at - right).max() < 1e-7


def test_deviations_are_exact():
    apart, part = np.array([[3, -5], [1 << 40, 2]]), np.array([1, 2])
    assert whitening.deviations(apart[:1], part, 7).tolist() == [20**2 + 37**2]
    assert whitening.deviations(apart, part, 7) == [20**2 + 37**2, None]
