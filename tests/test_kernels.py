"""Numpy kernels against first-order conditions and brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dayloom.functions import kernels


def _data(seed, n, d, scale=3.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1] = x[:, 0] + 0.05 * rng.normal(size=n)
    x = (x - x.mean(0)) / x.std(0)
    y = scale * (x[:, 0] - 0.5 * x[:, d - 1] + rng.normal(size=n))
    return x, y - y.mean()


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([(12, 20), (200, 15)]),
       st.sampled_from([(0.1, 0.0), (0.007, 0.003)]))
def test_elastic_net_is_optimal(seed, shape, penalty):
    x, y = _data(seed, *shape)
    (n, d), (l1, l2) = shape, penalty
    gram, cross = x.T @ x / n, x.T @ y / n
    w = kernels.elastic_net(gram[None], cross[None], l1, l2)[0]
    slope = cross - gram @ w - l2 * w
    assert np.abs(slope).max() <= l1 + 1e-8
    on = w != 0
    assert np.allclose(slope[on], l1 * np.sign(w[on]), atol=1e-8)


def test_ridge_normal_equations():
    x, y = _data(1, 80, 6)
    w = kernels.ridge((x.T @ x)[None], (x.T @ y)[None, :, None], [2.0])[0, :, 0]
    assert np.allclose(x.T @ (y - x @ w), 2.0 * w)


def test_huber_is_a_minimum():
    x, y = _data(2, 150, 5)
    y = y + np.where(np.arange(150) % 17 == 0, 60.0, 0.0)
    w, b = kernels.huber(x, y)
    r = np.abs(y - x @ w - b)

    def objective(w, b, s):
        z = np.abs(y - x @ w - b) / s
        return (s + np.where(z < 1.35, z * z, 2.7 * z - 1.35 ** 2) * s).sum() + 1e-4 * w @ w

    scales = np.linspace(0.2, 5, 4000)
    scale = min(scales, key=lambda s: objective(w, b, s))
    best = objective(w, b, scale)
    rng = np.random.default_rng(0)
    assert r.max() > 30
    for _ in range(200):
        assert objective(w + 1e-2 * rng.normal(size=5), b + 1e-2 * rng.normal(), scale) > best - 1e-6


@pytest.mark.parametrize("epsilon,penalise", [(0.1, False), (0.0, True)])
def test_insensitive_is_a_minimum(epsilon, penalise):
    x, y = _data(3, 120, 4)
    w, b = kernels.insensitive(x, y + 5, 1.0, epsilon, penalise)

    def objective(w, b):
        loss = np.maximum(np.abs(y + 5 - x @ w - b) - epsilon, 0).sum()
        return 0.5 * (w @ w + (b * b if penalise else 0.0)) + loss

    best, rng = objective(w, b), np.random.default_rng(0)
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(100):
            assert objective(w + size * rng.normal(size=4), b + size * rng.normal()) > best - 1e-4


def test_bayesian_ridge_recovers_weights():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x -= x.mean(0)
    y = x @ [2.0, 0.0, -1.0] + 0.1 * rng.normal(size=400)
    y -= y.mean()
    w = kernels.bayesian_ridge(x.T @ x, x.T @ y, y @ y, 400)
    assert np.allclose(w, [2.0, 0.0, -1.0], atol=0.03)


def test_walk_matches_a_plain_loop():
    lags, windows = (1, 7, 30), (7, 30)
    histories = [list(np.arange(1.0, 6.0)), list(np.sin(np.arange(60.0)))]

    def predict(step, recent):
        return 0.3 * recent[:, 0] + 0.2 * recent[:, 1] - 0.1 * recent[:, 2] \
            + 0.4 * recent[:, 3] + 0.1 * recent[:, 4]

    got = kernels.walk(histories, 12, predict, lags, windows)
    for row, h in zip(got, histories):
        h = list(h)
        for value in row:
            parts = [h[-n] if len(h) >= n else h[-1] for n in lags]
            parts += [np.mean(h[-w:]) for w in windows]
            expected = predict(0, np.array([parts]))[0]
            assert value == pytest.approx(expected, abs=1e-12)
            h.append(expected)


def test_nearest_mean_breaks_ties_by_order():
    x = np.zeros((6, 1))
    assert kernels.nearest_mean(x, np.arange(6.0), np.zeros(1), k=5) == 2.0
    assert kernels.nearest_mean(x[:2], np.array([1.0, 3.0]), np.zeros(1), k=5) == 2.0
