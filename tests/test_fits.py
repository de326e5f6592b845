"""The model fits against slow, independent calculations."""

import math

import numpy as np
import pytest

from demandloom.functions import fits


def rng(seed=0):
    return np.random.default_rng(seed)


# --- ARIMA(1,1,1)


def arma_covariance(n, phi, theta):
    """Covariance of an ARMA(1,1) with unit shocks, from its moving-average form."""
    weights = [1.0]
    for k in range(1, 20000):
        weights.append((phi + theta) * phi ** (k - 1))
        if abs(weights[-1]) < 1e-16:
            break
    w = np.array(weights)
    gamma = [float(w[: len(w) - k] @ w[k:]) if k < len(w) else 0.0 for k in range(n + 1)]
    return np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)]), np.array(gamma[1 : n + 1][::-1])


@pytest.mark.parametrize("phi, theta", [(0.5, 0.3), (-0.4, 0.7), (0.9, -0.8), (0.0, -0.95)])
def test_innovations_give_the_exact_likelihood(phi, theta):
    d = rng().normal(size=9)
    cov, ahead = arma_covariance(9, phi, theta)
    solved = np.linalg.solve(cov, d)
    exact = math.log(d @ solved / 9) + np.linalg.slogdet(cov)[1] / 9
    score, pred = fits._innovations(d[None, :], np.array([9]), np.array([[phi]]), np.array([[theta]]))
    assert score[0, 0] == pytest.approx(exact, abs=1e-9)
    assert pred[0, 0] == pytest.approx(ahead @ solved, abs=1e-9)


def test_arima_search_beats_a_dense_grid():
    for seed in range(5):
        d = np.diff(rng(seed).integers(1, 50, size=30).astype(float))
        size = np.array([len(d)])
        phi, theta, _ = fits._arima_search(d[None, :], size)
        found, _ = fits._innovations(d[None, :], size, phi[:, None], theta[:, None])
        side = np.linspace(-0.995, 0.995, 80)
        a, b = (g.ravel()[None, :] for g in np.meshgrid(side, side))
        grid, _ = fits._innovations(d[None, :], size, a, b)
        assert found[0, 0] <= grid.min() + 1e-3


def test_arima_recovers_its_own_process():
    e, d = rng(1).normal(size=4000), np.zeros(4000)
    for i in range(1, 4000):
        d[i] = 0.6 * d[i - 1] + e[i] + 0.3 * e[i - 1]
    phi, theta, _ = fits._arima_search(d[None, :], np.array([4000]))
    assert phi[0] == pytest.approx(0.6, abs=0.05) and theta[0] == pytest.approx(0.3, abs=0.05)


# --- trend and seasonality


def test_weights_minimise_the_posterior():
    g = rng(2)
    days = np.arange(120.0)
    y = 5 + 0.05 * days + np.sin(2 * np.pi * days / 7) + g.normal(scale=0.3, size=120)
    scaled = y / np.abs(y).max()
    x = fits._design(days, 0.0, 119.0, fits._knots(days))
    w, noise = fits._map_weights((x.T @ x)[None], (x.T @ scaled)[None], np.array([scaled @ scaled]), np.array([120.0]))
    w, noise = w[0], noise[0]
    changes = slice(2, x.shape[1] - 6)

    def loss(w, noise):
        sse = ((scaled - x @ w) ** 2).sum()
        ridge = w[0] ** 2 / 425 + w[1] ** 2 / 25 + (w[-6:] ** 2).sum() / 100
        return 60 * math.log(noise) + sse / (2 * noise) + noise / 0.5 + ridge / 2 + np.abs(w[changes]).sum() / 0.05

    best = loss(w, noise)
    for j in range(len(w)):
        for step in (-1e-2, 1e-2):
            moved = w.copy()
            moved[j] += step
            assert loss(moved, noise) >= best - 1e-2
    assert loss(w, noise * 1.05) >= best and loss(w, noise * 0.95) >= best


def test_seasonal_model_continues_trend_and_week():
    days = np.arange(140.0)
    wave = np.array([0, 3, 6, 2, -4, -5, -2.0])

    def truth(d):
        return 100 + 0.5 * d + wave[d.astype(int) % 7]

    ahead = np.arange(140.0, 154.0)
    (path,) = fits.seasonal_paths([days], [truth(days)], [ahead])
    assert np.abs(path - truth(ahead)).max() < 2.0


# --- boosted trees


def slow_boost(series, steps):
    x, y = series[:-1], series[1:]
    trees, start = [], sum(y) / len(y)

    def tree_value(tree, v):
        while isinstance(tree, tuple):
            tree = tree[1] if v < tree[0] else tree[2]
        return tree

    def predict(v):
        return start + sum(tree_value(t, v) for t in trees)

    def grow(rows, depth):
        total = sum(rows[i] for i in rows)
        leaf = 0.1 * total / (len(rows) + 1)
        if depth == 0:
            return leaf
        best = (1e-6, None)
        for cut in sorted({x[i] for i in rows})[1:]:
            left = [rows[i] for i in rows if x[i] < cut]
            rest = total - sum(left)
            gain = sum(left) ** 2 / (len(left) + 1) + rest**2 / (len(rows) - len(left) + 1) - total**2 / (len(rows) + 1)
            if gain > best[0] + 1e-9:
                best = (gain, cut)
        if best[1] is None:
            return leaf
        parts = ({i: r for i, r in rows.items() if (x[i] < best[1]) == side} for side in (True, False))
        return (best[1], *(grow(part, depth - 1) for part in parts))

    for _ in range(50):
        trees.append(grow({i: y[i] - predict(x[i]) for i in range(len(x))}, 2))
    out, last = [], series[-1]
    for _ in range(steps):
        last = max(predict(last), 0.0)
        out.append(last)
    return out


@pytest.mark.parametrize("seed, size", [(0, 6), (1, 9), (2, 20), (3, 33)])
def test_boosted_trees_match_grown_trees(seed, size):
    series = rng(seed).gamma(2.0, 20.0, size=size)
    (path,) = fits.boosted_paths([series], [5])
    assert path == pytest.approx(slow_boost(list(series), 5), rel=1e-9)


# --- all models


def all_paths(series, steps=5):
    days = [np.arange(float(len(s))) for s in series]
    ahead = [np.arange(float(len(s)), len(s) + float(steps)) for s in series]
    return {
        "arima": fits.arima_paths(series, [steps] * len(series)),
        "prophet": fits.seasonal_paths(days, series, ahead),
        "xgboost": fits.boosted_paths(series, [steps] * len(series)),
    }


@pytest.mark.parametrize("size", range(0, 9))
def test_short_series_have_no_fit(size):
    series = [np.arange(1.0, size + 1.0) * 3 % 7]
    for model, paths in all_paths(series).items():
        assert (paths[0] is not None) == (size >= fits.MIN_POINTS[model])


@pytest.mark.parametrize("value", [0.0, 7.0])
def test_constant_series_stay_constant(value):
    for model, paths in all_paths([np.full(12, value)]).items():
        assert paths[0] == pytest.approx([value] * 5, abs=1e-9), model


def test_paths_are_finite_and_not_negative():
    series = [rng(s).integers(0, 40, size=n).astype(float) for s, n in enumerate([6, 7, 12, 30, 31, 200])]
    series.append(np.linspace(100, 1, 20))
    for paths in all_paths(series, 40).values():
        for path in paths:
            assert len(path) == 40 and np.isfinite(path).all() and (path >= 0).all()


def test_batching_does_not_change_results():
    series = [rng(s).integers(0, 40, size=6 + s % 50).astype(float) for s in range(300)]
    together = all_paths(series)
    for i in (0, 17, 123, 299):
        alone = all_paths([series[i]])
        for model in together:
            assert together[model][i] == pytest.approx(alone[model][0], rel=1e-6, abs=1e-6)


def test_missing_values_and_no_steps_have_no_fit():
    assert fits.arima_paths([np.array([1.0, np.nan, 2, 3, 4])], [3]) == [None]
    assert fits.boosted_paths([np.arange(9.0)], [0]) == [None]
    assert fits.arima_paths([None], [3]) == [None]


def test_one_failed_fit_does_not_harm_the_others(monkeypatch):
    real = fits._seasonal_chunk

    def failing(days, values, at):
        if any(v[0] == 99.0 for v in values):
            raise np.linalg.LinAlgError
        return real(days, values, at)

    good, bad = rng(3).gamma(2.0, 9.0, size=12), np.arange(99.0, 111.0)
    days, ahead = np.arange(12.0), np.arange(12.0, 15.0)
    (alone,) = fits.seasonal_paths([days], [good], [ahead])
    monkeypatch.setattr(fits, "_seasonal_chunk", failing)
    paths = fits.seasonal_paths([days] * 2, [good, bad], [ahead] * 2)
    assert paths[0] == pytest.approx(alone) and paths[1] is None


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_extreme_values_do_not_fail():
    for size in (1e-300, 1e150, 1e308):
        for paths in all_paths([rng(4).random(20) * size]).values():
            assert paths[0] is None or np.isfinite(paths[0]).all()
