"""Per-series model fits, vectorised over the series of one Arrow batch.

Spark packs one series per row and spreads the rows; the functions here only turn arrays
into forecast arrays. All are deterministic and treat each series on its own, so results do
not depend on batching or partitioning. A series that is too short gives None.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_POINTS = {"arima": 4, "prophet": 4, "xgboost": 6}

CHUNK = 256


def _usable(values: np.ndarray | None, steps: int | None, least: int) -> bool:
    return values is not None and len(values) >= least and bool(steps) and bool(np.isfinite(values).all())


def _chunks(lengths: dict[int, int]) -> Iterator[list[int]]:
    """Row numbers, longest series first, in chunks of similar length."""
    order = sorted(lengths, key=lambda i: -lengths[i])
    for at in range(0, len(order), CHUNK):
        yield order[at : at + CHUNK]


def _padded(arrays: list[np.ndarray], fill: float) -> np.ndarray:
    out = np.full((len(arrays), max(map(len, arrays))), fill)
    for row, a in enumerate(arrays):
        out[row, : len(a)] = a
    return out


# --- ARIMA(1,1,1): exact Gaussian likelihood of the differenced ARMA(1,1) ---------------

EDGE = 0.999


def _innovations(d: np.ndarray, size: np.ndarray, phi: np.ndarray, theta: np.ndarray):
    """One-step prediction pass: -2 log-likelihood per value, and the next prediction.

    Rows of `d` come longest first, so the series still running at step t are a prefix.
    """
    r = (1.0 + 2.0 * phi * theta + theta**2) / (1.0 - phi**2)
    pred = np.zeros_like(phi)
    squares, logs = np.zeros_like(phi), np.zeros_like(phi)
    running = np.searchsorted(-size, -np.arange(d.shape[1]), side="left")
    for t in range(d.shape[1]):
        k = running[t]
        now = d[:k, t, None]
        u = now - pred[:k]
        squares[:k] += u * u / r[:k]
        logs[:k] += np.log(r[:k])
        pred[:k] = phi[:k] * now + theta[:k] / r[:k] * u
        r[:k] = 1.0 + theta[:k] ** 2 - theta[:k] ** 2 / r[:k]
    n = size[:, None]
    return np.log(np.maximum(squares, 1e-300) / n) + logs / n, pred


def _arima_search(d: np.ndarray, size: np.ndarray):
    """Best (phi, theta) per series on ever finer grids, and the next difference."""
    rows = np.arange(len(size))
    best_phi, best_theta = np.zeros(len(size)), np.zeros(len(size))
    half, points = EDGE, 9
    for _ in range(6):
        offsets = np.linspace(-half, half, points)
        along, across = (g.ravel() for g in np.meshgrid(offsets, offsets, indexing="ij"))
        phi = np.clip(best_phi[:, None] + along, -EDGE, EDGE)
        theta = np.clip(best_theta[:, None] + across, -EDGE, EDGE)
        score, pred = _innovations(d, size, phi, theta)
        pick = score.argmin(axis=1)
        best_phi, best_theta, next_diff = phi[rows, pick], theta[rows, pick], pred[rows, pick]
        half, points = offsets[1] - offsets[0], 7
    return best_phi, best_theta, next_diff


def _arima_chunk(series: list[np.ndarray], steps: list[int]) -> list[np.ndarray]:
    diffs = [np.diff(s) for s in series]
    phi, _, next_diff = _arima_search(_padded(diffs, 0.0), np.array([len(x) for x in diffs]))
    out = []
    for i, s in enumerate(series):
        # A constant series has no likelihood to speak of and stays constant.
        ahead = next_diff[i] * phi[i] ** np.arange(steps[i]) if diffs[i].any() else np.zeros(steps[i])
        out.append(np.maximum(s[-1] + np.cumsum(ahead), 0.0))
    return out


def arima_paths(series, steps) -> list:
    out: list = [None] * len(series)
    fit = {i: len(s) for i, s in enumerate(series) if _usable(s, steps[i], MIN_POINTS["arima"])}
    for chunk in _chunks(fit):
        for i, path in zip(chunk, _arima_chunk([series[i] for i in chunk], [steps[i] for i in chunk])):
            out[i] = path if np.isfinite(path).all() else None
    return out


# --- Trend with change points and weekly waves, maximum a posteriori ---------------------

# The published default priors of the trend-and-seasonality model.
CHANGE_POINTS, CHANGE_RANGE, CHANGE_SCALE = 25, 0.8, 0.05
TREND_VAR, SEASON_VAR, NOISE_VAR = 5.0**2, 10.0**2, 0.5**2
WEEKLY_ORDER = 3
# At midnight the four daily cosine terms are 1, so they only widen the intercept's prior.
INTERCEPT_VAR = TREND_VAR + 4 * SEASON_VAR
NOISE_FLOOR = 1e-4
ROUNDS, SETTLED = 60, 1e-5


def _design(days: np.ndarray, start: float, span: float, knots: np.ndarray) -> np.ndarray:
    t = (days - start) / span
    hinges = np.maximum(t[:, None] - knots, 0.0)
    angle = 2.0 * np.pi * np.outer(days, np.arange(1, WEEKLY_ORDER + 1)) / 7.0
    return np.hstack([np.ones((len(t), 1)), t[:, None], hinges, np.sin(angle), np.cos(angle)])


def _map_weights(gram: np.ndarray, moment: np.ndarray, yy: np.ndarray, n: np.ndarray):
    """Weights and noise variance per series, for scaled values.

    The Laplace prior of the change points enters as a ridge that is weighted anew each round.
    """
    p = gram.shape[1]
    changes, diagonal = slice(2, p - 2 * WEEKLY_ORDER), np.arange(p)
    precision = np.full(moment.shape, 1.0 / SEASON_VAR)
    precision[:, 0], precision[:, 1] = 1.0 / INTERCEPT_VAR, 1.0 / TREND_VAR
    precision[:, changes] = 1.0 / CHANGE_SCALE**2
    weights, noise = np.zeros_like(moment), np.full(len(yy), NOISE_VAR)
    left = np.arange(len(yy))
    for _ in range(ROUNDS):
        # Each series stops on its own, so its result does not depend on its neighbours.
        g, m, size = gram[left], moment[left], n[left]
        system = g / noise[left, None, None]
        system[:, diagonal, diagonal] += precision[left]
        w = np.linalg.solve(system, (m / noise[left, None])[:, :, None])[:, :, 0]
        fitted = (w * (g @ w[:, :, None])[:, :, 0]).sum(axis=1)
        sse = np.maximum(yy[left] - 2.0 * (w * m).sum(axis=1) + fitted, 0.0)
        noise[left] = np.maximum((np.sqrt(size**2 + 4.0 * sse / NOISE_VAR) - size) * NOISE_VAR / 2.0, NOISE_FLOOR)
        precision[left, changes] = 1.0 / (CHANGE_SCALE * np.maximum(np.abs(w[:, changes]), 1e-6))
        moved = np.abs(w - weights[left]).max(axis=1)
        weights[left] = w
        left = left[moved > SETTLED]
        if not len(left):
            break
    return weights, noise


def _knots(days: np.ndarray) -> np.ndarray:
    past = int(np.floor(len(days) * CHANGE_RANGE))
    places = np.linspace(0, past - 1, min(CHANGE_POINTS, past - 1) + 1).round().astype(int)[1:]
    return (days[places] - days[0]) / max(days[-1] - days[0], 1.0)


def _seasonal_chunk(days: list[np.ndarray], values: list[np.ndarray], at: list[np.ndarray]) -> list[np.ndarray]:
    """Fits series with equally many change points in one stack of small systems."""
    knots = [_knots(day) for day in days]
    spans = [max(day[-1] - day[0], 1.0) for day in days]
    scales = [np.abs(y).max() for y in values]
    scaled = [y / scale for y, scale in zip(values, scales)]
    designs = (_design(day, day[0], span, k) for day, span, k in zip(days, spans, knots))
    grams, moments = zip(*((x.T @ x, x.T @ y) for x, y in zip(designs, scaled)))
    squares, sizes = np.array([y @ y for y in scaled]), np.array([float(len(y)) for y in scaled])
    w, _ = _map_weights(np.stack(grams), np.stack(moments), squares, sizes)
    return [
        np.maximum(_design(ahead, day[0], span, k) @ weights * scale, 0.0)
        for ahead, day, span, k, weights, scale in zip(at, days, spans, knots, w, scales)
    ]


def _seasonal_or_none(days: list[np.ndarray], values: list[np.ndarray], at: list[np.ndarray]) -> list:
    try:
        return _seasonal_chunk(days, values, at)
    except np.linalg.LinAlgError:
        if len(values) == 1:
            return [np.array([np.nan])]
        # One series without a solution must not cost the others theirs.
        return [_seasonal_or_none([d], [v], [a])[0] for d, v, a in zip(days, values, at)]


def seasonal_paths(days, series, at) -> list:
    out: list = [None] * len(series)
    steps = [None if a is None else len(a) for a in at]
    groups: dict[int, dict[int, int]] = {}
    for i, s in enumerate(series):
        if not _usable(s, steps[i], MIN_POINTS["prophet"]):
            continue
        if s.min() == s.max():
            out[i] = np.full(steps[i], max(s[0], 0.0))
            continue
        knots = min(CHANGE_POINTS, int(len(s) * CHANGE_RANGE) - 1)
        groups.setdefault(knots, {})[i] = len(s)
    for group in groups.values():
        for chunk in _chunks(group):
            picked = ([np.asarray(col[i], dtype=float) for i in chunk] for col in (days, series, at))
            for i, path in zip(chunk, _seasonal_or_none(*map(list, picked))):
                out[i] = path if np.isfinite(path).all() else None
    return out


# --- Boosted depth-2 trees on the previous value -----------------------------------------

# Fixed values of the boosted model.
TREES, RATE, SHRINK, LEAST_GAIN = 50, 0.1, 1.0, 1e-6


def _gain(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    # Cuts outside a node have no meaning here; the caller masks them.
    with np.errstate(divide="ignore", invalid="ignore"):
        return g * g / (n + SHRINK)


def _boosted_chunk(series: list[np.ndarray], steps: list[int]) -> list[np.ndarray]:
    order = [np.argsort(s[:-1], kind="stable") for s in series]
    size = np.array([len(o) for o in order])
    x = _padded([s[:-1][o] for s, o in zip(series, order)], np.inf)
    y = _padded([s[1:][o] for s, o in zip(series, order)], 0.0)
    m, rows, width = size[:, None], np.arange(len(series)), x.shape[1]
    real = np.arange(width) < m
    # Cut k puts the first k sorted rows to the left; equal values are never parted.
    cut = np.arange(1, width)
    allowed = (x[:, :-1] < x[:, 1:]) & (cut < m)
    # Running sums add in order, so the zeros that fill up a row cannot change the last digit.
    fit = np.where(real, np.cumsum(y, axis=1)[:, -1:] / m, 0.0)

    def best_cut(left, n_left, total, n_total, usable):
        gain = _gain(left, n_left) + _gain(total - left, n_total - n_left) - _gain(total, n_total)
        gain = np.where(usable, gain, -np.inf)
        k = gain.argmax(axis=1)
        return np.where(gain[rows, k] > LEAST_GAIN, cut[k], 0)

    for _ in range(TREES if width > 1 else 0):
        residual = np.where(real, y - fit, 0.0)
        below = np.cumsum(residual, axis=1)
        total, left = below[:, -1:], below[:, :-1]
        root = best_cut(left, cut, total, m, allowed)[:, None]
        at_root = np.where(root > 0, np.take_along_axis(below, np.maximum(root - 1, 0), axis=1), 0.0)
        low = best_cut(left, cut, at_root, root, allowed & (cut < root))[:, None]
        high = best_cut(left - at_root, cut - root, total - at_root, m - root, allowed & (cut > root) & (root > 0))[:, None]
        edges = np.sort(np.hstack([np.zeros_like(root), low, root, high, m]), axis=1)
        sums = np.hstack([np.zeros_like(total), below])
        part = np.diff(np.take_along_axis(sums, edges, axis=1), axis=1)
        leaf = RATE * part / (np.diff(edges, axis=1) + SHRINK)
        for j in range(leaf.shape[1]):
            inside = (np.arange(width) >= edges[:, j : j + 1]) & (np.arange(width) < edges[:, j + 1 : j + 2])
            fit += np.where(inside, leaf[:, j : j + 1], 0.0)
    last = np.array([s[-1] for s in series])
    path = np.empty((len(series), max(steps)))
    for t in range(path.shape[1]):
        place = np.maximum((x <= last[:, None]).sum(axis=1) - 1, 0)
        last = np.maximum(fit[rows, place], 0.0)
        path[:, t] = last
    return [path[i, : steps[i]] for i in range(len(series))]


def boosted_paths(series, steps) -> list:
    out: list = [None] * len(series)
    fit = {i: len(s) for i, s in enumerate(series) if _usable(s, steps[i], MIN_POINTS["xgboost"])}
    for chunk in _chunks(fit):
        for i, path in zip(chunk, _boosted_chunk([series[i] for i in chunk], [steps[i] for i in chunk])):
            out[i] = path if np.isfinite(path).all() else None
    return out


# --- Spark columns -----------------------------------------------------------------------

# Ship this module with the functions, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATH = T.ArrayType(T.DoubleType())


def _steps(column: pd.Series) -> list:
    return [0 if pd.isna(s) else int(s) for s in column]


@F.pandas_udf(PATH)
def _arima_udf(values: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series(arima_paths(list(values), _steps(steps)), dtype=object)


@F.pandas_udf(PATH)
def _seasonal_udf(days: pd.Series, values: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series(seasonal_paths(list(days), list(values), list(at)), dtype=object)


@F.pandas_udf(PATH)
def _boosted_udf(values: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series(boosted_paths(list(values), _steps(steps)), dtype=object)


def model_path(model: str, days: Column, values: Column, at_days: Column, steps: Column) -> Column:
    """Forecast array of one model at the `steps` days `at_days` (since 1970), NULL where it has no fit.

    A NULL `values` skips the row, so `when(chosen, values)` fits only the chosen model.
    """
    if model == "arima":
        return _arima_udf(values, steps)
    if model == "prophet":
        return _seasonal_udf(days, values, at_days)
    if model == "xgboost":
        return _boosted_udf(values, steps)
    raise ValueError(f"unknown model {model!r}")
