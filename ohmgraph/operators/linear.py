"""Linear models with penalties from sums alone.

All that a least-squares fit with penalties needs is A'A for A = [1, columns, label]. Columns are standardised by its means
and deviations. A ridge is one solve; elastic net and lasso go by coordinate descent with covariance updates, and end with
a solve over the columns that are left, which the conditions of the minimum confirm. So every penalty, grid point and
set of columns costs arithmetic on a small matrix, and the rows are read once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Sweeps of the descent at most, and how often the exact solve is tried.
SWEEPS, EVERY = 20_000, 20
KINDS = ("ridge", "elastic_net", "lasso")


@dataclass
class Moments:
    """Of standardised columns: correlations, covariances with the label, and what takes coefficients back."""

    n: float
    mean: np.ndarray
    sd: np.ndarray
    corr: np.ndarray
    xy: np.ndarray
    y_mean: float


def moments(g: np.ndarray) -> Moments:
    """From A'A with the constant first and the label last. Constant columns have deviation 1 and correlate with nothing."""
    n = g[0, 0]
    mean, y_mean = g[0, 1:-1] / n, g[0, -1] / n
    cov = g[1:-1, 1:-1] / n - np.outer(mean, mean)
    xy = g[1:-1, -1] / n - mean * y_mean
    sd = np.sqrt(np.maximum(np.diagonal(cov), 0))
    flat = sd <= 1e-12
    sd = np.where(flat, 1.0, sd)
    corr = cov / np.outer(sd, sd)
    corr[flat], corr[:, flat] = 0.0, 0.0
    return Moments(n, mean, sd, corr, np.where(flat, 0.0, xy / sd), float(y_mean))


def soft(x: float, by: float) -> float:
    return math.copysign(max(0.0, abs(x) - by), x)


def exact(corr: np.ndarray, xy: np.ndarray, one: float, two: float, b: np.ndarray) -> np.ndarray | None:
    """The minimum with the signs of b, if it is the minimum: no sign turns, and no column outside pulls harder than the penalty."""
    at = np.flatnonzero(b)
    out = np.zeros(len(b))
    if len(at):
        sign = np.sign(b[at])
        try:
            out[at] = np.linalg.solve(corr[np.ix_(at, at)] + two * np.eye(len(at)), xy[at] - one * sign)
        except np.linalg.LinAlgError:
            return None
        if (np.sign(out[at]) != sign).any():
            return None
    pull = np.abs(xy - corr @ out - two * out)
    pull[at] = 0.0
    return out if pull.max(initial=0.0) <= one * (1 + 1e-9) + 1e-12 else None


def descent(corr: np.ndarray, xy: np.ndarray, one: float, two: float, start: np.ndarray | None = None) -> np.ndarray:
    """Minimises b'Cb / 2 - b'q + one |b|_1 + two b'b / 2."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    left = xy - corr @ b
    diagonal = np.diagonal(corr)
    for sweep in range(1, SWEEPS + 1):
        most = 0.0
        for j in range(len(b)):
            scale = diagonal[j] + two
            new = soft(left[j] + diagonal[j] * b[j], one) / scale if scale > 0 else 0.0
            if new != b[j]:
                step = new - b[j]
                left -= corr[:, j] * step
                b[j] = new
                most = max(most, abs(step))
        if sweep % EVERY == 0 or most <= 1e-13:
            found = exact(corr, xy, one, two, b)
            if found is not None:
                return found
        if most <= 1e-13:
            break
    return b


def fit(g: np.ndarray, model: str, settings: dict, use: list[int] | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the columns as they came; columns outside use get 0. start: coefficients to begin from."""
    m = moments(g)
    at = np.arange(len(m.mean)) if use is None else np.array(use, int)
    coef, alpha = np.zeros(len(m.mean)), settings["alpha"]
    if len(at):
        corr, xy = m.corr[np.ix_(at, at)], m.xy[at]
        if model == "ridge":
            coef[at] = np.linalg.solve(corr + np.diag(np.where(np.diagonal(corr) > 0, alpha / m.n, 1.0)), xy)
        elif model in KINDS:
            l1 = settings["l1"]
            coef[at] = descent(corr, xy, alpha * l1, alpha * (1 - l1), None if start is None else (start * m.sd)[at])
        else:
            raise ValueError(f"unknown linear model: {model}")
        coef /= m.sd
    return coef, float(m.y_mean - coef @ m.mean)


def path(g: np.ndarray, model: str, tried: list[dict], use: list[int] | None = None) -> list[tuple[np.ndarray, float]]:
    """Fits of several settings in their order; each starts from the one with the next larger penalty."""
    out: list = [None] * len(tried)
    last: dict[float, np.ndarray] = {}
    for i in sorted(range(len(tried)), key=lambda i: -tried[i]["alpha"]):
        l1 = tried[i].get("l1", 0.0)
        out[i] = fit(g, model, tried[i], use, last.get(l1))
        last[l1] = out[i][0]
    return out


def scores(g: np.ndarray, coef: np.ndarray, intercept: float) -> tuple[float, float]:
    """R² and mean squared error on the rows that A'A was added from."""
    b = np.concatenate([[intercept], coef, [-1.0]])
    sse, n = float(b @ g @ b), g[0, 0]
    sst = float(g[-1, -1] - g[0, -1] ** 2 / n) if n else 0.0
    return (1 - sse / sst if sst > 0 else math.nan), (sse / n if n else math.nan)


def best_setting(grams: np.ndarray, inner_of: list[int], model: str, tried: list[dict]) -> int:
    """Which setting has the best mean R² over inner folds. grams: A'A of disjoint sets of rows, inner_of their inner folds."""
    total, r2 = grams.sum(0), []
    for fold in sorted(set(inner_of)):
        own = grams[[i for i, f in enumerate(inner_of) if f == fold]].sum(0)
        if own[0, 0] and total[0, 0] > own[0, 0]:
            r2.append([scores(own, *found)[0] for found in path(total - own, model, tried)])
    mean = np.array([np.mean([v for v in col if not math.isnan(v)] or [-np.inf]) for col in zip(*r2, strict=True)] or [-np.inf] * len(tried))
    return int(mean.argmax())
