"""Unit-root test and order search of one series in numpy, to hold the Spark operators against."""

from __future__ import annotations

import math

import numpy as np

from demandlens.forecast.arima import MAX_D, MAX_P, MAX_Q, gaussian_aic, long_ar_order, mackinnon_crit, mackinnon_p


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Coefficients, residual sum of squares and (XᵀX)⁻¹, or None if the columns are linearly dependent."""
    if not x.shape[1]:
        return np.zeros(0), float(y @ y), np.zeros((0, 0))
    if len(y) < x.shape[1]:
        return None
    scale = np.sqrt((x * x).sum(0))
    if not scale.all():
        return None
    gram = (x / scale).T @ (x / scale)
    values, vectors = np.linalg.eigh(gram)
    if values[0] <= 1e-10 * values[-1]:
        return None
    inverse = (vectors / values) @ vectors.T / np.outer(scale, scale)
    beta = inverse @ (x.T @ y)
    rest = y - x @ beta
    return beta, float(rest @ rest), inverse


def adf(v: np.ndarray, max_lag: int | None = None) -> dict:
    """The test on one series; ``max_lag`` overrides the usual bound."""
    out = dict.fromkeys(("adf_statistic", "p_value", "crit_1", "crit_5", "crit_10", "used_lag", "nobs", "is_stationary"))
    n = len(v)
    top = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)) if max_lag is None else max_lag
    if top < 0 or n < 4:
        return out | {"status": "too_short"}
    if (v == v[0]).all():
        return out | {"status": "constant"}
    dy = np.diff(v)

    def design(lag: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the differences from ``first`` on: constant, level before, the ``lag`` differences before."""
        cols = [np.ones(len(dy) - first), v[first:-1], *(dy[first - k:len(dy) - k] for k in range(1, lag + 1))]
        return np.column_stack(cols), dy[first:]

    full, y = design(top, top)
    best = None
    for lag in range(top + 1):
        found = least_squares(full[:, :lag + 2], y)
        if found and found[1] <= 1e-12 * float(y @ y):
            return out | {"status": "exact_fit"}
        if found:
            aic = gaussian_aic(found[1], len(y), lag + 2)
            if best is None or aic < best[0]:
                best = (aic, lag)
    if best is None:
        return out | {"status": "singular"}
    lag = best[1]
    x, y = design(lag, lag)
    found = least_squares(x, y)
    free = len(y) - x.shape[1]
    if found is None or free <= 0:
        return out | {"status": "singular" if found is None else "too_short"}
    if found[1] <= 1e-12 * float(y @ y):
        return out | {"status": "exact_fit"}
    tau = float(found[0][1] / math.sqrt(found[1] / free * found[2][1, 1]))
    crit, p = mackinnon_crit(len(y)), mackinnon_p(tau)
    return {"adf_statistic": tau, "p_value": p, "crit_1": crit["1%"], "crit_5": crit["5%"], "crit_10": crit["10%"], "used_lag": lag,
            "nobs": len(y), "is_stationary": bool(p < 0.05), "status": "ok"}


def _stable(coef: np.ndarray) -> bool:
    """Whether 1 − c₁z − c₂z² − … has all roots outside the unit circle."""
    return not coef.any() or bool((np.abs(np.roots(np.concatenate([[1.0], -coef]))) < 1 - 1e-6).all())


class Fits:
    """All candidate orders of one series.  ``table``: (aic, p, d, q, coef) with coef = [c, φ1..3, θ1..3]."""

    def __init__(self, y: np.ndarray):
        self.y, n = y, len(y)
        m = long_ar_order(n) if n > 1 else 1
        self.first = MAX_D + m + MAX_Q
        self.innovations: dict[int, np.ndarray] = {}
        self.table: list[tuple] = []
        for d in range(MAX_D + 1):
            w = np.concatenate([np.zeros(d), np.diff(y, d)]) if n > d else np.zeros(n)
            e = np.zeros(n)
            rows = np.arange(d + m, n)
            if len(rows):
                x = np.column_stack([np.ones(len(rows)), *(w[rows - k] for k in range(1, m + 1))])
                found = least_squares(x, w[rows])
                beta = found[0] if found else np.linalg.lstsq(x, w[rows], rcond=None)[0]
                e[rows] = w[rows] - x @ beta
            self.innovations[d] = e
            self._fit(d, w, e, np.arange(self.first, n))

    def _fit(self, d: int, w: np.ndarray, e: np.ndarray, rows: np.ndarray) -> None:
        if len(rows) < MAX_P + MAX_Q + 2:
            return
        full = np.column_stack([np.ones(len(rows)), *(w[rows - k] for k in range(1, MAX_P + 1)), *(e[rows - k] for k in range(1, MAX_Q + 1))])
        for p in range(MAX_P + 1):
            for q in range(MAX_Q + 1):
                use = [0] * (d == 0) + list(range(1, p + 1)) + list(range(1 + MAX_P, 1 + MAX_P + q))
                found = least_squares(full[:, use], w[rows])
                # an exact fit (a constant or a straight line) has no likelihood
                if found is None or found[1] <= 1e-12 * float(self.y @ self.y):
                    continue
                coef = np.zeros(1 + MAX_P + MAX_Q)
                coef[use] = found[0]
                if _stable(coef[1:1 + MAX_P]) and _stable(-coef[1 + MAX_P:]):
                    self.table.append((gaussian_aic(found[1], len(rows), p + q + 1 + (d == 0)), p, d, q, coef))

    def best(self) -> tuple:
        """Lowest AIC, ties to the first (p, d, q); a random walk where nothing could be fitted."""
        if self.table:
            return min(self.table, key=lambda c: c[:4])
        return None, 1, 1, 1, np.zeros(1 + MAX_P + MAX_Q)

    def run(self, horizon: int) -> tuple[np.ndarray, np.ndarray]:
        """Fitted values (nan where the sample has not begun) and the next ``horizon`` values of the best order."""
        _, _, d, _, coef = self.best()
        y, n = self.y, len(self.y)
        pad = MAX_D + MAX_P
        level = np.concatenate([np.full(pad, y[0] if d else 0.0), y, np.zeros(horizon)])
        e = np.concatenate([np.zeros(pad), self.innovations[d], np.zeros(horizon)])
        w = level.copy()
        for _ in range(d):
            w = np.concatenate([[0.0], np.diff(w)])

        def ahead(t: int) -> float:
            step = coef[0] + sum(coef[k] * w[t - k] + coef[MAX_P + k] * e[t - k] for k in range(1, MAX_P + 1))
            return step + (0.0, level[t - 1], 2 * level[t - 1] - level[t - 2])[d]

        start = self.first if self.table else d
        fitted = np.full(n, np.nan)
        for t in range(start, n):
            fitted[t] = ahead(t + pad)
        for t in range(n + pad, n + pad + horizon):
            level[t] = ahead(t)
            w[t] = level[t] - (0.0, level[t - 1], 2 * level[t - 1] - level[t - 2])[d]
        return fitted, level[n + pad:]
