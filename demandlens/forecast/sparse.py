"""Least squares with ridge weights on some columns and a sparsity (L1) weight on others,
from Gram sums, for a stack of products at once.

The objective of each product is ``½ bᵀAb − bᵀc + ½ Σ ridgeⱼ bⱼ² + Σ weight |bⱼ|`` (the last
sum over the sparse columns).  The other columns are eliminated first (their solution is
linear in the sparse coefficients), which leaves a small problem of the sparse columns alone.
That is solved by coordinate descent over the whole stack; its non-zero set is then solved
exactly, so the optimality conditions hold to rounding.
"""

from __future__ import annotations

import numpy as np

SWEEPS = 20_000
TOLERANCE = 1e-13


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a x = b`` for a stack of symmetric matrices, scaled to a unit diagonal first."""
    d = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    scaled = a / d[:, :, None] / d[:, None, :]
    try:
        x = np.linalg.solve(scaled, b / d[:, :, None])
    except np.linalg.LinAlgError:
        x = np.linalg.pinv(scaled, hermitian=True) @ (b / d[:, :, None])
    return x / d[:, :, None]


def descend(s: np.ndarray, c: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Minimises ``½ xᵀSx − cᵀx + weight Σ|x|`` for every (S, c, weight) of the stack."""
    n, m = c.shape
    x = np.zeros((n, m))
    diagonal = np.maximum(np.einsum("nii->ni", s), 1e-300)
    size = np.abs(c).max(1, initial=0) / diagonal.max(1, initial=1e-300) + 1e-300
    for _ in range(SWEEPS):
        moved = np.zeros(n)
        for j in range(m):
            pull = c[:, j] - np.einsum("nk,nk->n", s[:, j], x) + diagonal[:, j] * x[:, j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - weight, 0) / diagonal[:, j]
            moved = np.maximum(moved, np.abs(new - x[:, j]))
            x[:, j] = new
        if (moved <= TOLERANCE * size).all():
            break
    return x


def polish(s: np.ndarray, c: np.ndarray, weight: float, x: np.ndarray) -> np.ndarray:
    """The exact solution on the non-zero set of ``x``, if it keeps the signs."""
    on = np.flatnonzero(x)
    if not len(on):
        return x
    exact = _solve(s[None][:, on][:, :, on], (c[on] - weight * np.sign(x[on]))[None, :, None])[0, :, 0]
    if (np.sign(exact) != np.sign(x[on])).any():
        return x
    out = np.zeros_like(x)
    out[on] = exact
    return out


def sparse_ridge(a: np.ndarray, c: np.ndarray, yy: np.ndarray, n_rows: np.ndarray, ridge: np.ndarray, sparse: np.ndarray,
                 scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (n, k), the sparsity weight (n) and the residual sum of squares (n) of a stack of Gram sums:
    ``a`` (n, k, k), ``c`` = sums with the target (n, k), ``yy`` = its sum of squares.

    The sparsity weight is the noise variance over ``scale`` (the scale of the change points' Laplace prior); the noise
    variance is the penalised residual sum of squares without change points over ``n_rows`` − 1.
    """
    free = np.setdiff1d(np.arange(a.shape[1]), sparse)
    full = a + np.diag(ridge)
    right = np.concatenate([full[:, free][:, :, sparse], c[:, free, None]], axis=2)
    solved = _solve(full[:, free][:, :, free], right)
    of_sparse, alone = solved[:, :, :-1], solved[:, :, -1]
    s = full[:, sparse][:, :, sparse] - right[:, :, :-1].transpose(0, 2, 1) @ of_sparse
    left = c[:, sparse] - np.einsum("nfm,nf->nm", right[:, :, :-1], alone)
    weight = np.maximum(yy - np.einsum("nf,nf->n", c[:, free], alone), 0) / np.maximum(n_rows - 1, 1) / scale
    x = descend(s, left, weight)
    x = np.stack([polish(*one) for one in zip(s, left, weight, x, strict=True)]) if len(x) else x
    beta = np.zeros(c.shape)
    beta[:, sparse] = x
    beta[:, free] = alone - np.einsum("nfm,nm->nf", of_sparse, x)
    sse = yy - 2 * np.einsum("nk,nk->n", beta, c) + np.einsum("nj,njk,nk->n", beta, a, beta)
    return beta, weight, np.maximum(sse, 0)


def gradient(a: np.ndarray, c: np.ndarray, beta: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Minus the slope of the smooth part of the objective: 0 for free columns at the optimum, within ± weight for sparse ones."""
    return c - np.einsum("njk,nk->nj", a, beta) - ridge * beta
