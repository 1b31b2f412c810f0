"""Sufficient statistics for least squares (the ``gram`` helper, G).

For every key (usually the product) the Gram matrix ``ZᵀZ`` of
``Z = [1, x₁ … x_p, y]`` is an ordinary distributed aggregation: rows are
reduced map-side, so a key holding a third of the rows still ships one
partial matrix per task.  :func:`gram` has one SQL ``sum`` per entry of the
upper triangle (JVM, whole-stage codegen) and suits the models with a
handful of columns; :func:`gram_blocks` suits the seasonal model with its
fixed 62: each Arrow batch gives one partial upper triangle per key, merged
by a grouped sum.  The caller chooses by its model, never by the data.

Only the p×p solve runs in Python, in :func:`solve_table`, one row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _complete(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    data = df.select(*keys, *[F.col(c) if types[c] == "double" else F.col(c).cast("double").alias(c) for c in cols])
    # one IsNotNull per column (a single n-column null test would make the
    # optimizer's constraint propagation grow with every alias above it)
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull()
    return data.where(keep)


def gram(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``(keys…, n, g)`` with ``g`` the row-major k×k Gram matrix of
    ``[1, cols…]`` (k = len(cols) + 1) over rows where no column is null."""
    keys, cols = list(keys), list(cols)
    k = len(cols) + 1
    z = [F.lit(1.0)] + [F.col(c) for c in cols]
    sums = [F.sum(z[i] * z[j]).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)]
    agg = _complete(df, keys, cols).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    entries = [F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    return agg.select(*keys, "n", F.array(*entries).alias("g"))


def gram_blocks(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The same as :func:`gram` for wide designs: a partial upper triangle per key and Arrow batch."""
    keys, cols = list(keys), list(cols)
    data = _complete(df, keys, cols)
    k = len(cols) + 1
    upper = np.triu_indices(k)
    schema = T.StructType([*(data.schema[c] for c in keys), T.StructField("_n", T.LongType()),
                           T.StructField("_u", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        for pdf in batches:
            rows = []
            for kv, grp in pdf.groupby(keys, sort=False, dropna=False):
                z = np.column_stack([np.ones(len(grp)), grp[cols].to_numpy(dtype=float)])
                rows.append((*(kv if isinstance(kv, tuple) else (kv,)), len(grp), (z.T @ z)[upper]))
            yield pd.DataFrame(rows, columns=[*keys, "_n", "_u"])

    parts = data.mapInPandas(partial, schema).select(*keys, "_n", F.posexplode("_u").alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_n").alias("_n"), F.sum("_x").alias("_x"))
    packed = sums.groupBy(*keys).agg(F.max("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    place = np.zeros((k, k), dtype=int)
    place[upper] = np.arange(len(upper[0]))
    # one text literal: thousands of number literals would slow the planner down
    place = F.split(F.lit(",".join(map(str, np.maximum(place, place.T).ravel()))), ",").cast("array<int>")
    # the sorted sums are bound once (as the only element of an array), not sorted again for each entry
    full = F.transform(F.array("_s"), lambda sums: F.transform(place, lambda i: F.get(sums, i)["_x"]))
    return packed.select(*keys, "n", F.element_at(full, 1).alias("g"))


def gram_lists(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """``(keys…, n, u)`` for designs that differ in width: ``col`` holds a row's whole design as a list (equally long within a
    key), ``u`` the upper triangle of its Gram matrix, row by row (see :func:`from_upper`)."""
    keys = list(keys)
    data = df.select(*keys, col)
    schema = T.StructType([*(data.schema[c] for c in keys), T.StructField("_n", T.LongType()), T.StructField("_u", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        for pdf in batches:
            rows = []
            for kv, grp in pdf.groupby(keys, sort=False, dropna=False):
                z = np.stack(grp[col].to_numpy())
                rows.append((*(kv if isinstance(kv, tuple) else (kv,)), len(grp), (z.T @ z)[np.triu_indices(z.shape[1])]))
            yield pd.DataFrame(rows, columns=[*keys, "_n", "_u"])

    parts = data.mapInPandas(partial, schema).select(*keys, "_n", F.posexplode("_u").alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_n").alias("_n"), F.sum("_x").alias("_x"))
    packed = sums.groupBy(*keys).agg(F.max("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    return packed.select(*keys, "n", F.col("_s")["_x"].alias("u"))


def solve_rows(table: DataFrame, fn: Callable[[dict], list[dict]], schema: T.StructType) -> DataFrame:
    """Like :func:`solve_table` with any number of rows per key."""
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for r in pdf.to_dict("records") for x in fn(r)], columns=names)

    return table.mapInPandas(run, schema)


def solve_table(table: DataFrame, fn: Callable[[dict], dict], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to every row of a small per-key table (Gram matrices and
    their parameters) in Arrow batches; no shuffle, one output row per key."""
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([fn(r) for r in pdf.to_dict("records")], columns=names)

    return table.mapInPandas(run, schema)


def solve_stacks(table: DataFrame, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType, g: str = "g") -> DataFrame:
    """Apply ``fn`` to whole Arrow batches of a small per-key table: it gets the batch and its Gram matrices as one (n, k, k) stack."""
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                stack = np.stack(pdf[g].to_numpy())
                k = round(stack.shape[1] ** 0.5)
                yield fn(pdf, stack.astype(float).reshape(-1, k, k))[names]

    return table.mapInPandas(run, schema)


# --------------------------------------------------------------- numpy side
def as_matrix(g, k: int) -> np.ndarray:
    return np.asarray(g, dtype=float).reshape(k, k)


def from_upper(u) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    u = np.asarray(u, dtype=float)
    k = int(round((np.sqrt(8 * len(u) + 1) - 1) / 2))
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = u
    return out + np.triu(out, 1).T


def regress(g: np.ndarray, use: Sequence[int], target: int) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Coefficients, residual sum of squares and inverse matrix of the regression of a column on others, from their Gram
    matrix; None if the columns are linearly dependent."""
    use = list(use)
    if not use:
        return np.zeros(0), float(g[target, target]), np.zeros((0, 0))
    a, b = g[np.ix_(use, use)], g[use, target]
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    if not scale.all():
        return None
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    if values[0] <= 1e-10 * values[-1]:
        return None
    inverse = (vectors / values) @ vectors.T / np.outer(scale, scale)
    beta = inverse @ b
    return beta, max(float(g[target, target] - 2 * beta @ b + beta @ a @ beta), 0.0), inverse


def lstsq_from_gram(G: np.ndarray, feat: Sequence[int], target: int, ridge: float = 0.0,
                    intercept: int | None = 0) -> tuple[np.ndarray, float]:
    """Solve the normal equations restricted to the columns ``feat`` for the
    target column; the ``intercept`` column (if listed in ``feat``) is not
    penalised.  Returns (coefficients, SSE)."""
    idx = list(feat)
    A = G[np.ix_(idx, idx)].copy()
    b = G[idx, target]
    if ridge:
        pen = np.full(len(idx), ridge)
        if intercept is not None and intercept in idx:
            pen[idx.index(intercept)] = 0.0
        A += np.diag(pen)
    # a unit diagonal, so that columns of very different size cost no digits
    d = np.sqrt(np.maximum(np.diag(A), 1e-300))
    scaled = A / d[:, None] / d
    own = np.linalg.eigvalsh(scaled)
    if own[0] > 1e-13 * own[-1]:
        beta = np.linalg.solve(scaled, b / d) / d
    else:  # too few rows or dependent columns: the smallest coefficients that fit
        beta = np.linalg.lstsq(scaled, b / d, rcond=1e-10)[0] / d
    sse = float(G[target, target] - 2 * beta @ b + beta @ G[np.ix_(idx, idx)] @ beta)
    return beta, max(sse, 0.0)

