"""SQL text that solves least squares, for the oracles of the regression models.

Independent of the engine's solver: Gram sums are grouped sums, normal equations are solved
by Gauss–Jordan elimination (a recursive CTE, one pivot a step), an L1 weight by coordinate
descent (one sweep a step) and then exactly on the non-zero set, and recursions over days are
recursive CTEs.  All text is for DuckDB; the statement must begin with ``WITH RECURSIVE``.

Rows of a matrix are (k, i, j, v): key, row and column (from 0), value.
"""

from __future__ import annotations


def gram_rows(name: str, source: str, size: int, key: str = "Product_ID") -> str:
    """CTEs: ``name`` holds the matrix of sums of ``x[i] * x[j]`` over the rows of each key of ``source`` (``x``: a list)."""
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    at = {p: n for n, p in enumerate(upper, 1)}
    sums = ", ".join(f"sum(x[{i + 1}] * x[{j + 1}])" for i, j in upper)
    full = [(i, j, at[min(i, j), max(i, j)]) for i in range(size) for j in range(size)]
    lists = ", ".join(f"unnest([{', '.join(str(p[c]) for p in full)}]) AS {n}" for c, n in enumerate(("i", "j", "n")))
    return f"""{name}_g AS (SELECT {key} AS k, [{sums}] AS g FROM {source} GROUP BY 1)
, {name} AS (SELECT k, i, j, g[n] AS v FROM {name}_g, (SELECT {lists}))"""


def eliminate(name: str, source: str, pivots: int) -> str:
    """CTEs: ``name`` is ``source`` after pivots on the first ``pivots`` columns: their solutions stand in the other columns,
    and what is left of the other rows is the Schur complement."""
    return f"""{name}_e AS (SELECT 0 AS step, k, i, j, v FROM {source}
  UNION ALL
  SELECT step + 1, k, i, j, CASE WHEN i = step THEN v / d ELSE v - a * r / d END
  FROM (SELECT *, max(CASE WHEN i = step AND j = step THEN v END) OVER (PARTITION BY k) AS d, max(CASE WHEN j = step THEN v END) OVER (PARTITION BY k, i) AS a,
               max(CASE WHEN i = step THEN v END) OVER (PARTITION BY k, j) AS r FROM {name}_e) WHERE step < {pivots})
, {name} AS (SELECT k, i, j, v FROM {name}_e WHERE step = {pivots})"""


def solution(name: str, solved: str, pivots: int, target: int) -> str:
    """CTE: the solved column as a list ``b`` per key."""
    return f"{name} AS (SELECT k, list(v ORDER BY i) AS b FROM {solved} WHERE i < {pivots} AND j = {target} GROUP BY k)"


def sparse(name: str, problem: str, size: int, sweeps: int = 300) -> str:
    """CTEs: minimises ``½ dᵀSd − cᵀd + w Σ|d|`` for every (k, s, c, w) of ``problem`` (s: list of rows, c: list); ``name``
    has (k, d)."""
    step = "d"
    text = f"SELECT k, sweep, s, c, w, d FROM {name}_cd JOIN {problem} USING (k) WHERE sweep < {sweeps}"
    for j in range(1, size + 1):
        pull = f"(c[{j}] - list_dot_product(s[{j}], {step}) + s[{j}][{j}] * {step}[{j}])"
        new = f"(sign({pull}) * greatest(abs({pull}) - w, 0) / s[{j}][{j}])"
        text = f"SELECT k, sweep, s, c, w, list_concat(list_append({step}[1:{j - 1}], {new}), {step}[{j + 1}:{size}]) AS d FROM ({text})"
    zero = ", ".join(["0::DOUBLE"] * size)
    cells = f"(SELECT unnest(range({size})) AS i) r, (SELECT unnest(range({size + 1})) AS j) q"
    return f"""{name}_cd AS (SELECT k, 0 AS sweep, [{zero}] AS d FROM {problem}
  UNION ALL
  SELECT k, sweep + 1, d FROM ({text}))
, {name}_on AS (SELECT k, s, c, w, d FROM {name}_cd JOIN {problem} USING (k) WHERE sweep = {sweeps})
, {name}_m AS (SELECT k, i, j, CASE WHEN j = {size} THEN CASE WHEN d[i + 1] <> 0 THEN c[i + 1] - w * sign(d[i + 1]) ELSE 0 END
                                    WHEN i = j AND d[i + 1] = 0 THEN 1 WHEN d[i + 1] = 0 OR d[j + 1] = 0 THEN 0 ELSE s[i + 1][j + 1] END::DOUBLE AS v
               FROM {name}_on, {cells})
, {eliminate(name + '_x', name + '_m', size)}
, {name} AS (SELECT k, list(v ORDER BY i) AS d FROM {name}_x WHERE j = {size} GROUP BY k)"""


def dot(a: str, b: str, low: int, high: int) -> str:
    """Σ a[i] b[i] for i from ``low`` to ``high`` (from 1, both included)."""
    return f"list_dot_product({a}[{low}:{high}], {b}[{low}:{high}])"
