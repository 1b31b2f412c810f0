"""Small helpers that write oracle SQL text; edges and labels are given by the caller."""

from __future__ import annotations

from collections.abc import Sequence

POS = "Demand IS NOT NULL AND Demand > 0"


def lit(v) -> str:
    if isinstance(v, str):
        if v.startswith("@"):
            return v[1:]  # raw SQL expression
        return "'" + v.replace("'", "''") + "'"
    if v == float("inf"):
        return "CAST('infinity' AS DOUBLE)"
    return repr(v)


def cut(x: str, edges: Sequence, include_lowest: bool = False) -> str:
    e = [lit(v) for v in edges]
    first = f"{x} >= {e[0]}" if include_lowest else f"{x} > {e[0]}"
    arms = " ".join(f"WHEN {first} AND {x} <= {e[i]} THEN {i}" for i in range(1, len(e)))
    return f"CASE {arms} END"


def label(idx: str, labels: Sequence[str]) -> str:
    arr = ", ".join(lit(s) for s in labels)
    return f"list_extract([{arr}], {idx})"


def mean(x: str) -> str:
    return f"CAST(SUM({x}) AS DOUBLE) / COUNT({x})"


def dsum(x: str) -> str:
    return f"CAST(SUM({x}) AS DOUBLE)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def q(x: str, p: float) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p!r})"


REVENUE = "(Price * CAST(Demand AS DECIMAL(18,4)))"
DISCOUNT_AMOUNT = "(Price * Discount)"
ROI = (f"((CAST({REVENUE} AS DOUBLE) - CAST({DISCOUNT_AMOUNT} AS DOUBLE)) "
       f"/ (CAST({DISCOUNT_AMOUNT} AS DOUBLE) + 1.0))")
EFFECTIVENESS = "(CAST(Marketing_Effect AS DOUBLE) * Demand)"
TURNOVER = "(Demand / (Stock_Availability + 1.0))"
