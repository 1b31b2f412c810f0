"""Banding (B1–B12): one ``cut`` helper producing right-closed bins.

A bin is returned as a 1-based INT (``null`` when the value falls outside
every bin); labels are looked up from the bin number.  Edges may be
literals or Columns (data-dependent edges such as quantiles are computed by
a one-row aggregate and attached to every row, see :func:`attach_scalars`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.demand import COMPETITOR, DEMAND, DISCOUNT, EFFECT, PRICE, STOCK
from .quantiles import exact_quantiles, quantile_table

INF = float("inf")

# Bin edges of each band.
PRICE_EDGES = [0, 50, 100, 200, INF]
DISCOUNT_EDGES = [0, 0.05, 0.15, 0.30, 1.0]
STOCK_EDGES = [0, 30, 70, 90, 100]
DISCOUNT_PCT_EDGES = [0, 5, 15, 30, 100]
EFFECT_EDGES = [0, 0.3, 0.6, 0.8, 1.0]
COMPETITOR_FACTORS = [0.8, 0.95, 1.05]


def interval_labels(edges: Sequence) -> list[str]:
    """Labels of the bins between ``edges``, such as ``(5, 15]``."""
    return [f"({a}, inf)" if b == INF else f"({a}, {b}]" for a, b in zip(edges, edges[1:], strict=False)]


def part_labels(n: int) -> list[str]:
    """Labels of ``n`` bins whose edges depend on the data."""
    return [f"{i} of {n}" for i in range(1, n + 1)]


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def cut(x: Column, edges: Sequence, include_lowest: bool = False) -> Column:
    """Bin number of ``x`` for right-closed intervals ``(e0,e1] … (ek-1,ek]``.

    With ``include_lowest`` the first interval is ``[e0,e1]``.  Values below
    the first edge, above the last one, or null give null (Q1).  Repeated
    edges leave an empty bin rather than failing (Q25).
    """
    e = [_c(v) for v in edges]
    first_ok = (x >= e[0]) if include_lowest else (x > e[0])
    expr = None
    for i in range(1, len(e)):
        cond = first_ok & (x <= e[i])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def label_of(bin_col: Column, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in labels]), bin_col)


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (quantile edges, means) to every row.

    The right side is a global aggregate, so it has exactly one row: its
    size is bounded by construction, and broadcasting it avoids a shuffle of
    the fact table.
    """
    return df.crossJoin(F.broadcast(scalars))


# Fixed edges --------------------------------------------------
def price_category(include_lowest: bool = True) -> Column:
    """B1: overview page excludes 0 (include_lowest=False), price page includes 0."""
    return cut(F.col(PRICE), PRICE_EDGES, include_lowest)


def discount_category() -> Column:
    return cut(F.col(DISCOUNT), DISCOUNT_EDGES, True)


def stock_category() -> Column:
    return cut(F.col(STOCK), STOCK_EDGES, True)


def discount_pct_band() -> Column:
    return cut(F.col(DISCOUNT) * 100, DISCOUNT_PCT_EDGES, False)


def marketing_effect_band() -> Column:
    return cut(F.col(EFFECT), EFFECT_EDGES, False)


# Data-dependent edges -------------------------------------------
def price_quartile_band(df: DataFrame, col: str = PRICE) -> DataFrame:
    """Bins 0, q25, q50, q75, ∞ of the (filtered) set; label with rounded edges."""
    edges = cut_lineage(exact_quantiles(df, [], col, [0.25, 0.5, 0.75], "_q"))  # one row, read by everything that uses the bands
    out = attach_scalars(df, edges.select(*[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]))
    r = [F.lit("0"), *[F.bround(F.col(c), 0).cast("bigint").cast("string") for c in ("q25", "q50", "q75")]]
    closed = [F.concat(F.lit("("), a, F.lit(", "), b, F.lit("]")) for a, b in zip(r, r[1:], strict=False)]
    label = F.element_at(F.array(*closed, F.concat(F.lit("("), r[-1], F.lit(", inf)"))), F.col("band"))
    out = out.withColumn("band", cut(F.col(col).cast("double"), [0, F.col("q25"), F.col("q50"), F.col("q75"), INF]))
    return out.withColumn("band_label", label).drop("q25", "q50", "q75")


def competitor_band(df: DataFrame, col: str = COMPETITOR) -> DataFrame:
    """0, .8, .95, 1.05 × mean, ∞."""
    m = df.agg(F.avg(F.col(col).cast("double")).alias("_cmean"))
    out = attach_scalars(df, m)
    edges = [0] + [F.col("_cmean") * f for f in COMPETITOR_FACTORS] + [INF]
    out = out.withColumn("band", cut(F.col(col).cast("double"), edges))
    return out.withColumn("band_label", label_of(F.col("band"), interval_labels([0, *COMPETITOR_FACTORS, INF]))).drop("_cmean")


def tertile_band(df: DataFrame, col: str) -> DataFrame:
    """B8 with the B9 fallback.

    Quantile bins q=3 (edges at 0, 1/3, 2/3, 1, lowest included).  When
    repeated edges are dropped fewer than three bins remain, the three labels
    no longer fit and the banding falls back to three equal widths (B9).
  
    """
    x = F.col(col).cast("double")
    edges = cut_lineage(exact_quantiles(df, [], x, [0.0, 1 / 3, 2 / 3, 1.0], "_e"))
    stats = edges.select(F.array_distinct("_e").alias("_e"), F.col("_e")[0].alias("_mn"), F.col("_e")[3].alias("_mx"))
    out = attach_scalars(df, stats)
    qbin = cut(x, [F.element_at("_e", i) for i in range(1, 5)], include_lowest=True)
    ebin = cut(x, _equal_width_edges(F.col("_mn"), F.col("_mx"), 3))
    out = out.withColumn("band", F.when(F.size("_e") == 4, qbin).otherwise(ebin))
    return out.withColumn("band_label", label_of(F.col("band"), part_labels(3))).drop("_e", "_mn", "_mx")


def _equal_width_edges(mn: Column, mx: Column, k: int) -> list[Column]:
    """Edges of pandas ``cut(bins=k)``: k equal widths, lowest edge lowered by
    0.1 % of the range; a constant column is widened by 0.1 % on both sides
    (by 0.001 when it is 0)."""
    same = mn == mx
    lo = F.when(same, F.when(mn == 0, F.lit(-0.001)).otherwise(mn - F.abs(mn) * 0.001)).otherwise(mn)
    hi = F.when(same, F.when(mx == 0, F.lit(0.001)).otherwise(mx + F.abs(mx) * 0.001)).otherwise(mx)
    step = (hi - lo) / k
    first = F.when(same, lo).otherwise(lo - (hi - lo) * 0.001)
    return [first] + [lo + step * i for i in range(1, k)] + [hi]


def equal_width_band(df: DataFrame, col: str, k: int = 3) -> DataFrame:
    """K equal widths between min and max (see :func:`_equal_width_edges`)."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    out = attach_scalars(df, mm)
    return out.withColumn("band", cut(x, _equal_width_edges(F.col("_mn"), F.col("_mx"), k))).drop("_mn", "_mx")


def price_third_band(df: DataFrame, col: str = PRICE) -> DataFrame:
    """3 equal widths of the filtered price, outer edges ∓0.1, include lowest."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    out = attach_scalars(df, mm)
    rng = F.col("_mx") - F.col("_mn")
    edges = [F.col("_mn") - 0.1, F.col("_mn") + rng / 3, F.col("_mn") + 2 * rng / 3, F.col("_mx") + 0.1]
    out = out.withColumn("band", cut(x, edges, include_lowest=True))
    return out.withColumn("band_label", label_of(F.col("band"), part_labels(3))).drop("_mn", "_mx")


def level_bands(df: DataFrame) -> DataFrame:
    """B11 discount level (0, q33, q67, 1) and B12 sales performance
    (0, q33, q67, ∞ of Demand), both include the lowest edge."""
    d, y = F.col(DISCOUNT).cast("double"), F.col(DEMAND)
    out = attach_scalars(df, cut_lineage(quantile_table(df, [], {"_dq": (d, [0.33, 0.67]), "_yq": (y, [0.33, 0.67])})))
    out = out.withColumns({
        "discount_level": cut(d, [0, F.col("_dq")[0], F.col("_dq")[1], 1.0], True),
        "sales_level": cut(y, [0, F.col("_yq")[0], F.col("_yq")[1], INF], True),
    })
    return out.drop("_dq", "_yq")

