"""Daily series and their window operators (A11, A36, A37, J1, J4, J5, W1–W8,
W12, W13).

A *daily series* has one row per (product, day): the fact rows are reduced
by a grouped sum first (partial aggregation map-side, so even a product with
a third of all sales rows arrives as at most one row per day per task).
Window operators then partition by product; a partition holds one product's
days, whose number is bounded by the calendar span, not by the data volume.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggs import dmean
from ..functions.derive import holiday_int
from ..session import cut_lineage
from ..sources.demand import DATE, DEMAND, DISCOUNT, EFFECT, HOLIDAY, PRICE, PRODUCT, STOCK

P, D, Y = PRODUCT, DATE, DEMAND


def by_product(product: str = P, date: str = D) -> Window:
    return Window.partitionBy(product).orderBy(date)


# A11 / A36 / A37 ----------------------------------------------------------------
def daily_series(df: DataFrame, value: str = Y) -> DataFrame:
    """A11 per product: ``(Product_ID, Date, Demand)`` summed per day.
    Model pages take every row (no positive-demand filter, Q23)."""
    return df.groupBy(P, D).agg(F.sum(value).cast("double").alias(value))


def daily_checkpoint(df: DataFrame, value: str = Y) -> DataFrame:
    """A11 written once to the shared checkpoint folder.

    Model fits read their daily series several times (Gram pass, fitted
    values, recursion state); materialising products × days rows once means
    the fact tables are scanned and joined once per query instead of once
    per pass, and a lost executor restarts from the checkpoint.
    """
    return cut_lineage(daily_series(df, value))


# Regressors of the seasonal model and how each is folded per day (S3).
REGRESSORS = [EFFECT, PRICE, DISCOUNT, STOCK]


def daily_features(df: DataFrame) -> DataFrame:
    """Per (product, day) sum Demand, max holiday flag, mean of the
    four regressors (exact decimal sums, double means).

    A table may lack the holiday flag or some regressors (S3): these are 0
    everywhere, which a standardised, penalised regression leaves without effect."""
    holiday = holiday_int(F.max(HOLIDAY)) if HOLIDAY in df.columns else F.lit(0)
    return df.groupBy(P, D).agg(
        F.sum(Y).cast("double").alias(Y), holiday.alias(HOLIDAY),
        *[(dmean(c) if c in df.columns else F.lit(0.0)).alias(c) for c in REGRESSORS])


def last_n_mean(daily: DataFrame, cols: list[str], n: int = 30) -> DataFrame:
    """Per product, mean of each column over its last ``n`` rows."""
    w = Window.partitionBy(P).orderBy(F.desc(D))
    tail = daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return tail.groupBy(P).agg(*[F.avg(c).alias(c) for c in cols])


# J1 -------------------------------------------------------------------------------
def fill_calendar(daily: DataFrame, value: str = Y) -> DataFrame:
    """Every day between each product's first and last day; missing = 0.

    One pass over the series: each day is exploded up to the day before the
    product's next one, and only the first of them keeps the value."""
    after = F.lead(D).over(by_product())
    days = F.sequence(F.col(D), F.coalesce(F.date_sub(after, 1), F.col(D)), F.expr("INTERVAL 1 DAY"))
    filled = daily.select(P, F.col(D).alias("_from"), F.col(value).alias("_v"), days.alias("_days"))
    filled = filled.select(P, "_from", "_v", F.explode("_days").alias(D))
    return filled.select(P, D, F.when(F.col(D) == F.col("_from"), F.coalesce("_v", F.lit(0.0))).otherwise(0.0).alias(value))


# J4 -------------------------------------------------------------------------------
def holiday_window(daily: DataFrame, holiday: str = HOLIDAY, lower: int = -1, upper: int = 1) -> DataFrame:
    """Flags ``hol_m1, hol_0, hol_p1`` when the day lies at that offset
    from a holiday date; holiday dates are taken over all products (Q22).

    The distinct holiday days (≤ one per calendar day) are exploded to their
    offsets and equi-joined on the day: an interval join without a nested
    loop."""
    days = daily.where(F.col(holiday) == 1).select(D).distinct()
    offs = days.select(F.explode(F.sequence(F.lit(lower), F.lit(upper))).alias("_o"), D) \
        .select(F.date_add(D, F.col("_o")).alias(D), "_o")
    names = {o: f"hol_{'m' if o < 0 else ('p' if o > 0 else '')}{abs(o)}" for o in range(lower, upper + 1)}
    flags = offs.groupBy(D).agg(*[F.max((F.col("_o") == o).cast("int")).alias(n) for o, n in names.items()])
    out = daily.join(flags, D, "left")
    return out.na.fill(0, subset=list(names.values()))


# J5 -------------------------------------------------------------------------------
def align_actual_fitted(actual: DataFrame, fitted: DataFrame, value: str = Y) -> DataFrame:
    """Inner join of actual and fitted values on (product, day)."""
    return actual.select(P, D, F.col(value).alias("actual")).join(
        fitted.select(P, D, F.col("value").alias("fitted")), [P, D])


# W1–W4 ---------------------------------------------------------------------------
def moving_avg(value: str = Y, n: int = 7, strict: bool = False) -> Column:
    """W1 (``min_periods=1``) / W2 (null until ``n`` rows): trailing row mean."""
    w = by_product().rowsBetween(-(n - 1), 0)
    m = F.avg(value).over(w)
    return F.when(F.count(value).over(w) == n, m) if strict else m


def lag_k(value: str, k: int) -> Column:
    """Value ``k`` rows back."""
    return F.lag(value, k).over(by_product())


def difference(value: str = Y) -> Column:
    """Value minus the previous row's value (null on the first row)."""
    return F.col(value) - F.lag(value, 1).over(by_product())


# W5 -------------------------------------------------------------------------------
EWMA_BLOCK = 128


def ewma(daily: DataFrame, value: str = Y, span: float = 5.0, out: str = "ewma") -> DataFrame:
    """``e0 = x0, e_t = a·x_t + (1−a)·e_{t−1}`` with a = 2/(span+1)
    (pandas ``ewm(adjust=False)``) for any span of 1 or more.

    Closed form ``e_t = Σ_k w_k r^(t−k) x_k`` (r = 1−a, w_0 = 1, w_k = a).
    Rows are cut into blocks of B rows, B small enough for r^−B to stay
    finite; inside a block a running window sum of ``w_k r^−(k−s) x_k`` (s =
    block start) gives the in-block part.  The carry into a block folds the
    totals of the product's earlier blocks, ``C ← r^B·C + T``: one array of
    days / B numbers per product.
    """
    a = 2.0 / (span + 1.0)
    r = 1.0 - a
    if not 0 <= r < 1:
        raise ValueError("the span must be 1 or more")
    if r == 0:
        return daily.withColumn(out, F.col(value))
    B = max(1, min(EWMA_BLOCK, int(280 / -math.log10(r))))
    t = F.row_number().over(by_product()) - 1
    x = daily.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / B)).withColumn("_u", F.col("_t") % B)
    wk = F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.lit(a))
    x = x.withColumn("_term", wk * F.col(value) * F.pow(F.lit(r), -F.col("_u").cast("double")))
    wb = Window.partitionBy(P, "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_local", F.sum("_term").over(wb) * F.pow(F.lit(r), F.col("_u").cast("double")))
    # block totals brought to the block's last slot (u = B−1)
    blocks = (x.groupBy(P, "_b").agg(F.max_by("_local", "_u").alias("_last"), F.max("_u").alias("_umax"))
              .withColumn("_T", F.col("_last") * F.pow(F.lit(r), (F.lit(B - 1) - F.col("_umax")).cast("double"))))
    earlier = F.collect_list("_T").over(Window.partitionBy(P).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(P, "_b", F.aggregate(earlier, F.lit(0.0), lambda c, total: c * F.lit(r ** B) + total).alias("_C"))
    x = x.join(blocks, [P, "_b"])
    res = F.col("_local") + F.col("_C") * F.pow(F.lit(r), (F.col("_u") + 1).cast("double"))
    return x.withColumn(out, res).drop("_t", "_b", "_u", "_term", "_local", "_C")


# W6 -------------------------------------------------------------------------------
def lookback_windows(daily: DataFrame, value: str, n: int = 30, out: str = "window") -> DataFrame:
    """The previous ``n`` values as an array (rows with a full window only)."""
    w = by_product().rowsBetween(-n, -1)
    return daily.withColumn(out, F.collect_list(value).over(w)).where(F.size(out) == n)


# W7 -------------------------------------------------------------------------------
def decompose_additive(filled: DataFrame, value: str = Y, period: int = 7) -> DataFrame:
    """Classical additive decomposition of a gap-free daily series.

    trend = centred ``period``-row mean (null where the window is short);
    seasonal = per-phase mean of (value − trend) minus the mean of those
    phase means; residual = value − trend − seasonal.  Phase = row position
    mod period from the series start.
    """
    if period % 2 == 0:
        raise ValueError("odd periods only")
    h = period // 2
    w = by_product().rowsBetween(-h, h)
    x = filled.withColumn("_pos", F.row_number().over(by_product()) - 1) \
        .withColumn("phase", (F.col("_pos") % period).cast("int"))
    x = x.withColumn("trend", F.when(F.count(value).over(w) == period, F.avg(value).over(w)))
    x = x.withColumn("_det", F.col(value) - F.col("trend"))
    ph = x.groupBy(P, "phase").agg(F.avg("_det").alias("_pm"))
    ph = ph.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy(P))).drop("_pm")
    x = x.join(ph, [P, "phase"])
    return (x.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
            .drop("_pos", "_det"))


# W8 -------------------------------------------------------------------------------
def tail_n(daily: DataFrame, n: int, last: bool = True) -> DataFrame:
    """Last (or first) ``n`` rows of every series."""
    o = F.desc(D) if last else F.asc(D)
    w = Window.partitionBy(P).orderBy(o)
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# W12 / W13 ----------------------------------------------------------------------
def minmax_scale(daily: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """Per-series (x − min)/(max − min), keeping min and max for the
    inverse ``x = s·(max − min) + min``; a constant series scales to 0."""
    w = Window.partitionBy(P)
    x = daily.withColumn("_mn", F.min(value).over(w)).withColumn("_mx", F.max(value).over(w))
    rng = F.col("_mx") - F.col("_mn")
    return x.withColumn(out, F.when(rng > 0, (F.col(value) - F.col("_mn")) / rng).otherwise(F.lit(0.0)))


def minmax_inverse(scaled: Column, mn: Column, mx: Column) -> Column:
    return F.when(mx > mn, scaled * (mx - mn) + mn).otherwise(mn)


def standardise(daily: DataFrame, value: str, out: str = "z") -> DataFrame:
    """Per-series (x − mean)/population std (1 when the std is 0),
    keeping mean and std for transforming future values."""
    w = Window.partitionBy(P)
    x = daily.withColumn("_mu", F.avg(value).over(w)).withColumn("_sd", F.stddev_pop(value).over(w))
    x = x.withColumn("_sd", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0)))
    return x.withColumn(out, (F.col(value) - F.col("_mu")) / F.col("_sd"))

