"""Derived columns (P1–P18).  Every function returns a ``Column`` or adds
columns with built-in expressions only, so they stay inside whole-stage
codegen and fuse with the scan that feeds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.demand import COMPETITOR, DATE, DEMAND, DISCOUNT, EFFECT, HOLIDAY, PRICE, STOCK

# Month names used by the monthly chart, January first.
MONTH_NAMES_TR = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran",
                  "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
# Holiday status labels for 0 and 1.
HOLIDAY_LABELS = ["Normal", "Holiday"]
# Days between 0001-01-01 (ordinal 1) and 1970-01-01.
ORDINAL_EPOCH = 719163


def dbl(c: str | Column) -> Column:
    """Double view of a stored decimal column, for maths."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# P1 -------------------------------------------------------------------
def with_calendar_parts(df: DataFrame, date: str = DATE) -> DataFrame:
    """Year, ISO week, month, quarter, English month and weekday names."""
    d = F.col(date)
    return df.withColumns({
        "Year": F.year(d), "Week": F.weekofyear(d), "Month": F.month(d), "Quarter": F.quarter(d),
        "Month_Name": F.date_format(d, "MMMM"), "Weekday": F.date_format(d, "EEEE"),
    })


# P2 / P17 ---------------------------------------------------------------
def holiday_int(col: str | Column = HOLIDAY) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("int")


def holiday_label(col: str = HOLIDAY) -> Column:
    return F.when(F.col(col) == 1, F.lit(HOLIDAY_LABELS[1])).when(F.col(col) == 0, F.lit(HOLIDAY_LABELS[0]))


# P3–P11 -----------------------------------------------------------------
def revenue() -> Column:
    """Price × Demand, exact decimal product (cast to double by the caller)."""
    return F.col(PRICE) * F.col(DEMAND).cast("decimal(18,4)")


def discount_amount() -> Column:
    return F.col(PRICE) * F.col(DISCOUNT)


def discounted_price() -> Column:
    return F.col(PRICE) * (F.lit(1) - F.col(DISCOUNT))


def price_difference() -> Column:
    return F.col(PRICE) - F.col(COMPETITOR)


def campaign_roi() -> Column:
    """(Revenue − Discount_Amount) / (Discount_Amount + 1), in double."""
    rev, amt = dbl(revenue()), dbl(discount_amount())
    return (rev - amt) / (amt + F.lit(1.0))


def campaign_effectiveness() -> Column:
    return dbl(EFFECT) * F.col(DEMAND)


def stock_demand_ratio() -> Column:
    return F.col(STOCK) / (F.col(DEMAND) + F.lit(1.0))


def stock_efficiency(ratio: Column | None = None) -> Column:
    """ratio > 2 → excess, < 0.5 → short, else optimal."""
    r = stock_demand_ratio() if ratio is None else ratio
    return F.when(r > 2, "excess").when(r < 0.5, "short").otherwise("optimal")


def stock_turnover() -> Column:
    return F.col(DEMAND) / (F.col(STOCK) + F.lit(1.0))


# P12–P16 ----------------------------------------------------------------
def week_start(date: str = DATE) -> Column:
    """Monday of the row's ISO week, as a DATE."""
    return F.trunc(F.col(date), "week")


def date_ordinal(date: str = DATE) -> Column:
    """Proleptic Gregorian day number (0001-01-01 = 1)."""
    return F.unix_date(F.col(date)) + F.lit(ORDINAL_EPOCH)


def day_of_week(date: str | Column = DATE) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(date)


def is_weekend(date: str | Column = DATE) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def log_demand(col: str | Column = DEMAND) -> Column:
    return F.log1p(F.col(col) if isinstance(col, str) else col)


def exp_demand(col: str | Column) -> Column:
    return F.expm1(F.col(col) if isinstance(col, str) else col)


def month_label(month: str | Column) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES_TR]), m.cast("int"))


def title_label(col: str) -> Column:
    """Trimmed text in title case, for option lists (first letter of a word upper, the rest lower)."""
    return F.initcap(F.trim(F.col(col)))


# P18 ----------------------------------------------------------------------
def to_ds_y(df: DataFrame, date: str = DATE, value: str = DEMAND) -> DataFrame:
    return df.withColumnRenamed(date, "ds").withColumnRenamed(value, "y")

