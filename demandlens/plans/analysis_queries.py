"""Registered analysis queries (S4, A1–A38) with their DuckDB oracles."""

from __future__ import annotations

from ..operators.analytics import overview as ov
from ..sources import demand as src
from .registry import register
from .sqlgen import POS, REVENUE, cut, dsum, label, mean, q, r6

# Edges and labels are written out here, apart from the engine's, so that the oracle proves them.
INF = float("inf")
PCT, PCT_LABELS = [0, 5, 15, 30, 100], ["(0, 5]", "(5, 15]", "(15, 30]", "(30, 100]"]
EFFECT, EFFECT_LABELS = [0, 0.3, 0.6, 0.8, 1.0], ["(0, 0.3]", "(0.3, 0.6]", "(0.6, 0.8]", "(0.8, 1.0]"]
STOCK, STOCK_LABELS = [0, 30, 70, 90, 100], ["(0, 30]", "(30, 70]", "(70, 90]", "(90, 100]"]
RIVAL, RIVAL_LABELS = [0.8, 0.95, 1.05], ["(0, 0.8]", "(0.8, 0.95]", "(0.95, 1.05]", "(1.05, inf)"]
THIRDS = ["1 of 3", "2 of 3", "3 of 3"]
HOLIDAY_LABELS = ["Normal", "Holiday"]
MONTH_NAMES_TR = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]

# ------------------------------------------------------------------ S4
register("filter_options", f"""
SELECT * FROM (
  SELECT DISTINCT 'product' AS kind, Product_ID AS value FROM demand
  UNION ALL
  SELECT DISTINCT 'campaign' AS kind, Marketing_Campaign AS value FROM demand WHERE Marketing_Campaign IS NOT NULL
) ORDER BY kind, value""")(src.filter_options)

register("filter_limits", """
SELECT min(Date) AS min_date, max(Date) AS max_date, CAST(floor(max(Price)) AS BIGINT) AS max_price FROM demand
""")(src.filter_limits)

# ------------------------------------------------------------------ A1–A7
register("kpi_overview", f"""
SELECT {r6(mean('Demand'))} AS avg_demand, {r6(mean('Price'))} AS avg_price,
       {r6(mean('Discount') + ' * 100')} AS avg_discount_pct
FROM demand WHERE {POS}""")(ov.kpi_overview)

register("monthly_performance", f"""
SELECT CAST(month(Date) AS BIGINT) AS month, {dsum('Demand')} AS demand, {dsum(REVENUE)} AS revenue,
       {r6(mean('Price'))} AS avg_price, {label('month(Date)', MONTH_NAMES_TR)} AS month_name
FROM demand WHERE {POS} GROUP BY month(Date) ORDER BY month""")(ov.monthly_performance)

BOX = (f"COUNT(Demand) AS n, {r6(mean('Demand'))} AS mean, {r6(q('Demand', 0.25))} AS q25, "
       f"{r6(q('Demand', 0.5))} AS median, {r6(q('Demand', 0.75))} AS q75, "
       "CAST(min(Demand) AS DOUBLE) AS min, CAST(max(Demand) AS DOUBLE) AS max")

register("holiday_distribution", f"""
SELECT CAST(Public_Holiday AS BIGINT) AS holiday, {BOX},
       {label('Public_Holiday + 1', HOLIDAY_LABELS)} AS status
FROM demand WHERE {POS} GROUP BY Public_Holiday ORDER BY holiday""")(ov.holiday_distribution)

register("top_products", f"""
SELECT Product_ID, {dsum('Demand')} AS demand,
       CAST(round_even(SUM({REVENUE}), 2) AS DOUBLE) AS revenue, {r6(mean('Price'))} AS avg_price
FROM demand WHERE {POS}
GROUP BY Product_ID ORDER BY demand DESC, Product_ID LIMIT 10""")(ov.top_products)


def _band_sql(feature: str) -> tuple[str, str]:
    """(CTE text producing ``banded`` from ``base``, nothing else)."""
    if feature == "Price":
        edges = ["@0", "@s.q25", "@s.q50", "@s.q75", float("inf")]
        r = lambda c: f"CAST(CAST(round_even(s.{c}, 0) AS BIGINT) AS VARCHAR)"
        lab = (f"list_extract(['(0, ' || {r('q25')} || ']', '(' || {r('q25')} || ', ' || {r('q50')} || ']', "
               f"'(' || {r('q50')} || ', ' || {r('q75')} || ']', '(' || {r('q75')} || ', inf)'], band)")
        stats = (f"SELECT {q('Price', 0.25)} AS q25, {q('Price', 0.5)} AS q50, {q('Price', 0.75)} AS q75 "
                 "FROM base")
        x = "CAST(b.Price AS DOUBLE)"
        return (f", s AS ({stats}), b1 AS (SELECT b.*, {cut(x, edges)} AS band, s.* FROM base b, s), "
                f"banded AS (SELECT b1.*, {lab.replace('s.', 'b1.')} AS band_label FROM b1 WHERE band IS NOT NULL)"), ""
    if feature == "Discount":
        return (f", banded AS (SELECT * FROM (SELECT b.*, {cut('(b.Discount * 100)', PCT)} AS band "
                f"FROM base b) WHERE band IS NOT NULL), banded2 AS (SELECT *, {label('band', PCT_LABELS)} "
                "AS band_label FROM banded)"), "2"
    if feature == "Marketing_Effect":
        return (f", banded AS (SELECT * FROM (SELECT b.*, {cut('b.Marketing_Effect', EFFECT)} AS band "
                f"FROM base b) WHERE band IS NOT NULL), banded2 AS (SELECT *, {label('band', EFFECT_LABELS)} "
                "AS band_label FROM banded)"), "2"
    if feature == "Competitor_Price":
        edges = ["@0"] + [f"@(s.m * {f!r})" for f in RIVAL] + [float("inf")]
        return (f", s AS (SELECT {mean('CAST(Competitor_Price AS DOUBLE)')} AS m FROM base), "
                f"banded AS (SELECT * FROM (SELECT b.*, {cut('CAST(b.Competitor_Price AS DOUBLE)', edges)} AS band "
                f"FROM base b, s) WHERE band IS NOT NULL), banded2 AS (SELECT *, "
                f"{label('band', RIVAL_LABELS)} AS band_label FROM banded)"), "2"
    # tertiles (B8) with the equal-width fallback
    x = f"CAST(b.{feature} AS DOUBLE)"
    stats = (f"SELECT list_sort(list_distinct([{q(feature, 0.0)}, {q(feature, 1 / 3)}, {q(feature, 2 / 3)}, "
             f"{q(feature, 1.0)}])) AS e, min(CAST({feature} AS DOUBLE)) AS mn, max(CAST({feature} AS DOUBLE)) AS mx "
             "FROM base")
    qb = cut(x, ["@s.e[1]", "@s.e[2]", "@s.e[3]", "@s.e[4]"], True)
    lo = "(CASE WHEN s.mn = s.mx THEN (CASE WHEN s.mn = 0 THEN -0.001 ELSE s.mn - abs(s.mn) * 0.001 END) ELSE s.mn END)"
    hi = "(CASE WHEN s.mx = s.mn THEN (CASE WHEN s.mx = 0 THEN 0.001 ELSE s.mx + abs(s.mx) * 0.001 END) ELSE s.mx END)"
    first = f"(CASE WHEN s.mn = s.mx THEN {lo} ELSE {lo} - ({hi} - {lo}) * 0.001 END)"
    eb = cut(x, [f"@{first}", f"@({lo} + ({hi} - {lo}) / 3 * 1)", f"@({lo} + ({hi} - {lo}) / 3 * 2)", f"@{hi}"])
    return (f", s AS ({stats}), banded AS (SELECT * FROM (SELECT b.*, CASE WHEN len(s.e) = 4 THEN {qb} "
            f"ELSE {eb} END AS band FROM base b, s) WHERE band IS NOT NULL), banded2 AS (SELECT *, "
            f"{label('band', THIRDS)} AS band_label FROM banded)"), "2"


def _profile_sql(feature: str) -> str:
    ctes, suffix = _band_sql(feature)
    t = "banded" + suffix
    return f"""
, base AS (SELECT * FROM demand WHERE {POS})
{ctes}
, per AS (
  SELECT band, band_label, COUNT(*) AS n, {r6(mean('Demand'))} AS mean, {r6(q('Demand', 0.5))} AS median,
         {r6('stddev_samp(CAST(Demand AS DOUBLE))')} AS std, {r6(q('Demand', 0.25))} AS q25,
         {r6(q('Demand', 0.75))} AS q75, SUM(Demand) AS s_
  FROM {t} GROUP BY band, band_label)
SELECT band, band_label, n, mean, median, std, q25, q75,
       CAST(SUM(n) OVER () AS BIGINT) AS total_n, COUNT(*) OVER () AS n_bands,
       round(SUM(s_) OVER () / SUM(n) OVER (), 6) AS overall_mean
FROM per ORDER BY band"""


def _outlier_sql(feature: str) -> str:
    ctes, suffix = _band_sql(feature)
    t = "banded" + suffix
    return f"""
, base AS (SELECT * FROM demand WHERE {POS})
{ctes}
, f AS (SELECT band AS fb, {q('Demand', 0.25)} AS q1, {q('Demand', 0.75)} AS q3 FROM {t} GROUP BY band)
SELECT band, band_label, Product_ID, Date, Demand AS demand
FROM {t} JOIN f ON band = fb
WHERE Demand < q1 - 1.5 * (q3 - q1) OR Demand > q3 + 1.5 * (q3 - q1)"""


def _reg_profile(name: str, feature: str):
    def fn(df):
        out = ov.feature_demand_profile(df, feature)
        return out.select("band", "band_label", "n", "mean", "median", "std", "q25", "q75",
                          "total_n", "n_bands", "overall_mean")
    fn.__doc__ = ov.feature_demand_profile.__doc__
    register(name, _profile_sql(feature))(fn)


for _name, _feat in [("feature_demand_profile_price", "Price"),
                     ("feature_demand_profile_discount", "Discount"),
                     ("feature_demand_profile_effect", "Marketing_Effect"),
                     ("feature_demand_profile_competitor", "Competitor_Price"),
                     ("feature_demand_profile_stock", "Stock_Availability")]:
    _reg_profile(_name, _feat)

register("box_outliers_price", _outlier_sql("Price"))(lambda df: ov.box_outliers(df, "Price"))
register("box_outliers_discount", _outlier_sql("Discount"))(lambda df: ov.box_outliers(df, "Discount"))

register("describe_price", f"""
SELECT COUNT(Price) AS count, {r6(mean('Price'))} AS mean, {r6('stddev_samp(CAST(Price AS DOUBLE))')} AS std,
       CAST(min(Price) AS DOUBLE) AS min, {r6(q('Price', 0.25))} AS q25, {r6(q('Price', 0.5))} AS q50,
       {r6(q('Price', 0.75))} AS q75, CAST(max(Price) AS DOUBLE) AS max
FROM demand WHERE {POS}""")(lambda df: ov.describe(df, "Price"))

# ------------------------------------------------------------------ A8–A17 (demand page)
from ..operators.analytics import campaign as cp  # noqa: E402
from ..operators.analytics import demand as dm  # noqa: E402
from ..operators.analytics import price as pr  # noqa: E402
from ..operators.analytics import stock as st  # noqa: E402
from .sqlgen import DISCOUNT_AMOUNT, EFFECTIVENESS, ROI, TURNOVER  # noqa: E402

register("kpi_demand", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, w AS (SELECT weekofyear(Date) AS week, SUM(Demand) AS s FROM base GROUP BY 1)
SELECT CAST(max(Demand) AS DOUBLE) AS max_demand, CAST(min(Demand) AS DOUBLE) AS min_demand,
       {dsum('Demand')} AS total_demand,
       {r6('stddev_samp(Demand) / (' + mean('Demand') + ') * 100')} AS volatility_pct,
       (SELECT CAST(week AS BIGINT) FROM w ORDER BY s DESC, week LIMIT 1) AS peak_week
FROM base""")(dm.kpi_demand)

register("daily_demand", f"""
SELECT Date, {dsum('Demand')} AS demand FROM demand WHERE {POS} GROUP BY Date""")(dm.daily_demand)

register("daily_demand_by_product", f"""
SELECT Product_ID, Date, {dsum('Demand')} AS demand FROM demand WHERE {POS} GROUP BY Product_ID, Date""")(
    lambda df: dm.daily_demand(df, by_product=True))

register("daily_moving_average", f"""
, d AS (SELECT Date, {dsum('Demand')} AS demand FROM demand WHERE {POS} GROUP BY Date)
SELECT Date, demand, round(avg(demand) OVER (ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma7
FROM d""")(dm.daily_moving_average)

register("seasonal_distribution", f"""
SELECT Seasonal_Trend AS season, {BOX} FROM demand WHERE {POS} GROUP BY Seasonal_Trend""")(dm.seasonal_distribution)

register("yearly_demand", f"""
SELECT CAST(year(Date) AS BIGINT) AS year, {dsum('Demand')} AS demand FROM demand WHERE {POS}
GROUP BY year(Date) ORDER BY year""")(dm.yearly_demand)

register("product_performance", f"""
, p AS (SELECT Product_ID, {dsum('Demand')} AS demand, {mean('Price')} AS p FROM demand WHERE {POS} GROUP BY Product_ID)
SELECT Product_ID, demand, round(p, 6) AS avg_price, round(demand * p, 6) AS revenue FROM p
ORDER BY demand DESC, Product_ID""")(dm.product_performance)

register("campaign_demand_share", f"""
, c AS (SELECT Marketing_Campaign, {dsum('Demand')} AS demand FROM demand
        WHERE {POS} AND Marketing_Campaign IS NOT NULL GROUP BY Marketing_Campaign)
SELECT Marketing_Campaign, demand, round(demand / SUM(demand) OVER () * 100, 6) AS share_pct FROM c
ORDER BY demand DESC, Marketing_Campaign""")(dm.campaign_demand_share)

_NPR2 = "round_even(({x}) * 100, 0) / 100"
register("weekly_variation", f"""
, w AS (SELECT CAST(weekofyear(Date) AS BIGINT) AS week,
               {_NPR2.format(x=dsum('Demand'))} AS total,
               {_NPR2.format(x=mean('Demand'))} AS mean,
               {_NPR2.format(x='stddev_samp(Demand)')} AS std
        FROM demand WHERE {POS} GROUP BY weekofyear(Date))
SELECT week, total, mean, std, round(coalesce(std / mean * 100, 0.0), 6) AS variation_pct FROM w
ORDER BY week""")(dm.weekly_variation)

_WEEK_COLS = ", ".join(
    f"CAST(coalesce(SUM(CASE WHEN weekofyear(Date) = {w} THEN Demand END), 0) AS DOUBLE) AS w{w:02d}"
    for w in dm.WEEKS)
register("week_product_matrix", f"""
SELECT Product_ID, {_WEEK_COLS} FROM demand WHERE {POS} GROUP BY Product_ID""")(dm.week_product_matrix)

register("week_product_long", f"""
, s AS (SELECT Product_ID, CAST(weekofyear(Date) AS BIGINT) AS week, {dsum('Demand')} AS demand
        FROM demand WHERE {POS} GROUP BY 1, 2)
, g AS (SELECT p.Product_ID, w.week FROM (SELECT DISTINCT Product_ID FROM s) p, (SELECT DISTINCT week FROM s) w)
SELECT g.Product_ID, g.week, coalesce(s.demand, 0.0) AS demand
FROM g LEFT JOIN s ON g.Product_ID = s.Product_ID AND g.week = s.week""")(dm.week_product_long)

# ------------------------------------------------------------------ A18–A22 (stock page)
register("daily_stock", f"""
SELECT Date, {r6(mean('Stock_Availability'))} AS avg_stock, {dsum('Demand')} AS demand,
       COUNT(DISTINCT Product_ID) AS products
FROM demand WHERE {POS} GROUP BY Date""")(st.daily_stock)

register("stock_category_counts", f"""
, b AS (SELECT {cut('Stock_Availability', STOCK, True)} AS band FROM demand WHERE {POS})
, c AS (SELECT band, COUNT(*) AS n FROM b WHERE band IS NOT NULL GROUP BY band)
SELECT band, n, {label('band', STOCK_LABELS)} AS label, round(n / SUM(n) OVER () * 100, 6) AS share_pct
FROM c ORDER BY n DESC, band""")(st.stock_category_counts)

register("stock_demand_by_product", f"""
SELECT Product_ID, {r6(mean('Stock_Availability'))} AS avg_stock, {r6(mean('Demand'))} AS avg_demand,
       {r6(mean('Price'))} AS avg_price
FROM demand WHERE {POS} GROUP BY Product_ID""")(st.stock_demand_by_product)

register("stock_demand_trend", f"""
, p AS (SELECT Product_ID, {mean('Stock_Availability')} AS x, {mean('Demand')} AS y
        FROM demand WHERE {POS} GROUP BY Product_ID)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       round(regr_r2(y, x), 6) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM p""")(st.stock_demand_trend)

register("stock_turnover_top15", f"""
, p AS (SELECT Product_ID, {mean(TURNOVER)} AS turnover FROM demand WHERE {POS} GROUP BY Product_ID)
SELECT Product_ID, round(turnover, 6) AS turnover FROM
  (SELECT * FROM p ORDER BY turnover DESC, Product_ID LIMIT 15) ORDER BY turnover, Product_ID""")(
    st.stock_turnover_top)

register("kpi_stock", f"""
SELECT {r6(mean('Stock_Availability'))} AS avg_stock, {r6(mean(TURNOVER))} AS avg_turnover,
       COUNT(*) FILTER (WHERE {cut('Stock_Availability', STOCK, True)} = 1) AS critical_rows
FROM demand WHERE {POS}""")(st.kpi_stock)

# ------------------------------------------------------------------ A23–A29, A35, A38 (campaign page)
CPOS = f"{POS} AND Marketing_Campaign IS NOT NULL"

register("campaign_performance", f"""
SELECT Marketing_Campaign, {dsum('Demand')} AS demand, {dsum(REVENUE)} AS revenue,
       {r6(mean('Marketing_Effect'))} AS avg_effect, {r6(mean('Discount'))} AS avg_discount
FROM demand WHERE {CPOS} GROUP BY Marketing_Campaign ORDER BY revenue, Marketing_Campaign""")(
    cp.campaign_performance)


def _mm(c: str) -> str:
    return (f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 50.0 ELSE coalesce(({c} - min({c}) OVER ()) / "
            f"(max({c}) OVER () - min({c}) OVER ()) * 100, 50.0) END")


register("campaign_radar", f"""
, p AS (SELECT Marketing_Campaign, {dsum('Demand')} AS demand, {dsum(REVENUE)} AS revenue,
               {mean('Marketing_Effect')} AS effect, {mean(ROI)} AS roi, {mean('Discount')} AS discount
        FROM demand WHERE {CPOS} GROUP BY Marketing_Campaign)
SELECT Marketing_Campaign, round({_mm('demand')}, 6) AS demand_score, round({_mm('revenue')}, 6) AS revenue_score,
       round({_mm('effect')}, 6) AS effect_score, round({_mm('roi')}, 6) AS roi_score,
       round(100 - {_mm('discount')}, 6) AS discount_score FROM p""")(cp.campaign_radar)

register("campaign_discount_flow", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, qs AS (SELECT quantile_cont(CAST(Discount AS DOUBLE), [0.33, 0.67]) AS dq,
                quantile_cont(CAST(Demand AS DOUBLE), [0.33, 0.67]) AS yq FROM base)
, b AS (SELECT Marketing_Campaign,
          {cut('CAST(Discount AS DOUBLE)', ['@0', '@qs.dq[1]', '@qs.dq[2]', 1.0], True)} AS discount_level,
          {cut('Demand', ['@0', '@qs.yq[1]', '@qs.yq[2]', float('inf')], True)} AS sales_level
        FROM base, qs)
, c AS (SELECT Marketing_Campaign, discount_level, COUNT(*) AS n FROM b
        WHERE Marketing_Campaign IS NOT NULL AND discount_level IS NOT NULL AND sales_level IS NOT NULL
        GROUP BY 1, 2)
, r AS (SELECT *, dense_rank() OVER (ORDER BY Marketing_Campaign) - 1 AS source FROM c)
SELECT Marketing_Campaign, CAST(discount_level AS BIGINT) AS discount_level,
       {label('discount_level', THIRDS)} AS level_label, n, CAST(source AS BIGINT) AS source,
       CAST(max(source) OVER () + 1 + discount_level - 1 AS BIGINT) AS target FROM r""")(cp.campaign_discount_flow)

register("campaign_weekly_timeline", f"""
SELECT CAST(date_trunc('week', Date) AS DATE) AS week_start, Marketing_Campaign, {dsum('Demand')} AS demand,
       {dsum(REVENUE)} AS revenue
FROM demand WHERE {CPOS} GROUP BY 1, 2""")(cp.campaign_weekly_timeline)

register("campaign_roi_summary", f"""
SELECT Marketing_Campaign, {r6(mean(ROI))} AS avg_roi, {dsum(REVENUE)} AS revenue,
       {dsum(DISCOUNT_AMOUNT)} AS discount_amount, CAST(SUM({REVENUE}) - SUM({DISCOUNT_AMOUNT}) AS DOUBLE) AS net_profit
FROM demand WHERE {CPOS} GROUP BY Marketing_Campaign ORDER BY avg_roi, Marketing_Campaign""")(cp.campaign_roi_summary)

register("seasonal_campaign_rollup", f"""
SELECT Seasonal_Trend AS season, Marketing_Campaign AS campaign, {dsum('Demand')} AS demand,
       {dsum(REVENUE)} AS revenue, CAST(GROUPING(Seasonal_Trend, Marketing_Campaign) AS BIGINT) AS level
FROM demand WHERE {CPOS} GROUP BY ROLLUP (Seasonal_Trend, Marketing_Campaign)""")(cp.seasonal_campaign_rollup)

register("kpi_campaign", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, e AS (SELECT Marketing_Campaign, SUM({EFFECTIVENESS}) AS eff FROM base
        WHERE Marketing_Campaign IS NOT NULL GROUP BY 1)
SELECT round(coalesce({mean('Discount')} * 100, 0.0), 6) AS avg_discount_pct,
       coalesce({dsum(DISCOUNT_AMOUNT)}, 0.0) AS total_discount,
       coalesce((SELECT Marketing_Campaign FROM e ORDER BY eff DESC, Marketing_Campaign LIMIT 1), 'no data')
         AS best_campaign,
       round(coalesce(AVG({ROI}), 0.0), 6) AS avg_roi
FROM base""")(cp.kpi_campaign)

_SAMPLE = "ORDER BY md5(concat('42', Row_ID)), Row_ID LIMIT {n}"
register("discount_points", f"""
SELECT Row_ID, Product_ID, CAST(Discount AS DOUBLE) AS discount, Demand AS demand, CAST(Price AS DOUBLE) AS price,
       Marketing_Campaign AS campaign, CAST({REVENUE} AS DOUBLE) AS revenue
FROM demand WHERE {POS} {_SAMPLE.format(n=1000)}""")(cp.discount_points)

register("discount_demand_trend", f"""
, s AS (SELECT CAST(Discount AS DOUBLE) AS x, Demand AS y FROM demand WHERE {POS} {_SAMPLE.format(n=1000)})
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
       round(regr_r2(y, x), 6) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM s""")(cp.discount_demand_trend)

# ------------------------------------------------------------------ A30–A34, A38 (price page)
register("price_funnel", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, s AS (SELECT min(CAST(Price AS DOUBLE)) AS mn, max(CAST(Price AS DOUBLE)) AS mx FROM base)
, b AS (SELECT Demand, {REVENUE} AS rev,
          {cut('CAST(Price AS DOUBLE)', ['@(s.mn - 0.1)', '@(s.mn + (s.mx - s.mn) / 3)', '@(s.mn + 2 * (s.mx - s.mn) / 3)', '@(s.mx + 0.1)'], True)} AS band
        FROM base, s)
, p AS (SELECT band, {label('band', THIRDS)} AS band_label, {dsum('Demand')} AS demand,
               {dsum('rev')} AS revenue FROM b WHERE band IS NOT NULL GROUP BY band)
SELECT band, band_label, demand, revenue,
       round(demand / lag(demand) OVER (ORDER BY band DESC) * 100, 6) AS pct_previous
FROM p ORDER BY band DESC""")(pr.price_funnel)

register("competitor_comparison", f"""
SELECT Product_ID, {r6(mean('Price'))} AS avg_price, {r6(mean('Competitor_Price'))} AS avg_competitor_price,
       {dsum(REVENUE)} AS revenue
FROM demand WHERE {POS} GROUP BY Product_ID ORDER BY revenue DESC, Product_ID""")(pr.competitor_comparison)

register("weekly_price_trend", f"""
SELECT CAST(date_trunc('week', Date) AS DATE) AS week_start, {r6(mean('Price'))} AS avg_price,
       {r6(mean('Competitor_Price'))} AS avg_competitor_price
FROM demand WHERE {POS} GROUP BY 1 ORDER BY 1""")(pr.weekly_price_trend)

register("kpi_price", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, p AS (SELECT Product_ID, SUM({REVENUE}) AS rev FROM base GROUP BY 1)
SELECT {r6(mean('Price'))} AS avg_price,
       (SELECT Product_ID FROM p ORDER BY rev DESC, Product_ID LIMIT 1) AS top_product,
       {dsum(REVENUE)} AS total_revenue
FROM base""")(pr.kpi_price)

register("price_demand_points", f"""
SELECT Row_ID, Product_ID, CAST(Price AS DOUBLE) AS price, Demand AS demand, Marketing_Campaign AS campaign,
       CAST({REVENUE} AS DOUBLE) AS revenue
FROM demand WHERE {POS} {_SAMPLE.format(n=500)}""")(pr.price_demand_points)

register("price_discount_surface", f"""
, base AS (SELECT CAST(Price AS DOUBLE) AS p, CAST(Discount AS DOUBLE) AS d, Demand FROM demand WHERE {POS})
, s AS (SELECT min(p) AS pmin, max(p) AS pmax, min(d) AS dmin, max(d) AS dmax, avg(Demand) AS gmean FROM base)
, g AS (SELECT i, j,
          CASE WHEN j = 19 THEN pmax ELSE j * ((pmax - pmin) / 19) + pmin END AS price,
          CASE WHEN i = 19 THEN dmax ELSE i * ((dmax - dmin) / 19) + dmin END AS discount,
          (pmax - pmin) / 10 AS pr, (dmax - dmin) / 10 AS dr, gmean
        FROM s, range(20) t1(i), range(20) t2(j))
, c AS (SELECT g.i, g.j, avg(b.Demand) AS m FROM g JOIN base b
          ON abs(b.p - g.price) <= g.pr AND abs(b.d - g.discount) <= g.dr GROUP BY g.i, g.j)
SELECT CAST(g.i AS BIGINT) AS i, CAST(g.j AS BIGINT) AS j, round(g.price, 6) AS price,
       round(g.discount, 6) AS discount, round(coalesce(c.m, g.gmean), 6) AS demand
FROM g LEFT JOIN c ON g.i = c.i AND g.j = c.j""")(pr.price_discount_surface)

# ------------------------------------------------------------------ A2, A11, A13, A15, A16, A26, A28 from the stored roll-up
from ..operators.analytics import stored  # noqa: E402
from ..sources.rollup import DailyRollup  # noqa: E402
from .registry import ORACLES  # noqa: E402


def _reg_stored(name: str, fn) -> None:
    """The same question, answered from a roll-up of the facts that is written first; the oracle is that of the facts."""
    def run(df):
        return fn(DailyRollup.build(df).load())
    run.__doc__ = fn.__doc__
    register(f"{name}_stored", ORACLES[name], raw_oracle=True)(run)


for _name, _fn in [("monthly_performance", stored.monthly_performance), ("daily_demand", stored.daily_demand),
                   ("daily_demand_by_product", lambda s: stored.daily_demand(s, by_product=True)), ("yearly_demand", stored.yearly_demand),
                   ("campaign_demand_share", stored.campaign_demand_share), ("weekly_variation", stored.weekly_variation),
                   ("campaign_weekly_timeline", stored.campaign_weekly_timeline), ("seasonal_campaign_rollup", stored.seasonal_campaign_rollup)]:
    _reg_stored(_name, _fn)
