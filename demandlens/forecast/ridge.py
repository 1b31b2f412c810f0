"""M2 ``poly_ridge_forecast``: polynomial ridge trend on the smoothed series.

daily sum (A11) → EWMA span 5 (W5) → day number standardised per product
(W13, population std) → powers 1..4 → ridge with an unpenalised intercept
for each alpha; the alpha with the lowest training RMSE % is kept (Q18) →
fitted values and ``horizon`` future days.

The power sums are one Gram aggregation per product (G); the 5×5 solves for
all alphas run in one small per-product Python step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derive import date_ordinal
from ..sources.demand import DATE, DEMAND, PRODUCT
from . import evaluate as ev
from .gram import as_matrix, gram, lstsq_from_gram, solve_table
from .series import daily_checkpoint, ewma, standardise

P, D, Y = PRODUCT, DATE, DEMAND
# Candidate penalties, tried in this order.
ALPHAS = [0.1, 1.0, 5.0, 10.0, 25.0, 50.0]
DEGREE = 4


def _prepared(df: DataFrame) -> DataFrame:
    d = ewma(daily_checkpoint(df), Y, 5.0, out="smoothed")
    d = standardise(d.withColumn("ordinal", date_ordinal(D).cast("double")), "ordinal", out="z")
    return d.withColumns({f"z{k}": F.pow(F.col("z"), k) for k in range(1, DEGREE + 1)})


def ridge_fit(df: DataFrame, alphas=ALPHAS) -> DataFrame:
    """Per product: chosen alpha, its training RMSE % and the coefficients
    ``[b0, b1..b4]`` on (1, z, z², z³, z⁴)."""
    return _fit(_prepared(df), alphas)


def _fit(d: DataFrame, alphas) -> DataFrame:
    return solve(gram(d, [P], [f"z{k}" for k in range(1, DEGREE + 1)] + ["smoothed"]), [P], alphas)


def solve(grams: DataFrame, keys: list[str], alphas=ALPHAS) -> DataFrame:
    """``keys``, the alpha of the lowest training RMSE %, that RMSE % and the coefficients, from Gram matrices over
    [1, z … z⁴, smoothed]."""
    k = DEGREE + 2
    alist = list(alphas)
    schema = T.StructType([*(grams.schema[c] for c in keys), T.StructField("alpha", T.DoubleType()), T.StructField("train_rmse_pct", T.DoubleType()),
                           T.StructField("beta", T.ArrayType(T.DoubleType()))])

    def best_alpha(row):
        G = as_matrix(row["g"], k)
        n = float(row["n"])
        ybar = G[0, k - 1] / n
        best = None
        for a in alist:
            beta, sse = lstsq_from_gram(G, range(k - 1), k - 1, ridge=a, intercept=0)
            score = np.sqrt(sse / n) / ybar * 100 if ybar else np.inf
            if best is None or score < best[1]:
                best = (a, score, beta)
        return {**{c: row[c] for c in keys}, "alpha": best[0], "train_rmse_pct": float(best[1]), "beta": [float(v) for v in best[2]]}

    return solve_table(grams, best_alpha, schema)


def poly(beta_col: str, z: F.Column) -> F.Column:
    out = F.element_at(beta_col, 1)
    for k in range(1, DEGREE + 1):
        out = out + F.element_at(beta_col, k + 1) * F.pow(z, k)
    return out


def ridge_forecast(df: DataFrame, horizon: int = 30, alphas=ALPHAS) -> DataFrame:
    """``(Product_ID, Date, kind, value, status)``: fitted smoothed history and forecasts."""
    d = _prepared(df)
    coef = _fit(d, alphas)
    fitted = d.join(coef, P).select(P, D, F.lit("fitted").alias("kind"), poly("beta", F.col("z")).alias("value"), F.lit("ok").alias("status"))
    return fitted.unionByName(future(_listed(d, coef), horizon))


def _listed(d: DataFrame, coef: DataFrame) -> DataFrame:
    last = d.groupBy(P).agg(F.max(D).alias("through"), F.first("_mu").alias("_mu"), F.first("_sd").alias("_sd"))
    numbers = F.create_map(F.lit("beta"), F.col("beta"), F.lit("alpha"), F.array("alpha"), F.lit("mean"), F.array("_mu"), F.lit("deviation"), F.array("_sd"))
    return last.join(coef, P).select(P, "through", F.lit("ok").alias("status"), numbers.alias("values"))


def coefficients(df: DataFrame, alphas=ALPHAS) -> DataFrame:
    """One row per product: through (last day of the fit), status, and ``values``, a map of number lists."""
    d = _prepared(df)
    return _listed(d, _fit(d, alphas))


def future(coefs: DataFrame, horizon: int = 30) -> DataFrame:
    """Forecast rows from rows of :func:`coefficients`; products without coefficients keep one row with their status."""
    v = F.col("values")
    fut = coefs.where("status = 'ok'").select(P, v["beta"].alias("beta"), v["mean"][0].alias("_mu"), v["deviation"][0].alias("_sd"),
                                              F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "through")
    fut = fut.withColumn(D, F.date_add("through", F.col("h")))
    zf = (date_ordinal(D).cast("double") - F.col("_mu")) / F.col("_sd")
    out = fut.select(P, D, F.lit("forecast").alias("kind"), poly("beta", zf).alias("value"), F.lit("ok").alias("status"))
    return out.unionByName(coefs.where("status <> 'ok'").select(P, F.lit("none").alias("kind"), "status"), allowMissingColumns=True)


def ridge_metrics(df: DataFrame, alphas=ALPHAS) -> DataFrame:
    """M10 for M2 on the smoothed series (natural scale), with the alpha."""
    d = _prepared(df)
    coef = _fit(d, alphas)
    pairs = d.join(coef, P).select(P, F.col("smoothed").alias("actual"), poly("beta", F.col("z")).alias("fitted"))
    return ev.forecast_metrics(pairs).join(coef.select(P, "alpha"), P)
