"""A keyed store of fitted coefficients, and forecasts from it without a refit.

The store is a Parquet folder of (version, model, product, through, start, status, values):
what a model's ``coefficients`` gives, a row per product.  Saving adds a version; a reader
takes each (model, product)'s row of its highest version, so saving some products replaces
just these, a reader never sees half a save (a version's files appear when its job commits),
and earlier versions can be read as they were.  ``compact`` writes the current rows as one
version into a new folder.

Scoring reads only the store.  A product that was asked for and has no row gets one row of
kind "none" with status "missing"; a product whose fit had no result keeps its reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.demand import PRODUCT
from . import recursive, ridge, seasonal, trend

P = PRODUCT
SCHEMA = f"model string, {P} string, through date, start date, status string, `values` map<string,array<double>>, version long"
COLUMNS = ["model", P, "through", "start", "status", "values"]

#: Of each model: the fit (a row per product) and the forecast from such rows.
MODELS: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {
    "trend": (trend.coefficients, trend.future),
    "poly_ridge": (ridge.coefficients, ridge.future),
    "recursive_linear": (recursive.coefficients, recursive.future),
    "seasonal_regression": (seasonal.coefficients, seasonal.future),
}


class CoefficientStore:
    """Coefficients under ``path`` (a folder that all executors reach)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)

    def _all(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def version(self) -> int:
        """The highest version, 0 for an empty store."""
        return self._all().agg(F.max("version")).first()[0] or 0

    def save(self, model: str, coefs: DataFrame) -> int:
        """Adds rows of ``model`` as a new version, which it returns; products not among them keep their rows."""
        if model not in MODELS:
            raise ValueError(f"no stored form of {model}; known: {', '.join(MODELS)}")
        number = self.version() + 1
        rows = coefs.withColumn("model", F.lit(model))
        if "start" not in rows.columns:
            rows = rows.withColumn("start", F.lit(None).cast("date"))
        rows.select(*COLUMNS).withColumn("version", F.lit(number)).write.mode("append").partitionBy("version").parquet(self.path)
        return number

    def fit(self, model: str, df: DataFrame) -> int:
        """Fits ``model`` to all products of ``df`` and saves the rows."""
        return self.save(model, MODELS[model][0](df))

    def load(self, model: str | None = None, version: int | None = None) -> DataFrame:
        """The current rows (or those as of ``version``), one per model and product."""
        rows = self._all()
        if model is not None:
            rows = rows.where(F.col("model") == model)
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        row = F.max_by(F.struct(*COLUMNS[2:], "version"), "version").alias("_r")
        return rows.groupBy("model", P).agg(row).select("model", P, "_r.*")

    def forecast(self, model: str, horizon: int = 30, products: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Forecast rows from the stored coefficients, of ``products`` (a frame with the product column) or all stored ones."""
        rows = self.load(model, version)
        if products is not None:
            asked = products.select(P).distinct()
            rows = asked.join(rows, P, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
        return MODELS[model][1](rows, horizon)

    def compact(self, path: str) -> CoefficientStore:
        """The current rows as version 1 of a new store."""
        target = CoefficientStore(self.spark, path)
        if target._exists():
            raise FileExistsError(path)
        self.load().drop("version").withColumn("version", F.lit(1)).write.partitionBy("version").parquet(path)
        return target
