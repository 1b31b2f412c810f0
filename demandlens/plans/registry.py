"""Named queries over the driver tables, each with an optional DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle is SQL over the
same parquet tables; the demand view is prepended as the CTE ``demand`` (the
view text runs unchanged in both engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.demand import DEMAND_VIEW_SQL, demand_view

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_demand(sql: str) -> str:
    """Prefix the demand view as a CTE; ``sql`` may add more CTEs after a comma
    by starting with ``, name AS (...)``."""
    body = sql.strip()
    if body.startswith(","):
        return f"WITH demand AS ({DEMAND_VIEW_SQL}){body}"
    return f"WITH demand AS ({DEMAND_VIEW_SQL})\n{body}"


def register(name: str, oracle: str | None = None, raw_oracle: bool = False):
    """Register a query taking the demand view (or, with ``raw_oracle``, the
    spark session and folder) under ``name``."""
    def deco(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(demand_view(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle if raw_oracle else with_demand(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so the registry is filled."""
    from . import analysis_queries, filter_queries, forecast_queries, series_queries  # noqa: F401
