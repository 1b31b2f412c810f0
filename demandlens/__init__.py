"""demandlens: demand analytics and forecasting as Spark DataFrame/SQL jobs."""

__version__ = "0.1.0"
