"""A stored daily roll-up of the facts: mergeable partial states by product, day, campaign,
season, holiday flag and whether the demand is positive.

The states are sums, counts, smallest and largest values and sums of squares, so any coarser
answer (months, weeks, seasons, campaigns) is a sum of states, exact as from the facts: means
are sums over counts, spreads come from the squares.  The table is a row per key and day,
whatever the number of sales rows, and is partitioned by month.

``merge`` adds new facts: their states are merged with the stored ones of the months they
fall into, and only those partitions are written anew.  ``rebuild`` replaces whole months
from the facts, for corrections and deletions.  Both write the merged months to the
checkpoint folder before the partitions are overwritten, so a lost executor never leaves a
partition that was read half.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.derive import revenue
from ..session import checkpoint_dir, cut_lineage
from .demand import CAMPAIGN, DATE, DEMAND, DISCOUNT, EFFECT, HOLIDAY, PRICE, PRODUCT, SEASON, STOCK

KEYS = [PRODUCT, DATE, CAMPAIGN, SEASON, HOLIDAY, "positive"]
MONTH = "month_of_day"
#: Measures with a sum and a count each.
MEANS = {"price": PRICE, "discount": DISCOUNT, "effect": EFFECT, "stock": STOCK}
SUMS = ["n", "demand", "demand_n", "demand_sq", "revenue", *MEANS, *[f"{m}_n" for m in MEANS]]


def states(facts: DataFrame) -> DataFrame:
    """The partial states of fact rows; map-side combined, one row per key and day."""
    y = F.col(DEMAND)
    keyed = facts.withColumn("positive", F.coalesce(y > 0, F.lit(False)))
    return keyed.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.sum(y).alias("demand"), F.count(y).alias("demand_n"), F.sum(y * y).alias("demand_sq"), F.sum(revenue()).alias("revenue"),
        F.min(y).alias("demand_min"), F.max(y).alias("demand_max"),
        *[F.sum(c).alias(m) for m, c in MEANS.items()], *[F.count(c).alias(f"{m}_n") for m, c in MEANS.items()])


def merged(rows: DataFrame, like: DataFrame) -> DataFrame:
    """States of equal keys as one state, with the column types of ``like``."""
    out = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS], F.min("demand_min").alias("demand_min"), F.max("demand_max").alias("demand_max"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in like.schema.fields if f.name != MONTH])


def month_of(day: Column) -> Column:
    """The partition of a day, such as 199501."""
    return F.year(day) * 100 + F.month(day)


def _by_month(rows: DataFrame) -> DataFrame:
    """Rows with their partition, dealt out so that a partition has a few files, however many tasks made it."""
    return rows.withColumn(MONTH, month_of(F.col(DATE))).repartition(MONTH, F.pmod(F.xxhash64(PRODUCT), F.lit(4)))


class DailyRollup:
    """The roll-up under ``path`` (a folder that all executors reach); ``schema`` spares a reader the look at the files."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    @classmethod
    def build(cls, facts: DataFrame, path: str | None = None) -> DailyRollup:
        """The roll-up of all facts; without ``path``, in a folder of its own under the cluster's checkpoint folder."""
        spark = facts.sparkSession
        path = path or f"{checkpoint_dir(spark).rstrip('/')}/rollups/{uuid.uuid4().hex}"
        rows = _by_month(states(facts))
        rows.write.partitionBy(MONTH).parquet(path)
        return cls(spark, path, rows.schema)

    def load(self) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)

    def months(self, rows: DataFrame) -> list[int]:
        """The months of ``rows``: a short list, whatever the rows."""
        return sorted(r["m"] for r in rows.where(F.col(DATE).isNotNull()).select(month_of(F.col(DATE)).alias("m")).distinct().collect())

    def _replace(self, rows: DataFrame) -> None:
        """Overwrites the partitions that ``rows`` fall into, and no others."""
        cut_lineage(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(self.path)

    def merge(self, facts: DataFrame) -> list[int]:
        """Adds new fact rows; gives the months whose partitions were written."""
        months = self.months(facts)
        if months:
            now = self.load()
            stored = now.where(F.col(MONTH).isin(months)).drop(MONTH)
            new = states(facts).select(*[F.col(f.name).cast(f.dataType) for f in stored.schema.fields])
            self._replace(_by_month(merged(stored.unionByName(new), now)))
        return months

    def rebuild(self, facts: DataFrame, months: list[int]) -> None:
        """Replaces the given months by the states of ``facts`` (all facts, or those of these months); a month without facts
        keeps a partition without rows."""
        own = facts.where(month_of(F.col(DATE)).isin(months))
        now = self.load()
        rows = _by_month(states(own)).select(*[F.col(f.name).cast(f.dataType) for f in now.schema.fields])
        left = sorted(set(months) - set(self.months(own)))
        self._replace(rows)
        for month in left:
            now.limit(0).drop(MONTH).write.mode("overwrite").parquet(f"{self.path}/{MONTH}={month}")
