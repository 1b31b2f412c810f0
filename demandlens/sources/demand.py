"""The demand fact table: schema, readers (S1, S2), column normalising (S3),
filter domains (S4), result records (S5), and the demand view over the
driver's star-schema tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_path

# Column names of the demand table (fixed by the data contract).
DATE, PRODUCT, DEMAND = "Date", "Product_ID", "Demand"
PRICE, DISCOUNT = "Price", "Discount"
CAMPAIGN, EFFECT = "Marketing_Campaign", "Marketing_Effect"
SEASON, STOCK, HOLIDAY, COMPETITOR = "Seasonal_Trend", "Stock_Availability", "Public_Holiday", "Competitor_Price"
ROW_ID = "Row_ID"

# Types of a demand table that is read from a file: doubles keep every value
# as it is written, so that none crosses an edge of a band by rounding.
DEMAND_SCHEMA = T.StructType([
    T.StructField(DATE, T.DateType(), False),
    T.StructField(PRODUCT, T.StringType(), False),
    T.StructField(DEMAND, T.DoubleType(), True),
    T.StructField(PRICE, T.DoubleType(), True),
    T.StructField(DISCOUNT, T.DoubleType(), True),
    T.StructField(CAMPAIGN, T.StringType(), True),
    T.StructField(EFFECT, T.DoubleType(), True),
    T.StructField(SEASON, T.StringType(), False),
    T.StructField(STOCK, T.DoubleType(), True),
    T.StructField(HOLIDAY, T.IntegerType(), False),
    T.StructField(COMPETITOR, T.DoubleType(), True),
    T.StructField(ROW_ID, T.StringType(), False),
])

# Derived columns of the view, one expression each; they run unchanged in
# Spark SQL and in DuckDB.
_VIEW_COLUMNS = {
    DATE: "CAST(l_shipdate AS DATE)",
    PRODUCT: "p_brand",
    DEMAND: "l_quantity",
    PRICE: "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.002 AS DECIMAL(4,3)) AS DECIMAL(12,2))",
    DISCOUNT: "CAST(CAST(l_discount AS DECIMAL(4,2)) * 5 AS DECIMAL(4,2))",
    CAMPAIGN: "NULLIF(o_orderpriority, '4-NOT SPECIFIED')",
    EFFECT: "CAST(CAST(l_tax AS DECIMAL(4,2)) * CAST(12.5 AS DECIMAL(3,1)) AS DECIMAL(5,3))",
    SEASON: ("CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' "
             "WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring' "
             "WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"),
    STOCK: "CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 101 AS DOUBLE)",
    HOLIDAY: ("CASE WHEN month(l_shipdate) * 100 + day(l_shipdate) IN (101, 423, 501, 519, 830, 1029) "
              "THEN 1 ELSE 0 END"),
    COMPETITOR: ("CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.002 AS DECIMAL(4,3)) AS DECIMAL(12,2)) "
                 "* CAST(0.75 + 0.01 * p_size AS DECIMAL(4,2)) AS DECIMAL(12,2))"),
    ROW_ID: ("concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
             "CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))"),
}


# The view as SQL text: the oracle queries use it as a CTE named ``demand``.
DEMAND_VIEW_SQL = ("SELECT " + ", ".join(f"{e} AS {name}" for name, e in _VIEW_COLUMNS.items())
                   + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")


def demand_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part → the demand fact table.

    Only the columns the view needs are read (the projection reaches the
    parquet scans), and the join strategy is left to Catalyst/AQE: at scale
    lineitem ⋈ orders is a sort-merge join on the order key and part is joined
    by part key; neither side is forced into a broadcast.
    """
    li = spark.read.parquet(table_path(sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    od = spark.read.parquet(table_path(sf_dir, "orders")).select("o_orderkey", "o_orderpriority")
    pt = spark.read.parquet(table_path(sf_dir, "part")).select("p_partkey", "p_brand", "p_size")
    joined = li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
    return joined.select(*[F.expr(e).alias(name) for name, e in _VIEW_COLUMNS.items()])


# ---------------------------------------------------------------- S1 / S2
def _raw_demand(spark: SparkSession, path: str, fmt: str | None) -> DataFrame:
    """The file's known columns by name (blanks around names don't count), CSV cells as text."""
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    raw, _ = normalise_columns(raw)
    missing = [f.name for f in DEMAND_SCHEMA.fields if f.name not in (*raw.columns, ROW_ID)]
    if missing:
        raise ValueError(f"the demand table lacks the columns {missing}")
    names = [f.name for f in DEMAND_SCHEMA.fields if f.name in raw.columns]
    if ROW_ID in names:
        return raw.select(*names)
    # equal rows get equal keys: their order does not matter
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    return raw.select(*names, key.alias(ROW_ID))


def _parsed(raw: DataFrame) -> DataFrame:
    """``raw`` with the typed columns and, in ``_bad``, the names of filled cells that don't parse."""
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in DEMAND_SCHEMA.fields}
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & t.isNull(), F.lit(c)) for c, t in typed.items()]),
                   lambda x: x.isNotNull())
    return raw.select(F.struct(*raw.columns).alias("_raw"), bad.alias("_bad"), *[t.alias(c) for c, t in typed.items()])


def load_demand(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read the demand table (CSV with header, or parquet) by column name with the fixed types.

    A missing column is an error.  Rows with a cell that does not parse are not in
    the result but in :func:`rejected_demand`; an empty cell is null.
    """
    rows = _parsed(_raw_demand(spark, path, fmt))
    return rows.where(F.size("_bad") == 0).select(*DEMAND_SCHEMA.names)


def rejected_demand(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The rows that :func:`load_demand` leaves out, as read, with the columns at fault in ``bad_columns``."""
    rows = _parsed(_raw_demand(spark, path, fmt))
    return rows.where(F.size("_bad") > 0).select("_raw.*", F.col("_bad").alias("bad_columns"))


def write_cleaned(df: DataFrame, path: str) -> None:
    """S2 (write side): positive-demand rows written once as parquet,
    partitioned by year so date-bounded reads prune whole folders."""
    (df.filter(F.col(DEMAND).isNotNull() & (F.col(DEMAND) > 0))
       .withColumn("year", F.year(DATE))
       .write.mode("overwrite").partitionBy("year").parquet(path))


def load_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """S2 (read side): the pre-cleaned copy."""
    return spark.read.parquet(path).drop("year")


# ---------------------------------------------------------------- S3
# How each known column is folded into one row per (product, day); fixed values.
DAILY_FOLD = {
    DEMAND: "sum",
    HOLIDAY: "max",
    EFFECT: "mean",
    PRICE: "mean",
    DISCOUNT: "mean",
    STOCK: "mean",
}


def normalise_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """S3: strip blanks around column names; report which known columns are
    present together with the fold (sum / max / mean) used for each."""
    stripped = df.toDF(*[c.strip() for c in df.columns])
    present = {c: how for c, how in DAILY_FOLD.items() if c in stripped.columns}
    return stripped, present


# ---------------------------------------------------------------- S4
def filter_options(df: DataFrame) -> DataFrame:
    """S4 (lists): the option lists of the filter bar in long form
    ``(kind, value)`` -- distinct products and distinct non-null campaigns,
    sorted.  Kept as rows (not one collected array) so the list size never
    has to fit in one task."""
    products = df.select(F.lit("product").alias("kind"), F.col(PRODUCT).alias("value")).distinct()
    campaigns = (df.where(F.col(CAMPAIGN).isNotNull())
                 .select(F.lit("campaign").alias("kind"), F.col(CAMPAIGN).alias("value")).distinct())
    return products.unionByName(campaigns).orderBy("kind", "value")


def filter_limits(df: DataFrame) -> DataFrame:
    """S4 (limits): one row with the date range and ``int(max(Price))``,
    the default upper end of the price slider (Q3)."""
    return df.agg(F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"),
                  F.floor(F.max(PRICE)).cast("bigint").alias("max_price"))


# ---------------------------------------------------------------- S5
def result_records(df: DataFrame) -> Iterator[dict]:
    """Row dicts of a result, partition after partition, whatever its size.

    The driver holds one partition at a time; results for other programs are
    written with :func:`write_result`.
    """
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


def write_result(df: DataFrame, path: str) -> None:
    """A result of any size as Parquet."""
    df.write.mode("overwrite").parquet(path)
