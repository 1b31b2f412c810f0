"""Exact quantiles (linear interpolation, Q7) by a rank index.

Equal values are counted first, map-side, so rows of a hot group or value arrive as counts.
The counts are dealt out by ranges of (column, group, value) and sorted there: a range holds
its share of the *distinct* values, however they are spread, so one extreme value does not
push the others into one task.  A small table, a row per range and group, says how many rows
lie before; each wanted rank is looked up in the one range that holds it.  Several columns
share one index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def rank_index(df: DataFrame, keys: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """``(_g, _v, _n, _part)``: how often each value occurs per column number and group, in sorted ranges numbered ``_part``.

    Written once to the checkpoint folder, so that the range numbers stay as they are.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("c"), v.cast("double").alias("v")) for i, v in enumerate(values)])
    rows = df.select(*keys, F.explode(entries).alias("_e")).where(F.col("_e.v").isNotNull())
    counts = rows.groupBy(F.struct(F.col("_e.c").alias("_c"), *keys).alias("_g"), F.col("_e.v").alias("_v")).agg(F.count("*").alias("_n"))
    return cut_lineage(counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()))


def quantile_table(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str | Column, Sequence[float]]]) -> DataFrame:
    """One row per group that has values: ``keys`` and, under each name of ``wanted``, the array of that column's quantiles
    (nulls if the group has no value of it).

    Groups are bands, seasons or the like: a handful, whatever the data.  What is broadcast has at most a row per wanted
    rank and group.
    """
    columns = [F.col(v) if isinstance(v, str) else v for v, _ in wanted.values()]
    index = rank_index(df, keys, columns)
    parts = index.groupBy("_g", "_part").agg(F.sum("_n").alias("_in"))
    upto = Window.partitionBy("_g").orderBy("_part")
    parts = parts.select("_g", "_part", "_in", (F.sum("_in").over(upto) - F.col("_in")).alias("_before"),
                         F.sum("_in").over(Window.partitionBy("_g")).alias("_all"))
    ranks = []
    for c, (_, probs) in enumerate(wanted.values()):
        for i, p in enumerate(probs):
            at = (F.col("_all") - 1) * F.lit(float(p))
            for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
                ranks.append(F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.lit(end).alias("end"), at.alias("at"), rank.alias("rank")))
    held = F.filter(F.array(*ranks), lambda r: (r["c"] == F.col("_g._c")) & (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_in")))
    needed = parts.select("_g", "_part", "_before", held.alias("_ranks")).where(F.size("_ranks") > 0)
    within = Window.partitionBy("_g", "_part").orderBy("_v")
    found = index.join(F.broadcast(needed), ["_g", "_part"]).withColumn("_to", F.col("_before") + F.sum("_n").over(within))
    found = found.select("_g", "_v", F.explode(F.filter("_ranks", lambda r: (r["rank"] < F.col("_to")) & (r["rank"] >= F.col("_to") - F.col("_n")))).alias("_r"))

    def quantile(c: int, i: int) -> Column:
        own = (F.col("_g._c") == c) & (F.col("_r.i") == i)
        low, high, at = (F.max(F.when(cond, x)) for cond, x in ((own & (F.col("_r.end") == "low"), F.col("_v")), (own & (F.col("_r.end") == "high"), F.col("_v")),
                                                               (own, F.col("_r.at"))))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    arrays = [F.array(*[quantile(c, i) for i in range(len(probs))]).alias(name) for c, (name, (_, probs)) in enumerate(wanted.items())]
    out = found.groupBy(*[F.col("_g")[k].alias(k) for k in keys]).agg(F.count("*").alias("_found"), *arrays)
    return out.where(F.col("_found") > 0).drop("_found")  # without keys, no values would be a row too


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: Sequence[float], name: str = "quantiles") -> DataFrame:
    """The quantiles of one column: ``keys`` and the array ``name``."""
    return quantile_table(df, list(keys), {name: (value, probs)})
