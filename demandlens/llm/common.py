"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, table_path

#: Words are runs of anything but the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that one Arrow batch hands to Python at most; long texts make small batches preferable.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the Arrow batch size that the operators assume."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    small_batches(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the cluster's shared checkpoint folder and read again.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation.
    The folder belongs to the job: it may go once the job's results are stored.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_memory() -> None:
    """Gives memory that a task is done with back to the system; Python workers outlive their tasks and share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches that frees its memory at the end of the task."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()
    return wrapped


def components(links: DataFrame, a: str, b: str, passes: int | None = None) -> DataFrame:
    """Connected components of the undirected ``links``: one row (node, root) per node that
    has a link; root is the smallest node of its component.

    Each pass takes the smallest label among a node's neighbours, then follows that label
    once (pointer jumping).  A hub only ever meets partial minima, its links are never
    gathered, and labels live in a written table between passes.  With ``passes``, it stops
    after so many: equal roots then still mean one component, but not the other way round.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                   .union(links.select(F.col(b).alias("u"), F.col(a).alias("v"))))
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("root")))
    done = 0
    while passes is None or done < passes:
        heard = (both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node"))
                 .agg(F.min("root").alias("m")))
        low = labels.join(heard, "node").select("node", "root", F.least("root", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = written(low.join(jump, "low").select("node", F.col("root").alias("was"),
                                                   F.least("low", "far").alias("root")))
        done += 1
        if passes is None and new.where("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
    return labels
