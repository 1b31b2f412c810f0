"""Target-distribution importance resampling (11): hashed n-gram models of raw and target texts, and a Gumbel top-k draw.

Words come from bytes: a table of 256 entries lower-cases A-Z and blanks every separator in
the text's UTF-8, and ``bytes.split`` does the rest.  Features are runs of up to ``longest``
words; ``zlib.crc32`` of a run continues from that of the run one word shorter, so no run is
ever put together as bytes.  Counters add up the features of a batch, a task sends one row
per bucket it met, and Spark sums them: at most ``buckets`` rows reach the driver for the
raw and the target texts each, whatever their size.

A second pass gives each document the mean gain of its features; the draw adds Gumbel noise
from a digest of its key.  Ranks are exact and no task sees all rows: rows go to ranges of
the order, and each range starts where the ones before it end.

Null and empty texts have no words: weight 0, never drawn (with ``min_words`` of 1 or more).
Very long texts are cut at blanks and counted a part at a time.  Rows equal in key and text
get equal scores and follow each other in rank.  A null key is hashed as empty text and
ranks before other keys of its score.  An empty table gives an empty result; without target
texts all target counts are 0.  Columns beyond key and text don't matter, whatever their
names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

BUCKETS = 10_000
#: Bytes of a text whose words are listed at a time.
PART = 1 << 20

#: What a byte of UTF-8 becomes: 0-9, a-z and all bytes of longer characters stay, A-Z are lower-cased, the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _parts(clean: bytes) -> Iterator[list[bytes]]:
    """The words of a translated text, a part at a time."""
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PART)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def features(text: bytes, longest: int) -> tuple[int, Counter]:
    """Number of words, and how often each crc32 of a run of 1 to ``longest`` words occurs."""
    n, found, before = 0, Counter(), []
    for words in _parts(text.translate(TABLE)):
        n += len(words)
        words = before + words
        seeds = [zlib.crc32(w) for w in words]
        found.update(seeds[len(before):])
        for size in range(2, longest + 1):
            seeds = [zlib.crc32(w, zlib.crc32(b" ", s)) for s, w in zip(seeds, words[size - 1:], strict=False)]
            found.update(seeds[max(0, len(before) - size + 1):])
        before = words[len(words) - longest + 1:] if longest > 1 else []
    return n, found


def _counted(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for target, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = features(text or b"", longest)[1]
                at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % buckets
                np.add.at(total[int(target)], at, np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        target, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(target == 1), pa.array(bucket.astype(np.int32)), pa.array(total[target, bucket])],
                                         names=["target", "bucket", "n"])
    return released(run)


def gains(docs: DataFrame, text: str, targets: DataFrame, target_text: str, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: the floor of 1000 times the log of its smoothed share in the target texts over that in ``docs``."""
    both = (docs.select(F.lit(False).alias("target"), F.col(text).cast("string").alias("text"))
            .union(targets.select(F.lit(True), F.col(target_text).cast("string"))))
    rows = (both.mapInArrow(_counted(longest, buckets), "target boolean, bucket int, n long")
            .groupBy("target", "bucket").agg(F.sum("n").alias("n")).toArrow())
    n = np.zeros((2, buckets))
    n[rows["target"].to_numpy().astype(int), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    (s, t), (all_s, all_t) = n, n.sum(1)
    ratio = (t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def _weighed(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n_words, found = features(text or b"", longest)
                of = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % len(gain)
                words.append(n_words)
                n.append(int(of.sum()))
                weight.append(int(gain[at] @ of) // n[-1] if n[-1] else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, n, weight))],
                                             names=["key", "n_words", "n_features", "weight"])
    return released(run)


def weights(docs: DataFrame, key: str, text: str, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """One row a document: key, n_words, n_features, and weight, the floored mean gain of its features."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_weighed(gain, longest), f"key {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank``, from 1, in the given order, which should tell rows apart.

    Ranges of the order are sorted one by one; a table with a row per range holds where each begins.
    """
    pid, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    put = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted((r["pid"], r["n"]) for r in put.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect())
    start, before = {}, 0
    for p, n in sizes:
        start[p] = before
        before += n
    spark = rows.sparkSession
    starts = spark.createDataFrame(list(start.items()) or [(0, 0)], "_pid long, _start long")
    return (put.withColumn("_pid", pid).join(F.broadcast(starts), "_pid")
            .withColumn("rank", F.col("_start") + at + 1).drop("_pid", "_start", "_at"))


def resample(docs: DataFrame, key: str, text: str, targets: DataFrame, target_text: str, longest: int = 1,
             buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row a document: ``key``, n_features, weight, score, and rank, null for those that the draw leaves.

    Of the N documents of at least ``min_words`` words, the ``percent`` * N / 100 (floored) highest scores are drawn, ties to
    the smaller key.  A score is the weight plus the floor of 1000 times a Gumbel number made from ``seed`` and key.
    """
    gain = gains(docs, text, targets, target_text, longest, buckets)
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((head.cast("double") + 0.5) / 4294967296.0)))
    rows = written(weights(docs, key, text, gain, longest).withColumn("score", F.col("weight") + noise))
    able = rows.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    # equal rows are told apart by a number, so that no range must hold all of them
    order = [F.col("score").desc(), F.col("key").asc_nulls_first(), F.col("n_features"), F.col("_row")]
    some = ranked(able.withColumn("_row", F.monotonically_increasing_id()), order).drop("_row")
    some = some.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
