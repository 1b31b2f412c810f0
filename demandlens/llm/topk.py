"""Exact top-k search (5): a pivot-distance index.

The largest inner product is the smallest Euclidean distance once every vector gets one more
component, sqrt(M^2 - |x|^2) with M the largest norm, and a query gets 0 there.  So each
vector is keyed by its nearest pivot and its distance to it.  The vectors of a pivot, sorted
by distance, are cut into annuli of about ``ANNULUS`` rows: the blocks of the index.  A
query first meets its own annulus, which gives a score that its k-th best must reach, hence
a radius.  By the triangle inequality it then needs only annuli that the radius touches; it
visits them nearest bound first and the radius shrinks as better scores come.

Pivots are chosen from a sample of ``SAMPLE`` rows (smallest hashes of their ids); they
decide the cost and never the result.  Every row is in the index.  Equal vectors, however
many, share a distance; they are dealt into several blocks of equal bounds.

Queries that are near each other are asked together, ``GROUP`` or so at a time, so a block
travels once per group and not once per query.  Where no bound rules anything out (vectors
without structure in many dimensions) this is all that is left: blocks against blocks.

Vectors that are null, or hold a null or a non-finite component, take no part, nor do rows
without an id.  Rows are told apart by a number of their own: rows of equal id are candidates
each for itself (each other's, too), and each query row has its own answer.  A shorter vector
counts as filled up with zeros.  Scores are exact integers: in doubles while these are
exact, else in Python integers; a score beyond 64 bits is refused.  Ties go to the smaller id.
An empty table gives an empty result; columns beyond key and vector don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import released, written

SAMPLE = 4096
PIVOTS = 32
ANNULUS = 4096
#: Distances of a pivot are counted in so many cells; cells make up the annuli.
CELLS = 2048
#: Blocks that one task visits for a group of queries, and queries that are asked together (about twice as many at most).
VISITS = 64
GROUP = 2048
RESULT = "query_id long, rank int, vec_id long, score long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With the component that makes all norms equal."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Farthest-first points of the sample, moved to the means of their rows."""
    pivots = sample[:1]
    near = _distances(sample, pivots)[:, 0]
    while len(pivots) < n and near.max() > 0:
        pivots = np.vstack([pivots, sample[near.argmax()]])
        near = np.minimum(near, _distances(sample, pivots[-1:])[:, 0])
    for _ in range(rounds):
        own = _distances(sample, pivots).argmin(1)
        pivots = np.vstack([sample[own == i].mean(0) if (own == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _keyed(pivots: np.ndarray, width: int, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(2), width), top), pivots)
                pivot = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])],
                                                 names=["row", "id", "x", "pivot", "d"])
    return released(run)


def _bytes(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([column.to_numpy().astype("<i8").tobytes()], pa.binary())


def _packed(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending"), ("row", "ascending")])
        x = _matrix(table["x"].combine_chunks(), width)
        x = x.astype("<f4") if np.abs(x).max(initial=0) < 2**24 else x
        d = table["d"].to_numpy()
        return pa.table({"block": table["block"][:1], "pivot": table["pivot"][:1], "low": [d.min()], "high": [d.max()],
                         "rows": _bytes(table["row"]), "ids": _bytes(table["id"]), "vectors": pa.array([x.tobytes()], pa.binary()), "single": [x.dtype.itemsize == 4]})
    return run


def _unpacked(rows: bytes, vectors: bytes, single: bool) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(rows, dtype="<i8")
    return own, np.frombuffer(vectors, dtype="<f4" if single else "<f8").reshape(len(own), -1).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q]
    if any(abs(v) >= 2**63 for r in exact for v in r):
        raise OverflowError("a score does not fit 64 bits")
    return np.array(exact, dtype=np.int64).reshape(len(q), len(x))


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first by falling score, then id, then row."""
    if len(ids) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, rows, scores = ids[keep], rows[keep], scores[keep]
    order = np.lexsort((rows, ids, -scores))[:k]
    return ids[order], rows[order], scores[order]


def _started(k: int):
    """For the queries of a block: the score that each query's k-th best reaches at least, by that block alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows, x = _unpacked(row["rows"], row["vectors"], row["vectors_single"])
                asked, q = _unpacked(row["asked"], row["queries"], row["single"])
                s = _scores(q, x)
                least = np.full(len(asked), np.iinfo(np.int64).min)
                for i in range(len(asked)):
                    own = s[i][rows != asked[i]]
                    if len(own) >= k:
                        least[i] = np.partition(own, len(own) - k)[len(own) - k]
                out.append(least.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "asked", "names", "queries", "single")), pa.array(out, pa.binary())],
                                             names=["g", "asked", "names", "queries", "single", "least"])
    return run


def _grouped(table: pa.Table) -> pa.Table:
    """The queries of several blocks as one group."""
    rows = table.sort_by("asked").to_pylist()
    single = all(r["single"] for r in rows)
    queries = [_unpacked(r["asked"], r["queries"], r["single"])[1].astype("<f4" if single else "<f8").tobytes() for r in rows]
    joined = {c: pa.array([b"".join(r[c] for r in rows)], pa.binary()) for c in ("asked", "names", "least")}
    return pa.table({"g": table["g"][:1], "asked": joined["asked"], "names": joined["names"], "queries": pa.array([b"".join(queries)], pa.binary()),
                     "single": [single], "least": joined["least"]})


def _reach(q: np.ndarray, least: np.ndarray, top: float) -> np.ndarray:
    """Distance within which a query's k best lie, given a score that they reach (a little more, for rounding)."""
    far = np.where(least == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum((q * q).sum(1) + top - 2.0 * least.astype(np.float64), 0)))
    return far * (1 + 1e-9) + 1e-6


def _touched(pivots: np.ndarray, top: float):
    """For each group of queries and pivot: the distances at which an annulus can matter to one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, q = _unpacked(row["asked"], row["queries"], row["single"])
                d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                far = _reach(q, np.frombuffer(row["least"], dtype="<i8"), top)[:, None]
                n = len(pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["g"]] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array((d - far).min(0)), pa.array((d + far).max(0)),
                     pa.array(d.min(0)), pa.array(d.max(0))], names=["g", "pivot", "from", "to", "near", "far"])
    return run


def _visited(pivots: np.ndarray, top: float, k: int):
    """Visits the blocks of each group of queries, nearest bound first, and gives each query's k best of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, names, q, d, least, best = None, None, None, None, None, None, []
        none = (np.empty(0, np.int64),) * 3

        def over() -> pa.RecordBatch:
            n = [len(x[0]) for x in best]
            cols = [np.repeat(asked, n), np.repeat(names, n), *(np.concatenate([x[i] for x in best]) for i in range(3))]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query_row", "query_id", "vec_id", "row", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["g"] != group:
                    if group is not None:
                        yield over()
                    group = row["g"]
                    asked, q = _unpacked(row["asked"], row["queries"], row["asked_single"])
                    names = np.frombuffer(row["names"], dtype="<i8")
                    d = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
                    least = np.frombuffer(row["least"], dtype="<i8").copy()
                    best = [none] * len(asked)
                p = row["pivot"]
                bound = np.maximum(d[:, p] - row["high"], row["low"] - d[:, p])
                open_ = np.flatnonzero(bound <= _reach(q, least, top))
                if not len(open_):
                    continue
                rows, x = _unpacked(row["rows"], row["vectors"], row["single"])
                ids = np.frombuffer(row["ids"], dtype="<i8")
                for at in range(0, len(open_), 512):
                    some = open_[at:at + 512]
                    for s, i in zip(_scores(q[some], x), some, strict=True):
                        good = np.flatnonzero(s >= least[i])
                        good = good[rows[good] != asked[i]]
                        if len(good):
                            best[i] = _best(*(np.concatenate([a, b[good]]) for a, b in zip(best[i], (ids, rows, s), strict=True)), k)
                            if len(best[i][0]) >= k:
                                least[i] = max(least[i], best[i][2][-1])
        if group is not None:
            yield over()
    return released(run)


def _merged(queries: dict[int, int]) -> dict[int, int]:
    """For each pivot the number of a group: neighbours in the list of pivots share one while they have few queries."""
    out, number, size = {}, 0, 0
    for pivot in sorted(queries):
        if size and size + queries[pivot] > GROUP:
            number, size = number + 1, 0
        out[pivot] = number
        size += queries[pivot]
    return out


def search(df: DataFrame, key: str, vector: Column, is_query: Column, k: int = 20) -> DataFrame:
    """The k largest inner products of each query row with all other rows: ``query_id, rank, vec_id, score``.

    ``vector``: array of whole numbers as doubles.  ``is_query``: condition on ``key`` that marks query rows.
    """
    spark = df.sparkSession
    sound = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (df.select(F.col(key).cast("long").alias("id"), vector.cast("array<double>").alias("x")).where(F.col("id").isNotNull() & sound)
            .select(F.monotonically_increasing_id().alias("row"), "id", "x"))
    rows = written(rows)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    width, top = rows.agg(F.max(F.size("x")), F.max(square)).first()
    if width is None:
        return spark.createDataFrame([], RESULT)
    sample = rows.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).toArrow()
    pivots = choose_pivots(_lifted(_matrix(sample["x"].combine_chunks(), width), top))

    keyed = rows.mapInArrow(_keyed(pivots, width, top), "row long, id long, x array<double>, pivot int, d double")
    reach = 2 * float(np.sqrt(top)) + 1
    keyed = keyed.withColumn("cell", F.least(F.floor(F.col("d") / reach * CELLS), F.lit(CELLS - 1)).cast("int"))
    keyed = written(keyed)
    # at most PIVOTS * CELLS rows, whatever the input
    cells = keyed.groupBy("pivot", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.Window.partitionBy("pivot").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1))
    cells = cells.select("pivot", "cell", F.floor(F.coalesce(before, F.lit(0)) / ANNULUS).alias("ring"),
                         F.ceil(F.col("n") / ANNULUS).alias("deals"))
    block = F.concat_ws(".", "pivot", "ring", F.when(F.col("deals") > 1, F.concat_ws("-", "cell", F.pmod(F.xxhash64("row"), "deals"))))
    dealt = keyed.join(F.broadcast(cells), ["pivot", "cell"]).select("row", "id", "x", "pivot", "d", block.alias("block"))
    dealt = written(dealt)
    kind = "block string, pivot int, low double, high double, rows binary, ids binary, vectors binary, single boolean"
    blocks = written(dealt.groupBy("block").applyInArrow(_packed(width), kind).withColumn("b", F.monotonically_increasing_id()))
    asked = dealt.where(is_query)
    # at most a row per pivot
    merged = _merged({r["pivot"]: r["n"] for r in asked.groupBy("pivot").agg(F.count("*").alias("n")).collect()})
    if not merged:
        return spark.createDataFrame([], RESULT)
    asked = (asked.groupBy("block").applyInArrow(_packed(width), kind)
             .select("block", F.col("rows").alias("asked"), F.col("ids").alias("names"), F.col("vectors").alias("queries"), F.col("single").alias("asked_single")))
    number = F.element_at(F.create_map(*[F.lit(x) for pair in merged.items() for x in pair]), F.col("pivot"))
    # a pivot with more queries than a group holds makes several
    upto = F.sum(F.length("asked") / 8).over(W.Window.partitionBy("pivot").orderBy("low", "b"))
    both = asked.join(blocks, "block").withColumn("g", F.concat_ws(".", number, F.when(upto > GROUP, F.concat_ws("-", "pivot", F.floor(upto / GROUP)))))
    both = both.select("g", "asked", "names", "queries", F.col("asked_single").alias("single"), "rows", "vectors", F.col("single").alias("vectors_single"))
    kind = "g string, asked binary, names binary, queries binary, single boolean, least binary"
    groups = written(both.mapInArrow(_started(k), kind).groupBy("g").applyInArrow(_grouped, kind))
    spans = groups.select("g", "asked", "queries", "single", "least").mapInArrow(
        _touched(pivots, top), "g string, pivot int, `from` double, `to` double, near double, far double")
    outside = F.greatest(F.lit(0.0), F.col("near") - F.col("high"), F.col("low") - F.col("far"))
    pairs = spans.join(blocks.select("b", "pivot", "low", "high"), "pivot").where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")))
    pairs = pairs.select("g", "b", outside.alias("outside"))
    parts = -(-blocks.count() // VISITS)
    full = (pairs.join(groups.select("g", "asked", "names", "queries", F.col("single").alias("asked_single"), "least"), "g")
            .join(blocks.select("b", "pivot", "low", "high", "rows", "ids", "vectors", "single"), "b"))
    full = full.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts))).repartition("g", "part").sortWithinPartitions("g", "part", "outside", "b")
    found = full.select("g", "asked", "names", "queries", "asked_single", "least", "pivot", "low", "high", "rows", "ids", "vectors", "single").mapInArrow(
        _visited(pivots, top, k), "query_row long, query_id long, vec_id long, row long, score long")
    order = W.Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
