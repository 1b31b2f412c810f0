"""Near-duplicates (1): BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its shingles of ``SHINGLE`` words (a shorter text: one shingle of
all its words).  Two texts are linked if the overlap of the multisets, the sum of the smaller
counts over the sum of the larger ones, is at least ``SIMILARITY``; classes are the connected
components of the links.

Signatures.  A shingle's weight range is cut at 0, 1, 2, 4, 8, ...; on each of these
intervals runs a Poisson process over time whose rate is the interval's length times the
number of components, seeded by shingle and interval alone.  Its points fall on a component
and on a weight level; a level at or above the shingle's count is thinned out, which splits
the interval that holds the count.  A component's value is its earliest point, so two texts
agree in a component with probability equal to their weighted Jaccard similarity.  A
process only runs until a bound after which no point can be the earliest; a text with a
component still empty runs again with twice the bound.

Candidates.  Texts that share a band of the signature share a bucket.  Equal word sequences
are one node from the start, so copies cost nothing more.

1. In every bucket all texts are compared with its smallest one, and classes are formed.
2. Where a bucket still holds different classes, its texts get a finer signature and are
   dealt into chunks of about ``CHUNK``.  Chunks meet two at a time; inside the task the
   signatures of every two texts of different classes are compared.  First only each text's
   likeliest partner of the other chunk becomes a row and is compared, which joins most of
   what belongs together;
3. then, in buckets that still hold different classes, all pairs of different classes that
   the signatures don't rule out.

So every pair of a bucket ends up in one class or has been compared or ruled out: by its
lengths, or by signatures that lie four standard deviations below the threshold.  No bucket
is ever gathered, and leaders and sizes are partial aggregates.

Null, empty and blank texts are copies of each other.  Repeated rows are copies.  A null
key comes after all others when a class takes its smallest key as its name.  Words are
compared as they are written.  Very long texts are compared whole.  An empty table gives an
empty result; columns beyond key and text don't matter (and are carried by ``kept``),
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, components, released, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
COMPONENTS = BANDS * ROWS
#: Standard deviations below the threshold at which a signature rules a pair out.
MARGIN = 4.0
#: Shingles whose processes run at a time (for ``COMPONENTS`` components; fewer for more).
SHINGLES = 100_000
#: Components of the finer signature, and texts of a bucket that are compared at a time.
FINE = 1024
CHUNK = 256

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
                dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes, words: _Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text (sorted hashes) and their counts."""
    own = text.split()
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(words.__getitem__, own), dtype=np.uint64, count=len(own))
    k = min(size, len(w))
    n = len(w) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = _mix(out + w[j:j + n] * _ODD[j % len(_ODD)])
    return np.unique(out, return_counts=True)


def _run(best: np.ndarray, seed: np.ndarray, rate: np.ndarray, bound: np.ndarray, slot: np.ndarray, start: np.ndarray, length: np.ndarray,
         count: np.ndarray, m: int, steps: int) -> None:
    """Runs the processes up to their bounds, ``steps`` points at a time, and keeps the earliest point per component."""
    time, done = np.zeros(len(seed)), 0
    while len(seed):
        at = np.arange(done + 1, done + steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r = _mix(seed[:, None] + at)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time  # one sum after the other, so that equal points have equal times whatever ``steps`` is
        t = np.cumsum(gap, axis=1)
        ok = t <= bound[:, None]
        row, _ = np.nonzero(ok)
        if len(row):
            r = _mix(r[ok] ^ np.uint64(0xA0761D6478BD642F))
            component = ((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            level = start[row] + (((r & np.uint64(0xFFFFFFFF)) * length[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            kept = level < count[row]
            np.minimum.at(best, slot[row[kept]] + component[kept].astype(np.int64), t[ok][kept])
        go = ok[:, -1]
        seed, rate, bound, slot, start, length, count, time = (x[go] for x in (seed, rate, bound, slot, start, length, count, t[:, -1]))
        done += steps


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash values (bits of the earliest times, one row per bag); empty bags get rows of zeros.

    Bags are taken a few at a time, so that the working arrays stay small whatever the batch.
    """
    room = SHINGLES * COMPONENTS // m
    parts, size = [[]], 0
    for bag in bags:
        if size and size + len(bag[0]) > room:
            parts.append([])
            size = 0
        parts[-1].append(bag)
        size += len(bag[0])
    return np.vstack([_signatures(p, m) for p in parts]) if bags else np.empty((0, m), np.uint64)


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    total = np.array([c.sum() for _, c in bags], dtype=np.float64)
    best = np.full((len(bags), m), np.inf)
    reach = (np.log(m) + 3) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        best[todo] = np.inf
        key = np.concatenate([bags[i][0] for i in todo])
        count = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        doc = np.repeat(todo, [len(bags[i][0]) for i in todo])
        interval, start, length = 0, 0, 1
        flat = best.reshape(-1)
        while len(key):
            seed = _mix(key + np.array([interval], dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            rate, bound = np.full(len(key), float(m * length)), reach[doc]
            # processes that expect as many points run together
            want = np.ceil(np.log2(np.maximum(rate * bound, 0.5) * 1.5)).astype(np.int64)
            for k in np.unique(want):
                i = want == k
                _run(flat, seed[i], rate[i], bound[i], doc[i] * m, np.full(i.sum(), start), np.full(i.sum(), length), count[i], m, max(1, 1 << max(0, int(k))))
            interval, start = interval + 1, start + length
            length = start
            more = count > start
            key, count, doc = key[more], count[more], doc[more]
        todo = todo[np.isinf(best[todo]).any(1)]
        reach[todo] *= 2
    best[total == 0] = 0
    return best.view(np.uint64)


def bands(sign: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    out = np.arange(n, dtype=np.uint64)[None, :] * _ODD[0] + np.zeros((len(sign), 1), dtype=np.uint64)
    for j in range(rows):
        out = _mix(out + sign.reshape(len(sign), n, rows)[:, :, j] * _ODD[j % len(_ODD)])
    return out


@released
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        if len(words) > 500_000:
            words.clear()
        bags = [shingles(t or b"", words) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        sign = signatures(bags)
        weight = [int(c.sum()) for _, c in bags]
        keys = [b if w else np.empty(0, np.uint64) for b, w in zip(bands(sign).astype(np.int64, copy=False), weight, strict=True)]
        short = (_mix(sign) & np.uint64(0xFFFF)).astype("<u2")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(weight, pa.int64()), pa.array([k.view(np.int64).tolist() for k in keys], pa.list_(pa.int64())),
             pa.array([s.tobytes() for s in short], pa.binary())], names=["key", "digest", "weight", "bands", "sign"])


def _verified(similarity: float):
    """Pairs with both texts to pairs with their similarity, if it is high enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, bag = _Words(), None, None
        for batch in batches:
            if len(words) > 500_000:
                words.clear()
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep, sims = [], []
            for i, (leader, text, other) in enumerate(zip(b.to_pylist(), ta.cast(pa.binary()), tb.cast(pa.binary()), strict=True)):
                if leader != last:
                    last, bag = leader, shingles(other.as_py() or b"", words)
                key, count = shingles(text.as_py() or b"", words)
                common, x, y = np.intersect1d(key, bag[0], assume_unique=True, return_indices=True)
                both = np.minimum(count[x], bag[1][y]).sum()
                sim = both / max(1, count.sum() + bag[1].sum() - both)
                if sim >= similarity:
                    keep.append(i)
                    sims.append(float(sim))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])
    return released(run)


def _least(similarity: float, m: int) -> float:
    """Share of equal components below which a signature of ``m`` components rules the similarity out."""
    return similarity - MARGIN * (similarity * (1 - similarity) / m) ** 0.5


def _likely(similarity: float):
    """Pairs with both short signatures to the pairs that these do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, COMPONENTS) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= _least(similarity, COMPONENTS)))
    return released(run)


@released
def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their finer signatures."""
    words = _Words()
    for batch in batches:
        words.clear()
        sign = signatures([shingles(t.as_py() or b"", words) for t in batch.column(1).cast(pa.binary())], FINE)
        short = (_mix(sign) & np.uint64(0xFFFF)).astype("<u2")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in short], pa.binary())], names=["node", "fine"])


def _chunked(table: pa.Table) -> pa.Table:
    """The texts of one chunk as one row."""
    table = table.combine_chunks()
    numbers = [table[c].to_numpy().astype("<i8").tobytes() for c in ("node", "root", "weight")]
    return pa.table({"bucket": table["bucket"][:1], "chunk": table["chunk"][:1], **{c: pa.array([x], pa.binary()) for c, x in zip(("nodes", "roots", "weights"), numbers, strict=True)},
                     "signs": pa.array([b"".join(table["fine"].to_pylist())], pa.binary())})


def _compared(similarity: float, best: bool):
    """Two chunks of a bucket to their pairs of different classes that nothing rules out; with ``best``, only to each
    text's likeliest partner among those that look similar enough.  ``share``: of equal components."""
    least = similarity if best else _least(similarity, FINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                node, root, weight = ([np.frombuffer(row[f"{c}_{side}"], dtype="<i8") for side in "ab"] for c in ("nodes", "roots", "weights"))
                x, y = (np.frombuffer(row[f"signs_{side}"], dtype="<u2").reshape(-1, FINE) for side in "ab")
                share = np.zeros((len(x), len(y)), dtype=np.float32)
                for i in range(len(x)):
                    open_ = (root[1] != root[0][i]) & (np.minimum(weight[1], weight[0][i]) >= similarity * np.maximum(weight[1], weight[0][i]))
                    if row["one"]:
                        open_ &= node[1] > node[0][i]
                    at = np.flatnonzero(open_)
                    share[i, at] = (y[at] == x[i]).mean(1)
                if best:
                    own, other = share.max(1), share.max(0)
                    a = np.concatenate([node[0], node[1]])
                    b = np.concatenate([node[1][share.argmax(1)], node[0][share.argmax(0)]])
                    found = np.concatenate([own, other])
                    good = found >= least
                    a, b, found = a[good], b[good], found[good]
                else:
                    i, j = np.nonzero(share >= least)
                    a, b, found = np.maximum(node[0][i], node[1][j]), np.minimum(node[0][i], node[1][j]), share[i, j]
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(found.astype(np.float64))],
                                                 names=["bucket", "a", "b", "share"])
    return released(run)


def digest(text: Column) -> Column:
    """The same for texts with the same words in the same order."""
    return F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS + "+", " ")))


class Classes:
    """Near-duplicate classes of ``docs``."""

    def __init__(self, docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY):
        self.docs, self.key, self.text = docs, key, text
        given = docs.select(F.col(key).alias("key"), digest(F.col(text)).alias("digest"), F.col(text).cast("string").alias("text"))
        kind = docs.schema[key].dataType.simpleString()
        self.rows = written(given.mapInArrow(_signed, f"key {kind}, digest string, weight long, bands array<long>, sign binary"))
        first = F.min(F.struct(F.col("key").isNull().alias("last"), "key")).alias("first")
        nodes = written(self.rows.groupBy("digest").agg(first, F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sign").alias("sign"))
                        .select("digest", "first.key", "weight", "bands", "sign", F.monotonically_increasing_id().alias("node")))
        links = _links(given, nodes, similarity)
        if links is not None:
            roots = components(links, "a", "b").select(F.col("node").alias("n"), "root")
            named = nodes.join(roots, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node"))
        else:
            named = nodes.withColumn("root", F.col("node"))
        named = written(named.select("digest", "key", "root"))
        #: a row per class: its first text (smallest key, then digest), and how many different texts it has
        self.firsts = written(named.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "digest")).alias("first"),
                                                        F.count("*").alias("class_texts")))
        self.named = written(named.select("digest", "root").join(self.firsts, "root").select("digest", F.col("first.key").alias("class_id"), "class_texts"))

    def members(self) -> DataFrame:
        """One row a document: ``key``, ``class_id`` (smallest key of its class), ``class_texts`` (different texts in the class)."""
        return self.rows.select("key", "digest").join(self.named, "digest").select(F.col("key").alias(self.key), "class_id", "class_texts")

    def kept(self) -> DataFrame:
        """The documents of which each class keeps one: that with the smallest key (of equal rows, one)."""
        firsts = written(self.firsts.select(F.col("first.digest").alias("d"), F.col("first.key").alias("k")))
        same = (F.col("digest") == F.col("d")) & F.col("key").eqNullSafe(F.col("k"))
        often = self.rows.select("key", "digest").join(firsts, same).groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
        often = written(often.select("d"))
        docs = self.docs.select(F.struct(*self.docs.columns).alias("doc"), F.col(self.key).alias("key"), digest(F.col(self.text)).alias("digest"))
        out = docs.join(firsts.join(often, "d", "left_anti"), same).select("doc")
        if not often.isEmpty():
            again = docs.join(firsts.join(often, "d", "left_semi"), same)
            out = out.union(again.groupBy("digest").agg(F.first("doc").alias("doc")).select("doc"))
        return out.select("doc.*")


def classes(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: ``key``, ``class_id`` (smallest key of its class), ``class_texts`` (different texts in the class)."""
    return Classes(docs, key, text, similarity).members()


def kept(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class."""
    return Classes(docs, key, text, similarity).kept()


def _links(given: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame | None:
    """Links (a, b, similarity) between nodes that make up all classes of the candidates."""
    own = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    sizes = written(own.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    if sizes.isEmpty():
        return None
    buckets = written(own.join(sizes, "bucket"))
    texts = _texts(given, nodes, buckets)

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return written(both.select("a", "b", "ta", "tb").mapInArrow(_verified(similarity), "a long, b long, similarity double"))

    # 1. with the smallest of each bucket
    stars = buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    signs = nodes.select("node", "weight", "sign")
    a = signs.select(F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("sign").alias("sa"))
    b = signs.select(F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("sign").alias("sb"))
    near = F.least("wa", "wb") >= similarity * F.greatest("wa", "wb")
    stars = stars.join(a, "a").join(b, "b").where(near).select("a", "b", "sa", "sb").mapInArrow(_likely(similarity), "a long, b long")
    links = verified(written(stars))

    # 2. and 3. in buckets that hold different classes yet (two texts have been compared already)
    fine = None
    for best in (True, False):
        # for the first, classes need not be whole yet; for the second they must, or pairs within one would be listed
        roots = components(links, "a", "b", passes=2 if best else None).select(F.col("node").alias("r"), "root")
        now = written(buckets.where("n > 2").join(roots, F.col("node") == F.col("r"), "left").select("bucket", "node", "weight", "n", F.coalesce("root", "node").alias("root")))
        mixed = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
        open_ = written(now.join(written(mixed), "bucket"))
        if open_.isEmpty():
            break
        if fine is None:
            fine = written(texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_refined, "node long, fine binary"))
        links = links.union(verified(written(_pairs(open_.join(fine, "node"), similarity, best))))
    return links


def _pairs(rows: DataFrame, similarity: float, best: bool) -> DataFrame:
    """Pairs (a, b) of texts of one bucket and different classes that are worth a look."""
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK))
    dealt = rows.select("bucket", chunk.alias("chunk"), "node", "root", "weight", "fine")
    chunks = written(dealt.groupBy("bucket", "chunk").applyInArrow(_chunked, "bucket long, chunk long, nodes binary, roots binary, weights binary, signs binary"))
    parts = ("nodes", "roots", "weights", "signs")
    first = chunks.select("bucket", F.col("chunk").alias("ca"), *[F.col(c).alias(f"{c}_a") for c in parts])
    second = chunks.select("bucket", F.col("chunk").alias("cb"), *[F.col(c).alias(f"{c}_b") for c in parts])
    # each chunk lists the numbers of those it meets, so no join by bucket alone; the chunks themselves follow by number
    sizes = rows.groupBy("bucket").agg((F.ceil(F.max("n") / CHUNK) - 1).alias("last"))
    met = chunks.select("bucket", F.col("chunk").alias("ca")).join(sizes, "bucket").select("bucket", "ca", F.explode(F.sequence("ca", "last")).alias("cb"))
    met = met.join(second, ["bucket", "cb"]).join(first, ["bucket", "ca"]).withColumn("one", F.col("ca") == F.col("cb"))
    met = met.select("bucket", "one", *[f"{c}_{side}" for side in "ab" for c in parts]).repartition(F.xxhash64("nodes_a", "nodes_b"))
    found = met.mapInArrow(_compared(similarity, best), "bucket long, a long, b long, share double")
    if best:  # of all chunks that a text has met in a bucket
        found = found.groupBy("bucket", "a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _texts(given: DataFrame, nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """The text of each node that shares a bucket: of its row with the smallest key."""
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("digest", F.col("key").alias("k"), "node")
    found = given.join(wanted, "digest").where(F.col("key").eqNullSafe(F.col("k"))).select("node", "text")
    return written(found.dropDuplicates(["node"]))
