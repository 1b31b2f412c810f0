"""Mixing sources to target weights (3).

The words of a source, document after document, are packed into blocks of ``block`` words
(the last is shorter).  The output is made of shards of ``shard_slots`` block slots.  For
every shard the counts of its sources are drawn: the whole part of each expectation is
certain, and the rest of the shard's slots are a multinomial draw over the fractional parts
(a plain multinomial draw of all slots would miss small targets by several percent).  The
slots of a source are numbered through the shards; slot j belongs to pass ``j div blocks``
and is mapped by that pass's own pseudorandom permutation of the block numbers
(swap-or-not rounds, a bijection on any range), then joined with the blocks by number.  So
no block is taken twice before all are taken once, and at most ``repeats`` times at all: a
slot beyond that stays empty.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``share`` of all words; a target stops at ``repeats`` times its source's words, and the
excess goes to the others by weight until none is above.

Null text: no words.  Null is a source of its own.  Documents without words are listed, with
nothing taken.  Repeated rows are documents of their own.  Very long texts fill many blocks.
An empty table gives an empty mix; further columns are carried by ``texts``, whatever their
names.  Draws depend on ``seed``, the source's name and the documents' ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, written

WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARD_SLOTS = 65536
ROUNDS = 16
#: Documents of a source whose sizes are summed up one after the other; the sums of such runs are summed up next.
RUN = 512


def targets(sources: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``sources`` (source, source_size) with ``target`` and ``blocks``-free number ``sid`` (from 0, in code-point order)."""
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (n % len(WEIGHTS) + 1).cast("int"))
    rows = sources.select("source", "source_size", n.alias("sid"), weight.alias("weight"),
                          (F.sum("source_size").over(W.Window.partitionBy()) * share).alias("total"))
    # fullest first: a source is at its cap if the level that its successors and it would get is no lower
    full_first = W.Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    cap = F.col("source_size") * float(repeats)
    before = F.coalesce(F.sum(cap).over(full_first.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(full_first.rowsBetween(0, W.Window.unboundedFollowing))
    rows = rows.withColumn("capped", cap * still <= (F.col("total") - before) * F.col("weight"))
    whole = W.Window.partitionBy()
    spent = F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(whole), F.lit(0.0))
    level = (F.col("total") - spent) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return rows.select("source", "sid", "source_size", F.when(F.col("capped"), cap).otherwise(level * F.col("weight")).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Image of ``x`` under a pseudorandom permutation of 0 .. n-1 that ``key`` chooses (swap-or-not)."""
    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), *key, r).bitwiseAND(1) == 1, other).otherwise(at)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


class Mix:
    """A mix of ``docs``: ``documents()`` has the words taken of each, ``texts()`` the taken texts themselves."""

    def __init__(self, docs: DataFrame, key: str, text: str, source: str, share: float = 1.5, repeats: int = 2,
                 block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0, with_texts: bool = False):
        self.key, self.text, self.source, self.columns = key, text, source, docs.columns
        rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
        if with_texts:
            rows = written(rows)
        self.rows = rows
        size = F.regexp_count(F.coalesce(F.col("doc")[text], F.lit("")), F.lit(WORD)).cast("long")
        self.sizes = written(rows.select("row", F.col("doc")[key].alias("key"), F.col("doc")[source].alias("source"), size.alias("size")))
        sums = self.sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        self.sources = written(targets(sums, share, repeats).withColumn("blocks", F.ceil(F.col("source_size") / block)))
        self.pieces = self._pieces(block)
        self.slots = self._slots(shard_slots, repeats, seed)

    def _pieces(self, block: int) -> DataFrame:
        """(sid, at, row, start, words): the part of a document that lies in block ``at`` of its source."""
        runs = max(1, self.sizes.count() // RUN)
        rows = (self.sizes.where("size > 0").join(F.broadcast(self.sources.select(F.col("source").alias("s"), "sid")), F.col("source").eqNullSafe(F.col("s")))
                .select("row", "key", "size", "sid", F.pmod(F.xxhash64("key"), F.lit(runs)).alias("run")))
        within = W.Window.partitionBy("sid", "run").orderBy("key", "size", "row")
        rows = rows.withColumn("to", F.sum("size").over(within))
        of_runs = rows.groupBy("sid", "run").agg(F.max("to").alias("sum"))
        ahead = W.Window.partitionBy("sid").orderBy("run").rowsBetween(W.Window.unboundedPreceding, -1)
        of_runs = of_runs.select("sid", "run", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
        placed = rows.join(of_runs, ["sid", "run"]).select("sid", "row", "size", (F.col("ahead") + F.col("to") - F.col("size")).alias("first"))
        last = F.col("first") + F.col("size") - 1
        cut = placed.withColumn("at", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))))
        start = F.greatest(F.col("at") * block - F.col("first"), F.lit(0))
        stop = F.least((F.col("at") + 1) * block - F.col("first"), F.col("size"))
        return cut.select("sid", "at", "row", start.alias("start"), (stop - start).alias("words"))

    def _slots(self, shard_slots: int, repeats: int, seed: int) -> DataFrame:
        """(sid, at, pass): the block that each filled slot takes."""
        spark = self.sizes.sparkSession
        wanted = F.col("target") * F.col("blocks") / F.col("source_size")
        own = self.sources.where("source_size > 0").select(F.coalesce("source", F.lit("\u0000null")).alias("name"), "sid", "blocks", wanted.alias("wanted"))
        total = own.agg(F.sum("wanted")).first()[0] or 0.0
        shards = max(1, math.ceil(total / shard_slots))
        # expectations of a full shard (last = 0) and of the last one
        kinds = F.explode(F.array(F.struct(F.lit(0).alias("last"), F.lit(shard_slots / max(total, 1.0)).alias("part")),
                                  F.struct(F.lit(1).alias("last"), F.lit(1 - (shards - 1) * shard_slots / max(total, 1.0)).alias("part"))))
        own = own.withColumn("k", kinds).select("name", "sid", "blocks", "k.last", (F.col("wanted") * F.col("k.part")).alias("mean"))
        own = own.withColumn("sure", F.floor("mean")).withColumn("rest", F.col("mean") - F.col("sure"))
        upto = W.Window.partitionBy("last").orderBy("sid")
        all_of = W.Window.partitionBy("last")
        own = written(own.select("*", (F.sum("rest").over(upto) - F.col("rest")).alias("low"), F.sum("rest").over(upto).alias("high"),
                                 F.sum("rest").over(all_of).alias("rests")))
        shard = spark.range(shards).select(F.col("id").alias("shard"), (F.col("id") == shards - 1).cast("int").alias("last"))
        draws = shard.join(F.broadcast(own.groupBy("last").agg(F.max("rests").alias("rests"))), "last")
        draws = draws.select("shard", "last", "rests", F.explode(F.when(F.round("rests") >= 1, F.sequence(F.lit(1), F.round("rests").cast("int")))).alias("i"))
        x = F.col("rests") * uniform(F.lit(seed), F.col("shard"), F.col("i"))
        draws = draws.withColumn("x", x).withColumn("cell", F.floor("x"))
        spans = own.where("rest > 0").select("last", "sid", "low", "high", F.explode(F.sequence(F.floor("low"), F.floor("high"))).alias("cell"))
        drawn = (draws.join(spans.hint("merge"), ["last", "cell"]).where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high")))
                 .groupBy("shard", "sid").agg(F.count("*").alias("drawn")))
        counts = shard.join(own.select("last", "sid", "name", "blocks", "sure"), "last").join(drawn, ["shard", "sid"], "left")
        counts = counts.withColumn("count", F.col("sure") + F.coalesce("drawn", F.lit(0)))
        ahead = W.Window.partitionBy("sid").orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
        counts = written(counts.select("shard", "sid", "name", "blocks", "count", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("first")))
        self.counts = counts
        # few rows that each give many slots: dealt out before, and never taken for a small table after
        slots = counts.where("count > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid", "shard").select("shard", "sid", "name", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("j"))
        turn = F.floor(F.col("j") / F.col("blocks"))
        slots = slots.where(turn < repeats).select("shard", "sid", "name", "blocks", "j", turn.alias("pass"))
        return slots.select("shard", "sid", "j", "pass", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("name"), F.col("pass")).alias("at"))

    def documents(self) -> DataFrame:
        """One row a document: key, source, size, source_size, target (its source's), taken (words, repeats counted)."""
        times = self.slots.groupBy("sid", "at").agg(F.count("*").alias("times"))
        taken = self.pieces.join(times.hint("merge"), ["sid", "at"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        rows = self.sizes.join(taken, "row", "left").join(
            F.broadcast(self.sources.select(F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s")))
        return rows.select(F.col("key").alias(self.key), F.col("source").alias(self.source), "size", "source_size", "target",
                           F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """The mix: for each document and pass that takes of it, its row with the taken words as text.

        A document taken whole keeps its text as it is; of others the taken runs of words, joined by blanks,
        stand on a line each.
        """
        runs = self.pieces.join(self.slots.select("sid", "at", "pass").hint("merge"), ["sid", "at"]).groupBy("row", "pass").agg(
            F.sort_array(F.collect_list(F.struct("start", "words"))).alias("runs"), F.sum("words").alias("taken"))
        text = F.col("doc")[self.text]
        rows = self.rows.join(runs, "row")
        words = F.when(F.col("taken") < F.regexp_count(text, F.lit(WORD)), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        rows = rows.withColumn("all", words)

        # neighbouring pieces are one run: a line break stands where words between were not taken
        def run(r: Column, i: Column) -> Column:
            last = F.element_at("runs", i.cast("int"))
            gap = F.when(i == 0, "").when(last.start + last.words == r.start, " ").otherwise("\n")
            return F.concat(gap, F.array_join(F.slice("all", r.start.cast("int") + 1, r.words.cast("int")), " "))

        rows = rows.withColumn("mixed", F.when(F.col("all").isNull(), text).otherwise(F.array_join(F.transform("runs", run), "")))
        new = {self.text: F.col("mixed")}
        if "n_chars" in self.columns:
            new["n_chars"] = F.length("mixed").cast(rows.schema["doc"].dataType["n_chars"].dataType)
        return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in self.columns])
