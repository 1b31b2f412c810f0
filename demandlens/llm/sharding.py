"""Sharding (10): a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an
offset and a stride from a digest of its name.  The shards take turns; at its turn a shard
claims the first slot of its order that is still free.  So all shards own nearly the same
number of slots, and few slots change owner when a shard comes or goes.  A row's key is
hashed to a slot, and the broadcast table of ``table_size`` rows (a parameter, whatever the
input) gives its shard.

Nulls, blanks and repeats: a null key is placed as the empty text, equal keys always get
the same shard, an empty table gives an empty result, and columns of the input named
``slot`` or ``shard`` give way to the placement.  Key columns are joined as text with
``|`` and a backslash before any ``|`` or backslash of their own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 8191
SHARDS = 64


def _preference(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % size, int(digest[15:30], 16) % (size - 1) + 1


def lookup(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Owner (index into ``shards``) of every slot; ``size`` is prime and at least the number of shards."""
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime no smaller than the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and distinct")
    order = [_preference(name, size) for name in shards]
    tried, owner, free = [0] * len(shards), [-1] * size, size
    while free:
        for i, (offset, stride) in enumerate(order):
            while free:
                slot = (offset + tried[i] * stride) % size
                tried[i] += 1
                if owner[slot] < 0:
                    owner[slot] = i
                    free -= 1
                    break
    return owner


def table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table (slot, shard) as a frame of ``size`` rows."""
    owners = ",".join(map(str, lookup(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select(
        "slot", F.col("owner").cast("int").alias("shard"))


def slot_of(keys: list[Column], size: int = TABLE_SIZE) -> Column:
    """Slot of a row: the first 60 bits of the md5 of its key, modulo the table size."""
    own = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    if len(own) > 1:
        own = [F.regexp_replace(k, r"([\\|])", r"\\$1") for k in own]
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *own)), 1, 15), 16, 10)
    return (head.cast("long") % size).cast("int")


def place(df: DataFrame, keys: list[str], shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (index into ``shards``).  No shuffle: one hash and one broadcast lookup a row."""
    placed = df.withColumn("slot", slot_of([F.col(k) for k in keys], size)).drop("shard")
    return placed.join(F.broadcast(table(df.sparkSession, shards, size)), "slot")
