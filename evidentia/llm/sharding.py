"""Sharding: a lookup table of prime size whose slots the shards claim in turn, each by its own permutation."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; a table of so many slots spreads a hundred shards to within about one part in a hundred.
SLOTS = 65_537


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard.

    A shard's preference is the permutation (offset + k * skip) mod slots; the shards take turns, each claiming
    the first slot of its preference that is still free. Removing a shard moves few slots besides its own.
    The work and the result depend on slots alone, never on the data.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most as many as slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    at, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        skip.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null is a key like any other."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("null")) for k in keys]
    return F.pmod(F.xxhash64(*parts), F.lit(slots))


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): SLOTS rows whatever the input, about 1 MB, so that it can always be broadcast."""
    return spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard int")


def place(df: DataFrame, shards: Sequence[str], key: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """df with (slot, shard) behind its columns, which replace columns of these names.

    Placement is one lookup in the broadcast table: no shuffle, the same at every size. Give a key that
    no third of the rows shares (an id, or a group and an id): rows of one key lie in one shard by definition.
    """
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(*[F.col(k) for k in key], slots=slots))
    return keyed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot", "left").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")
