"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Method: each shard orders the slots of a table of prime size by its own
preference (offset and skip from its name: a permutation, as the size is
prime). The shards take turns, and each claims the first slot it prefers that
is still free, until the table is full. A row goes to the shard of the slot
that its key hashes to: one lookup, whatever the number of shards.

Slots differ by at most one between shards of equal weight, and adding or
removing a shard moves few of the other shards' slots. The table has a fixed
number of entries (a parameter), so it can be broadcast whatever the data.

Rows are placed by a key that is unique or near it; rows of one hot source
therefore spread over all shards.

Defined cases: a null key is hashed like the empty string; equal keys share a
shard; an empty table gives no rows; extra columns pass through, but for those
named ``slot`` or ``shard``, whose place the results take."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16381


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}/{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the position in ``shards`` of the shard that claimed it.
    A shard of weight w claims w slots a turn. ``slots`` must be prime."""
    if not shards:
        raise ValueError("there must be a shard")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime, at least the number of shards")
    order = [(_number(s, "offset") % slots, _number(s, "skip") % (slots - 1) + 1) if slots > 1 else (0, 1) for s in shards]
    tried, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i, (offset, skip) in enumerate(order):
            for _ in range((weights or {}).get(shards[i], 1)):
                if not free:
                    return table
                while table[at := (offset + tried[i] * skip) % slots] >= 0:
                    tried[i] += 1
                table[at] = i
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the size."""
    return F.conv(F.substr(F.md5(F.coalesce(key.cast("string"), F.lit(""))), F.lit(1), F.lit(15)), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with slot and shard (its name)."""
    table = lookup_table(shards, slots, weights)
    spark = rows.sparkSession
    # one string for the whole table: the plan stays small
    entries = (spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "at"))
               .select(F.col("slot").cast("long"), F.get(F.split(F.lit("\n".join(shards)), "\n"), F.col("at").cast("int")).alias("shard")))
    own = [c for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(*[F.col(f"`{c}`") for c in own], slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return placed.join(F.broadcast(entries), "slot").select(*[F.col(f"`{c}`") for c in own], "slot", "shard")


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 1, **params) -> None:
    """Write ``rows`` as Parquet, one folder for each shard."""
    placed = place(rows, key, shards, **params)
    part = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
