"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a prime-sized table, given by an offset
and a step from its name. In turns each shard claims its first free slot until the table is
full; so shards differ by at most one slot, and a shard that comes or goes moves few others.
A key's hash names a slot: one lookup in a broadcast table of fixed size places it.

A null key is placed like the empty string. Equal keys share a place, repeated rows too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard that holds each slot. Names are distinct, the size is prime."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime size, and distinct shards no more than slots")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = np.array([int.from_bytes(d[:8], "big") % slots for d in digests])
    step = np.array([int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests])
    held, left = np.full(slots, -1), slots
    while left:
        for k in range(min(len(shards), left)):
            while held[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            held[at[k]] = k
        left -= min(len(shards), left)
    return held


def place(rows: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """The rows with the slot and the shard of their key; columns of those names are replaced.

    The table has ``slots`` rows whatever the data's size, which bounds the broadcast.
    """
    held = lookup_table(shards, slots)
    table = rows.sparkSession.createDataFrame(pd.DataFrame({"_slot": np.arange(slots), "_shard": np.array(shards)[held]}))
    kept = rows.drop(*({slot, shard} - {key}))
    hashed = kept.withColumn("_slot", F.pmod(F.xxhash64(F.coalesce(kept[key].cast("string"), F.lit(""))), F.lit(slots)))
    placed = hashed.join(F.broadcast(table), "_slot")
    return placed.select(*[placed[c] for c in kept.columns if c not in (slot, shard)], placed["_slot"].alias(slot), placed["_shard"].alias(shard))
