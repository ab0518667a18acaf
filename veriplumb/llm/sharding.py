"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the table's slots, a permutation given by an offset and a step below the
prime table size. The shards take turns; each claims the first free slot of its order. A row's key then hashes to a slot,
and the slot's owner is its shard. A shard that joins or leaves moves little besides its own share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_KEY = "∅"


def is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def fill(shards: Sequence[str], size: int, turns: Sequence[int] | None = None) -> np.ndarray:
    """Index of the owning shard for each of ``size`` slots.

    ``turns`` gives each shard's claims per round (1 each by default), so that shards can have unequal shares. Shard
    names must differ and there may be no more of them than slots. The result depends on the set of shards alone, not on
    the order in which they are given.
    """
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("need distinct shards, no more than slots, and a prime number of slots")
    turns = list(turns or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not sum(turns):
        raise ValueError("turns must be as many as shards, not negative, and not all zero")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    at = [0] * len(shards)
    owner = np.full(size, -1, np.int32)
    left = size
    while left:
        for i in order:
            for _ in range(turns[i]):
                while left and owner[slot := (offset[i] + at[i] * step[i]) % size] >= 0:
                    at[i] += 1
                if not left:
                    return owner
                owner[slot] = i
                left -= 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5 modulo the table size; null has a slot of its own choice."""
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = 65_537, turns: Sequence[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with columns ``slot`` and ``shard``.

    The table is broadcast; it has ``size`` rows whatever the input. Columns of the input with the two output names are
    replaced. Null keys all go to one slot; equal keys to equal slots; an empty input gives no rows. Keys that hold many
    rows share a slot by definition: spread them by placing on a finer key.
    """
    owner = fill(shards, size, turns)
    rows = [(i, shards[o]) for i, o in enumerate(owner.tolist())]
    lookup = df.sparkSession.createDataFrame(rows, f"`{slot}` int, `{shard}` string")
    keep = [c for c in df.columns if c not in (slot, shard)]
    return df.withColumn(slot, slot_of(F.col(f"`{key}`"), size)).select(*(f"`{c}`" for c in keep), slot).join(F.broadcast(lookup), slot).select(*(f"`{c}`" for c in keep), slot, shard)
