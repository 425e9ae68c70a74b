"""Operator 5: placement on shards by a permutation-filled lookup table.

Shards take turns; each claims the next free slot in its own order of preference until a table of prime size
is full. Every shard gets an equal share, and a shard that goes gives up little but its own slots. The
table has a fixed size, so it is broadcast and placing a row is one lookup.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

SIZE = 65_537
#: The largest table: two longs a slot, 64 MB.
MOST = 4_000_037


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The shard's number for each slot. `size` is a prime above the number of shards, MOST at most."""
    names = sorted(set(shards))
    if len(names) != len(shards) or not names:
        raise ValueError("shards need names of their own")
    if not _prime(size) or not len(names) < size <= MOST:
        raise ValueError(f"not a prime between the number of shards and {MOST}: {size}")
    starts, steps = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        starts.append(int.from_bytes(h[:8], "big") % size)
        steps.append(int.from_bytes(h[8:16], "big") % (size - 1) + 1)
    table = np.full(size, -1, np.int32)
    at, left = list(starts), size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + steps[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key, from its text. A null key is placed like an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size


def table_rows(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    table = lookup_table(shards, size)
    names = np.array(shards, dtype=object)[table]
    return spark.createDataFrame(pa.table({"slot": np.arange(size, dtype=np.int64), "shard": pa.array(names, pa.string())}))


def placed(rows: DataFrame, key: str, shards: list[str], *, size: int = SIZE, into: str = "shard") -> DataFrame:
    """All rows and columns, and the shard of each in column `into` (replaced where it exists).

    Equal keys, null ones too, go to one shard; a hot key is one shard's by the nature of the operator,
    but the lookup moves no row. An empty table stays empty.
    """
    slot = fresh(rows, "slot")
    table = table_rows(rows.sparkSession, shards, size).select(F.col("slot").alias(slot), F.col("shard").alias(f"{slot}_to"))
    kept = rows.drop(into) if into != key else rows
    return (
        kept.withColumn(slot, slot_of(F.col(key), size))
        .join(F.broadcast(table), slot, "left")
        .withColumn(into, F.col(f"{slot}_to"))
        .drop(slot, f"{slot}_to")
    )
