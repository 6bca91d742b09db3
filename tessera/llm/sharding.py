"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime, at least a hundred times the shards, so that shares differ by about one percent.
TABLE = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE) -> np.ndarray:
    """Shard number of each slot. A shard's preference order is offset, offset + skip, ... modulo size, from two keyed
    hashes of its name; in turns, each shard claims the first slot of its order that is still free. The table depends
    on the names alone, and losing a shard moves few slots of the others."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    digest = lambda name, key: int.from_bytes(hashlib.blake2b(name.encode(), key=key, digest_size=8).digest(), "big")
    at = [digest(s, b"offset") % size for s in shards]
    skip = [digest(s, b"skip") % (size - 1) + 1 for s in shards]
    table, free = np.full(size, -1, np.int32), size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str] | None = None, size: int = TABLE) -> DataFrame:
    """df with shard_slot, shard_id and shard_name, looked up in a broadcast table of `size` rows (a fixed size, under
    2 MB for the default). No row moves. A null key has a slot like any other; equal keys share a shard; columns of df with one of
    the three names are replaced; an empty table stays empty, with the columns."""
    names = shards or [f"shard-{k:04d}" for k in range(SHARDS)]
    table = lookup_table(names, size)
    rows = df.sparkSession.createDataFrame([(slot, int(k), names[k]) for slot, k in enumerate(table.tolist())], "shard_slot int, shard_id int, shard_name string")
    clash = {"shard_slot", "shard_id", "shard_name"} & set(df.columns)
    keep = df.drop(*clash).withColumn("shard_slot", slot_of(F.col(key), size))
    return keep.join(F.broadcast(rows), "shard_slot", "left")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str] | None = None) -> None:
    """Writes one folder per shard. Rows meet by shard and a salt, so a task holds a part of one shard."""
    placed = assign_shards(df, key, shards)
    placed.withColumn("__salt", F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(8))).repartition("shard_name", "__salt").drop("__salt", "shard_slot", "shard_id").write.partitionBy("shard_name").mode("overwrite").parquet(path)


def sharding_query(docs: DataFrame) -> DataFrame:
    """Placement of every document, with the size of its text for the balance of the shards."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return assign_shards(d, "doc_id").select("doc_id", "n_bytes", F.col("shard_slot").cast("long"), F.col("shard_id").cast("long"), "shard_name")
