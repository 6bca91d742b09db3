"""Global orders and running totals without one task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import settled


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with `name`: 0, 1, ... in the order given. Rows are dealt out by ranges of the order; each range counts by
    itself and starts where the one before ends, so only one count per range meets in a task. The order must be total
    for the numbers to be the same every time."""
    keys = {f"__o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    d = rows.withColumns(keys).repartitionByRange(*[F.col(k) for k in keys])
    d = settled(d.withColumn("__part", F.spark_partition_id()))
    sizes = d.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return d.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + place).cast("long")).drop("__part", "__start", *keys)


def running(rows: DataFrame, keys: list[str], order: list[Column | str], totals: dict[str, Column], largest: bool = False) -> DataFrame:
    """rows with a running total of each column of `totals` in ascending order of `order` within equal keys, this row included; largest:
    the running maximum (of values that are not null) instead of the sum.

    Two levels: rows are dealt out by ranges of (keys, order), each range sums by itself, and starts with what the ranges
    before it have for its first key. So a key with any share of the rows is spread over many tasks, and what is broadcast is at
    most one row a range: no other key of a range goes on from an earlier one. A null key is a key. Rows that the order does
    not tell apart are in one range, in any order; an empty table stays empty."""
    add = F.max if largest else F.sum
    o = {f"__o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    v = {f"__v{k}": c for k, c in enumerate(totals.values())}
    d = rows.withColumns(o | v).repartitionByRange(*[F.col(c) for c in (*keys, *o)])
    d = settled(d.withColumn("__part", F.spark_partition_id()))
    parts = d.groupBy("__part", *keys).agg(*[add(c).alias(c) for c in v])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("__part").alias("__at"), *[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], *[add(c).over(before).alias(f"__before{c}") for c in v])
    carry = carry.where(F.coalesce(*[F.col(f"__before{c}") for c in v]).isNotNull())
    same = F.col("__part") == F.col("__at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__c{i}"))
    d = d.join(F.broadcast(carry), same, "left")  # a row a range
    within = Window.partitionBy("__part", *keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda c: F.greatest(add(c).over(within), F.col(f"__before{c}")) if largest else add(c).over(within) + F.coalesce(F.col(f"__before{c}"), F.lit(0))
    return d.withColumns({name: whole(c) for name, c in zip(totals, v, strict=True)}).select(*rows.columns, *totals)
