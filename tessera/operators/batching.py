"""Greedy batches under budgets, in a given order, and the end of training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import settled
from .ordering import running


def _last_that_fits(d: DataFrame, group: str, budgets: dict[str, int]) -> DataFrame:
    """(group, place, last) of rows (group, place, size and running total of each budget): the last row that a batch beginning at
    a place can take within all budgets, by binary search in the totals: totals and what a batch may reach are put in one order
    by value, and the largest place of a total so far is the answer to each question."""
    asked = None
    for name, most in budgets.items():
        totals = d.select(F.col(group).alias("g"), F.lit(name).alias("budget"), F.col(f"{name}_sum").alias("value"), F.lit(0).alias("kind"), F.col("place").alias("total_of"), F.lit(None).cast("long").alias("asks"))
        reach = d.select(F.col(group).alias("g"), F.lit(name).alias("budget"), (F.col(f"{name}_sum") - F.col(name) + most).alias("value"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("total_of"), F.col("place").alias("asks"))
        both = totals.unionByName(reach)
        asked = both if asked is None else asked.unionByName(both)
    found = running(asked, ["g", "budget"], ["value", "kind"], {"last": F.col("total_of")}, largest=True).where("kind = 1")
    return found.groupBy("g", F.col("asks").alias("place")).agg(F.min(F.coalesce("last", F.lit(0))).alias("last"))


def greedy_batches(rows: DataFrame, group: str, order: list[str], max_nodes: int, max_edges: int, skip_oversized: bool = True, max_rows: int | None = None, max_batches: int | None = None) -> DataFrame:
    """rows with batch_id: rows join the open batch while both budgets hold, else a new one begins. A row beyond a
    budget by itself is left out, or is a batch of its own. max_rows: also at most so many rows a batch (pairs, say). max_batches: rows of
    later batches of a group are left out (an epoch's cap, a limit that is the feature). rows: group, nodes, edges.

    No task holds a group. Where the batch that begins at a row would end is a search in running totals by ranges; which rows do begin
    one is found by pointer doubling: round k knows the first 2^k batches of every group and pointers 2^k batches long, so a
    group of n batches takes log2(n) joins by (group, place). Null sizes count as 0, a null group is a group; equal rows are told apart
    by where they happen to stand."""
    size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    over = (size("nodes") > max_nodes) | (size("edges") > max_edges)
    d = rows.where(~over) if skip_oversized else rows
    d = d.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(group).alias("g"), *[F.col(f"`{c}`").alias(f"by{k}") for k, c in enumerate(order)], size("nodes").alias("nodes"), size("edges").alias("edges"))
    by = [*[f"by{k}" for k in range(len(order))], "nodes", "edges", F.xxhash64("row")]
    d = settled(running(d, ["g"], by, {"nodes_sum": F.col("nodes"), "edges_sum": F.col("edges"), "place": F.lit(1).cast("long")}))
    fits = _last_that_fits(d, "g", {"nodes": max_nodes, "edges": max_edges})
    most = F.col("place") + (max_rows - 1 if max_rows else 1 << 60)
    jump = settled(fits.select(F.col("g").alias("j"), F.col("place").alias("at"), (F.greatest(F.col("place"), F.least("last", most)) + 1).alias("to")))
    starts = settled(d.where("place = 1").select("g", "place", F.lit(0).cast("long").alias("batch_id")))
    places, span = settled(d.select(F.col("g").alias("h"), F.col("place").alias("there"))), 1
    jump = settled(jump.join(places, F.col("j").eqNullSafe(F.col("h")) & (F.col("to") == F.col("there"))).select("j", "at", "to"))
    while not max_batches or span < max_batches:
        found = starts.join(jump, F.col("g").eqNullSafe(F.col("j")) & (F.col("place") == F.col("at")))
        found = settled(found.select("g", F.col("to").alias("place"), (F.col("batch_id") + span).alias("batch_id")))
        if found.isEmpty():
            break
        starts, span = starts.unionByName(found), 2 * span
        on = jump.select(F.col("j").alias("j2"), F.col("at").alias("at2"), F.col("to").alias("to2"))
        jump = settled(jump.join(on, F.col("j").eqNullSafe(F.col("j2")) & (F.col("to") == F.col("at2"))).select("j", "at", F.col("to2").alias("to")))
    starts = starts.select(F.col("g").alias("s"), F.col("place").alias("first"), F.col("batch_id").alias("begins"))
    d = d.select("g", "place", "row").join(starts, F.col("g").eqNullSafe(F.col("s")) & (F.col("place") == F.col("first")), "left")
    d = running(d.select("g", "place", "row", "begins"), ["g"], ["place"], {"batch_id": F.col("begins")}, largest=True).select("row.*", "batch_id")
    return d.where(F.col("batch_id") < max_batches) if max_batches else d


def oversized(rows: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """What skip_oversized leaves out, so that no row goes missing unseen."""
    return rows.where((F.col("nodes") > max_nodes) | (F.col("edges") > max_edges))


def early_stop(history: DataFrame, metric: str, patience: int, guard: str | None = None) -> DataFrame:
    """One row: the epoch at which training ends (patience epochs without a better metric, else the last) and the best
    epoch so far. An ordered fold over the epochs of one run. guard: a boolean column; epochs where it is false are never
    the best, except the first one while there is no other, and do not count against patience."""
    allowed = F.col(guard) if guard else F.lit(True)
    rows = history.agg(F.array_sort(F.collect_list(F.struct("epoch", F.col(metric).cast("double").alias("m"), allowed.alias("ok")))).alias("h"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(False).alias("guarded"), F.lit(-1).cast("long").alias("best_epoch"), F.lit(0).alias("wait"), F.lit(-1).cast("long").alias("stop"))

    def step(a, x):  # noqa: ANN001, ANN202
        done = a["wait"] >= patience
        first = a["best_epoch"] < 0
        better = ~done & (first | (x["ok"] & (~a["guarded"] | (x["m"] > a["best"]))))
        wait = F.when(done, a["wait"]).when(better, 0).when(x["ok"], a["wait"] + 1).otherwise(a["wait"])
        return F.struct(F.when(better, x["m"]).otherwise(a["best"]).alias("best"), (a["guarded"] | (better & x["ok"])).alias("guarded"), F.when(better, x["epoch"].cast("long")).otherwise(a["best_epoch"]).alias("best_epoch"), wait.alias("wait"), F.when(done, a["stop"]).otherwise(x["epoch"].cast("long")).alias("stop"))

    return rows.select(F.aggregate("h", start, step).alias("a")).select(F.col("a.best_epoch").alias("best_epoch"), F.col("a.stop").alias("stop_epoch"), F.round("a.best", 6).alias("best"))
