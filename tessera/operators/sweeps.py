"""Scans over ensemble weights and thresholds at once, exact, by counts that tasks can add up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import settled
from .metrics import confusion, rates
from .ordering import running

#: Cells (weights x steps of probability) that a task counts in, and weights that are multiplied out at a time.
CELLS, CHUNK = 1 << 20, 256
#: Most points of a grid; a grid is a parameter, not data.
MAX_GRID = 200_000
#: Thresholds that are candidates beside the probabilities.
ENDS = (0.0, 0.5, 1.0)
# fixed values: the strategies that are tried by default, first with any threshold, then with the fixed one
STRATEGY_TABLE = [
    ("unconstrained_val_f1", "f1", None, None),
    ("guarded_r90_p75_val_f1", "f1", 0.90, 0.75),
    ("guarded_r85_p70_val_f1", "f1", 0.85, 0.70),
    ("guarded_r80_p65_val_f1", "f1", 0.80, 0.65),
    ("unconstrained_val_mcc", "mcc", None, None),
    ("guarded_r90_p75_val_mcc", "mcc", 0.90, 0.75),
    ("guarded_r85_p70_val_mcc", "mcc", 0.85, 0.70),
]
FIXED_STRATEGY_TABLE = [
    ("fixed05_guarded_r90_p80_val_f1", "f1", 0.90, 0.80),
    ("fixed05_guarded_r90_p75_val_f1", "f1", 0.90, 0.75),
    ("fixed05_guarded_r90_p80_val_mcc", "mcc", 0.90, 0.80),
]
#: How equal objectives of thresholds of one weight are told apart, after the objective itself.
TIES = {"f1": ["mcc", "precision"], "mcc": ["f1", "precision"], "balanced_accuracy": ["mcc", "f1"]}


@dataclass(frozen=True)
class Strategy:
    """An objective, and what a point must not exceed or fall below."""

    name: str
    objective: str = "f1"
    recall_max: float | None = None
    positive_rate_max: float | None = None
    min_precision: float | None = None

    def allows(self) -> Column:
        guards = [F.lit(True)]
        guards += [F.col("recall") <= self.recall_max] if self.recall_max is not None else []
        guards += [F.col("positive_rate") <= self.positive_rate_max] if self.positive_rate_max is not None else []
        guards += [F.col("precision") >= self.min_precision] if self.min_precision is not None else []
        return reduce(and_, guards)


def strategies(fixed: bool = False) -> list[Strategy]:
    """The default strategies."""
    return [Strategy(*row) for row in (FIXED_STRATEGY_TABLE if fixed else STRATEGY_TABLE)]


def _points(grid: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names (in their order) and weights of a grid, which the driver holds."""
    rows = sorted(grid.select("weight_id", "weights").limit(MAX_GRID + 1).collect())
    if len(rows) > MAX_GRID:
        raise ValueError(f"more than {MAX_GRID} grid points")
    return [r.weight_id for r in rows], np.array([r.weights for r in rows], dtype=float)


def _mixed(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first weight, whether each row is positive, probabilities by weight and row), some weights at a time."""
    p = batch.column("probabilities").flatten().to_numpy(zero_copy_only=False).reshape(-1, weights.shape[1])
    positive = pa.compute.fill_null(pa.compute.equal(batch.column("label"), 1), False).to_numpy(zero_copy_only=False)
    for k in range(0, len(weights), CHUNK):
        yield k, positive, np.round(weights[k : k + CHUNK] @ p.T, 9)


def counts_at(rows: DataFrame, grid: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(weight_id, samples, tp, fp, fn, tn) of each grid point at a fixed threshold. A task adds up four numbers for each point;
    no row is repeated for a point. Without rows there are none."""
    names, weights = _points(grid)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(weights), 4), np.int64)
        any_ = False
        for batch in batches:
            any_ |= batch.num_rows > 0
            for k, positive, q in _mixed(batch, weights) if batch.num_rows else ():
                hit = q >= threshold
                for c, x in enumerate((hit & positive, hit & ~positive, ~hit & positive, ~hit & ~positive)):
                    n[k : k + len(q), c] += x.sum(1)
        if any_:
            yield pa.record_batch([pa.array(names), *(pa.array(n[:, c]) for c in range(4))], names=["weight_id", "tp", "fp", "fn", "tn"])

    d = rows.select(F.col("label").cast("int").alias("label"), F.col("probabilities").cast("array<double>").alias("probabilities"))
    d = d.mapInArrow(count, "weight_id string, tp long, fp long, fn long, tn long").groupBy("weight_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return d.select("weight_id", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("samples"), "tp", "fp", "fn", "tn")


def _counted(rows: DataFrame, weights: np.ndarray, steps: int, wanted: np.ndarray | None) -> DataFrame:
    """(w, step, pos, neg): rows of each weight by steps of the probability; with `wanted` (cells) also q, for each distinct
    probability of those cells alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((2, len(weights) * (steps + 1)), np.int64)
        for batch in batches:
            for k, positive, q in _mixed(batch, weights) if batch.num_rows else ():
                cell = np.clip(np.floor(q * steps), 0, steps).astype(np.int64) + (np.arange(k, k + len(q)) * (steps + 1))[:, None]
                if wanted is None:
                    for side, of in enumerate((~positive, positive)):
                        low, high = k * (steps + 1), (k + len(q)) * (steps + 1)
                        cells[side, low:high] += np.bincount(cell[:, of].ravel() - low, minlength=high - low)
                    continue
                w, r = np.nonzero(wanted[cell])
                if len(w):
                    keys, place = np.unique(np.stack([cell[w, r].astype(float), q[w, r]]), axis=1, return_inverse=True)
                    pos = np.bincount(place, positive[r], minlength=keys.shape[1]).astype(np.int64)
                    every = np.bincount(place, minlength=keys.shape[1])
                    at = keys[0].astype(np.int64)
                    yield pa.record_batch([pa.array(at // (steps + 1)), pa.array(at % (steps + 1)), pa.array(pos), pa.array(every - pos), pa.array(keys[1])], names=["w", "step", "pos", "neg", "q"])
        if wanted is None:
            at = np.flatnonzero(cells.any(0))
            yield pa.record_batch([pa.array(at // (steps + 1)), pa.array(at % (steps + 1)), pa.array(cells[1, at]), pa.array(cells[0, at])], names=["w", "step", "pos", "neg"])

    d = rows.select(F.col("label").cast("int").alias("label"), F.col("probabilities").cast("array<double>").alias("probabilities"))
    return d.mapInArrow(count, "w long, step long, pos long, neg long" + (", q double" if wanted is not None else ""))


def _ends(w: DataFrame, steps: int) -> DataFrame:
    """The candidates that are no row's probability, for each weight."""
    ends = F.array(*[F.struct(F.lit(min(int(t * steps), steps)).cast("long").alias("step"), F.lit(t).alias("q")) for t in ENDS])
    return w.select("w", F.explode(ends).alias("e")).select("w", "e.step", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"), "e.q")


def sweep(rows: DataFrame, grid: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """For each strategy the best (weight_id, threshold) and its rates: strategy, weight_id, threshold, tp, fp, fn, tn, f1, mcc,
    precision, recall, positive_rate, balanced_accuracy; a strategy that no point satisfies has no row.

    Candidates of a weight are its distinct probabilities and 0, 0.5 and 1; the objective decides, then mcc and precision (by mcc: f1
    and precision), then the threshold; between weights the objective, mcc, precision, threshold, and the first weight in the order of
    names. rows: label, probabilities (an array, one for each model); grid: weight_id, weights.

    Two rounds over the rows, and nothing of the size of rows x grid is shuffled. The first counts rows by weight and step of the
    probability: CELLS numbers a task at most. Counts above a step and in it bound what any threshold in the step can reach, since
    every objective grows with true positives and falls with false ones. The second looks at the rows of those steps alone whose bound
    reaches the best point that the first has already seen, and settles them exactly. No rows, no points."""
    names, weights = _points(grid)
    if not names or not strategies:
        raise ValueError("a grid and a strategy at least")
    steps = max(16, min(1024, CELLS // len(names)))
    spark = rows.sparkSession
    cells = settled(_counted(rows, weights, steps, None).groupBy("w", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    every = cells.select("w").distinct()
    whole = cells.groupBy(F.col("w").alias("of")).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    both = cells.unionByName(_ends(every, steps).drop("q")).groupBy("w", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.partitionBy("w").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)  # steps of one weight
    d = both.withColumns({"up_pos": F.coalesce(F.sum("pos").over(above), F.lit(0)), "up_neg": F.coalesce(F.sum("neg").over(above), F.lit(0))})
    d = settled(d.join(whole, F.col("w") == F.col("of")).drop("of"))

    def at(tp: Column, fp: Column) -> DataFrame:
        return rates(d.withColumns({"tp": tp, "fp": fp, "fn": F.col("all_pos") - tp, "tn": F.col("all_neg") - fp}), 9)

    most = at(F.col("up_pos") + F.col("pos"), F.col("up_neg"))
    fewest = at(F.col("up_pos"), F.col("up_neg")).select("w", "step", F.col("recall").alias("recall_low"), F.col("positive_rate").alias("rate_low"))
    met = at(F.col("up_pos") + F.col("pos"), F.col("up_neg") + F.col("neg"))
    known = met.agg(*[F.max(F.when(s.allows(), F.col(s.objective))).alias(f"s{k}") for k, s in enumerate(strategies)])
    bounds = most.join(fewest, ["w", "step"]).join(F.broadcast(known))  # one row
    open_ = []
    for k, s in enumerate(strategies):
        free = F.coalesce(F.col(s.objective) + 2e-9 >= F.col(f"s{k}"), F.lit(True))
        free &= (F.col("recall_low") <= s.recall_max) if s.recall_max is not None else F.lit(True)
        free &= (F.col("rate_low") <= s.positive_rate_max) if s.positive_rate_max is not None else F.lit(True)
        free &= (F.col("precision") >= s.min_precision) if s.min_precision is not None else F.lit(True)
        open_.append(free)
    left = settled(bounds.where(reduce(or_, open_)).select("w", "step", "up_pos", "up_neg", "all_pos", "all_neg"))
    wanted = np.zeros(len(names) * (steps + 1), bool)
    wanted[[r.w * (steps + 1) + r.step for r in left.select("w", "step").collect()]] = True  # CELLS at most
    exact = _counted(rows, weights, steps, wanted).unionByName(_ends(every, steps))
    exact = exact.join(left.select("w", "step"), ["w", "step"], "left_semi").groupBy("w", "step", "q").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    exact = running(exact, ["w", "step"], [-F.col("q")], {"tp": F.col("pos"), "fp": F.col("neg")}).join(left, ["w", "step"])
    tp, fp = F.col("tp") + F.col("up_pos"), F.col("fp") + F.col("up_neg")
    exact = exact.select("w", F.col("q").alias("threshold"), tp.alias("tp"), fp.alias("fp"), (F.col("all_pos") - tp).alias("fn"), (F.col("all_neg") - fp).alias("tn"))
    exact = settled(rates(exact, 9))
    kept = ["threshold", "tp", "fp", "fn", "tn", "f1", "mcc", "precision", "recall", "positive_rate", "balanced_accuracy"]
    out = None
    for s in strategies:
        own = exact.where(s.allows()).groupBy("w").agg(F.max(F.struct(s.objective, *TIES[s.objective], "threshold", F.struct(*kept).alias("row"))).alias("b")).select("w", "b.row.*")
        best = own.groupBy().agg(F.max(F.struct(s.objective, "mcc", "precision", "threshold", (-F.col("w")).alias("first"), F.struct("w", *kept).alias("row"))).alias("b"))
        best = best.where("b is not null").select(F.lit(s.name).alias("strategy"), "b.row.*")
        out = best if out is None else out.unionByName(best)
    label = spark.createDataFrame(list(enumerate(names)), "w long, weight_id string")
    out = out.join(F.broadcast(label), "w")  # a grid's names
    return out.select("strategy", "weight_id", "threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in kept[5:]])


def selected(scan: DataFrame, strategies: list[Strategy], threshold: float = 0.5) -> DataFrame:
    """For each strategy the best grid point of a scan at a fixed threshold (weight_id, rates), among those within its guards: by the objective, what
    tells equals apart, the lower rate of positives, and the first weight in the order of names. A strategy that no point satisfies has no row."""
    out = None
    for s in strategies:
        order = [s.objective, *TIES[s.objective]]
        key = F.struct(*[(-F.col(c)).alias(f"k{i}") for i, c in enumerate(order)], "positive_rate", "weight_id")
        best = scan.where(s.allows()).agg(F.min_by(F.struct(*scan.columns), key).alias("b")).where("b is not null")
        best = best.select(F.lit(s.name).alias("strategy"), F.lit(threshold).alias("threshold"), "b.*")
        out = best if out is None else out.unionByName(best)
    return out


def ranked(rows: DataFrame, chosen: DataFrame, grid: DataFrame) -> DataFrame:
    """strategy, roc_auc, average_precision of rows at the weights that were chosen. A row a strategy is broadcast."""
    from .metrics import average_precision, roc_auc

    points = chosen.select("strategy", "weight_id").join(grid, "weight_id")
    q = F.aggregate(F.zip_with("probabilities", "weights", lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x)
    d = settled(rows.join(F.broadcast(points)).select("strategy", "label", F.round(q, 9).alias("probability")))
    return roc_auc(d, ["strategy"]).join(average_precision(d, ["strategy"]), "strategy")


def frozen(rows: DataFrame, chosen: DataFrame, grid: DataFrame) -> DataFrame:
    """Rates of other rows (test, say) at the points that a sweep chose, as they are: strategy, weight_id, threshold, counts, rates. One row
    a strategy is broadcast, and only counts are shuffled."""
    points = chosen.select("strategy", "weight_id", "threshold").join(grid, "weight_id")
    q = F.aggregate(F.zip_with("probabilities", "weights", lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x)
    d = rows.join(F.broadcast(points)).withColumn("probability", F.round(q, 9))
    return rates(confusion(d, F.col("threshold"), ["strategy", "weight_id", "threshold"]))
