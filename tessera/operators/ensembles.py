"""Ensembles: alignment of models, weight grids, scans over them."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import settled
from .metrics import rates
from .ordering import numbered
from .sweeps import MAX_GRID, counts_at


def simplex_grid(spark: SparkSession, models: int, steps: int, positive: bool = False) -> DataFrame:
    """(weight_id, weights): all weights k / steps that sum to 1, in lexicographic order; positive: none is zero.
    Grown one model at a time, so only valid prefixes are made."""
    points = comb(steps - 1, models - 1) if positive else comb(models + steps - 1, steps)
    if points > MAX_GRID:
        raise ValueError(f"{points} grid points")
    low = int(positive)
    d = spark.range(1).select(F.array().cast("array<int>").alias("c"), F.lit(0).alias("used"))
    for k in range(models - 1):
        left = low * (models - 1 - k)
        d = d.select("c", "used", F.explode(F.expr(f"filter(sequence({low}, {steps}), x -> used + x + {left} <= {steps})")).alias("x"))
        d = d.select(F.concat("c", F.array("x")).alias("c"), (F.col("used") + F.col("x")).alias("used"))
    d = d.where(F.lit(steps) - F.col("used") >= low).select(F.concat("c", F.array(F.lit(steps) - F.col("used"))).alias("c"))
    place = F.concat(*[F.lpad(F.col("c")[i].cast("string"), 4, "0") for i in range(models)])
    return d.select(place.alias("weight_id"), F.transform("c", lambda x: x / F.lit(float(steps))).alias("weights"))


def subset_grid(spark: SparkSession, models: int, steps: int, largest: int) -> DataFrame:
    """(weight_id, weights) over all subsets of up to `largest` models, each member with a positive weight."""
    out = None
    for size in range(1, largest + 1):
        grid = simplex_grid(spark, size, steps, positive=True)
        for members in combinations(range(models), size):
            spread = F.array(*[F.col("weights")[members.index(m)] if m in members else F.lit(0.0) for m in range(models)])
            part = grid.select(F.concat(F.lit("+".join(map(str, members)) + ":"), "weight_id").alias("weight_id"), spread.alias("weights"))
            out = part if out is None else out.unionByName(part)
    return out


def aligned(models: list[DataFrame]) -> DataFrame:
    """(sample_id, label, probabilities) of samples that all models have; differing labels fail the job."""
    d = models[0].select("sample_id", F.col("label").alias("label"), F.array(F.col("probability").cast("double")).alias("probabilities"))
    for m in models[1:]:
        d = d.join(m.select("sample_id", F.col("label").alias("__l"), F.col("probability").cast("double").alias("__p")), "sample_id")
        wrong = F.raise_error(F.concat(F.lit("labels differ: "), F.col("sample_id"))).cast("int")
        d = d.select("sample_id", F.when(F.col("label") == F.col("__l"), F.col("label")).otherwise(wrong).alias("label"), F.concat("probabilities", F.array("__p")).alias("probabilities"))
    return d


def id_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples that only one of two models has, with the side."""
    d = a.select("sample_id").distinct().withColumn("a", F.lit(True)).join(b.select("sample_id").distinct().withColumn("b", F.lit(True)), "sample_id", "full_outer")
    return d.where("a is null or b is null").select("sample_id", F.when(F.col("a").isNull(), "second").otherwise("first").alias("only_in"))


def scan_grid(rows: DataFrame, grid: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of each grid point at a fixed threshold. Tasks add up counts by point; no row is repeated for a point."""
    return rates(counts_at(rows, grid, threshold))


def best_points(scan: DataFrame, top: int, by: tuple[str, str] = ("f1", "mcc"), recall_max: float = 1.0, positive_rate_max: float = 1.0) -> DataFrame:
    """The best `top` points by two metrics among those within the guards; ties by weight_id."""
    d = scan.where((F.col("recall") <= recall_max) & (F.col("positive_rate") <= positive_rate_max))
    return d.orderBy(F.desc(by[0]), F.desc(by[1]), "weight_id").limit(top)


def logistic_stack(train: DataFrame, models: int, space: str = "both", folds: int = 5, c: float = 1.0, seed: int = 42) -> DataFrame:
    """(sample_id, label, probability): out-of-fold probabilities of a logistic regression over the models'
    probabilities, their logits or both. Folds are stratified by a seeded order; with fewer than two rows of a class in
    every fold there is no stack and no row. train: sample_id, label, probabilities."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    clip = F.transform("probabilities", lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p)))
    logits = F.transform(clip, lambda p: F.log(p / (1 - p)))
    features = {"prob": F.col("probabilities"), "logit": logits, "both": F.concat("probabilities", logits)}[space]
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # one row a class
    k = min([folds, *sizes.values()])
    if len(sizes) < 2 or k < 2:
        return train.limit(0).select("sample_id", "label", F.lit(0.0).alias("probability"))
    d = train.select("sample_id", "label", array_to_vector(features).alias("features"))
    d = numbered(d, "at", "label", F.sha2(F.concat(F.lit(str(seed)), "sample_id"), 256), "sample_id")  # a label over many tasks
    starts = {label: sum(n for other, n in sizes.items() if other < label) for label in sizes}
    first = F.coalesce(*[F.when(F.col("label") == label, n) for label, n in starts.items()])
    d = settled(d.select("sample_id", "label", "features", ((F.col("at") - first) % k).alias("fold")))
    total, out = sum(sizes.values()), None
    for fold in range(k):
        fit = LogisticRegression(maxIter=100, regParam=1 / (c * total * (k - 1) / k), standardization=False).fit(d.where(F.col("fold") != fold))
        part = fit.transform(d.where(F.col("fold") == fold)).select("sample_id", "label", F.round(vector_to_array("probability")[1], 6).alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out
