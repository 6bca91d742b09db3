"""Explanation and reporting tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole to six places as the SQL's round has it: of the product of the double, not of its decimal digits (333 / 640 is 0.520312)."""
    return F.round(F.try_divide(part, whole) * F.lit(1e6), 0) / F.lit(1e6)


def line_topk(attention: DataFrame, k: int, negative: bool = False) -> DataFrame:
    """sample_id, rank, line, score: the best k lines of each sample by their best score (at least 0); null and negative lines go, unless negative
    (null comes last among equal scores)."""
    d = attention.where(F.lit(True) if negative else F.col("line") >= 0).groupBy("sample_id", "line").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), F.asc_nulls_last("line"))
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("sample_id", "rank", "line", "score")


def located(top: DataFrame, offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """top with source_line (line and the sample's offset) and its text, empty where there is no such line."""
    d = top.join(offsets, "sample_id", "left").withColumn("source_line", F.col("line") + F.coalesce("line_offset", F.lit(0)))
    return d.join(lines.select("sample_id", F.col("line").alias("source_line"), "text"), ["sample_id", "source_line"], "left").withColumn("text", F.coalesce("text", F.lit(""))).drop("line_offset")


def dashboard_samples(predictions: DataFrame, limit: int) -> DataFrame:
    """The most probable samples among the predicted positives, or among all if there are none; a top-k report."""
    some = predictions.agg(F.max("prediction").alias("__any"))
    d = predictions.join(F.broadcast(some))  # one row
    return d.where((F.col("prediction") == 1) | (F.col("__any") != 1)).drop("__any").orderBy(F.desc("probability"), "sample_id").limit(limit)


def context_lines(top: DataFrame, radius: int, last: DataFrame) -> DataFrame:
    """sample_id, line, new_block: the lines around each top line, each once; new_block marks a gap before it."""
    d = top.join(last, "sample_id")
    d = d.select("sample_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - radius), F.greatest(F.lit(1), F.least(F.col("line") + radius, F.col("last_line"))))).alias("line")).distinct()
    before = F.lag("line").over(Window.partitionBy("sample_id").orderBy("line"))
    return d.withColumn("new_block", F.coalesce((F.col("line") - before > 1).cast("int"), F.lit(0)))


def melted(metrics: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return metrics.unpivot([key], columns, "metric", "value")


def histogram(rows: DataFrame, value: Column, keys: list[str], bins: int, low: float, high: float) -> DataFrame:
    """keys, bin (0 .. bins - 1, the last closed), n, density."""
    place = F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins)).cast("int"))
    n = rows.where((value >= low) & (value <= high)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("density", F.round(F.col("n") / (whole * ((high - low) / bins)), 6))


def normalized_confusion(rows: DataFrame) -> DataFrame:
    """label, prediction, n, share of the label's rows."""
    n = rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return n.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy("label"))))


def mix(rows: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n, share: counts of column normalised over each row."""
    n = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy(row))))


def rank_shares(rows: DataFrame, categories: list[str], most: int = 3) -> DataFrame:
    """category, n, share: the categories of the first `most` lines of each sample, all of them, 0 for those that are not met. rows: rank, category."""
    n = rows.where(F.col("rank") <= most).groupBy("category").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    d = every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    whole = d.agg(F.greatest(F.sum("n"), F.lit(1)).alias("all"))
    return d.join(F.broadcast(whole)).select("category", "n", share(F.col("n"), F.col("all")).alias("share"))  # one row


def outcome_shares(rows: DataFrame, categories: list[str], most: int = 5) -> DataFrame:
    """outcome, category, n, share: of the first `most` lines of the samples of each outcome, every category's share; what is no listed category
    counts as other. Outcomes without lines have shares of 0. rows: rank, category, outcome."""
    listed = F.when(F.col("category").isin(categories), F.col("category")).otherwise("other")
    n = rows.where(F.col("rank") <= most).groupBy("outcome", listed.alias("category")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(o, c) for o in ("TP", "FP", "FN", "TN") for c in dict.fromkeys([*categories, "other"])], "outcome string, category string")
    d = every.join(n, ["outcome", "category"], "left").select("outcome", "category", F.coalesce("n", F.lit(0)).alias("n"))
    return d.withColumn("share", F.coalesce(share(F.col("n"), F.sum("n").over(Window.partitionBy("outcome"))), F.lit(0.0)))


def type_evidence(nodes: DataFrame, last: int = 6) -> DataFrame:
    """label, score, place: the highest score of each label, at least 0, the `last` largest of them in rising order (a report's limit). nodes: label, score."""
    d = nodes.groupBy("label").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    d = d.orderBy(F.desc("score"), F.desc("label")).limit(last)
    return d.withColumn("place", F.row_number().over(Window.orderBy("score", "label")))  # at most `last` rows


def relative_to_first(history: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """value over its first one in each run; runs whose first is zero or missing have none."""
    first = F.first(value).over(Window.partitionBy(run).orderBy(order))
    return history.select(run, order, F.round(F.try_divide(F.col(value), first), 6).alias("relative"))


def best_of(rows: DataFrame, where: Column, by: str) -> DataFrame:
    """The one row with the largest value, the smallest sample_id among equals."""
    return rows.where(where).orderBy(F.desc(by), "sample_id").limit(1)


def split_summary(graphs: DataFrame) -> DataFrame:
    """part, n, positive_rate, exact median nodes and edges, share without control-flow edges."""
    return graphs.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"), F.median("nodes").alias("median_nodes"), F.median("edges").alias("median_edges"), F.round(F.avg((F.col("cfg_edges") == 0).cast("double")), 6).alias("missing_cfg"))
