"""Classification metrics, thresholds and ranking scores over (label, probability) rows, grouped by any keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def rates(d: DataFrame, digits: int = 6) -> DataFrame:
    """d (with tp, fp, fn, tn) with accuracy, precision, recall, specificity, f1, balanced_accuracy, mcc and
    positive_rate; 0 where a denominator is."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    big = lambda c: c.cast("double")
    root = F.sqrt(big(tp + fp) * big(tp + fn) * big(tn + fp) * big(tn + fn))
    out = {
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": F.when(root == 0, F.lit(0.0)).otherwise((big(tp) * big(tn) - big(fp) * big(fn)) / root),
        "positive_rate": _ratio(tp + fp, n),
    }
    return d.withColumns({k: F.round(v, digits) for k, v in out.items()})


def confusion(rows: DataFrame, threshold: Column, keys: list[str]) -> DataFrame:
    """keys, samples, tp, fp, fn, tn at a threshold (a column, so it may differ by row)."""
    hit, pos = F.col("probability") >= threshold, F.col("label") == 1
    counts = {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}
    return rows.groupBy(*keys).agg(F.count("*").alias("samples"), *[F.count_if(v).alias(k) for k, v in counts.items()])


def _summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold, pos, neg and what is at or above each threshold (tp, fp) and below it (fn, tn). One key may have any share of the
    rows: the sums run by ranges, and totals meet them in a join of keys."""
    d = running(counts, keys, [-F.col("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")})
    whole = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    d = d.join(whole, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True)))
    return d.select(*counts.columns, "tp", "fp", (F.col("__pos") - F.col("tp")).alias("fn"), (F.col("__neg") - F.col("fp")).alias("tn"))


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, threshold, pos, neg, tp, fp, fn, tn at each distinct probability: one row each, by running sums from the
    top over rows that are summed per probability first. At least one key."""
    d = rows.groupBy(*keys, F.col("probability").alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return _summed(d, keys)


def best_threshold(rows: DataFrame, keys: list[str], by: str = "f1") -> DataFrame:
    """keys, threshold, <by>: the distinct probability with the best score; of equals the largest."""
    d = rates(curve(rows, keys), 9)
    best = d.groupBy(*keys).agg(F.max(F.struct(by, "threshold")).alias("b"))
    return best.select(*keys, "b.threshold", F.round(f"b.{by}", 6).alias(by))


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, roc_auc: pairs of a positive and a negative in the right order, ties half; null with one class only."""
    d = curve(rows, keys)
    twice = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")))  # per negative: positives above, twice, and tied ones
    d = d.groupBy(*keys).agg(twice.alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return d.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("w").cast("double") / (2.0 * F.col("p") * F.col("n")), 6)).alias("roc_auc"))


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, average_precision: the sum over thresholds of recall gained times precision; null without positives."""
    d = curve(rows, keys)
    gain = F.sum(F.col("pos") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    d = d.groupBy(*keys).agg(gain.alias("g"), F.sum("pos").alias("p"))
    return d.select(*keys, F.when(F.col("p") > 0, F.round(F.col("g") / F.col("p"), 6)).alias("average_precision"))


def roc_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = curve(rows, keys)
    return d.select(*keys, "threshold", F.round(_ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("tpr"))


def guarded_scan(rows: DataFrame, keys: list[str], objective: str = "f1", recall_max: float | None = None, positive_rate_max: float | None = None, min_precision: float | None = None) -> DataFrame:
    """keys, threshold and rates of the best threshold that violates no guard; keys without one have no row. Candidates
    are the distinct probabilities and 0, 0.5 and 1; the objective decides, then mcc (by mcc: f1), precision (by balanced_accuracy: f1) and the threshold."""
    ends = rows.select(*keys).distinct().select(*keys, F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("probability"), F.lit(None).cast("int").alias("label"))
    both = rows.select(*keys, F.col("probability").cast("double").alias("probability"), F.col("label").cast("int").alias("label")).unionByName(ends)
    d = both.groupBy(*keys, F.col("probability").alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    d = rates(_summed(d, keys), 9)
    for column, bound, op in (("recall", recall_max, "<="), ("positive_rate", positive_rate_max, "<="), ("precision", min_precision, ">=")):
        if bound is not None:
            d = d.where(f"{column} {op} {bound}D")
    ties = {"f1": ("mcc", "precision"), "mcc": ("f1", "precision"), "balanced_accuracy": ("mcc", "f1")}[objective]
    best = d.groupBy(*keys).agg(F.max(F.struct(objective, *ties, "threshold", *[c for c in ("mcc", "precision", "recall", "positive_rate") if c not in (objective, *ties)])).alias("b"))
    return best.select(*keys, "b.threshold", *[F.round(f"b.{c}", 6).alias(c) for c in dict.fromkeys([objective, "mcc", "precision", "recall", "positive_rate"])])


def at_thresholds(rows: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of rows at each named threshold of their keys (thresholds: keys, threshold_key, threshold)."""
    return rates(confusion(rows.join(thresholds, keys), F.col("threshold"), [*keys, "threshold_key", "threshold"]))


def prediction_shift(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: shared samples, mean |difference of probability|, share of equal labels; zeros if nothing is shared."""
    d = before.select("sample_id", F.col("probability").alias("a")).join(after.select("sample_id", F.col("probability").alias("b")), "sample_id")
    same = ((F.col("a") >= threshold) == (F.col("b") >= threshold)).cast("double")
    return d.agg(F.count("*").alias("samples"), F.round(F.coalesce(F.avg(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)), 6).alias("mean_shift"), F.round(F.coalesce(F.avg(same), F.lit(0.0)), 6).alias("agreement"))


def best_checkpoint(history: DataFrame, metric: str, lower: bool = False, guards: Column | None = None) -> DataFrame:
    """The epoch with the best metric among those that pass the guards; the earliest of equals."""
    d = history.where(guards) if guards is not None else history
    value = F.col(metric) if lower else -F.col(metric)
    return d.agg(F.min(F.struct(value.alias("v"), F.col("epoch").alias("epoch"))).alias("b")).select("b.epoch", (F.col("b.v") if lower else -F.col("b.v")).alias(metric))


def weighted_mean_loss(batches: DataFrame) -> DataFrame:
    """One row: the mean loss weighed by samples (loss, n); 0 without batches, an error if there are some but no positive number of samples."""
    total = F.sum("n")
    wrong = F.raise_error(F.lit("batches without samples")).cast("double")
    mean = F.when(F.count("*") == 0, F.lit(0.0)).when(F.coalesce(total, F.lit(0)) <= 0, wrong).otherwise(F.sum(F.col("loss") * F.col("n")) / total)
    return batches.agg(F.round(mean, 6).alias("loss"))


def mean_diagnostics(batches: DataFrame) -> DataFrame:
    """(name, value): the plain mean over batches of each diagnostic. batches: diagnostics (map of name to value)."""
    d = batches.select(F.explode("diagnostics").alias("name", "v"))
    return d.groupBy("name").agg(F.round(F.avg("v"), 6).alias("value"))
