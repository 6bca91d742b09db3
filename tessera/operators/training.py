"""Training by aggregated gradients: each step one tree of sums over the rows, parameters and optimiser state a small written table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import settled
from . import metrics


@dataclass(frozen=True)
class Plan:
    """How to train. Widths: features in, hidden layers (ReLU), two logits out. A step is a share of the rows and pairs, dealt by a
    hash of seed, epoch and id; steps=1 takes all of them. Checkpoints go by `metric` on validation rows ("loss": by the training loss)."""

    widths: tuple[int, ...]
    epochs: int = 50
    steps: int = 1
    patience: int = 8
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    clip: float = 1.0
    class_weight: tuple[float, float] = (1.0, 1.0)
    lambda_replay: float = 0.0
    lambda_rank: float = 0.0
    margin: float = 0.5
    rank_warmup: int = 0
    rank_ramp: int = 0
    metric: str = "loss"
    recall_max: float | None = None
    positive_rate_min: float | None = None
    positive_rate_max: float | None = None
    seed: int = 42


BETAS, EPSILON = (0.9, 0.999), 1e-8
_STATE = "epoch int, step long, parameters array<double>, first_moment array<double>, second_moment array<double>, loss double, main_loss double, replay_loss double, ranking_loss double, lambda_rank double, rows long, pairs long, threshold double, score double, guarded_out boolean, best_epoch int, remaining_patience int, f1 double, mcc double, roc_auc double, pr_auc double, precision double, recall double, positive_rate double"


def rank_weight(plan: Plan, epoch: int) -> float:
    """Weight of the ranking loss in an epoch (from 0): none in the warm-up, then a ramp."""
    if plan.lambda_rank <= 0 or epoch < plan.rank_warmup:
        return 0.0
    return plan.lambda_rank * (min(1.0, (epoch - plan.rank_warmup + 1) / plan.rank_ramp) if plan.rank_ramp > 0 else 1.0)


def initial(plan: Plan) -> np.ndarray:
    """Seeded uniform weights by layer: a matrix (in by out), then its bias."""
    r = np.random.default_rng(plan.seed)
    layers = []
    for a, b in zip(plan.widths, plan.widths[1:], strict=False):
        layers += [r.uniform(-1, 1, (a, b)) / np.sqrt(a), r.uniform(-1, 1, b) / np.sqrt(a)]
    return np.concatenate([x.ravel() for x in layers])


def _layers(widths: tuple[int, ...], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(widths, widths[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def logits(widths: tuple[int, ...], flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(logits, what went into each layer)."""
    inputs, layers = [], _layers(widths, flat)
    for k, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w + b
        x = np.maximum(x, 0) if k + 1 < len(layers) else x
    return x, inputs


def _gradient(widths: tuple[int, ...], flat: np.ndarray, inputs: list[np.ndarray], up: np.ndarray) -> np.ndarray:
    """Sum over rows of the gradient of a loss whose gradient by the logits is `up`."""
    out: list[np.ndarray] = []
    for (w, _), x in zip(reversed(_layers(widths, flat)), reversed(inputs), strict=True):
        out = [(x.T @ up).ravel(), up.sum(0), *out]
        up = (up @ w.T) * (x > 0)  # x is a ReLU's output in all layers but the first, where the product is not used
    return np.concatenate(out)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-_softplus(-x))


def _sums_of(plan: Plan, flat: np.ndarray, batch: pa.RecordBatch, rank: float) -> np.ndarray:
    """[weights, rows, main loss, pairs, replay loss, ranking loss, main gradient..., pair gradient...] summed over a batch: rows with a label,
    and pairs, which have the features of both sides."""
    size = len(flat)
    out = np.zeros(6 + 2 * size)
    matrix = lambda name, rows: rows.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, plan.widths[0])
    paired = batch.column("other").is_valid()
    rows, pairs = batch.filter(pa.compute.invert(paired)), batch.filter(paired)
    if rows.num_rows:
        z, inputs = logits(plan.widths, flat, matrix("features", rows))
        y = rows.column("label").to_numpy().astype(float)
        w = np.where(y == 1, plan.class_weight[1], plan.class_weight[0])
        risk = z[:, 1] - z[:, 0]
        up = w * (_sigmoid(risk) - y)
        out[:3] = w.sum(), len(y), (w * _softplus(np.where(y == 1, -risk, risk))).sum()
        out[6 : 6 + size] = _gradient(plan.widths, flat, inputs, np.stack([-up, up], 1))
    if pairs.num_rows:
        (zp, ip), (zn, in_) = (logits(plan.widths, flat, matrix(c, pairs)) for c in ("features", "other"))
        rp, rn = zp[:, 1] - zp[:, 0], zn[:, 1] - zn[:, 0]
        gap = _sigmoid(plan.margin - rp + rn)
        out[3:6] = len(rp), 0.5 * (_softplus(-rp) + _softplus(rn)).sum(), _softplus(plan.margin - rp + rn).sum()
        up_p = plan.lambda_replay * 0.5 * (_sigmoid(rp) - 1) - rank * gap
        up_n = plan.lambda_replay * 0.5 * _sigmoid(rn) + rank * gap
        out[6 + size :] = _gradient(plan.widths, flat, ip, np.stack([-up_p, up_p], 1)) + _gradient(plan.widths, flat, in_, np.stack([-up_n, up_n], 1))
    return out


def _tree_sum(vectors: DataFrame, length: int) -> np.ndarray:
    """The sum of array rows (one a task): once more by about the square root of the tasks' number of tasks, then by the driver, which
    gets that many rows of the model's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(length), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = total + batch.column("v").flatten().to_numpy().reshape(-1, length).sum(0), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    width = max(1, round(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    rows = vectors.repartition(width).mapInArrow(add, "v array<double>").collect()
    return np.sum([r.v for r in rows], axis=0) if rows else np.zeros(length)


def _step_sums(plan: Plan, data: DataFrame, flat: np.ndarray, epoch: int, step: int) -> np.ndarray:
    rank, length = rank_weight(plan, epoch), 6 + 2 * len(flat)
    held = data.sparkSession.sparkContext.broadcast(flat)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(length), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = total + _sums_of(plan, held.value, batch, rank), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    own = data if plan.steps == 1 else data.where(F.pmod(F.xxhash64(F.lit(plan.seed), F.lit(epoch), "key"), F.lit(plan.steps)) == step)
    total = _tree_sum(own.select("label", "features", "other").mapInArrow(sums, "v array<double>"), length)
    held.destroy()
    return total


def _updated(plan: Plan, state: dict, sums: np.ndarray) -> None:
    """One AdamW step on the state: decoupled decay, the gradient cut to a norm first. A step without rows changes nothing."""
    size = len(state["parameters"])
    weight, _, _, pairs, _, _ = sums[:6]
    g = (sums[6 : 6 + size] / weight if weight else 0) + (sums[6 + size :] / pairs if pairs else 0)
    if not weight and not pairs:
        return
    g = g * min(1.0, plan.clip / (float(np.sqrt((g * g).sum())) + 1e-6))
    state["step"] += 1
    t, (b1, b2) = state["step"], BETAS
    p = state["parameters"] * (1 - plan.learning_rate * plan.weight_decay)
    state["first_moment"] = b1 * state["first_moment"] + (1 - b1) * g
    state["second_moment"] = b2 * state["second_moment"] + (1 - b2) * g * g
    scale = np.sqrt(state["second_moment"] / (1 - b2**t)) + EPSILON
    state["parameters"] = p - plan.learning_rate * (state["first_moment"] / (1 - b1**t)) / scale


def probabilities(plan: Plan, parameters: np.ndarray, rows: DataFrame) -> DataFrame:
    """(sample_id, label, probability) of rows (sample_id, label, features); rows without whole features are left out."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, plan.widths[0])
            z, _ = logits(plan.widths, parameters, x)
            yield pa.record_batch([batch.column("sample_id"), batch.column("label"), pa.array(_sigmoid(z[:, 1] - z[:, 0]))], names=["sample_id", "label", "probability"])

    return _whole(rows, plan).mapInArrow(predict, "sample_id string, label int, probability double")


def _whole(rows: DataFrame, plan: Plan) -> DataFrame:
    d = rows.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"))
    return d.where((F.size("features") == plan.widths[0]) & ~F.exists("features", lambda x: x.isNull() | F.isnan(x)))


def _validated(plan: Plan, state: dict, rows: DataFrame) -> dict:
    """Rates at the threshold with the best F1, ROC AUC and average precision, from one curve."""
    p = settled(probabilities(plan, state["parameters"], rows).where("label is not null").withColumn("k", F.lit(0)))
    keys = ["k"]
    best = metrics.best_threshold(p, keys).select("k", "threshold")
    at = metrics.rates(metrics.confusion(p.join(F.broadcast(best), keys), F.col("threshold"), [*keys, "threshold"]), 9)  # one row
    one = at.join(metrics.roc_auc(p, keys), keys).join(metrics.average_precision(p, keys), keys).first()
    if one is None:
        return {}
    return {c: one[c] for c in ("threshold", "f1", "mcc", "precision", "recall", "positive_rate", "roc_auc")} | {"pr_auc": one["average_precision"], "balanced_accuracy": one["balanced_accuracy"]}


def _judged(plan: Plan, before: dict | None, state: dict, found: dict) -> None:
    """Whether this epoch is the best so far, and how much patience is left: guarded-out epochs are never the best, except the first one while
    there is no other, and cost no patience."""
    out = plan.metric != "loss" and any(
        limit is not None and found and wrong(found[c], limit)
        for c, limit, wrong in (("recall", plan.recall_max, float.__gt__), ("positive_rate", plan.positive_rate_max, float.__gt__), ("positive_rate", plan.positive_rate_min, float.__lt__))
    )
    value = state["loss"] if plan.metric == "loss" else found.get(plan.metric)
    score = None if out or value is None else float(value)
    best = before["best_score"] if before else None
    better = score is not None and (best is None or (score < best if plan.metric == "loss" else score > best))
    first = before is None
    state |= {"guarded_out": out, "score": score, "best_score": score if better else best, "best_epoch": state["epoch"] if better or first else before["best_epoch"]}
    patience = plan.patience if first else before["remaining_patience"]
    state["remaining_patience"] = plan.patience if better or first else patience - (not out)


class _Book:
    """The written epochs of a run, one folder each; a folder counts once Spark has committed it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> int:
        """The last of the epochs 1, 2, ... that are all there."""
        jvm, k = self.spark.sparkContext._jvm, 0
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while True:
            done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch={k + 1}/_SUCCESS")
            if not done.getFileSystem(conf).exists(done):
                return k
            k += 1

    def epochs(self, last: int) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(*[f"{self.path}/epoch={k}" for k in range(1, last + 1)])

    def write(self, state: dict) -> None:
        names = [x.split()[0] for x in _STATE.split(", ")]
        row = tuple(v.tolist() if isinstance(v := state.get(n), np.ndarray) else v for n in names)
        self.spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch={state['epoch']}")


def train(rows: DataFrame, plan: Plan, path: str, pairs: DataFrame | None = None, validation: DataFrame | None = None, start: np.ndarray | None = None) -> DataFrame:
    """Trains a classifier and returns its epochs: parameters, optimiser state, losses, validation rates, the best epoch so far.

    rows and validation: sample_id, label (0 or 1), features; pairs: positive_id, negative_id. The loss of a step is the class-weighted
    cross entropy of its rows, plus lambda_replay times that of its pairs' sides, plus the rank weight of the epoch times the softplus of
    margin less the gap of a pair's risks. Rows without a label or whole features are left out, as are pairs whose side is missing; rows
    with one id are one each. A step is one pass: every task adds up gradients, a tree adds those, and the driver gets a vector of the
    model's size a branch; the features of pairs are joined once.

    Each epoch is written under path before the next begins. A run that was killed goes on after the last epoch there, with the same
    results; a run that is over is read back. It ends after plan.epochs, or when patience is used up."""
    spark = rows.sparkSession
    book = _Book(spark, path)
    last, state = book.last(), None
    if last:
        r = book.epochs(last).where(F.col("epoch") == last).first().asDict()
        state = r | {c: np.array(r[c]) for c in ("parameters", "first_moment", "second_moment")}
        best = book.epochs(last).where(F.col("epoch") == r["best_epoch"]).first()
        state["best_score"] = best.score
    if state is None or (state["remaining_patience"] > 0 and last < plan.epochs):
        d = _whole(rows, plan).where("label in (0, 1)")
        data = d.select(F.xxhash64("sample_id").alias("key"), "label", "features", F.lit(None).cast("array<double>").alias("other"))
        if pairs is not None:
            side = lambda c, name: d.select(F.col("sample_id").alias(c), F.col("features").alias(name))
            both = pairs.select(F.col("positive_id").cast("string").alias("positive_id"), F.col("negative_id").cast("string").alias("negative_id"))
            both = both.join(side("positive_id", "features"), "positive_id").join(side("negative_id", "other"), "negative_id")
            data = data.unionByName(both.select(F.xxhash64("positive_id", "negative_id").alias("key"), F.lit(1).alias("label"), "features", "other"))
        data = settled(data)
        flat = initial(plan) if start is None else np.asarray(start, float)
        state = state or {"epoch": 0, "step": 0, "parameters": flat, "first_moment": np.zeros_like(flat), "second_moment": np.zeros_like(flat)}
        for epoch in range(last, plan.epochs):
            before = dict(state) if epoch else None
            total, rank = np.zeros(6), rank_weight(plan, epoch)
            loss = 0.0
            for step in range(plan.steps):
                sums = _step_sums(plan, data, state["parameters"], epoch, step)
                w, n, main, m, replay, ranking = sums[:6]
                parts = [main / w if w else 0.0, replay / m if m else 0.0, ranking / m if m else 0.0]
                loss += (parts[0] + plan.lambda_replay * parts[1] + rank * parts[2]) * n
                total += [w, n, parts[0] * n, m, replay, ranking]
                _updated(plan, state, sums)
            n, m = max(total[1], 1), max(total[3], 1)
            state |= {"epoch": epoch + 1, "loss": loss / n, "main_loss": total[2] / n, "replay_loss": total[4] / m, "ranking_loss": total[5] / m, "lambda_rank": rank, "rows": int(total[1]), "pairs": int(total[3])}
            state |= {k: None if v is None else float(v) for k, v in state.items() if k in ("loss", "main_loss", "replay_loss", "ranking_loss")}
            found = _validated(plan, state, validation) if validation is not None else {}
            state |= {c: found.get(c) for c in ("threshold", "f1", "mcc", "roc_auc", "pr_auc", "precision", "recall", "positive_rate")}
            _judged(plan, before, state, found)
            book.write(state)
            if state["remaining_patience"] <= 0:
                break
    return book.epochs(book.last())


def evaluated(plan: Plan, epochs: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """Rates of test rows by the best epoch's parameters, at thresholds that validation chose and that are not chosen again:
    threshold_key (fixed_0_5, val_f1, val_mcc), threshold, counts and rates."""
    best = epochs.orderBy(F.desc("epoch")).select("best_epoch").first()
    parameters = np.array(epochs.where(F.col("epoch") == best.best_epoch).first().parameters)
    val, other = (settled(probabilities(plan, parameters, d).where("label is not null").withColumn("k", F.lit(0))) for d in (validation, test))
    t = [metrics.best_threshold(val, ["k"], m).select("k", F.lit(f"val_{m}").alias("threshold_key"), "threshold") for m in ("f1", "mcc")]
    fixed = val.select("k").distinct().select("k", F.lit("fixed_0_5").alias("threshold_key"), F.lit(0.5).alias("threshold"))
    return metrics.at_thresholds(other, fixed.unionByName(t[0]).unionByName(t[1]), ["k"]).drop("k")
