"""Gated message passing over graphs, and a convolution over their first nodes: a whole classifier from given parameters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import settled

#: Nodes of a graph that the convolution sees.
SLOTS = 205


@dataclass(frozen=True)
class Branch:
    """A convolution over features with a graph's slots as channels: kernel three, pool three by two, kernel one, pool two by
    two, and a sum. first: (out, slots, 3), second: (out, out of the first)."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    last: np.ndarray
    last_bias: float


@dataclass(frozen=True)
class Gated:
    """project (in, hidden) with its bias; messages, one matrix (hidden, hidden) a round; the recurrent unit's weights (3 x hidden, hidden)
    for what comes in and for the state, gates in the order reset, update, new; a branch for values and one for gates."""

    project: np.ndarray
    project_bias: np.ndarray
    messages: list[np.ndarray]
    inward: np.ndarray
    inward_bias: np.ndarray
    state: np.ndarray
    state_bias: np.ndarray
    value: Branch
    gate: Branch


def _erf(x: np.ndarray) -> np.ndarray:
    """To 1.5e-7, by the same polynomial as model.gelu."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _list(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _whole(column: Column, width: int) -> Column:
    return (F.size(column) == width) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x))


def gated_states(nodes: DataFrame, edges: DataFrame, p: Gated) -> DataFrame:
    """(sample_id, node_id, start, state): the projected input of each node and its state after all rounds. nodes: sample_id, node_id,
    features; edges: sample_id, src, dst.

    In a round a node adds up the messages of its incoming edges (a repeated edge counts each time, none is zero) and updates its
    state. Messages meet by a join on the source and an aggregate with a map-side part, so hubs are summed where their edges are; each round is
    written before the next. Nodes without whole features are left out, and edges of nodes that are not there say nothing."""
    wide, hidden = p.project.shape
    schema = "sample_id string, node_id string, start array<double>, state array<double>, message array<double>"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column("features"), wide) @ p.project + p.project_bias
            x = 0.5 * x * (1 + _erf(x / np.sqrt(2.0)))
            yield pa.record_batch([b.column("sample_id"), b.column("node_id"), _list(x), _list(x), _list(x @ p.messages[0])], names=["sample_id", "node_id", "start", "state", "message"])

    def step(k: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, m = _rows(b.column("state"), hidden), _rows(b.column("incoming"), hidden)
                a, c = m @ p.inward.T + p.inward_bias, h @ p.state.T + p.state_bias
                reset, update = (_sigmoid(a[:, i * hidden : (i + 1) * hidden] + c[:, i * hidden : (i + 1) * hidden]) for i in range(2))
                new = np.tanh(a[:, 2 * hidden :] + reset * c[:, 2 * hidden :])
                h = (1 - update) * new + update * h
                message = h @ p.messages[k + 1] if k + 1 < len(p.messages) else np.zeros_like(h)
                yield pa.record_batch([b.column("sample_id"), b.column("node_id"), b.column("start"), _list(h), _list(message)], names=["sample_id", "node_id", "start", "state", "message"])

        return run

    d = nodes.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("node_id").cast("string").alias("node_id"), F.col("features").cast("array<double>").alias("features"))
    d = settled(d.where(_whole(F.col("features"), wide)).mapInArrow(begin, schema))
    e = settled(edges.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    for k in range(len(p.messages)):
        sent = e.join(d.select("sample_id", F.col("node_id").alias("src"), "message"), ["sample_id", "src"])
        got = sent.groupBy("sample_id", F.col("dst").alias("node_id")).agg(F.array(*[F.sum(F.col("message")[i]) for i in range(hidden)]).alias("incoming"))
        zeros = F.array(*[F.lit(0.0)] * hidden)
        met = d.join(got, ["sample_id", "node_id"], "left").select("sample_id", "node_id", "start", "state", F.coalesce("incoming", zeros).alias("incoming"))
        d = settled(met.mapInArrow(step(k), schema))
    return d.select("sample_id", "node_id", "start", "state")


def _pool(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    n = (x.shape[-1] - size) // stride + 1
    return np.max([x[..., k : k + (n - 1) * stride + 1 : stride] for k in range(size)], axis=0)


def branch_score(x: np.ndarray, b: Branch) -> np.ndarray:
    """One number for each graph of x (graphs, slots, features)."""
    wide = x.shape[2]
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1)))
    y = sum(np.einsum("cs,gst->gct", b.first[:, :, k], padded[:, :, k : k + wide]) for k in range(3)) + b.first_bias[None, :, None]
    y = np.pad(_pool(np.maximum(y, 0), 3, 2), ((0, 0), (0, 0), (1, 1)))
    y = _pool(np.einsum("cd,gdt->gct", b.second, y) + b.second_bias[None, :, None], 2, 2)
    return y.reshape(len(x), -1) @ b.last + b.last_bias


def gated_classifier(nodes: DataFrame, edges: DataFrame, p: Gated, order: list[str], slots: int = SLOTS) -> DataFrame:
    """(sample_id, risk, probability): the product of the two branches over a graph's first `slots` nodes in the given order (columns of
    nodes that tell its nodes apart), the value branch on states beside projected inputs, the gate branch on states. Graphs with fewer
    nodes are filled up with zeros; graphs without nodes have no row. A task holds the slots of some graphs: nodes beyond them go before any
    shuffle, as far as each task can tell."""
    hidden = p.project.shape[1]
    d = gated_states(nodes, edges, p)
    by = nodes.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("node_id").cast("string").alias("node_id"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)])
    first = Window.partitionBy("sample_id").orderBy(*[f"by{k}" for k in range(len(order))])
    d = by.join(d, ["sample_id", "node_id"]).withColumn("slot", F.row_number().over(first)).where(F.col("slot") <= slots)
    graphs = d.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.concat("state", "start").alias("x")))).alias("s")).select("sample_id", F.flatten("s.x").alias("x"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = np.zeros((part.num_rows, slots, 2 * hidden))
                for g in range(part.num_rows):
                    rows = part.column("x")[g].values.to_numpy(zero_copy_only=False).reshape(-1, 2 * hidden)
                    x[g, : len(rows)] = rows
                risk = branch_score(x, p.value) * branch_score(x[:, :, :hidden], p.gate)
                yield pa.record_batch([part.column("sample_id"), pa.array(risk), pa.array(_sigmoid(risk))], names=["sample_id", "risk", "probability"])

    return graphs.mapInArrow(score, "sample_id string, risk double, probability double")
