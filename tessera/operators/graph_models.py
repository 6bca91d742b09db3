"""Whole graph classifiers from given parameters: convolutions as joins and sums of messages, layers over Arrow batches in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import settled
from .recurrent import _erf, _list, _rows, _sigmoid, _whole

Layer = tuple[np.ndarray, np.ndarray]  # weights (in, out) and bias


@dataclass(frozen=True)
class Convolutions:
    """project: (features, hidden). The two convolutions have one matrix (plain) or one a relation and the last one for a node
    itself (typed); norms: scale and shift of each. Plain graphs are classified by mean and maximum (2 x hidden, 2)."""

    project: Layer
    first: tuple[list[np.ndarray], np.ndarray]
    second: tuple[list[np.ndarray], np.ndarray]
    norms: tuple[Layer, Layer]
    classifier: Layer


@dataclass(frozen=True)
class Fusion:
    """What follows the typed convolutions: attention (hidden,) and its bias, the projection of a sample's own vector, the gate
    between the two (2 x hidden, hidden); without semantic and gate the graph's vector stands alone."""

    attention: tuple[np.ndarray, float]
    semantic: Layer | None
    gate: Layer | None


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / np.sqrt(2.0)))


def _norm(x: np.ndarray, layer: Layer) -> np.ndarray:
    centred = x - x.mean(1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(1, keepdims=True) + 1e-5) * layer[0] + layer[1]


_STATES = "sample_id string, node_id string, state array<double>"


def _mapped(d: DataFrame, columns: dict[str, int], made: Callable[..., np.ndarray]) -> DataFrame:
    """sample_id, node_id and state = made(matrix of each column) over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = made(*(_rows(b.column(c), n) for c, n in columns.items()))
            yield pa.record_batch([b.column("sample_id"), b.column("node_id"), _list(state)], names=["sample_id", "node_id", "state"])

    return settled(d.select("sample_id", "node_id", *columns).mapInArrow(run, _STATES))


def _sum(column: str, n: int, of: Callable[[Column], Column] = F.sum) -> Column:
    return F.array(*[of(F.col(column)[k]) for k in range(n)])


def _start(nodes: DataFrame, project: Layer) -> DataFrame:
    wide = len(project[0])
    d = nodes.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("node_id").cast("string").alias("node_id"), F.col("features").cast("array<double>").alias("features"))
    return _mapped(d.where(_whole(F.col("features"), wide)), {"features": wide}, lambda x: _gelu(x @ project[0] + project[1]))


def _ends(edges: DataFrame, states: DataFrame, *more: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    e = edges.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), *more)
    at = lambda side: states.select("sample_id", F.col("node_id").alias(side))
    return settled(e.join(at("src"), ["sample_id", "src"], "left_semi").join(at("dst"), ["sample_id", "dst"], "left_semi"))


def plain_states(nodes: DataFrame, edges: DataFrame, p: Convolutions) -> DataFrame:
    """(sample_id, node_id, state) after two convolutions that weigh a neighbour by both ends' degrees, self-loops included. nodes: sample_id,
    node_id, features; edges: sample_id, src, dst, repeated ones count each time."""
    hidden = p.project[0].shape[1]
    s = _start(nodes, p.project)
    e = _ends(edges, s)
    degree = settled(e.groupBy("sample_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("n")))
    scale = F.array(1 / F.sqrt(F.coalesce("n", F.lit(0)) + F.lit(1.0)))  # a self-loop each
    own = settled(s.select("sample_id", "node_id").join(degree, ["sample_id", "node_id"], "left").select("sample_id", "node_id", scale.alias("scale")))
    for k, (weights, bias) in enumerate((p.first, p.second)):
        d = settled(s.join(own, ["sample_id", "node_id"]))
        sent = e.join(d.select("sample_id", F.col("node_id").alias("src"), F.transform("state", lambda v: v * F.col("scale")[0]).alias("m")), ["sample_id", "src"])
        got = sent.groupBy("sample_id", F.col("dst").alias("node_id")).agg(_sum("m", hidden).alias("got"))
        d = d.join(got, ["sample_id", "node_id"], "left").withColumn("got", F.coalesce("got", F.array(*[F.lit(0.0)] * hidden)))

        def layer(state: np.ndarray, scale: np.ndarray, got: np.ndarray, k: int = k, weights: np.ndarray = weights[0], bias: np.ndarray = bias) -> np.ndarray:
            x = (got + state * scale) * scale @ weights + bias
            return _gelu(_norm(x + state if k else x, p.norms[k]))

        s = _mapped(d, {"state": hidden, "scale": 1, "got": hidden}, layer)
    return s


def _weighed(edges: DataFrame) -> DataFrame:
    """edges with share: one over the number of edges of their type that their end gets."""
    n = edges.groupBy("sample_id", "dst", "edge_type").agg(F.count("*").alias("n"))
    return settled(edges.join(n, ["sample_id", "dst", "edge_type"]).select("sample_id", "src", "dst", "edge_type", (1 / F.col("n")).alias("share")))


def _with_relations(states: DataFrame, edges: DataFrame, weights: list[np.ndarray], hidden: int) -> DataFrame:
    """states with got: for each relation the mean of the neighbours' states times the relation's matrix, added up. edges: of _weighed. A message is
    its share of the mean, so all relations are one sum; a node's own state is a row of the same aggregate and meets no join."""
    sent = edges.join(states.select("sample_id", F.col("node_id").alias("src"), F.col("state").alias("m")), ["sample_id", "src"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, kind, share = _rows(b.column("m"), hidden), b.column("edge_type").to_numpy(), b.column("share").to_numpy()
            out = np.zeros_like(m)
            for r in np.unique(kind):
                out[kind == r] = m[kind == r] @ weights[r]
            yield pa.record_batch([b.column("sample_id"), b.column("node_id"), _list(out * share[:, None])], names=["sample_id", "node_id", "state"])

    got = sent.select("sample_id", F.col("dst").alias("node_id"), "edge_type", "share", "m").mapInArrow(weighed, _STATES)
    return _gathered(states, got, hidden)


def _gathered(states: DataFrame, messages: DataFrame, hidden: int) -> DataFrame:
    """states with got, the sum of a node's messages (sample_id, node_id, state), zeros if there are none. Messages without a node say nothing."""
    at = lambda c, own: [(F.col(c)[k] if own else F.lit(None).cast("double")) for k in range(hidden)]
    names = [*[f"s{k}" for k in range(hidden)], *[f"g{k}" for k in range(hidden)]]
    row = lambda d, own: d.select("sample_id", "node_id", *[c.alias(n) for c, n in zip([*at("state", own), *at("state", not own)], names, strict=True)])
    sums = row(states, True).unionByName(row(messages, False)).groupBy("sample_id", "node_id").agg(*[F.sum(n).alias(n) for n in names])
    zero = F.lit(0.0)
    return sums.where("s0 is not null").select("sample_id", "node_id", F.array(*[f"s{k}" for k in range(hidden)]).alias("state"), F.array(*[F.coalesce(f"g{k}", zero) for k in range(hidden)]).alias("got"))


def typed_states(nodes: DataFrame, edges: DataFrame, p: Convolutions) -> DataFrame:
    """(sample_id, node_id, state) after two convolutions that add, for each relation, the mean of the neighbours times its matrix. edges: also
    edge_type, from 0; types without a matrix say nothing."""
    hidden, relations = p.project[0].shape[1], len(p.first[0]) - 1
    s = _start(nodes, p.project)
    e = _ends(edges, s, F.col("edge_type").cast("int").alias("edge_type")).where(F.col("edge_type").between(0, relations - 1))
    e = _weighed(e)
    for k, (weights, bias) in enumerate((p.first, p.second)):
        d = _with_relations(s, e, weights, hidden)

        def layer(state: np.ndarray, got: np.ndarray, k: int = k, root: np.ndarray = weights[-1], bias: np.ndarray = bias) -> np.ndarray:
            x = got + state @ root + bias
            return _gelu(_norm(x + state if k else x, p.norms[k]))

        s = _mapped(d, {"state": hidden, "got": hidden}, layer)
    return s


def _classified(vectors: DataFrame, layer: Layer) -> DataFrame:
    """(sample_id, risk, probability) of (sample_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _rows(b.column("vector"), len(layer[0])) @ layer[0] + layer[1]
            risk = z[:, 1] - z[:, 0]
            yield pa.record_batch([b.column("sample_id"), pa.array(risk), pa.array(_sigmoid(risk))], names=["sample_id", "risk", "probability"])

    return vectors.mapInArrow(run, "sample_id string, risk double, probability double")


def plain_classifier(nodes: DataFrame, edges: DataFrame, p: Convolutions) -> DataFrame:
    """(sample_id, risk, probability): plain convolutions, then mean and maximum of a graph's states. Graphs are pooled by aggregates with a map-side
    part, so a graph of any size is many tasks' work; graphs without nodes have no row."""
    hidden = p.project[0].shape[1]
    pooled = plain_states(nodes, edges, p).groupBy("sample_id").agg(F.concat(_sum("state", hidden, F.avg), _sum("state", hidden, F.max)).alias("vector"))
    return _classified(pooled, p.classifier)


def fusion_classifier(nodes: DataFrame, edges: DataFrame, samples: DataFrame, p: Convolutions, f: Fusion) -> tuple[DataFrame, DataFrame]:
    """((sample_id, risk, probability), (sample_id, node_id, attention)): typed convolutions, a mean weighed by attention, and a gate between that
    and a vector of the sample itself. samples: sample_id, vector; a sample without one, or without nodes, has no row."""
    hidden = p.project[0].shape[1]
    s = typed_states(nodes, edges, p)
    score = _mapped(s, {"state": hidden}, lambda h: np.concatenate([h, _sigmoid(h @ f.attention[0] + f.attention[1])[:, None]], axis=1))
    weight = F.greatest(F.sum(F.col("state")[hidden]), F.lit(1e-6))
    pooled = score.groupBy("sample_id").agg(F.array(*[F.sum(F.col("state")[k] * F.col("state")[hidden]) / weight for k in range(hidden)]).alias("graph"))
    attention = score.select("sample_id", "node_id", F.col("state")[hidden].alias("attention"))
    if f.semantic is None or f.gate is None:
        return _classified(pooled.withColumnRenamed("graph", "vector"), p.classifier), attention
    wide = len(f.semantic[0])
    own = samples.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("vector").cast("array<double>").alias("own"))
    both = pooled.join(own.where(_whole(F.col("own"), wide)), "sample_id").withColumn("node_id", F.lit(""))

    def fused(graph: np.ndarray, own: np.ndarray) -> np.ndarray:
        semantic = _gelu(own @ f.semantic[0] + f.semantic[1])
        gate = _sigmoid(np.concatenate([graph, semantic], axis=1) @ f.gate[0] + f.gate[1])
        return gate * graph + (1 - gate) * semantic

    return _classified(_mapped(both, {"graph": hidden, "own": wide}, fused).select("sample_id", F.col("state").alias("vector")), p.classifier), attention


@dataclass(frozen=True)
class Block:
    """A typed convolution with a residual and a norm, and a layer of twice the width with another."""

    relations: list[np.ndarray]  # one a relation, the last one for a node itself
    bias: np.ndarray
    norm: Layer
    up: Layer
    down: Layer
    last_norm: Layer


@dataclass(frozen=True)
class Jump:
    """A gated projection, blocks whose states are all read at the end, a readout of three pools, a sample's own vector gated in, and
    heads for the fused, the graph's and the own vector, weighed by the softmax of `heads`."""

    value: Layer
    gate: Layer
    norm: Layer
    blocks: list[Block]
    jump: Layer
    jump_norm: Layer
    attention: tuple[np.ndarray, float]
    readout: Layer
    readout_norm: Layer
    semantic: Layer
    semantic_norm: Layer
    fusion: Layer
    classifiers: tuple[Layer, Layer, Layer]
    heads: np.ndarray


def jump_classifier(nodes: DataFrame, edges: DataFrame, samples: DataFrame, p: Jump) -> tuple[DataFrame, DataFrame]:
    """((sample_id, risk, probability), (sample_id, node_id, attention)), as fusion_classifier, with the model of Jump. edges: sample_id, src, dst,
    edge_type; samples: sample_id, vector."""
    wide, hidden = p.value[0].shape
    d = nodes.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("node_id").cast("string").alias("node_id"), F.col("features").cast("array<double>").alias("features"))
    s = _mapped(d.where(_whole(F.col("features"), wide)), {"features": wide}, lambda x: _norm(_gelu(x @ p.value[0] + p.value[1]) * _sigmoid(x @ p.gate[0] + p.gate[1]), p.norm))
    e = _ends(edges, s, F.col("edge_type").cast("int").alias("edge_type")).where(F.col("edge_type").between(0, len(p.blocks[0].relations) - 2))
    e = _weighed(e)
    passed = []
    for b in p.blocks:

        def block(state: np.ndarray, got: np.ndarray, b: Block = b) -> np.ndarray:
            x = _norm(state + _gelu(got + state @ b.relations[-1] + b.bias), b.norm)
            return _norm(x + _gelu(x @ b.up[0] + b.up[1]) @ b.down[0] + b.down[1], b.last_norm)

        s = _mapped(_with_relations(s, e, b.relations, hidden), {"state": hidden, "got": hidden}, block)
        passed.append(s)
    whole = passed[0]
    for s in passed[1:]:
        whole = whole.join(s.withColumnRenamed("state", "more"), ["sample_id", "node_id"]).select("sample_id", "node_id", F.concat("state", "more").alias("state"))

    def read(states: np.ndarray) -> np.ndarray:
        h = _norm(_gelu(states @ p.jump[0] + p.jump[1]), p.jump_norm)
        return np.concatenate([h, _sigmoid(h @ p.attention[0] + p.attention[1])[:, None]], axis=1)

    score = _mapped(whole, {"state": hidden * len(p.blocks)}, read)
    weight = F.greatest(F.sum(F.col("state")[hidden]), F.lit(1e-6))
    weighed = F.array(*[F.sum(F.col("state")[k] * F.col("state")[hidden]) / weight for k in range(hidden)])
    pooled = score.groupBy("sample_id").agg(F.concat(weighed, _sum("state", hidden, F.avg), _sum("state", hidden, F.max)).alias("graph"))
    own = samples.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("vector").cast("array<double>").alias("own"))
    both = pooled.join(own.where(_whole(F.col("own"), len(p.semantic[0]))), "sample_id").withColumn("node_id", F.lit(""))
    weights = np.exp(p.heads - p.heads.max()) / np.exp(p.heads - p.heads.max()).sum()

    def logits(graph: np.ndarray, own: np.ndarray) -> np.ndarray:
        graph = _norm(_gelu(graph @ p.readout[0] + p.readout[1]), p.readout_norm)
        semantic = _norm(_gelu(own @ p.semantic[0] + p.semantic[1]), p.semantic_norm)
        gate = _sigmoid(np.concatenate([graph, semantic], axis=1) @ p.fusion[0] + p.fusion[1])
        vectors = (gate * graph + (1 - gate) * semantic, graph, semantic)
        return sum(w * (v @ c[0] + c[1]) for w, v, c in zip(weights, vectors, p.classifiers, strict=True))

    z = _mapped(both, {"graph": 3 * hidden, "own": len(p.semantic[0])}, logits).select("sample_id", F.col("state").alias("vector"))
    return _classified(z, (np.eye(2), np.zeros(2))), score.select("sample_id", "node_id", F.col("state")[hidden].alias("attention"))
