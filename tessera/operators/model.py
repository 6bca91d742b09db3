"""Forward passes and losses as DataFrame algebra, parameters given as tables or literals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gcn_aggregate(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(node, dim, v): sums of neighbours' values over sqrt(degrees), a self-loop for every node. edges: src, dst;
    states: node, dim, v."""
    nodes = states.select("node").distinct()
    loops = edges.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    degree = loops.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))
    d = lambda side: degree.select(F.col("node").alias(side), F.col("degree").alias(f"{side}_degree"))
    weighted = loops.join(d("src"), "src").join(d("dst"), "dst").withColumn("w", 1 / F.sqrt(F.col("src_degree").cast("double") * F.col("dst_degree")))
    return weighted.join(states.select(F.col("node").alias("src"), "dim", "v"), "src").groupBy(F.col("dst").alias("node"), "dim").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("v"))


def relation_mean(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(node, edge_type, dim, v): the mean over incoming neighbours of each relation."""
    return edges.join(states.select(F.col("node").alias("src"), "dim", "v"), "src").groupBy(F.col("dst").alias("node"), "edge_type", "dim").agg(F.round(F.avg("v"), 6).alias("v"))


def linear(states: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, dim, v) = states times weights (in_dim, out_dim, w), as a join on the inner dimension."""
    w = weights.select(F.col("in_dim").alias("dim"), "out_dim", "w")
    return states.join(w, "dim").groupBy("node", F.col("out_dim").alias("dim")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def attention_pool(states: DataFrame, bag: str, score: str, value: str) -> DataFrame:
    """(bag, weighted, mean, max): sigmoid-weighted mean, mean and maximum of a bag's values."""
    w = sigmoid(F.col(score))
    return states.groupBy(bag).agg(F.round(F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(1e-6)), 6).alias("weighted"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("max"))


def bag_softmax(rows: DataFrame, bag: str, score: str) -> DataFrame:
    """rows with weight: softmax of the score within each bag, by aggregates joined back."""
    tops = rows.groupBy(bag).agg(F.max(score).alias("__top"))
    d = rows.join(tops, bag).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    sums = d.groupBy(bag).agg(F.sum("__e").alias("__sum"))
    return d.join(sums, bag).withColumn("weight", F.round(F.col("__e") / F.col("__sum"), 6)).drop("__top", "__e", "__sum")


def topk_logit(rows: DataFrame, bag: str, score: str, mask: str, k: int, temperature: float) -> DataFrame:
    """(bag, risk, candidates): T * logsumexp(s / T) - log(k) over the k best candidates; all rows where no mask is set."""
    some = rows.groupBy(bag).agg(F.max(mask).alias("__some"))
    d = rows.join(some, bag).where(F.col(mask) | ~F.col("__some"))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(bag).orderBy(F.desc(score)))).where(F.col("__r") <= k)
    tops = d.groupBy(bag).agg(F.max(score).alias("__m"), F.count("*").alias("candidates"))
    d = d.join(tops, bag).groupBy(bag, "__m", "candidates").agg(F.sum(F.exp((F.col(score) - F.col("__m")) / temperature)).alias("__s"))
    return d.select(bag, F.round(F.col("__m") + temperature * F.log("__s") - F.log(F.col("candidates").cast("double")), 6).alias("risk"), "candidates")


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def cross_entropy(logit: Column, label: Column) -> Column:
    """Loss of a two-class row by its risk logit (difference of the two)."""
    return softplus(F.when(label == 1, -logit).otherwise(logit))


def weighted_loss(rows: DataFrame, weights: tuple[float, float], gamma: float = 2.0) -> DataFrame:
    """One row: weighted cross-entropy (over the sum of weights) and focal loss (mean)."""
    ce = cross_entropy(F.col("logit"), F.col("label"))
    w = F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    return rows.agg(F.round(F.sum(w * ce) / F.sum(w), 6).alias("cross_entropy"), F.round(F.avg(F.pow(1 - F.exp(-ce), F.lit(gamma)) * w * ce), 6).alias("focal"))


def pair_loss(pairs: DataFrame, margin: float) -> DataFrame:
    """One row: mean softplus(margin - positive + negative) and the mean cross-entropy of the pairs; zeros if none."""
    rank = softplus(F.lit(margin) - F.col("positive_logit") + F.col("negative_logit"))
    replay = (cross_entropy(F.col("positive_logit"), F.lit(1)) + cross_entropy(F.col("negative_logit"), F.lit(0))) / 2
    return pairs.agg(F.round(F.coalesce(F.avg(rank), F.lit(0.0)), 6).alias("rank_loss"), F.round(F.coalesce(F.avg(replay), F.lit(0.0)), 6).alias("replay_loss"))


def rank_weight(epoch: Column, warmup: int, ramp: int, full: float) -> Column:
    """0 during warm-up, then linear up to full."""
    return F.least(F.lit(full), F.greatest(F.lit(0.0), full * (epoch - warmup) / float(max(1, ramp))))


# ---- layers over array columns, parameters as lists


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written into the plan once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def dense(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """weights (a list per output) times x, plus bias."""
    row = lambda x, w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return _let(x, lambda x: F.array(*[row(x, w) + F.lit(float(bias[k] if bias else 0.0)) for k, w in enumerate(weights)]))


def erf(x: Column) -> Column:
    """The error function by a rational approximation, right to 1.5e-7."""
    series = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - _let(1 / (1 + 0.3275911 * F.abs(x)), series) * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return _let(x, lambda x: 0.5 * x * (1 + erf(x / F.lit(2.0**0.5))))


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    """x less its mean, over its standard deviation."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    centred = _let(x, lambda x: _let(mean(x), lambda m: F.transform(x, lambda v: v - m)))
    return _let(centred, lambda c: _let(F.sqrt(mean(F.transform(c, lambda v: v * v)) + epsilon), lambda d: F.transform(c, lambda v: v / d)))


def gated_bottleneck(states: DataFrame, value: tuple, gate: tuple) -> DataFrame:
    """states (node, h) with h = the norm of gelu(value) times sigmoid(gate); value, gate: (weights, bias)."""
    d = states.select("node", dense(F.col("h"), *value).alias("v"), dense(F.col("h"), *gate).alias("g"))
    d = d.select("node", F.zip_with("v", "g", lambda v, g: gelu(v) * sigmoid(g)).alias("h"))
    return d.select("node", layer_norm(F.col("h")).alias("h"))


def relational_conv(states: DataFrame, edges: DataFrame, relations: list[list[list[float]]], root: list[list[float]], bias: list[float]) -> DataFrame:
    """(node, h, conv): the root's part plus, for each relation, its weights times the mean of the incoming neighbours.
    edges: src, dst, edge_type. Means come from a partial aggregate, so a hub is no list."""
    sizes = range(len(root))
    near = edges.join(states.select(F.col("node").alias("src"), "h"), "src").groupBy(F.col("dst").alias("node"), "edge_type").agg(F.array(*[F.avg(F.col("h")[k]) for k in range(len(root[0]))]).alias("m"))
    part = None
    for k, w in enumerate(relations):
        part = F.when(F.col("edge_type") == k, dense(F.col("m"), w)) if part is None else part.when(F.col("edge_type") == k, dense(F.col("m"), w))
    summed = near.select("node", part.alias("p")).groupBy("node").agg(F.array(*[F.sum(F.col("p")[k]) for k in sizes]).alias("p"))
    d = states.join(summed, "node", "left").withColumn("own", dense(F.col("h"), root, bias))
    return d.select("node", "h", F.when(F.col("p").isNull(), F.col("own")).otherwise(F.zip_with("own", "p", lambda a, b: a + b)).alias("conv"))


def _feed_forward(d: DataFrame, inner: tuple, outer: tuple) -> DataFrame:
    d = d.withColumn("f", F.transform(dense(F.col("h"), *inner), gelu))
    d = d.withColumn("f", dense(F.col("f"), *outer))
    return d.withColumn("h", F.zip_with("h", "f", lambda a, b: a + b)).withColumn("h", layer_norm(F.col("h"))).drop("f")


def residual_block(states: DataFrame, edges: DataFrame, relations: list, root: list, bias: list, inner: tuple, outer: tuple) -> DataFrame:
    """(node, h): the norm of h + gelu(conv), then the norm of that and its feed-forward part."""
    d = relational_conv(states, edges, relations, root, bias)
    d = d.select("node", F.zip_with("h", "conv", lambda a, b: a + gelu(b)).alias("h")).withColumn("h", layer_norm(F.col("h")))
    return _feed_forward(d, inner, outer)


def gated_residual_block(states: DataFrame, edges: DataFrame, relations: list, root: list, bias: list, gate: tuple, candidate: tuple, inner: tuple, outer: tuple) -> DataFrame:
    """(node, h, gate): as residual_block, but the message's candidate is let through by a gate on state and message."""
    d = relational_conv(states, edges, relations, root, bias).withColumn("m", F.transform("conv", gelu))
    d = d.withColumn("gate", F.transform(dense(F.concat("h", "m"), *gate), sigmoid)).withColumn("c", F.transform(dense(F.col("m"), *candidate), gelu))
    d = d.select("node", "gate", F.zip_with("h", F.zip_with("gate", "c", lambda a, b: a * b), lambda a, b: a + b).alias("h"))
    return _feed_forward(d.withColumn("h", layer_norm(F.col("h"))), inner, outer).select("node", "h", "gate")


def gate_stats(blocks: DataFrame) -> DataFrame:
    """One row: mean and spread of all gates."""
    return blocks.select(F.explode("gate").alias("g")).agg(F.round(F.avg("g"), 6).alias("gate_mean"), F.round(F.stddev_pop("g"), 6).alias("gate_std"))


def fused(graph: Column, semantic: Column, gate: tuple) -> Column:
    """gate * graph + (1 - gate) * semantic, with the gate from both."""
    g = F.transform(dense(F.concat(graph, semantic), *gate), sigmoid)
    return F.zip_with(F.zip_with(g, graph, lambda a, b: a * b), F.zip_with(g, semantic, lambda a, b: (1 - a) * b), lambda a, b: a + b)


def mixed_heads(heads: list[Column], weights: list[float]) -> Column:
    """Logits (arrays) of several heads under the softmax of their weights."""
    top = max(weights)
    e = [F.exp(F.lit(float(w - top))) for w in weights]
    share = [x / sum(e[1:], e[0]) for x in e]
    scaled = lambda h, s: F.transform(h, lambda v: v * s)
    parts = [scaled(h, s) for h, s in zip(heads, share, strict=True)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def slice_logits(rows: DataFrame, bag: str, score: str, k: int, temperature: float, slice_mask: str | None = None, seed_mask: str | None = None) -> DataFrame:
    """(bag, low, high, candidates): logits -risk / 2 and risk / 2 from the k best candidates. Candidates are what the slice
    mask has in a bag, or the seed mask where there is no slice mask; all of the bag if it has none there."""
    mask = slice_mask or seed_mask
    d = rows.withColumn("__mask", F.coalesce(F.col(mask), F.lit(False)) if mask else F.lit(True))
    r = topk_logit(d, bag, score, "__mask", k, temperature)
    return r.select(bag, (0.0 - F.col("risk") / 2).alias("low"), (F.col("risk") / 2).alias("high"), "candidates")


def bag_attention(rows: DataFrame, bag: str, score: str, value: str) -> DataFrame:
    """(bag, weighted, top, entropy): softmax-weighted sum and maximum of a value over each bag, and the weights' entropy."""
    tops = rows.groupBy(bag).agg(F.max(score).alias("__top"))
    d = rows.join(tops, bag).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    sums = d.groupBy(bag).agg(F.sum("__e").alias("__sum"))
    d = d.join(sums, bag).withColumn("__w", F.col("__e") / F.col("__sum"))
    return d.groupBy(bag).agg(F.round(F.sum(F.col("__w") * F.col(value)), 6).alias("weighted"), F.round(F.max(value), 6).alias("top"), F.round(-F.sum(F.col("__w") * F.log(F.greatest(F.col("__w"), F.lit(1e-8)))), 6).alias("entropy"))


def composite_loss(rows: DataFrame, pairs: DataFrame, margin: float, replay: float, rank: float, auxiliary: float = 0.0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """One row: main, auxiliary, replay, rank and total loss. rows: logit, label, branches (array of logits, may be empty);
    pairs: positive_logit, negative_logit and evidence logits of both, null where the pair's own decide the ranking."""
    w = F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    mean = lambda c: F.sum(w * c) / F.sum(w)
    branch = F.aggregate(F.transform("branches", lambda z: cross_entropy(z, F.col("label"))), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("branches"), F.lit(1))
    a = rows.agg(mean(cross_entropy(F.col("logit"), F.col("label"))).alias("main"), mean(branch).alias("auxiliary"))
    ranked = softplus(F.lit(margin) - F.coalesce("positive_evidence", "positive_logit") + F.coalesce("negative_evidence", "negative_logit"))
    again = (cross_entropy(F.col("positive_logit"), F.lit(1)) + cross_entropy(F.col("negative_logit"), F.lit(0))) / 2
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    b = pairs.agg(zero(F.avg(again)).alias("replay"), zero(F.avg(ranked)).alias("rank"))
    total = F.col("main") + auxiliary * F.col("auxiliary") + replay * F.col("replay") + rank * F.col("rank")
    return a.join(F.broadcast(b)).select(*[F.round(c, 6).alias(c) for c in ("main", "auxiliary", "replay", "rank")], F.round(total, 6).alias("total"))  # one row each
