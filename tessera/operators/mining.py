"""Motif features and hard-negative mining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.storage import scratch, settled
from .ordering import numbered


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def _millionths(v: Column) -> Column:
    return F.round(v * 1_000_000).cast("long")


def scale_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + mean absolute difference); 0 for empty arrays."""
    gap = F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(1 / (1 + gap / F.size(a)))


def motif_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """sample_id and 23 features. nodes: sample_id, label, name, method_full_name, code, control_type;
    edges: sample_id, label (forward relations)."""
    names = F.array("name", F.coalesce("method_full_name", F.lit("")))
    call = F.when(F.col("label") == "CALL", names).otherwise(F.array().cast("array<string>"))
    short = F.transform(call, lambda n: F.lower(F.element_at(F.split(n, r"\."), -1)))
    flag = lambda words, of: F.max(F.arrays_overlap(of, F.array(*[F.lit(w) for w in words])).cast("double"))
    aggs = [flag(words, short).alias(k) for k, words in fixed.MOTIF_APIS.items()]
    aggs += [flag([f"<operator>.{w}" for w in words], call).alias(k) for k, words in fixed.MOTIF_OPERATORS.items()]
    code = F.lower(F.coalesce("code", F.lit("")))
    errors = sum(((F.length(code) - F.length(F.replace(code, F.lit(t), F.lit("")))) / len(t) for t in fixed.ERROR_RETURNS), F.lit(0.0))
    log = lambda c: F.round(F.log1p(c), 6)
    n = nodes.groupBy("sample_id").agg(
        *aggs,
        log(F.count("*")).alias("num_nodes"),
        log(F.count_if(F.col("label") == "CONTROL_STRUCTURE")).alias("branch_count"),
        log(F.count_if(F.upper("control_type").isin("FOR", "WHILE", "DO"))).alias("loop_count"),
        log(F.count_if(F.col("label") == "RETURN")).alias("return_count"),
        log(F.sum(F.when(F.col("label") == "RETURN", errors).otherwise(0.0))).alias("error_return_count"),
    )
    relations = {"AST": "num_ast_edges", "CFG": "num_cfg_edges", "CDG": "num_cdg_edges", "REACHING_DEF": "num_reaching_def_edges"}
    e = edges.groupBy("sample_id").agg(log(F.count("*")).alias("num_edges"), *[log(F.count_if(F.col("label") == r)).alias(c) for r, c in relations.items()])
    d = n.join(e, "sample_id", "left").na.fill(0.0, ["num_edges", *relations.values()])
    return d.select("sample_id", *fixed.MOTIF_APIS, *fixed.MOTIF_OPERATORS, "num_nodes", "num_edges", *relations.values(), *fixed.SCALE_FEATURES[2:])


def scored_pairs(positives: DataFrame, negatives: DataFrame, min_score: float, blocks: int | None = None) -> DataFrame:
    """positive_id, negative_id, pair_score and its parts for every pair that scores at least min_score.

    Both sides: id, motif, structure, scale (array<double>); negatives also fp (probability, null counts as 0); ids are
    numbers. Parts are whole millionths, so a score is exact and equal ones are equal everywhere. A score is asked for each pair, so the
    work is the product; both sides are cut into blocks of about TILE rows by hash, one task's step is a block against a block, and what
    goes on is the pairs that score enough. A row that lacks a vector or a component has no score. blocks: of each side, by its size if not given."""
    width = lambda d: blocks or max(1, -(-d.count() // TILE))
    vectors = ("motif", "structure", "scale")

    def tiles(d: DataFrame, side: str, *more: Column) -> DataFrame:
        whole = F.col("id").isNotNull()
        for c in vectors:
            whole &= F.col(c).isNotNull() & ~F.exists(c, F.isnull)
        d = d.where(whole).select("id", *[F.col(c).cast("array<double>").alias(c) for c in vectors], *more)
        names = d.columns
        d = d.groupBy(F.pmod(F.xxhash64("id"), F.lit(width(d))).alias(f"{side}_block")).agg(F.collect_list(F.struct(*names)).alias("r"))  # about TILE rows
        return settled(d.select(f"{side}_block", *[F.col(f"r.{c}").alias(f"{side}_{c}") for c in names]))

    p = tiles(positives, "p")
    n = tiles(negatives, "n", _millionths(F.coalesce("fp", F.lit(0.0))).alias("fp"))
    pairs = p.select("p_block").crossJoin(F.broadcast(n.select("n_block")))  # numbers of blocks
    spread = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(spread * 4, "p_block", "n_block").join(p, "p_block").join(n, "n_block").drop("p_block", "n_block")
    d = pairs.mapInArrow(_scored_tiles(round(min_score * 1_000_000)), _SCORED)
    whole = lambda c: F.col(c) / F.lit(1_000_000.0)
    return d.select("positive_id", "negative_id", whole("score").alias("pair_score"), *[whole(k).alias(f"{k}_similarity") for k in vectors], whole("fp").alias("false_positive_probability"))


#: Rows of a block of a side of scored_pairs, and of what is scored at once.
TILE, STRIP = 1024, 64
_SCORED = "positive_id long, negative_id long, score long, motif long, structure long, scale long, fp long"


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole millionths, halves away from zero."""
    x = x * 1_000_000
    down = np.floor(np.abs(x))
    return np.copysign(down + (np.abs(x) - down >= 0.5), x).astype(np.int64)


def added(parts: Iterator[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """A sum from left to right, as the scalar columns add."""
    out = np.zeros(shape)
    for x in parts:
        out += x
    return out


def _scored_tiles(least: int):  # noqa: ANN202
    """Pairs of two blocks that score `least` millionths or more; a strip of positives at a time."""
    hundredths = {k: round(100 * fixed.PAIR_WEIGHTS[w]) for k, w in (("motif", "motif"), ("structure", "structure"), ("scale", "scale"), ("fp", "false_positive"))}

    def matrix(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
        rows = batch.column(name)[k].values
        return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCORED.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                p, n = ({c: matrix(batch, f"{side}_{c}", k) for c in ("motif", "structure", "scale")} for side in "pn")
                p_id, n_id, fp = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("p_id", "n_id", "n_fp"))
                norms = {c: [np.sqrt(added((x[c][:, i] * x[c][:, i] for i in range(x[c].shape[1])), (len(x[c]),))) for x in (p, n)] for c in ("motif", "structure")}
                for at in range(0, len(p_id), STRIP):
                    rows, shape = slice(at, at + STRIP), (len(p_id[at : at + STRIP]), len(n_id))
                    parts = []
                    for c in ("motif", "structure"):
                        dot = added((p[c][rows, i, None] * n[c][None, :, i] for i in range(p[c].shape[1])), shape)
                        norm = norms[c][0][rows, None] * norms[c][1][None]
                        parts.append(rounded(np.divide(dot, norm, out=np.zeros(shape), where=norm != 0)))
                    wide = p["scale"].shape[1]
                    gap = added((np.abs(p["scale"][rows, i, None] - n["scale"][None, :, i]) for i in range(wide)), shape)
                    parts.append(rounded(1 / (1 + gap / wide)) if wide else np.zeros(shape, np.int64))
                    parts.append(np.broadcast_to(fp[None], shape))
                    total = sum(w * x for w, x in zip(hundredths.values(), parts, strict=True)) + 50
                    score = np.where(total < 0, -(-total // 100), total // 100)
                    i, j = np.nonzero(score >= least)
                    if len(i):
                        yield pa.record_batch([pa.array(x) for x in (p_id[rows][i], n_id[j], score[i, j], *(x[i, j] for x in parts))], names=names)

    return run


def _ranked(pairs: DataFrame) -> DataFrame:
    by = Window.partitionBy("positive_id")
    return pairs.withColumn("rank", F.row_number().over(by.orderBy(F.desc("pair_score"), "negative_id")) - 1).withColumn("n", F.count("*").over(by))


def hard_negative_bank(pairs: DataFrame, max_pairs: int, share: tuple[float, float] = fixed.BANK_SLICE) -> DataFrame:
    """Of each positive's ranked negatives, the slice between two shares (at least one), cut to max_pairs."""
    low = F.floor(F.col("n") * F.lit(share[0])).cast("int")
    high = F.greatest(low + 1, F.floor(F.col("n") * F.lit(share[1])).cast("int"))
    return _ranked(pairs).where((F.col("rank") >= low) & (F.col("rank") < F.least(high, low + max_pairs))).drop("n")


def review_queue(pairs: DataFrame, share: float = fixed.REVIEW_SHARE) -> DataFrame:
    """Each positive's best negatives: the top share, at least one."""
    return _ranked(pairs).where(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)).cast("int"))).drop("n")


def _spaced(positives: DataFrame, pool: DataFrame, k: int, seed: int) -> DataFrame:
    """k negatives for each positive without pairing all: the pool in a seeded order is a ring, and a positive takes
    every stride-th place from a seeded start. pool: negative_id, pair_score."""
    key = lambda c: F.sha2(F.concat(F.lit(f"{seed}|"), F.col(c).cast("string")), 256)
    ring = numbered(pool, "place", key("negative_id"), "negative_id")
    size = ring.agg(F.count("*").cast("int").alias("size"))
    p = positives.select(F.col("id").alias("positive_id")).join(F.broadcast(size)).where("size > 0")  # one row
    start = F.pmod(F.conv(F.substring(key("positive_id"), 1, 12), 16, 10).cast("long"), F.col("size"))
    stride = F.greatest(F.lit(1), (F.col("size") / F.lit(k)).cast("int"))
    draws = F.explode(F.expr(f"sequence(0, least({k}, size) - 1)"))
    p = p.withColumn("start", start).withColumn("stride", stride).withColumn("draw", draws)
    p = p.withColumn("place", F.pmod(F.col("start") + F.col("draw") * F.col("stride"), F.col("size")).cast("long"))
    return p.join(ring, "place").select("positive_id", "negative_id", "pair_score", "draw")


def random_bank(positives: DataFrame, negatives: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return _spaced(positives, negatives.select(F.col("id").alias("negative_id"), F.lit(0.0).alias("pair_score")), k, seed)


def false_positive_bank(positives: DataFrame, negatives: DataFrame, k: int, share: float = fixed.FALSE_POSITIVE_SHARE, seed: int = 42) -> DataFrame:
    """Draws from the negatives with the highest false-positive probability: the top share, at least one."""
    n = negatives.select("id", F.coalesce("fp", F.lit(0.0)).alias("fp"))
    ranked = numbered(n, "r", -F.col("fp"), -F.col("id")).join(F.broadcast(n.agg(F.count("*").alias("n"))))  # one row
    pool = ranked.where(F.col("r") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)).cast("int"))).select(F.col("id").alias("negative_id"), F.col("fp").alias("pair_score"))
    return _spaced(positives, pool, k, seed)


def pair_metrics(pairs: DataFrame, scores: DataFrame, positives: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: ranking accuracy, false-positive rate of the distinct matched negatives, mean gap, coverage of positives,
    pairs per covered positive; 0 where empty. scores: id, logit, probability; positives: id."""
    s = lambda side: scores.select(F.col("id").alias(f"{side}_id"), F.col("logit").alias(f"{side}_logit"), F.col("probability").alias(f"{side}_probability"))
    d = pairs.select("positive_id", "negative_id").join(s("positive"), "positive_id").join(s("negative"), "negative_id")
    gap = F.col("positive_logit") - F.col("negative_logit")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    whole = d.agg(zero(F.avg((gap > 0).cast("double"))).alias("ranking_accuracy"), zero(F.avg(gap)).alias("mean_gap"), F.count("*").alias("n_pairs"), F.count_distinct("positive_id").alias("n_covered"))
    negatives = d.select("negative_id", "negative_probability").distinct().agg(zero(F.avg((F.col("negative_probability") >= threshold).cast("double"))).alias("matched_negative_fpr"))
    total = positives.agg(F.count_distinct("id").alias("n_positives"))
    one = whole.join(F.broadcast(negatives)).join(F.broadcast(total))  # one row each
    return one.select("ranking_accuracy", "matched_negative_fpr", "mean_gap", zero(F.try_divide(F.col("n_covered"), F.col("n_positives"))).alias("positive_coverage"), zero(F.try_divide(F.col("n_pairs"), F.col("n_covered"))).alias("pairs_per_positive"))


def weak_baseline(features: DataFrame, columns: list[str], label_col: str = "label", split_col: str = "part"):  # noqa: ANN201
    """Balanced logistic regression on the train part; (model, predictions with sample_id, label, probability, part)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=columns, outputCol="features").transform(features)
    train = d.where(F.col(split_col) == "train")
    n = train.groupBy(label_col).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"))
    train = train.join(F.broadcast(n), label_col).join(F.broadcast(total)).withColumn("weight", F.col("__all") / (2.0 * F.col("__n")))  # one row a label
    model = LogisticRegression(labelCol=label_col, weightCol="weight", maxIter=100, regParam=1e-3, standardization=False).fit(train)
    return model, model.transform(d).select("sample_id", F.col(label_col).alias("label"), F.round(vector_to_array("probability")[1], 6).alias("probability"), F.col(split_col).alias("part"))


def false_positive_snapshot(predictions: DataFrame) -> DataFrame:
    """(sample_id, probability) of the negatives: what a bank is mined from."""
    return predictions.where("label = 0").select("sample_id", "probability")


def pair_audit_sample(bank: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """The first `limit` pairs in a seeded order; a sampling operator."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("positive_id").cast("string"), F.col("negative_id").cast("string")), 256)
    return bank.withColumn("__key", key).orderBy("__key", "positive_id", "negative_id").limit(limit).drop("__key")



def weak_baselines(features: DataFrame, groups: dict[str, list[str]], epochs: int = 30, learning_rate: float = 0.05, label_col: str = "label", split_col: str = "part") -> DataFrame:
    """(feature_group, part, n, positives, roc_auc, train_auc, gap): for each group of features a balanced linear classifier, trained on the
    train part by aggregated gradients, its ranking in each part and how far that is below training. features: sample_id, the label,
    the part and a column for each feature; a row that lacks a feature of a group is left out of it. Both classes must be in the train part."""
    from . import training
    from .metrics import roc_auc

    d = settled(features.select(F.col("sample_id").cast("string").alias("sample_id"), F.col(label_col).cast("int").alias("label"), F.col(split_col).alias("part"), *{c: F.col(c).cast("double").alias(c) for columns in groups.values() for c in columns}.values()))
    out = None
    for name, columns in groups.items():
        rows = d.select("sample_id", "label", "part", F.array(*columns).alias("features")).where(~F.exists("features", F.isnull))
        n = {r.label: r["count"] for r in rows.where("part = 'train'").groupBy("label").count().collect()}  # a row a class
        weight = tuple(sum(n.values()) / (2.0 * n[k]) for k in (0, 1))
        plan = training.Plan((len(columns), 2), epochs=epochs, patience=epochs, learning_rate=learning_rate, clip=float("inf"), class_weight=weight)
        run = training.train(rows.where("part = 'train'"), plan, scratch(d.sparkSession, "baseline"), start=[0.0] * (2 * len(columns) + 2))
        last = training.np.array(run.orderBy(F.desc("epoch")).first().parameters)
        p = settled(training.probabilities(plan, last, rows).join(rows.select("sample_id", "part"), "sample_id"))
        found = p.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives")).join(roc_auc(p, ["part"]), "part")
        train = found.where("part = 'train'").select(F.col("roc_auc").alias("train_auc"))
        found = found.join(F.broadcast(train)).select(F.lit(name).alias("feature_group"), "part", "n", "positives", "roc_auc", "train_auc", F.round(F.col("train_auc") - F.col("roc_auc"), 6).alias("gap"))  # one row
        out = found if out is None else out.unionByName(found)
    return out


def forest_audit(features: DataFrame, columns: list[str], offsets: list[int], trees: int = 50, depth: int = 8, label_col: str = "label", id_col: str = "sample_id") -> DataFrame:
    """(offset, part, n, positives, roc_auc, train_auc, gap): how well a bag of trees ranks, and how much of that is learnt by heart, over
    several splits. offset: a seed of the split (80/10/10 within each label) and of the trees. Rows that lack a feature are left out.
    Trees are grown by pyspark.ml over all rows of the train part."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .metrics import roc_auc
    from .prep import stratified_split

    d = settled(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(features.select(F.col(id_col).cast("string").alias("sample_id"), F.col(label_col).cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns])).select("sample_id", "label", "features"))
    out = None
    for offset in offsets:
        split = settled(stratified_split(d, seed=offset))
        model = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=offset).fit(split.where("part = 'train'"))
        p = settled(model.transform(split).select("part", "label", vector_to_array("probability")[1].alias("probability")))
        found = p.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("positives")).join(roc_auc(p, ["part"]), "part")
        train = found.where("part = 'train'").select(F.col("roc_auc").alias("train_auc"))
        found = found.join(F.broadcast(train)).select(F.lit(offset).alias("offset"), "part", "n", "positives", "roc_auc", "train_auc", F.round(F.col("train_auc") - F.col("roc_auc"), 6).alias("gap"))  # one row
        out = found if out is None else out.unionByName(found)
    return out
