"""Queries of splits, metrics, thresholds, ensembles and mining, each with the SQL that gives the same rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import ensembles, metrics, mining, mining_blocks, prep, sweeps, training
from ..sources.storage import scratch, settled
from .bindings import PREDICTIONS_SQL, predictions, retrieval, samples, table

KEYS = ["part", "model"]

NORMALIZED = "regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\r\\n]*', '', 'g'), '\\s+', '', 'g')"
SAMPLES_SQL = f"samples as (select doc_id::varchar as sample_id, quality as label, sha256({NORMALIZED}) as source_hash from documents join labels using (doc_id))"
SIZES_SQL = """least(n, round_even(n * 0.8::double, 0)::int) as train_n, greatest(0, least(n - least(n, round_even(n * 0.8::double, 0)::int), round_even(n * 0.1::double, 0)::int)) as val_n"""
CURVE_SQL = """byp as (select part, model, probability as threshold, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg from predictions group by all),
 curve as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by part, model) - sum(pos) over w as fn, sum(neg) over (partition by part, model) - sum(neg) over w as tn
 from byp window w as (partition by part, model order by threshold desc rows between unbounded preceding and current row))"""


def rates_sql(digits: int = 6) -> str:
    q = lambda a, b: f"(case when ({b}) = 0 then 0.0 else ({a})::double / ({b})::double end)"
    root = "sqrt((tp + fp)::double * (tp + fn)::double * (tn + fp)::double * (tn + fn)::double)"
    parts = {
        "accuracy": q("tp + tn", "tp + fp + fn + tn"),
        "precision": q("tp", "tp + fp"),
        "recall": q("tp", "tp + fn"),
        "specificity": q("tn", "tn + fp"),
        "f1": q("2 * tp", "2 * tp + fp + fn"),
        "balanced_accuracy": f"({q('tp', 'tp + fn')} + {q('tn', 'tn + fp')}) / 2",
        "mcc": f"(case when {root} = 0 then 0.0 else (tp::double * tn::double - fp::double * fn::double) / {root} end)",
        "positive_rate": q("tp + fp", "tp + fp + fn + tn"),
    }
    return ", ".join(f"round({v}, {digits}) as {k}" for k, v in parts.items())


def source_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(T.source_hash(F.col("text")).alias("source_hash"))
    return d.groupBy("source_hash").agg(F.count("*").alias("n"))


def strict_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prep.grouped_split(samples(spark, sf_dir), mixed="least")
    return s.groupBy("part", "label").agg(F.count("*").alias("n_rows"), F.count_distinct("source_hash").alias("n_groups"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.stratified_split(samples(spark, sf_dir).select("sample_id", "label"))


def leaking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.leaking_groups(prep.stratified_split(samples(spark, sf_dir)))


def exclusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "doc_id", "lang")
    known = docs.where(F.col("lang") == "fr").select("sample_id", F.lit("known_bad").alias("reason"))
    graphs = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    sources = table(spark, sf_dir, "documents").where("n_chars >= 500").select(F.col("doc_id").cast("string").alias("sample_id"))
    return prep.exclusion_cascade(docs.select("sample_id"), known, graphs, sources, ["1", "2", "3"])


def evenly_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return prep.evenly_sampled(o, 5, ["o_custkey"], ["o_orderkey"])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(metrics.confusion(predictions(spark, sf_dir), F.lit(0.5), KEYS))


def best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(predictions(spark, sf_dir), KEYS, "f1")


def best_mcc_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(predictions(spark, sf_dir), KEYS, "mcc")


def metrics_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    val = p.where("part = 'val'")
    t = [metrics.best_threshold(val, ["model"], m).select("model", F.lit(f"val_{m}").alias("threshold_key"), "threshold") for m in ("f1", "mcc")]
    fixed = val.select("model").distinct().select("model", F.lit("fixed_0_5").alias("threshold_key"), F.lit(0.5).alias("threshold"))
    return metrics.at_thresholds(p.where("part = 'test'"), fixed.unionByName(t[0]).unionByName(t[1]), ["model"])


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(predictions(spark, sf_dir), KEYS)


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(predictions(spark, sf_dir), KEYS)


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(predictions(spark, sf_dir), KEYS)


def guarded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.guarded_scan(predictions(spark, sf_dir), KEYS, "f1", recall_max=0.9, positive_rate_max=0.8)


def prediction_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return metrics.prediction_shift(p.where("model = 0"), p.where("model = 1"))


def simplex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ensembles.simplex_grid(spark, 4, 10)
    return g.select("weight_id", *[F.round(F.col("weights")[k], 6).alias(f"w{k}") for k in range(4)])


def _aligned(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    p = predictions(spark, sf_dir).where(F.col("part") == part)
    return ensembles.aligned([p.where(F.col("model") == k).select("sample_id", "label", "probability") for k in range(4)])


def ensemble_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensembles.scan_grid(_aligned(spark, sf_dir, "val"), ensembles.simplex_grid(spark, 4, 5)).select("weight_id", "samples", "tp", "fp", "fn", "tn", "f1", "mcc")


def fixed05_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = ensembles.scan_grid(_aligned(spark, sf_dir, "val"), ensembles.subset_grid(spark, 4, 5, 3))
    return ensembles.best_points(scan, 20, recall_max=0.95, positive_rate_max=0.9).select("weight_id", "tp", "fp", "fn", "tn", "f1", "mcc")


STRATEGIES = [
    sweeps.Strategy("free_f1"),
    sweeps.Strategy("guarded_f1", recall_max=0.9, positive_rate_max=0.75),
    sweeps.Strategy("tight_f1", recall_max=0.8, positive_rate_max=0.65),
    sweeps.Strategy("free_mcc", "mcc"),
    sweeps.Strategy("guarded_mcc", "mcc", recall_max=0.85, positive_rate_max=0.7),
    sweeps.Strategy("precise_balance", "balanced_accuracy", min_precision=0.55),
    sweeps.Strategy("impossible", min_precision=1.01),
]


def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best weights and threshold of four models for each strategy, on validation."""
    return sweeps.sweep(_aligned(spark, sf_dir, "val"), ensembles.simplex_grid(spark, 4, 10), STRATEGIES)


def fixed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default strategies at the fixed threshold: weights that validation selects, and rates and rankings on validation and test."""
    grid, val, test = ensembles.simplex_grid(spark, 4, 10), _aligned(spark, sf_dir, "val"), _aligned(spark, sf_dir, "test")
    chosen = settled(sweeps.selected(ensembles.scan_grid(val, grid), [*sweeps.strategies(True), sweeps.Strategy("balance", "balanced_accuracy", positive_rate_max=0.6)]))
    named = lambda d, part: d.select("strategy", F.col("roc_auc").alias(f"{part}_roc_auc"), F.col("average_precision").alias(f"{part}_pr_auc"))
    out = chosen.select("strategy", "weight_id", F.col("f1").alias("val_f1"), F.col("mcc").alias("val_mcc"))
    out = out.join(named(sweeps.ranked(val, chosen, grid), "val"), "strategy").join(named(sweeps.ranked(test, chosen, grid), "test"), "strategy")
    return out.join(sweeps.frozen(test, chosen, grid).select("strategy", F.col("f1").alias("test_f1"), F.col("mcc").alias("test_mcc")), "strategy")


def frozen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the points that validation chose give on test, next to their rates on validation."""
    grid = ensembles.simplex_grid(spark, 4, 10)
    chosen = sweeps.sweep(_aligned(spark, sf_dir, "val"), grid, STRATEGIES)
    test = sweeps.frozen(_aligned(spark, sf_dir, "test"), chosen, grid).select("strategy", "samples", "tp", "fp", "fn", "tn", *[F.col(c).alias(f"test_{c}") for c in ("f1", "mcc", "precision", "recall")])
    return chosen.select("strategy", "weight_id", "threshold", F.col("f1").alias("val_f1"), F.col("mcc").alias("val_mcc")).join(test, "strategy")


def hard_negative_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, _ = mining_blocks.mined_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 0.25, 3)  # counts first, so only slices become rows
    return bank.select("positive_id", "negative_id", "rank", "pair_score")


_BRANDS, _NAMES, _TYPES = 25, ("ring", "widget", "bolt", "gear"), ("ECONOMY", "SMALL", "STANDARD", "PROMO", "LARGE")


def _part_vectors(spark: SparkSession, sf_dir: str, positive: bool) -> DataFrame:
    """Parts as vectors of flags (words of the name, type, groups of brands), counts (orders, items, returns, suppliers) and sizes; small parts are positive."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.count_distinct("l_suppkey").alias("suppliers"))
    d = table(spark, sf_dir, "part").join(li, "p_partkey")
    brand = F.substring("p_brand", 7, 2).cast("int")
    flags = [F.contains("p_name", F.lit(w)) for w in _NAMES] + [F.col("p_type") == t for t in _TYPES] + [brand % 4 == k for k in range(4)]
    d = d.where((F.col("p_size") <= 5) == F.lit(positive))
    vector = lambda *c: F.array(*[x.cast("double") for x in c])
    return d.select(F.col("p_partkey").alias("id"), vector(*flags).alias("motif"), vector(*[F.col(c) for c in ("orders", "items", "returns", "suppliers")]).alias("structure"), vector(F.floor(F.col("p_retailprice") / 50), F.col("p_size") % 7).alias("scale"), (F.col("p_partkey") % 20 / 20.0).alias("fp"))


def mined_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of small parts, by blocks."""
    bank, _ = mining_blocks.mined_bank(_part_vectors(spark, sf_dir, True), _part_vectors(spark, sf_dir, False), 0.4, 3)
    return bank


TRAINING = training.Plan((4, 2), epochs=4, learning_rate=0.05, weight_decay=0.01, clip=0.25, class_weight=(1.0, 1.65), lambda_replay=0.25, lambda_rank=0.2, margin=0.35, rank_warmup=1, rank_ramp=2)
_START = [(i * 7 % 5 - 2) / 10 for i in range(10)]


def _vectors(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    of = F.when(F.col("vec_id") % 10 == 8, "val").when(F.col("vec_id") % 10 == 9, "test").otherwise("train")
    return e.where(of == part).select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.slice("embedding", 1, 4).cast("array<double>").alias("features"))


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mining.random_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 3)
    return training.train(_vectors(spark, sf_dir, "train"), TRAINING, scratch(spark, "run"), pairs, start=_START)


def trained_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and parameters of a linear classifier after each epoch."""
    values = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("loss", "main_loss", "replay_loss", "ranking_loss")] + [F.struct(F.lit(f"p{i}").alias("name"), F.col("parameters")[i].alias("value")) for i in range(len(_START))]
    return _trained(spark, sf_dir).select("epoch", F.explode(F.array(*values)).alias("x")).select("epoch", "x.name", F.round("x.value", 6).alias("value"))


def trained_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rates of the best epoch's classifier at the thresholds of validation."""
    d = training.evaluated(TRAINING, _trained(spark, sf_dir), _vectors(spark, sf_dir, "val"), _vectors(spark, sf_dir, "test"))
    return d.select("threshold_key", F.round("threshold", 6).alias("threshold"), "samples", "tp", "fp", "fn", "tn", "f1", "mcc")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, _ = mining_blocks.mined_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 0.25, 1 << 40, (0.0, fixed.REVIEW_SHARE))
    return queue.select("positive_id", "negative_id", "rank", "pair_score")


def random_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.random_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 3)


def fp_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.false_positive_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 2)


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives, negatives = retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0)
    scores = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(4 * F.col("embedding")[0].cast("double"), 6).alias("logit"), F.round((1 + F.col("embedding")[1].cast("double")) / 2, 6).alias("probability"))
    return mining.pair_metrics(mining.random_bank(positives, negatives, 3), scores, positives)


_GROUPS = {"motif": range(13), "structure": range(13, 17), "scale": range(17, 23), "all": range(23)}
_EPOCHS = 6


def weak_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of a balanced linear classifier for each feature group, in each part, and its distance to training."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.when(F.col("vec_id") % 10 == 8, "val").when(F.col("vec_id") % 10 == 9, "test").otherwise("train").alias("part"), *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(23)])
    return mining.weak_baselines(e, {g: [f"f{k}" for k in ks] for g, ks in _GROUPS.items()}, epochs=_EPOCHS)


def forest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over the vectors of parts that mined_bank uses, on two splits."""
    d = _part_vectors(spark, sf_dir, True).withColumn("label", F.lit(1)).unionByName(_part_vectors(spark, sf_dir, False).withColumn("label", F.lit(0)))
    names = {f"{g}{k}": F.col(g)[k] for g, n in (("motif", 13), ("structure", 4), ("scale", 2)) for k in range(n)}
    return mining.forest_audit(d.select(F.col("id").alias("sample_id"), "label", *[c.alias(n) for n, c in names.items()]), list(names), [1, 2], trees=10, depth=5)


QUERIES = [source_hash_groups, strict_split_summary, stratified_split, leaking_groups, exclusion_cascade, evenly_sampled, confusion, best_f1_threshold, best_mcc_threshold, metrics_at_thresholds, roc_auc, average_precision, roc_points, guarded_scan, prediction_shift, simplex_grid, ensemble_scan, fixed05_combos, weight_sweep, fixed_selection, frozen_points, hard_negative_bank, mined_bank, trained_epochs, trained_evaluation, review_queue, random_bank, fp_bank, pair_metrics, weak_baselines, forest_audit]

_SPLIT = f"""split as (select *, case when r <= train_n then 'train' when r <= train_n + val_n then 'val' else 'test' end as part from (select *, {SIZES_SQL} from (
 select *, count(*) over (partition by label) as n, row_number() over (partition by label order by sha256('42' || label::varchar || sample_id), sample_id) as r from samples)))"""
_BEST = lambda m: f"with {PREDICTIONS_SQL}, {CURVE_SQL}, scored as (select *, {rates_sql(9)} from curve) select part, model, threshold, round({m}, 6) as {m} from (select *, row_number() over (partition by part, model order by {m} desc, threshold desc) as r from scored) where r = 1"
_PAIRS = """pos as (select * from embeddings where label >= 5), neg as (select * from embeddings where label < 5),
 dots as (select p.vec_id as positive_id, n.vec_id as negative_id,
 list_sum(list_transform(range(1, 14), lambda i: p.embedding[i]::double * n.embedding[i]::double)) as md, list_sum(list_transform(range(1, 14), lambda i: p.embedding[i]::double ** 2)) as ma, list_sum(list_transform(range(1, 14), lambda i: n.embedding[i]::double ** 2)) as mb,
 list_sum(list_transform(range(14, 18), lambda i: p.embedding[i]::double * n.embedding[i]::double)) as sd, list_sum(list_transform(range(14, 18), lambda i: p.embedding[i]::double ** 2)) as sa, list_sum(list_transform(range(14, 18), lambda i: n.embedding[i]::double ** 2)) as sb,
 list_sum(list_transform(range(18, 24), lambda i: abs(p.embedding[i]::double - n.embedding[i]::double))) / 6 as gap, round((1 + n.embedding[64]::double) / 2, 6) as fp from pos p, neg n),
 pairs as (select * from (select positive_id, negative_id, ((40 * round(1000000 * md / (sqrt(ma) * sqrt(mb)))::bigint + 30 * round(1000000 * sd / (sqrt(sa) * sqrt(sb)))::bigint + 15 * round(1000000 / (1 + gap))::bigint + 15 * round(1000000 * fp)::bigint + 50) // 100) / 1000000.0::double as pair_score from dots) where pair_score >= 0.25),
 ranked as (select *, row_number() over (partition by positive_id order by pair_score desc, negative_id) - 1 as rank, count(*) over (partition by positive_id) as n from pairs)"""
_RING = lambda k, pool: f"""pos as (select vec_id as id from embeddings where label >= 5), {pool},
 ring as (select *, row_number() over (order by sha256('42|' || negative_id::varchar), negative_id) - 1 as place from pool), sized as (select count(*) as size from ring),
 draws as (select id as positive_id, draw, ((('0x' || substr(sha256('42|' || id::varchar), 1, 12))::bigint % size) + draw * greatest(1, size // {k})) % size as place from pos, sized, (select unnest(range({k})) as draw) where draw < size),
 bank as (select positive_id, negative_id, pair_score, draw::int as draw from draws join ring using (place))"""  # noqa: E731
_RANDOM = _RING(3, "pool as (select vec_id as negative_id, 0.0::double as pair_score from embeddings where label < 5)")
_FP = _RING(2, "neg as (select vec_id as id, round((1 + embedding[64]::double) / 2, 6) as fp from embeddings where label < 5), pool as (select id as negative_id, fp as pair_score from (select *, row_number() over (order by fp desc, id desc) as r, count(*) over () as n from neg) where r <= greatest(1, floor(n * 0.1::double)))")
_GRID = lambda s: f"grid as (select lpad(a::varchar, 4, '0') || lpad(b::varchar, 4, '0') || lpad(c::varchar, 4, '0') || lpad(({s} - a - b - c)::varchar, 4, '0') as weight_id, [a / {s}.0::double, b / {s}.0::double, c / {s}.0::double, ({s} - a - b - c) / {s}.0::double] as w from (select unnest(range({s + 1})) as a), (select unnest(range({s + 1})) as b), (select unnest(range({s + 1})) as c) where a + b + c <= {s})"
_WIDE = "wide as (select sample_id, any_value(label) as label, list(probability order by model) as p from predictions where part = 'val' group by sample_id)"
_COUNTS = "count(*) as samples, count(*) filter (q >= 0.5 and label = 1) as tp, count(*) filter (q >= 0.5 and label <> 1) as fp, count(*) filter (q < 0.5 and label = 1) as fn, count(*) filter (q < 0.5 and label <> 1) as tn"

def _subset_rows(models: int, steps: int, largest: int) -> str:
    """(weight_id, weights) of all subsets of up to `largest` models with positive weights, as SQL values."""
    rows = []
    for n in range(1, largest + 1):
        for members in combinations(range(models), n):
            for cuts in combinations(range(1, steps), n - 1):
                parts = [b - a for a, b in zip((0, *cuts), (*cuts, steps), strict=True)]
                weights = [parts[members.index(m)] / steps if m in members else 0 for m in range(models)]
                rows.append(f"('{'+'.join(map(str, members))}:{''.join(f'{p:04d}' for p in parts)}', {weights}::double[])")
    return "(values " + ", ".join(rows) + ") as grid(weight_id, w)"


def _guard(s: sweeps.Strategy) -> str:
    parts = [f"recall <= {s.recall_max}"] * (s.recall_max is not None) + [f"positive_rate <= {s.positive_rate_max}"] * (s.positive_rate_max is not None) + [f"precision >= {s.min_precision}"] * (s.min_precision is not None)
    return " and ".join(parts) or "true"


_SWEEP = f"""{PREDICTIONS_SQL}, {_GRID(10)}, {_WIDE}, mixed as materialized (select weight_id, label, round(p[1] * w[1] + p[2] * w[2] + p[3] * w[3] + p[4] * w[4], 9) as q from wide, grid),
 candidates as (select distinct weight_id, q as threshold from mixed union select weight_id, unnest([0.0::double, 0.5, 1.0]) from grid),
 c as (select weight_id, threshold, count(*) filter (q >= threshold and label = 1) as tp, count(*) filter (q >= threshold and label <> 1) as fp, count(*) filter (q < threshold and label = 1) as fn, count(*) filter (q < threshold and label <> 1) as tn from candidates join mixed using (weight_id) group by 1, 2),
 scored as materialized (select *, {rates_sql(9)} from c), chosen as (
 {" union all ".join(f"(select '{s.name}' as strategy, * from (select *, row_number() over (partition by weight_id order by {s.objective} desc, {', '.join(t + ' desc' for t in sweeps.TIES[s.objective])}, threshold desc) as r from scored where {_guard(s)}) where r = 1 order by {s.objective} desc, mcc desc, precision desc, threshold desc, weight_id limit 1)" for s in STRATEGIES)})"""

def _training_sql() -> str:
    """Each epoch of TRAINING written out: risks, gradients by feature, one step of the optimiser (both logits' weights move oppositely but for decay)."""
    t, (b1, b2) = TRAINING, training.BETAS
    sig = lambda x: f"(1 / (1 + exp(-({x}))))"
    plus = lambda x: f"ln(1 + exp({x}))"
    start = ", ".join(f"({j}, {_START[2 * j]}::double, {_START[2 * j + 1]}::double, 0.0::double, 0.0::double)" for j in range(5))
    parts = [f"""x as materialized (select vec_id, (label >= 5)::int as y, case when label >= 5 then {t.class_weight[1]}::double else {t.class_weight[0]}::double end as cw, j, case when j = 4 then 1.0::double else embedding[j + 1]::double end as v from embeddings, (select unnest(range(5)) as j) where vec_id % 10 < 8),
 w0(j, a, b, m, s) as (values {start})"""]
    for e in range(t.epochs):
        rank = training.rank_weight(t, e)
        hat = lambda c, beta: f"({c} / (1 - {beta}::double ** {e + 1}))"  # noqa: B023, E731
        move = f"{t.learning_rate}::double * {hat('m1', b1)} / (sqrt({hat('s1', b2)}) + {training.EPSILON}::double)"
        parts.append(f"""r{e} as materialized (select vec_id, any_value(y) as y, any_value(cw) as cw, sum(v * (b - a)) as risk from x join w{e} using (j) group by 1),
 q{e} as materialized (select positive_id, negative_id, p.risk as rp, n.risk as rn from bank join r{e} p on p.vec_id = positive_id join r{e} n on n.vec_id = negative_id),
 gm{e} as (select j, sum(x.cw * ({sig('risk')} - x.y) * v) / sum(x.cw) as g from x join r{e} using (vec_id) group by 1),
 gp{e} as (select p.j, avg({t.lambda_replay}::double * 0.5::double * (({sig('rp')} - 1) * p.v + {sig('rn')} * n.v) - {rank}::double * {sig(f'{t.margin}::double - rp + rn')} * (p.v - n.v)) as g from q{e} join x p on p.vec_id = positive_id join x n on n.vec_id = negative_id and n.j = p.j group by 1),
 g{e} as materialized (select j, (gm{e}.g + gp{e}.g) * least(1.0::double, {t.clip}::double / (sqrt(2 * sum((gm{e}.g + gp{e}.g) ** 2) over ()) + 0.000001::double)) as g from gm{e} join gp{e} using (j)),
 w{e + 1} as materialized (select j, a * {1 - t.learning_rate * t.weight_decay}::double + {move} as a, b * {1 - t.learning_rate * t.weight_decay}::double - {move} as b, m1 as m, s1 as s from (select j, a, b, {b1}::double * m + {1 - b1}::double * g as m1, {b2}::double * s + {1 - b2}::double * g * g as s1 from w{e} join g{e} using (j))),
 l{e} as (select (select sum(cw * {plus('case y when 1 then -risk else risk end')}) / sum(cw) from r{e}) as main, (select avg(0.5::double * ({plus('-rp')} + {plus('rn')})) from q{e}) as replay, (select avg({plus(f'{t.margin}::double - rp + rn')}) from q{e}) as ranking),
 o{e} as (select {e + 1} as epoch, 'loss' as name, main + {t.lambda_replay}::double * replay + {rank}::double * ranking as value from l{e} union all select {e + 1}, 'main_loss', main from l{e} union all select {e + 1}, 'replay_loss', replay from l{e} union all select {e + 1}, 'ranking_loss', ranking from l{e}
 union all select {e + 1}, 'p' || (2 * j), a from w{e + 1} union all select {e + 1}, 'p' || (2 * j + 1), b from w{e + 1})""")
    return f"{_RANDOM}, " + ",\n ".join(parts)


def _baseline_sql(group: str) -> str:
    """One group's classifier written out, epoch by epoch, and its ROC AUC by part."""
    ks, t, (b1, b2) = list(_GROUPS[group]), training.Plan((1, 2), learning_rate=0.05), training.BETAS
    g, d = group, len(ks)
    sig = "(1 / (1 + exp(-risk)))"
    parts = [f"{g}_x as materialized (select vec_id, y, cw, part, j, case when j = {d} then 1.0::double else embedding[{ks[0] + 1} + j]::double end as v from e, (select unnest(range({d + 1})) as j))", f"{g}_w0 as (select unnest(range({d + 1})) as j, 0.0::double as a, 0.0::double as b, 0.0::double as m, 0.0::double as s)"]
    for e in range(_EPOCHS):
        move = f"{t.learning_rate}::double * (m1 / (1 - {b1}::double ** {e + 1})) / (sqrt(s1 / (1 - {b2}::double ** {e + 1})) + {training.EPSILON}::double)"
        keep = f"{1 - t.learning_rate * t.weight_decay}::double"
        parts.append(f"""{g}_r{e} as materialized (select vec_id, sum(v * (b - a)) as risk from {g}_x join {g}_w{e} using (j) where part = 'train' group by 1), {g}_g{e} as (select j, sum(cw * ({sig} - y) * v) / sum(cw) as g from {g}_x join {g}_r{e} using (vec_id) group by 1),
 {g}_w{e + 1} as materialized (select j, a * {keep} + {move} as a, b * {keep} - {move} as b, m1 as m, s1 as s from (select j, a, b, {b1}::double * m + {1 - b1}::double * g as m1, {b2}::double * s + {1 - b2}::double * g * g as s1 from {g}_w{e} join {g}_g{e} using (j)))""")
    parts.append(f"""{g}_p as (select vec_id, any_value(part) as part, any_value(y) as y, sum(v * (b - a)) as risk from {g}_x join {g}_w{_EPOCHS} using (j) group by 1),
 {g}_a as (select '{g}' as feature_group, part, count(*) as n, sum(y)::bigint as positives, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as roc_auc from (select part, y, rank() over (partition by part order by risk) + (count(*) over (partition by part, risk) - 1) / 2.0 as r from {g}_p) group by 2)""")
    return ",\n ".join(parts)


_BASELINES = """with e0 as (select vec_id, (label >= 5)::int as y, case when vec_id % 10 = 8 then 'val' when vec_id % 10 = 9 then 'test' else 'train' end as part, embedding from embeddings),
 c as (select y, sum(count(*)) over () / (2.0::double * count(*)) as cw from e0 where part = 'train' group by y), e as (select * from e0 join c using (y)),
 """ + ",\n ".join(map(_baseline_sql, _GROUPS)) + ", whole as (" + " union all ".join(f"select * from {g}_a" for g in _GROUPS) + """)
 select w.feature_group, w.part, w.n, w.positives, w.roc_auc, t.roc_auc as train_auc, round(t.roc_auc - w.roc_auc, 6) as gap from whole w join whole t on t.feature_group = w.feature_group and t.part = 'train'"""

_TEST_RATES = f"""losses as (select epoch, value from ({" union all ".join(f"select * from o{e}" for e in range(TRAINING.epochs))}) where name = 'loss'), best as (select epoch from losses order by value, epoch limit 1),
 w as ({" union all ".join(f"select {e + 1} as epoch, * from w{e + 1}" for e in range(TRAINING.epochs))}),
 p as (select vec_id, vec_id % 10 as part, (e.label >= 5)::int as label, 1 / (1 + exp(-sum((case when j = 4 then 1.0::double else embedding[j + 1]::double end) * (b - a)))) as probability from embeddings e, w where w.epoch = (select epoch from best) and vec_id % 10 >= 8 group by 1, 2, 3),
 byt as (select probability as threshold, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg from p where part = 8 group by 1),
 c as (select *, sum(pos) over v as tp, sum(neg) over v as fp, sum(pos) over () - sum(pos) over v as fn, sum(neg) over () - sum(neg) over v as tn from byt window v as (order by threshold desc rows unbounded preceding)), sc as (select *, {rates_sql(9)} from c),
 t as (select 'fixed_0_5' as threshold_key, 0.5::double as threshold union all (select 'val_f1', threshold from sc order by f1 desc, threshold desc limit 1) union all (select 'val_mcc', threshold from sc order by mcc desc, threshold desc limit 1)),
 z as (select threshold_key, threshold, count(*) as samples, count(*) filter (probability >= threshold and label = 1) as tp, count(*) filter (probability >= threshold and label <> 1) as fp, count(*) filter (probability < threshold and label = 1) as fn, count(*) filter (probability < threshold and label <> 1) as tn from p, t where part = 9 group by 1, 2), f as (select *, {rates_sql()} from z)"""

_CHOSEN = [*sweeps.strategies(True), sweeps.Strategy("balance", "balanced_accuracy", positive_rate_max=0.6)]
_AUC = "round((sum(case when label = 1 then r end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6)"
_FIXED = f"""with {PREDICTIONS_SQL}, {_GRID(10)}, wide as (select part, sample_id, any_value(label) as label, list(probability order by model) as p from predictions where part <> 'train' group by 1, 2),
 mixed as materialized (select part, weight_id, label, round(p[1] * w[1] + p[2] * w[2] + p[3] * w[3] + p[4] * w[4], 9) as q from wide, grid), c as (select part, weight_id, {_COUNTS} from mixed group by 1, 2), scan as materialized (select *, {rates_sql()} from c),
 chosen as ({" union all ".join(f"(select '{s.name}' as strategy, * from scan where part = 'val' and {_guard(s)} order by {s.objective} desc, {', '.join(t + ' desc' for t in sweeps.TIES[s.objective])}, positive_rate, weight_id limit 1)" for s in _CHOSEN)}),
 at as (select strategy, m.part, m.label, q from chosen join mixed m using (weight_id)), ranks as (select strategy, part, label, q, rank() over (partition by strategy, part order by q) + (count(*) over (partition by strategy, part, q) - 1) / 2.0 as r,
 count(*) filter (label = 1) over (partition by strategy, part order by q desc) as tp, count(*) over (partition by strategy, part order by q desc) as hit from at),
 ranked as (select strategy, part, {_AUC} as auc, round(sum(case when label = 1 then tp::double / hit end) / sum(label), 6) as ap from ranks group by 1, 2)
 select strategy, weight_id, chosen.f1 as val_f1, chosen.mcc as val_mcc, v.auc as val_roc_auc, v.ap as val_pr_auc, t.auc as test_roc_auc, t.ap as test_pr_auc, s.f1 as test_f1, s.mcc as test_mcc
 from chosen join ranked v using (strategy) join ranked t using (strategy) join scan s using (weight_id) where v.part = 'val' and t.part = 'test' and s.part = 'test'""".replace(" at as (", " met as (").replace("from at)", "from met)")

ORACLES = {
    "fixed_selection": _FIXED,
    "source_hash_groups": f"select sha256({NORMALIZED}) as source_hash, count(*) as n from documents group by 1",
    "strict_split_summary": f"""with {SAMPLES_SQL}, grouped as (select source_hash as sample_id, min(label) as label from samples group by 1), {_SPLIT.replace('from samples', 'from grouped')}
 select part, s.label, count(*) as n_rows, count(distinct source_hash) as n_groups from samples s join split on split.sample_id = s.source_hash group by 1, 2""",
    "stratified_split": f"with {SAMPLES_SQL}, {_SPLIT} select sample_id, label, part from split",
    "leaking_groups": f"with {SAMPLES_SQL}, {_SPLIT} select source_hash, count(distinct part) as n_parts from split group by 1 having count(distinct part) > 1",
    "exclusion_cascade": """select doc_id::varchar as sample_id, case when lang = 'fr' then 'known_bad' when doc_id in (1, 2, 3) then 'conflicting_duplicate'
 when doc_id not in (select doc_id from labels) then 'missing_graphml' when not n_chars >= 500 then 'missing_source' end as reason from documents""",
    "evenly_sampled": """select o_custkey, o_orderkey from (select *, count(*) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)
 where n <= 5 or list_contains(list_transform(range(5), lambda k: round_even(k * (n - 1) / 4.0::double, 0)::int), i::int)""",
    "confusion": f"""with {PREDICTIONS_SQL}, c as (select part, model, {_COUNTS.replace('q ', 'probability ')} from predictions group by part, model) select *, {rates_sql()} from c""",
    "best_f1_threshold": _BEST("f1"),
    "best_mcc_threshold": _BEST("mcc"),
    "metrics_at_thresholds": f"""with {PREDICTIONS_SQL}, {CURVE_SQL}, scored as (select *, {rates_sql(9)} from curve where part = 'val'),
 t as (select model, 'fixed_0_5' as threshold_key, 0.5::double as threshold from scored group by 1 union all
 select model, 'val_f1', threshold from (select *, row_number() over (partition by model order by f1 desc, threshold desc) as r from scored) where r = 1 union all
 select model, 'val_mcc', threshold from (select *, row_number() over (partition by model order by mcc desc, threshold desc) as r from scored) where r = 1),
 c as (select model, threshold_key, threshold, count(*) as samples, count(*) filter (probability >= threshold and label = 1) as tp, count(*) filter (probability >= threshold and label <> 1) as fp,
 count(*) filter (probability < threshold and label = 1) as fn, count(*) filter (probability < threshold and label <> 1) as tn from predictions join t using (model) where part = 'test' group by 1, 2, 3) select *, {rates_sql()} from c""",
    "roc_auc": f"with {PREDICTIONS_SQL}, {CURVE_SQL} select part, model, round(sum(neg * (2 * tp - pos))::double / (2.0 * sum(pos) * sum(neg)), 6) as roc_auc from curve group by 1, 2",
    "average_precision": f"with {PREDICTIONS_SQL}, {CURVE_SQL} select part, model, round(sum(pos * tp::double / (tp + fp)) / sum(pos), 6) as average_precision from curve group by 1, 2",
    "roc_points": f"with {PREDICTIONS_SQL}, {CURVE_SQL} select part, model, threshold, round(fp::double / (fp + tn), 6) as fpr, round(tp::double / (tp + fn), 6) as tpr from curve",
    "guarded_scan": f"""with {PREDICTIONS_SQL}, ends as (select part, model, null::int as label, unnest([0.0::double, 0.5, 1.0]) as probability from (select distinct part, model from predictions)),
 both_ as (select part, model, label, probability from predictions union all select * from ends), {CURVE_SQL.replace('from predictions', 'from both_')}, scored as (select *, {rates_sql(9)} from curve)
 select part, model, threshold, round(f1, 6) as f1, round(mcc, 6) as mcc, round(precision, 6) as precision, round(recall, 6) as recall, round(positive_rate, 6) as positive_rate from
 (select *, row_number() over (partition by part, model order by f1 desc, mcc desc, precision desc, threshold desc) as r from scored where recall <= 0.9 and positive_rate <= 0.8) where r = 1""",
    "prediction_shift": f"""with {PREDICTIONS_SQL} select count(*) as samples, round(avg(abs(a.probability - b.probability)), 6) as mean_shift, round(avg(((a.probability >= 0.5) = (b.probability >= 0.5))::int::double), 6) as agreement
 from predictions a join predictions b using (sample_id) where a.model = 0 and b.model = 1""",
    "simplex_grid": f"with {_GRID(10)} select weight_id, round(w[1], 6) as w0, round(w[2], 6) as w1, round(w[3], 6) as w2, round(w[4], 6) as w3 from grid",
    "ensemble_scan": f"""with {PREDICTIONS_SQL}, {_GRID(5)}, {_WIDE}, mixed as (select weight_id, label, round(p[1] * w[1] + p[2] * w[2] + p[3] * w[3] + p[4] * w[4], 9) as q from wide, grid),
 c as (select weight_id, {_COUNTS} from mixed group by 1), r as (select *, {rates_sql()} from c) select weight_id, samples, tp, fp, fn, tn, f1, mcc from r""",
    "fixed05_combos": f"""with {PREDICTIONS_SQL}, {_WIDE}, mixed as (select weight_id, label, round(p[1] * w[1] + p[2] * w[2] + p[3] * w[3] + p[4] * w[4], 9) as q from wide, {_subset_rows(4, 5, 3)}),
 c as (select weight_id, {_COUNTS} from mixed group by 1), r as (select *, {rates_sql()} from c) select weight_id, tp, fp, fn, tn, f1, mcc from r where recall <= 0.95 and positive_rate <= 0.9 order by f1 desc, mcc desc, weight_id limit 20""",
    "weight_sweep": f"with {_SWEEP} select strategy, weight_id, threshold, tp, fp, fn, tn, round(f1, 6) as f1, round(mcc, 6) as mcc, round(precision, 6) as precision, round(recall, 6) as recall, round(positive_rate, 6) as positive_rate, round(balanced_accuracy, 6) as balanced_accuracy from chosen",
    "frozen_points": f"""with {_SWEEP}, test as (select sample_id, any_value(label) as label, list(probability order by model) as p from predictions where part = 'test' group by sample_id),
 t as (select strategy, weight_id, threshold, label, round(p[1] * w[1] + p[2] * w[2] + p[3] * w[3] + p[4] * w[4], 9) as q from test, (select strategy, weight_id, threshold from chosen) join grid using (weight_id)),
 n as (select strategy, {_COUNTS.replace('q >= 0.5', 'q >= threshold').replace('q < 0.5', 'q < threshold')} from t group by 1), f as (select *, {rates_sql()} from n)
 select strategy, weight_id, chosen.threshold, round(chosen.f1, 6) as val_f1, round(chosen.mcc, 6) as val_mcc, f.samples, f.tp, f.fp, f.fn, f.tn, f.f1 as test_f1, f.mcc as test_mcc, f.precision as test_precision, f.recall as test_recall from chosen join f using (strategy)""",
    "trained_epochs": f"with {_training_sql()} select epoch, name, round(value, 6) as value from (" + " union all ".join(f"select * from o{e}" for e in range(TRAINING.epochs)) + ")",
    "trained_evaluation": f"with {_training_sql()}, {_TEST_RATES} select threshold_key, round(threshold, 6) as threshold, samples, tp, fp, fn, tn, f1, mcc from f",
    "hard_negative_bank": f"with {_PAIRS} select positive_id, negative_id, rank::int as rank, pair_score from ranked where rank >= floor(n * 0.05::double) and rank < least(greatest(floor(n * 0.05::double) + 1, floor(n * 0.3::double)), floor(n * 0.05::double) + 3)",
    "mined_bank": f"""with li as (select l_partkey as p_partkey, count(distinct l_orderkey) as orders, count(*) as items, count(*) filter (l_returnflag = 'R') as returns, count(distinct l_suppkey) as suppliers from lineitem group by 1),
 v as (select p_partkey as id, p_size <= 5 as positive, [{', '.join([f"(contains(p_name, '{w}'))::int::double" for w in _NAMES] + [f"(p_type = '{t}')::int::double" for t in _TYPES] + [f"(substr(p_brand, 7, 2)::int % 4 = {k})::int::double" for k in range(4)])}] as m,
 [orders::double, items::double, returns::double, suppliers::double] as s, [floor(p_retailprice / 50), (p_size % 7)::double] as c, p_partkey % 20 / 20.0::double as fp from part join li using (p_partkey)),
 l as (select *, sqrt(list_dot_product(m, m)) as ml, sqrt(list_dot_product(s, s)) as sl from v),
 parts as (select p.id as positive_id, n.id as negative_id, case when p.ml * n.ml = 0 then 0 else round(1000000 * list_dot_product(p.m, n.m) / (p.ml * n.ml))::bigint end as m, case when p.sl * n.sl = 0 then 0 else round(1000000 * list_dot_product(p.s, n.s) / (p.sl * n.sl))::bigint end as s,
 round(1000000 / (1 + (abs(p.c[1] - n.c[1]) + abs(p.c[2] - n.c[2])) / 2))::bigint as c, round(1000000 * n.fp)::bigint as fp from l p, l n where p.positive and not n.positive),
 scored as (select *, (40 * m + 30 * s + 15 * c + 15 * fp + 50) // 100 as score from parts where (40 * m + 30 * s + 15 * c + 15 * fp + 50) // 100 >= 400000),
 ranked as (select *, row_number() over (partition by positive_id order by score desc, negative_id) - 1 as rank, count(*) over (partition by positive_id) as n from scored)
 select positive_id, negative_id, rank::int as rank, score / 1000000.0::double as pair_score, m / 1000000.0::double as motif_similarity, s / 1000000.0::double as structure_similarity, c / 1000000.0::double as scale_similarity, fp / 1000000.0::double as false_positive_probability
 from ranked where rank >= floor(n * 0.05::double) and rank < least(greatest(floor(n * 0.05::double) + 1, floor(n * 0.3::double)), floor(n * 0.05::double) + 3)""",
    "review_queue": f"with {_PAIRS} select positive_id, negative_id, rank::int as rank, pair_score from ranked where rank < greatest(1, floor(n * 0.05::double))",
    "random_bank": f"with {_RANDOM} select * from bank",
    "fp_bank": f"with {_FP} select * from bank",
    "weak_baselines": _BASELINES,
    "pair_metrics": f"""with {_RANDOM}, s as (select vec_id as id, round(4 * embedding[1]::double, 6) as logit, round((1 + embedding[2]::double) / 2, 6) as probability from embeddings),
 d as (select positive_id, negative_id, p.logit - n.logit as gap, n.probability as np from bank join s p on p.id = positive_id join s n on n.id = negative_id)
 select round(avg((gap > 0)::int::double), 6) as ranking_accuracy, (select round(avg((np >= 0.5)::int::double), 6) from (select distinct negative_id, np from d)) as matched_negative_fpr, round(avg(gap), 6) as mean_gap,
 round(count(distinct positive_id)::double / (select count(*) from pos), 6) as positive_coverage, round(count(*)::double / count(distinct positive_id), 6) as pairs_per_positive from d""",
}
