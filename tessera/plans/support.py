"""Queries of readers, writers, caches, node texts, batches, checkpoints and layers, each with the SQL that gives the same rows.

Readers and writers are shown by a round trip: a general table is written in the format, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching, ensembles, graph, metrics, mining, model, prep, report, scope, windows
from ..sources import sinks, tables
from ..sources.storage import scratch, settled
from . import structure
from .bindings import GRAPH_SQL, PREDICTIONS_SQL, _items, attention, graph_edges, graph_nodes, predictions, retrieval, table
from .evaluation import _RANDOM

# ---- readers and writers


def labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "labels")
    table(spark, sf_dir, "labels").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("sample_id"), F.lit("b").alias("base_id"), F.col("quality").alias("label"), F.lit("g.xml").alias("graphml_path")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return tables.labels(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("sample_id").cast("long")).alias("ids"))


def exclusions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation twice in one file: the later row stays."""
    path = scratch(spark, "exclusions")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("sample_id"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("zz first").alias("reason")), F.struct(F.lit(1).alias("k"), F.col("n_name").alias("reason")))).alias("x"))
    n.orderBy("x.k", "sample_id").coalesce(1).select("sample_id", "x.reason").write.option("header", True).csv(path)
    return tables.exclusions(spark, path)


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), (F.col("doc_id") % 2).cast("int").alias("label"), F.col("lang").alias("graphml_path"), F.col("source").alias("source_path"), F.md5("text").alias("source_hash"))
    sinks.write_json_lines(d, path)
    return tables.manifest(spark, path)


def source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a manifest; overrides by CSV for those of a few nations."""
    path = scratch(spark, "overrides")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"), F.col("s_name").alias("source_path"), "s_nationkey")
    s.where("s_nationkey < 5").select("sample_id", F.col("s_nationkey").cast("string").alias("line_offset"), F.lit("by hand").alias("notes")).write.option("header", True).csv(path)
    overrides = prep.validated_overrides(tables.override_rows(spark, path), s)
    prepared = s.where("s_nationkey % 2 = 0").select("sample_id", F.concat(F.lit("p/"), "source_path").alias("prepared_source_path"))
    return prep.source_map(s.select("sample_id", "source_path"), overrides, prepared)


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language as text files, read whole and cut into lines again."""
    path = scratch(spark, "sources")
    table(spark, sf_dir, "documents").where("text is not null").select("lang", F.regexp_replace("text", "\r", "").alias("text")).write.partitionBy("lang").text(path)
    lang = F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")
    lines = tables.source_lines(tables.source_texts(spark, f"{path}/*/*.txt")).where("text <> ''")
    return lines.groupBy(lang).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def predictions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run leaves, and its predictions read back."""
    path = scratch(spark, "run")
    p = predictions(spark, sf_dir).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    history = p.groupBy(F.col("model").alias("epoch")).agg(F.round(F.avg("probability"), 6).alias("loss"))
    sinks.write_run({"samples": float(p.count())}, history, p.where("part = 'test'"), attention(spark, sf_dir), path)
    return tables.predictions(spark, f"{path}/predictions").groupBy("label", "prediction").agg(F.count("*").alias("n"), F.round(F.sum("probability"), 4).alias("total"))


def node_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of nations, by region the lines of each."""
    path = scratch(spark, "attention")
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("line"), (F.col("n_nationkey") / 10).alias("score"))).alias("l"))
    one = n.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "l"))).alias("m"))
    one.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return tables.node_attention(spark, path)


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pairs")
    bank = mining.random_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 3)
    sinks.write_json_lines(bank.select(F.col("positive_id").cast("string").alias("positive_id"), F.col("negative_id").cast("string").alias("negative_id"), "pair_score"), path)
    return tables.pairs(spark, path).select("positive_id", "negative_id", "pair_score")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of metrics for each model, read together and melted."""
    path = scratch(spark, "runs")
    c = metrics.rates(metrics.confusion(predictions(spark, sf_dir), F.lit(0.5), ["model"]))
    c.select(F.col("model").alias("r"), "precision", "recall").write.partitionBy("r").json(path)
    return report.melted(tables.run_metrics(spark, f"{path}/r=*/*.json").select("run", "precision", "recall"), "run", ["precision", "recall"])


def audit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusion cascade of documents, written and read back: rows and ids of the manifest and of what is left out."""
    path = scratch(spark, "audit")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "lang", "n_chars")
    known = docs.where("lang = 'fr'").select("sample_id", F.lit("known_bad").alias("reason"))
    cascade = settled(prep.exclusion_cascade(docs.select("sample_id"), known, docs, docs.where("n_chars >= 500"), ["1", "2", "3"]))
    sinks.write_audit(cascade, prep.excluded(cascade, known.unionByName(spark.createDataFrame([("-7", "gone")], "sample_id string, reason string"))), path)
    total = lambda d, what: d.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.sum(F.col("sample_id").cast("long")).alias("ids"))
    return total(spark.read.json(f"{path}/manifest"), "manifest").unionByName(total(spark.read.option("header", True).csv(f"{path}/excluded"), "excluded")).unionByName(spark.read.json(f"{path}/report").select(F.lit("report").alias("what"), F.col("metadata_rows").alias("n"), F.col("included").alias("ids")))


def view_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes and items as edges, stored by view; a second run replaces one view only."""
    path = scratch(spark, "views")
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("view"), F.col("o_custkey").alias("node_id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("view"), F.col("l_partkey").alias("src"))
    sinks.write_views(nodes, edges, path)
    sinks.write_views(nodes.where("view = 'F'").withColumn("node_id", F.lit(1).cast(nodes.schema["node_id"].dataType)), edges.where("view = 'A'"), path)
    n = spark.read.parquet(f"{path}/nodes").groupBy("view").agg(F.count("*").alias("n"), F.sum("node_id").cast("long").alias("total")).withColumn("kind", F.lit("nodes"))
    return n.unionByName(spark.read.parquet(f"{path}/edges").groupBy("view").agg(F.count("*").alias("n"), F.sum("src").cast("long").alias("total")).withColumn("kind", F.lit("edges")))


def upserted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("commit_id"))
    new = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("sample_id"), F.lit(-1).cast("long").alias("commit_id"))
    return sinks.upserted_index(o.withColumn("commit_id", F.col("commit_id").cast("long")), new).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("commit_id").alias("commits"))


def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors put into a cache in two runs; the second one adds only what was pending."""
    path, e = scratch(spark, "cache"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit(1).alias("run"))
    windows.added_to_cache(e.where("id % 3 = 0"), path, {"encoder": "none", "size": "64"})
    whole = windows.added_to_cache(e.withColumn("run", F.lit(2)), path, {"encoder": "none", "size": "64"})
    return whole.groupBy("run").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# ---- graphs and texts


def _typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.length("name") % 5 == 0, "malloc").when(F.length("name") % 5 == 1, "<operator>.indexAccess").otherwise(F.col("name"))
    return graph_nodes(spark, sf_dir).select("sample_id", "node_id", "label", name.alias("name"), F.when(F.length("name") % 3 == 0, F.lit("lib.net.recv")).alias("method_full_name"), F.lit("x").alias("code"))


def seed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.seed_types(_typed_nodes(spark, sf_dir))


def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph_nodes(spark, sf_dir).select("label", F.create_map(F.lit("NAME"), "name", F.lit("CODE"), F.when(F.length("name") % 2 == 0, F.col("code")).otherwise(" "), F.lit("SIGNATURE"), F.lit("int(int)")).alias("attrs"))
    return n.select(T.node_text(F.when(F.col("label") == "IDENTIFIER", "BLOCK").otherwise(F.col("label")), F.col("attrs")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def normalized_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = structure._scope_nodes(spark, sf_dir, settled(_items(spark, sf_dir)))
    symbols = scope.scope_symbols(nodes, "full-anon")
    kind = F.when(F.col("node_id").cast("int") % 4 == 0, "METHOD_RETURN").when(F.col("node_id").cast("int") % 4 == 1, "BLOCK").otherwise(F.col("label"))
    out = scope.normalized_nodes(nodes.withColumn("label", kind), symbols, "full-anon")
    return out.groupBy("text").agg(F.count("*").alias("n"))


def incomplete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are samples, items their views; commits differ for returned items, and large parts are beyond the registry."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("view"), "l_returnflag", "l_partkey").dropDuplicates(["sample_id", "view"])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("fingerprint"))
    views = li.groupBy("sample_id").agg(F.count("*").alias("n")).where("n = 2").select("sample_id")
    li = li.join(views, "sample_id")
    index = li.select("sample_id", "view", F.lit(7).alias("commit_id"))
    payloads = li.select("sample_id", "view", F.lit(7).alias("commit_id"), F.lit(3).alias("max_text_id"))
    markers = o.select("sample_id", F.when(F.col("fingerprint") == "F", 7).otherwise(8).alias("commit_id"), "fingerprint")
    return graph.incomplete_samples(o, markers, index, payloads, 2, 10)


def line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.line_of_offset(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("line"))


# ---- vectors, batches, runs


def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "embedding", (F.col("vec_id") % 3 == 0).cast("int").alias("m"))
    return windows.masked_mean(e, "label", "embedding", "m")


def pooled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled vectors of each label; a label without vectors has zeros."""
    e = table(spark, sf_dir, "embeddings")
    groups = e.select("label").distinct().unionByName(spark.createDataFrame([(-1,)], "label int").select(F.col("label").cast(e.schema["label"].dataType)))
    d = windows.pooled_vectors(groups, e, "label", "embedding", 64).select("label", F.posexplode("features").alias("place", "v"))
    return d


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = windows.cache_stats(e, "vec_id", "embedding", 10_000_000)
    return s.select(F.round("abs_mean", 4).alias("abs_mean"), F.round("mean_std", 4).alias("mean_std"), "zero_rate", "rows")


def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = mining.random_bank(retrieval(spark, sf_dir, 1), retrieval(spark, sf_dir, 0), 3)
    return mining.pair_audit_sample(bank, 40).select("positive_id", "negative_id")


def fp_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mining.false_positive_snapshot(predictions(spark, sf_dir))
    return p.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("probability") * 1_000_000).cast("long")).alias("millionths"))


def _order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("nodes"), F.sum("l_quantity").cast("long").alias("edges"))
    return o.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.oversized(_order_sizes(spark, sf_dir), 5, 150).select("l_orderkey", "nodes", "edges")


def capped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most two orders, large ones alone."""
    return batching.greedy_batches(_order_sizes(spark, sf_dir), "o_custkey", ["l_orderkey"], 6, 1_000_000, skip_oversized=False, max_rows=2).select("o_custkey", "l_orderkey", "batch_id")


def id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    return ensembles.id_difference(d.where("lang <> 'fr'"), d.where("lang <> 'de'"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).alias("epoch")).agg(F.round(F.max("o_totalprice"), 2).alias("m"), F.count("*").alias("n"))


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _daily(spark, sf_dir)
    high, low = metrics.best_checkpoint(h, "m", guards=F.col("n") >= 3), metrics.best_checkpoint(h, "m", lower=True)
    return high.withColumn("kind", F.lit("high")).unionByName(low.withColumn("kind", F.lit("low")))


def guarded_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.early_stop(_daily(spark, sf_dir).withColumn("ok", F.col("epoch") % 3 != 0), "m", 15, "ok")


def weighted_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("loss"), F.count("*").alias("n"))
    return metrics.weighted_mean_loss(b).select(F.round("loss", 3).alias("loss"))


def mean_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    d = b.select(F.create_map(F.lit("orders"), F.col("n").cast("double"), F.lit("top"), F.when(F.col("n") > 1, F.col("top"))).alias("diagnostics"))
    return metrics.mean_diagnostics(d.select(F.map_filter("diagnostics", lambda k, v: v.isNotNull()).alias("diagnostics"))).select("name", F.round("value", 3).alias("value"))


def composite_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    z = lambda k: 4 * F.col("embedding")[k].cast("double")
    rows = e.select(z(0).alias("logit"), (F.col("label") >= 5).cast("int").alias("label"), F.array(z(1), z(2)).alias("branches"))
    pairs = e.select(z(3).alias("positive_logit"), z(4).alias("negative_logit"), F.when(F.col("vec_id") % 2 == 0, z(5)).alias("positive_evidence"), F.when(F.col("vec_id") % 2 == 0, z(6)).alias("negative_evidence"))
    return model.composite_loss(rows, pairs, 0.35, 0.25, 0.2, 0.2, (1.0, 1.65)).select(*[F.round(c, 5).alias(c) for c in ("main", "auxiliary", "replay", "rank", "total")])


def rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).alias("epoch")).distinct()
    return e.select("epoch", F.round(model.rank_weight(F.col("epoch"), 100, 500, 0.2), 6).alias("weight"), F.round(model.sigmoid(F.col("epoch") / 1000.0), 6).alias("gate"))


def located_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = report.line_topk(attention(spark, sf_dir), 3)
    offsets = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_nationkey").cast("long").alias("line_offset"))
    lines = structure._lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("sample_id"), F.col("pos").cast("long").alias("line"), F.col("line").alias("text"))
    return report.located(top, offsets, lines).select("sample_id", "rank", "source_line", F.md5("text").alias("digest"))


def best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).where("model = 1").select("sample_id", "label", "probability")
    return report.best_of(p, F.col("label") == 1, "probability").unionByName(report.best_of(p, F.col("label") == 0, "probability"))


def logistic_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aligned sample has one out-of-fold probability."""
    p = predictions(spark, sf_dir)
    a = ensembles.aligned([p.where(F.col("model") == k).select("sample_id", "label", "probability") for k in range(4)])
    d = ensembles.logistic_stack(a, 4, folds=3)
    return d.select("sample_id", "label", ((F.col("probability") > 0) & (F.col("probability") < 1)).alias("inside"))


# ---- layers: suppliers are nodes with three features; parameters follow a rule


def _w(rows: int, columns: int, a: int, b: int, c: int = 0, m: int = 7) -> list[list[float]]:
    return [[((a * o + b * i + c) % m - m // 2) / 10 for i in range(columns)] for o in range(rows)]


def _w_sql(a: int, b: int, c: int | str = 0, m: int = 7) -> str:
    return f"((({a} * o + {b} * i + {c}) % {m} - {m // 2}) / 10.0::double)"


_BIAS = [0.1, -0.1, 0.2, 0.0]
_RELATIONS, _ROOT = [_w(4, 4, 2, 3, r, 5) for r in range(3)], _w(4, 4, 1, 2, 0, 5)
_INNER, _OUTER = (_w(8, 4, 3, 1), None), (_w(4, 8, 1, 3), _BIAS)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("node"), F.array(F.col("s_acctbal").cast("double") / 5000, F.col("s_nationkey") / 10.0, (F.col("s_suppkey") % 7) / 7.0).alias("h"))


def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.gated_bottleneck(_features(spark, sf_dir), (_w(4, 3, 3, 5), _BIAS), (_w(4, 3, 2, 3), None))


def _long(d: DataFrame, key: str, column: str = "h") -> DataFrame:
    return d.select(key, F.posexplode(column).alias("o", "v")).select(key, "o", (F.round("v", 4) + F.lit(0.0)).alias("v"))  # no negative zero


def gated_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hidden(spark, sf_dir), "node")


def residual_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(model.residual_block(_hidden(spark, sf_dir), structure._supplier_edges(spark, sf_dir), _RELATIONS, _ROOT, _BIAS, _INNER, _OUTER), "node")


def _gated_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.gated_residual_block(_hidden(spark, sf_dir), structure._supplier_edges(spark, sf_dir), _RELATIONS, _ROOT, _BIAS, (_w(4, 8, 2, 1), [-1.0] * 4), (_w(4, 4, 3, 2), None), _INNER, _OUTER)


def gated_residual_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_gated_block(spark, sf_dir), "node")


def gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.gate_stats(_gated_block(spark, sf_dir)).select(F.round("gate_mean", 4).alias("gate_mean"), F.round("gate_std", 4).alias("gate_std"))


def selective_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _hidden(spark, sf_dir).join(_features(spark, sf_dir).select("node", F.col("h").alias("x")), "node")
    d = d.withColumn("s", F.transform(model.dense(F.col("x"), _w(4, 3, 5, 2)), model.gelu))
    return _long(d.select("node", model.fused(F.col("h"), F.col("s"), (_w(4, 8, 2, 1), _BIAS)).alias("h")), "node")


def head_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pair = lambda k: F.array(F.col("embedding")[k].cast("double"), F.col("embedding")[k + 1].cast("double"))
    return _long(e.select("vec_id", model.mixed_heads([pair(0), pair(2), pair(4)], [3.0, 0.0, -0.5]).alias("h")), "vec_id")


def slice_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("score"), (F.col("event_type") == "click").alias("seed"))
    return model.slice_logits(e, "user_id", "score", 4, 0.5, seed_mask="seed")


def bag_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.try_divide(F.tanh(F.col("value") / 100), 1 + F.exp(-F.col("value") / 200)).alias("score"), (F.col("value") / 100).alias("value"))
    return model.bag_attention(e, "user_id", "score", "value").select("user_id", *[F.round(c, 4).alias(c) for c in ("weighted", "top", "entropy")])


QUERIES = [
    labels_csv, exclusions_csv, manifest_rows, source_map, source_lines, predictions_csv, node_attention, pair_rows, run_metrics, audit_tables, view_tables, upserted_index, vector_cache,
    seed_types, node_texts, normalized_nodes, incomplete_samples, line_of_offset, masked_mean, pooled_features, cache_stats, pair_audit, fp_snapshot, oversized, capped_batches, id_difference,
    best_checkpoint, guarded_stop, weighted_mean_loss, mean_diagnostics, composite_loss, rank_weights, located_lines, best_of, logistic_stack, gated_bottleneck, residual_block,
    gated_residual_block, gate_stats, selective_fusion, head_mixture, slice_risk, bag_attention,
]

_DAILY = "h as (select date_diff('day', date '1992-01-01', o_orderdate::date) as epoch, round(max(o_totalprice), 2) as m, count(*) as n from orders group by 1)"
_SIZES = "g as (select l_orderkey, count(*) as nodes, sum(l_quantity)::bigint as edges from lineitem group by 1)"
_ERF = lambda x: f"(sign({x}) * (1 - (1 / (1 + 0.3275911::double * abs({x}))) * (0.254829592::double + (1 / (1 + 0.3275911::double * abs({x}))) * (-0.284496736::double + (1 / (1 + 0.3275911::double * abs({x}))) * (1.421413741::double + (1 / (1 + 0.3275911::double * abs({x}))) * (-1.453152027::double + (1 / (1 + 0.3275911::double * abs({x}))) * 1.061405429::double)))) * exp(-({x}) * ({x}))))"
_GELU = lambda x: f"(0.5::double * ({x}) * (1 + {_ERF(f'(({x}) / sqrt(2.0::double))')}))"
_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
_NORM = lambda name, of: f"{name} as materialized (select node, o, (v - avg(v) over (partition by node)) / sqrt(var_pop(v) over (partition by node) + 0.00001::double) as v from {of})"
_B = "(case o when 0 then 0.1::double when 1 then -0.1::double when 2 then 0.2::double else 0.0::double end)"
_LINEAR = lambda name, of, n, w, bias="0.0::double": f"{name} as materialized (select node, o, sum(v * {w}) + any_value({bias}) as v from (select node, o as i, v from {of}), (select unnest(range({n})) as o) group by 1, 2)"
_HIDDEN = f"""x as (select s_suppkey as node, 0 as o, s_acctbal::double / 5000 as v from supplier union all select s_suppkey, 1, s_nationkey / 10.0::double from supplier union all select s_suppkey, 2, (s_suppkey % 7) / 7.0::double from supplier),
 {_LINEAR('hv', 'x', 4, _w_sql(3, 5), _B)}, {_LINEAR('hg', 'x', 4, _w_sql(2, 3))}, ha as (select node, o, {_GELU('hv.v')} * {_SIG('hg.v')} as v from hv join hg using (node, o)), {_NORM('hid', 'ha')}"""
_CONV = f"""edges as (select s_suppkey as src, dst, s_suppkey % 3 as r from (select *, lead(s_suppkey) over (partition by s_nationkey order by s_suppkey) as dst from supplier) where dst is not null),
 near as (select dst as node, r, o, avg(v) as v from edges join hid on node = src group by 1, 2, 3),
 sent as (select node, o, sum(v * {_w_sql(2, 3, 'r', 5)}) as v from (select node, r, o as i, v from near), (select unnest(range(4)) as o) group by 1, 2), {_LINEAR('own', 'hid', 4, _w_sql(1, 2, 0, 5), _B)},
 conv as materialized (select own.node, own.o, own.v + coalesce(sent.v, 0) as v from own left join sent using (node, o))"""
_FORWARD = f"""{_NORM('h1', 'mixed')}, {_LINEAR('f1', 'h1', 8, _w_sql(3, 1))}, f2 as (select node, o, {_GELU('v')} as v from f1), {_LINEAR('f3', 'f2', 4, _w_sql(1, 3), _B)},
 h2 as (select h1.node, h1.o, h1.v + f3.v as v from h1 join f3 using (node, o)), {_NORM('h3', 'h2')}"""
_GATED = f"""msg as materialized (select node, o, {_GELU('v')} as v from conv), both_ as (select node, o, v from hid union all select node, o + 4, v from msg), {_LINEAR('gl', 'both_', 4, _w_sql(2, 1), '-1.0::double')},
 gt as (select node, o, {_SIG('v')} as v from gl), {_LINEAR('cl', 'msg', 4, _w_sql(3, 2))}, mixed as (select hid.node, hid.o, hid.v + gt.v * {_GELU('cl.v')} as v from hid join gt using (node, o) join cl using (node, o))"""
_RESULT = "select node, o::int as o, round(v, 4) + 0.0::double as v from"
_CE = lambda z, y: f"(ln(1 + exp(-abs({z}))) + greatest(case when {y} then -({z}) else ({z}) end, 0.0))"

ORACLES = {
    "labels_csv": "select quality::int as label, count(*) as n, sum(doc_id)::bigint as ids from labels group by 1",
    "exclusions_csv": "select n_nationkey::varchar as sample_id, n_name as reason from nation",
    "manifest_rows": "select doc_id::varchar as sample_id, (doc_id % 2)::int as label, lang as graphml_path, source as source_path, md5(text) as source_hash from documents",
    "source_map": """select s_suppkey::varchar as sample_id, s_name as raw_source_path, case when s_nationkey % 2 = 0 then 'p/' || s_name else '' end as prepared_source_path, (case when s_nationkey < 5 then s_nationkey else 0 end)::int as line_offset,
 case when s_nationkey < 5 then 'override' else 'default' end as offset_source, case when s_nationkey % 2 = 0 then 'ok' else 'missing_prepared_source' end as mapping_status, case when s_nationkey < 5 then 'by hand' else '' end as notes from supplier""",
    "source_lines": "select lang, count(*) as n, sum(length(l))::bigint as chars from (select lang, unnest(string_split(replace(text, chr(13), ''), chr(10))) as l from documents where text is not null) where l <> '' group by 1",
    "predictions_csv": f"with {PREDICTIONS_SQL} select label, (probability >= 0.5)::int as prediction, count(*) as n, round(sum(probability), 4) as total from predictions where part = 'test' group by 1, 2",
    "node_attention": "select 'r' || n_regionkey as sample_id, n_nationkey::bigint as line, n_nationkey / 10.0::double as score from nation",
    "pair_rows": f"with {_RANDOM} select positive_id::varchar as positive_id, negative_id::varchar as negative_id, pair_score from bank",
    "run_metrics": f"""with {PREDICTIONS_SQL}, c as (select model, count(*) filter (probability >= 0.5 and label = 1) as tp, count(*) filter (probability >= 0.5 and label <> 1) as fp, count(*) filter (probability < 0.5 and label = 1) as fn from predictions group by 1)
 select 'r=' || model as run, 'precision' as metric, round(tp / (tp + fp)::double, 6) as value from c union all select 'r=' || model, 'recall', round(tp / (tp + fn)::double, 6) from c""",
    "audit_tables": """with c as (select doc_id, case when lang = 'fr' then 'known_bad' when doc_id in (1, 2, 3) then 'c' when not n_chars >= 500 then 's' end as reason from documents)
 select 'manifest' as what, count(*) as n, sum(doc_id)::bigint as ids from c where reason is null union all select 'excluded', count(*) + 1, sum(doc_id)::bigint - 7 from c where reason is not null union all select 'report', count(*), count(*) filter (reason is null) from c""",
    "view_tables": """select o_orderstatus as view, count(*) as n, sum(case when o_orderstatus = 'F' then 1 else o_custkey end)::bigint as total, 'nodes' as kind from orders group by 1
 union all select l_returnflag, count(*), sum(l_partkey)::bigint, 'edges' from lineitem group by 1""",
    "upserted_index": "with n as (select c_custkey as k from customer where c_nationkey < 5) select o_custkey as sample_id, count(*) as n, sum(o_orderkey)::bigint as commits from orders where o_custkey not in (select k from n) group by 1 union all select k, 1, -1 from n",
    "vector_cache": "select case when vec_id % 3 = 0 then 1 else 2 end as run, count(*) as n, sum(vec_id)::bigint as ids from embeddings group by 1",
    "seed_types": f"""with {GRAPH_SQL}, n as (select sample_id, node_id, label, label = 'CALL' and (length(name) % 5 = 0 or length(name) % 3 = 0 or regexp_matches(lower(name), 'alloc|calloc|free|gets|malloc|memcpy|memmove|read|realloc|recv|scanf|sprintf|strcat|strcpy|strlen')) as risky, length(name) % 5 = 1 or (length(name) % 5 > 1 and regexp_matches(name, '\\[|->|\\*')) as memory from nodes),
 k as (select *, bool_or(risky) over (partition by sample_id) as any_ from n) select sample_id, node_id, case when risky then 1 when not any_ and memory and label in ('CALL', 'IDENTIFIER') then 2 else 0 end as seed_type from k""",
    "node_texts": f"""with {GRAPH_SQL} select case label when 'METHOD' then trim(name) || ' int(int)' when 'IDENTIFIER' then '<BLOCK>' else case when length(name) % 2 = 0 and trim(code) <> '' then trim(code) when trim(name) <> '' then trim(name) else '<CALL>' end end as text, count(*) as n from nodes group by 1""",
    "normalized_nodes": """with i as (select l_orderkey as o, l_partkey % 7 as f, l_suppkey % 5 as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
 l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as i from lineitem), first as (select *, min(i) over (partition by o, f) as ff, min(i) over (partition by o, v) as vf from i),
 d as (select *, dense_rank() over (partition by o order by ff) as fn, dense_rank() over (partition by o order by vf) as vn from first),
 t as (select case (100 + i) % 4 when 0 then '<RET>' when 1 then '<BLOCK>' else 'FUNC_' || fn end as text from d union all select case (200 + i) % 4 when 0 then '<RET>' when 1 then '<BLOCK>' else 'VAR_' || vn end from d) select text, count(*) as n from t group by 1""",
    "incomplete_samples": """with v as (select l_orderkey as k from (select distinct l_orderkey, l_linenumber from lineitem) group by 1 having count(*) = 2) select o_orderkey as sample_id from orders where not (o_orderkey in (select k from v) and o_orderstatus = 'F')""",
    "line_of_offset": "select doc_id, (length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) + 1)::int as line from documents where text is not null",
    "masked_mean": "with x as (select label, vec_id, unnest(range(64)) as dim, unnest(embedding)::double as v from embeddings) select label, dim::int as dim, round(sum(case when vec_id % 3 = 0 then v else 0 end) / greatest(count(*) filter (vec_id % 3 = 0), 1), 6) as mean from x group by 1, 2",
    "pooled_features": "with x as (select label, unnest(range(64)) as dim, unnest(embedding)::double as v from embeddings) select label, dim::int as place, round(avg(v), 6) as v from x group by 1, 2, dim union all select label, (dim + 64)::int, round(max(v), 6) from x group by label, dim union all select -1, unnest(range(128))::int, 0.0",
    "cache_stats": "with x as (select unnest(range(64)) as dim, unnest(embedding)::double as v from embeddings), d as (select dim, avg(abs(v)) as m, stddev_pop(v) as s from x group by 1) select round(round(avg(m), 6), 4) as abs_mean, round(round(avg(s), 6), 4) as mean_std, 0.0::double as zero_rate, (select count(*) from embeddings) as rows from d",
    "pair_audit": f"with {_RANDOM} select positive_id, negative_id from bank order by sha256('42|' || positive_id || '|' || negative_id), positive_id, negative_id limit 40",
    "fp_snapshot": f"with {PREDICTIONS_SQL} select sample_id, count(*) as n, sum(round(probability * 1000000)::bigint)::bigint as millionths from predictions where label = 0 group by 1",
    "oversized": f"with {_SIZES} select * from g where nodes > 5 or edges > 150",
    "capped_batches": f"""with recursive {_SIZES}, o as (select o_custkey, l_orderkey, nodes, row_number() over (partition by o_custkey order by l_orderkey) as i from g join orders on o_orderkey = l_orderkey),
 r as (select o_custkey, l_orderkey, i, 0 as batch_id, nodes as n, 1 as c, nodes > 6 as shut from o where i = 1 union all
 select o.o_custkey, o.l_orderkey, o.i, r.batch_id + (r.shut or o.nodes > 6 or r.n + o.nodes > 6 or r.c >= 2)::int, case when r.shut or o.nodes > 6 or r.n + o.nodes > 6 or r.c >= 2 then 0 else r.n end + o.nodes, case when r.shut or o.nodes > 6 or r.n + o.nodes > 6 or r.c >= 2 then 0 else r.c end + 1, o.nodes > 6
 from r join o on o.o_custkey = r.o_custkey and o.i = r.i + 1) select o_custkey, l_orderkey, batch_id from r""",
    "id_difference": "select doc_id as sample_id, case when lang = 'fr' then 'second' else 'first' end as only_in from documents where lang in ('fr', 'de')",
    "best_checkpoint": f"with {_DAILY} select * from (select epoch, m, 'high' as kind from h where n >= 3 order by m desc, epoch limit 1) union all select * from (select epoch, m, 'low' from h order by m, epoch limit 1)",
    "guarded_stop": f"""with recursive {_DAILY}, s as (select epoch, m, epoch % 3 <> 0 as ok, row_number() over (order by epoch) as i from h),
 r as (select i, m as best, ok as guarded, epoch as best_epoch, 0 as wait, epoch as stop_epoch from s where i = 1 union all
 select s.i, case when wait < 15 and s.ok and (not guarded or s.m > best) then s.m else best end, guarded or (wait < 15 and s.ok and (not guarded or s.m > best)), case when wait < 15 and s.ok and (not guarded or s.m > best) then s.epoch else best_epoch end,
 case when wait >= 15 then wait when s.ok and (not guarded or s.m > best) then 0 when s.ok then wait + 1 else wait end, case when wait >= 15 then stop_epoch else s.epoch end from r join s on s.i = r.i + 1)
 select best_epoch, stop_epoch, round(best, 6) as best from r order by i desc limit 1""",
    "weighted_mean_loss": "with b as (select round(avg(o_totalprice), 2) as loss, count(*) as n from orders group by o_orderpriority) select round(round(sum(loss * n) / sum(n), 6), 3) as loss from b",
    "mean_diagnostics": "with b as (select count(*)::double as n, max(o_totalprice) as top from orders group by o_custkey) select 'orders' as name, round(round(avg(n), 6), 3) as value from b union all select 'top', round(round(avg(top), 6), 3) from b where n > 1",
    "composite_loss": f"""with e as (select label >= 5 as y, case when label >= 5 then 1.65::double else 1.0::double end as w, list_transform(embedding[1:7], lambda v: 4 * v::double) as z, vec_id % 2 = 0 as own from embeddings),
 t as (select sum(w * {_CE('z[1]', 'y')}) / sum(w) as main, sum(w * ({_CE('z[2]', 'y')} + {_CE('z[3]', 'y')}) / 2) / sum(w) as auxiliary, avg(({_CE('z[4]', 'true')} + {_CE('z[5]', 'false')}) / 2) as replay,
 avg(ln(1 + exp(-abs(g))) + greatest(g, 0.0)) as rank from (select *, case when own then 0.35 - z[6] + z[7] else 0.35 - z[4] + z[5] end as g from e))
 select round(round(main, 6), 5) as main, round(round(auxiliary, 6), 5) as auxiliary, round(round(replay, 6), 5) as replay, round(round(rank, 6), 5) as rank, round(round(main + 0.2::double * auxiliary + 0.25::double * replay + 0.2::double * rank, 6), 5) as total from t""",
    "rank_weights": "select distinct epoch, round(least(0.2::double, greatest(0.0::double, 0.2::double * (epoch - 100) / 500.0::double)), 6) as weight, round(1 / (1 + exp(-epoch / 1000.0::double)), 6) as gate from (select date_diff('day', date '1992-01-01', o_orderdate::date)::int as epoch from orders)",
    "located_lines": f"""with {structure.LINES_SQL}, {structure._TOP(3)}, o as (select c_custkey::varchar as sample_id, c_nationkey as line_offset from customer where c_nationkey < 10), t as (select top.sample_id, rank, line + coalesce(line_offset, 0) as source_line from top left join o using (sample_id))
 select sample_id, rank, source_line::bigint as source_line, md5(coalesce(lines.line, '')) as digest from t left join lines on doc_id::varchar = sample_id and pos = source_line""",
    "best_of": f"with {PREDICTIONS_SQL} select sample_id, label, probability from (select *, row_number() over (partition by label order by probability desc, sample_id) as r from predictions where model = 1) where r = 1",
    "logistic_stack": f"with {PREDICTIONS_SQL} select distinct sample_id, label, true as inside from predictions",
    "gated_bottleneck": f"with {_HIDDEN} {_RESULT} hid",
    "residual_block": f"with {_HIDDEN}, {_CONV}, mixed as (select hid.node, hid.o, hid.v + {_GELU('conv.v')} as v from hid join conv using (node, o)), {_FORWARD} {_RESULT} h3",
    "gated_residual_block": f"with {_HIDDEN}, {_CONV}, {_GATED}, {_FORWARD} {_RESULT} h3",
    "gate_stats": f"with {_HIDDEN}, {_CONV}, {_GATED} select round(round(avg(v), 6), 4) as gate_mean, round(round(stddev_pop(v), 6), 4) as gate_std from gt",
    "selective_fusion": f"""with {_HIDDEN}, {_LINEAR('sl', 'x', 4, _w_sql(5, 2))}, sem as materialized (select node, o, {_GELU('v')} as v from sl), both_ as (select node, o, v from hid union all select node, o + 4, v from sem), {_LINEAR('gl', 'both_', 4, _w_sql(2, 1), _B)},
 fz as (select hid.node, hid.o, {_SIG('gl.v')} * hid.v + (1 - {_SIG('gl.v')}) * sem.v as v from hid join sem using (node, o) join gl using (node, o)) {_RESULT} fz""",
    "head_mixture": "with w as (select exp(0.0::double) as a, exp(-3.0::double) as b, exp(-3.5::double) as c), x as (select vec_id, unnest([0, 1]) as o, embedding as e from embeddings) select vec_id, o, round((e[o + 1]::double * a + e[o + 3]::double * b + e[o + 5]::double * c) / (a + b + c), 4) + 0.0::double as v from x, w",
    "slice_risk": """with e as (select user_id, value / 100 as s, event_type = 'click' as m, bool_or(event_type = 'click') over (partition by user_id) as masked from events), r as (select *, row_number() over (partition by user_id order by s desc) as k from e where m or not masked), t as (select user_id, s, max(s) over (partition by user_id) as mx from r where k <= 4),
 z as (select user_id, round(max(mx) + 0.5 * ln(sum(exp((s - mx) / 0.5))) - ln(count(*)::double), 6) as risk, count(*) as candidates from t group by 1) select user_id, 0.0::double - risk / 2 as low, risk / 2 as high, candidates from z""",
    "bag_attention": """with e as (select user_id, value / 100 as v, tanh(value / 100) / (1 + exp(-value / 200)) as s from events), x as (select *, exp(s - max(s) over (partition by user_id)) as ex from e), w as (select *, ex / sum(ex) over (partition by user_id) as w from x)
 select user_id, round(round(sum(w * v), 6), 4) as weighted, round(round(max(v), 6), 4) as top, round(round(-sum(w * ln(greatest(w, 1e-8))), 6), 4) as entropy from w group by 1""",
}
