"""Token windows, pooling and feature matrices."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def token_windows(tokens: Column, size: int, overlap: int, empty: bool = False) -> Column:
    """Array of (start, tokens): windows of `size` that overlap, up to the one that reaches the end; none for no tokens, or with
    `empty` one without tokens."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step, n = size - overlap, F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(float(step))).cast("int")) * step
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, F.lit(size)).alias("tokens")))
    if empty:
        return windows
    return F.when(n > 0, windows).otherwise(F.filter(windows, lambda w: F.lit(False)))


def head_tail(windows: Column, most: int) -> Column:
    """At most `most` windows: the first half, rounded up, and the last."""
    head, tail, n = (most + 1) // 2, most // 2, F.size(windows)
    last = F.slice(windows, F.greatest(F.lit(1), n - tail + 1), F.lit(tail)) if tail else F.filter(windows, lambda w: F.lit(False))
    return F.when(n <= most, windows).otherwise(F.concat(F.slice(windows, 1, head), last))


def framed(tokens: Column, size: int, begin: str = "<s>", end: str = "</s>", pad: str = "<pad>") -> tuple[Column, Column]:
    """(tokens with begin and end, padded to size; mask of the real ones)."""
    whole = F.concat(F.array(F.lit(begin)), F.slice(tokens, 1, size - 2), F.array(F.lit(end)))
    room = F.lit(size) - F.size(whole)
    return F.concat(whole, F.array_repeat(F.lit(pad), room)), F.concat(F.transform(whole, lambda t: F.lit(1)), F.array_repeat(F.lit(0), room))


def pooled(vectors: DataFrame, key: str, vector: str, digits: int = 6) -> DataFrame:
    """(key, dim, mean, max) over the vectors of each key: one row a dimension, with a map-side part."""
    d = vectors.select(key, F.posexplode(vector).alias("dim", "v"))
    return d.groupBy(key, "dim").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("mean"), F.round(F.max(F.col("v").cast("double")), digits).alias("max"))


def pooled_vectors(groups: DataFrame, vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(key, features): means then maxima; zeros for a key without vectors."""
    p = pooled(vectors, key, vector).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "max"))).alias("d"))
    zeros = F.array_repeat(F.lit(0.0), 2 * dimensions)
    features = F.concat(F.transform("d", lambda x: x["mean"]), F.transform("d", lambda x: x["max"]))
    return groups.select(key).distinct().join(p, key, "left").select(key, F.coalesce(features, zeros).alias("features"))


def masked_mean(vectors: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """(key, dim, mean) of the vectors whose mask is 1; the divisor is at least 1."""
    d = vectors.select(key, mask, F.posexplode(vector).alias("dim", "v"))
    return d.groupBy(key, "dim").agg(F.round(F.sum(F.col("v").cast("double") * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1)), 6).alias("mean"))


def cache_stats(vectors: DataFrame, id_col: str, vector: str, sample: int = 2000) -> DataFrame:
    """One row: mean |value|, mean spread of a dimension, rate of zero rows, over `sample` evenly spaced rows (a
    sampling operator; the ids must count up from 0)."""
    n = vectors.agg(F.count("*").alias("n"))
    k = F.least(F.lit(sample), F.col("n"))
    d = vectors.join(F.broadcast(n))  # one row
    place = F.when(k > 1, F.floor(F.round(F.ceil(F.col(id_col) * (k - 1) / (F.col("n") - 1)), 0) * (F.col("n") - 1) / (k - 1))).otherwise(F.lit(0))
    d = d.where(F.col(id_col) == place).select(id_col, vector)
    dims = d.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.avg(F.abs("v")).alias("m"), F.stddev_pop("v").alias("s"))
    zero = d.agg(F.avg(F.forall(vector, lambda v: v == 0).cast("double")).alias("zero_rate"), F.count("*").alias("rows"))
    return dims.agg(F.round(F.avg("m"), 6).alias("abs_mean"), F.round(F.avg("s"), 6).alias("mean_std")).join(F.broadcast(zero))


def label_counts(rows: DataFrame, vocabulary: list[str], total: str, prefix: str = "") -> DataFrame:
    """sample_id, the number of its rows under the name `total`, and of those of each label of the vocabulary, in one pass. rows: sample_id, label."""
    return rows.groupBy("sample_id").agg(F.count("*").alias(total), *[F.count_if(F.col("label") == v).alias(f"{prefix}{v}") for v in vocabulary])


def histogram_features(graphs: DataFrame, histogram: DataFrame | None, vocabulary: list[str], edge_histogram: DataFrame | None = None, edge_vocabulary: list[str] | None = None) -> DataFrame:
    """sample_id, log_nodes, log_edges, the share of each node label of the vocabulary, and with an edge histogram the log of one
    more than the count of each edge label. graphs: sample_id, nodes, edges; histograms: sample_id, label, n. Labels beyond the
    vocabularies say nothing; a graph without a label has 0. Without a histogram, graphs has the counts of each label itself, as label_counts names
    them (those of edges with "edge " before)."""
    share = lambda v: F.round(F.coalesce(F.col(f"`{v}`"), F.lit(0)) / F.greatest(F.lit(1), F.col("nodes")), 6).alias(f"{v}_fraction")
    columns = ["sample_id", F.round(F.log1p("nodes"), 6).alias("log_nodes"), F.round(F.log1p("edges"), 6).alias("log_edges"), *[share(v) for v in vocabulary]]
    d = graphs
    if histogram is not None:
        d = d.join(histogram.groupBy("sample_id").pivot("label", vocabulary).agg(F.sum("n")), "sample_id", "left")
    if edge_histogram is not None:
        named = edge_histogram.select("sample_id", F.concat(F.lit("edge "), "label").alias("label"), "n")
        of_edges = [f"edge {v}" for v in edge_vocabulary or []]
        d = d.join(named.groupBy("sample_id").pivot("label", of_edges).agg(F.sum("n")), "sample_id", "left")
    if edge_vocabulary is not None or edge_histogram is not None:
        columns += [F.round(F.log1p(F.coalesce(F.col(f"`edge {v}`"), F.lit(0))), 6).alias(f"{v}_log_count") for v in edge_vocabulary or []]
    return d.select(*columns)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def word_vectors(rows: DataFrame, tokens: str, size: int = 64, seed: int = 42, tasks: int | None = None):  # noqa: ANN201
    """Skip-gram vectors by pyspark.ml over all token lists; an empty list counts as one <EMPTY> token. tasks: how many train
    side by side (shuffle partitions if not given)."""
    from pyspark.ml.feature import Word2Vec

    d = rows.withColumn(tokens, F.when(F.size(tokens) == 0, F.array(F.lit("<EMPTY>"))).otherwise(F.col(tokens)))
    return Word2Vec(vectorSize=size, minCount=1, seed=seed, numPartitions=tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), inputCol=tokens, outputCol="vector").fit(d)


def checked_scope(scope: str) -> str:
    """The training scope of word vectors: only all tokens at once (transductive) is offered."""
    if scope == "train-only":
        raise NotImplementedError("vectors of the train part alone")
    if scope != "transductive":
        raise ValueError(f"no such scope: {scope!r}")
    return scope


def opened_cache(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame | None:
    """The vectors at path if they were written with the same metadata; None if there are none; other metadata is an error."""
    try:
        found = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}  # a few settings
    except AnalysisException:
        return None
    if found != wanted:
        raise ValueError(f"the cache at {path} was made with {found}, not {wanted}")
    return spark.read.parquet(f"{path}/vectors")


def added_to_cache(vectors: DataFrame, path: str, metadata: dict[str, str], key: str = "id") -> DataFrame:
    """Appends the vectors (key, ...) that the cache at path lacks, and returns the whole of it. An encoder is asked only
    for what `pending` leaves."""
    spark = vectors.sparkSession
    there = opened_cache(spark, path, metadata)
    if there is None:
        spark.createDataFrame(sorted(metadata.items()), "key string, value string").write.parquet(f"{path}/metadata")
    fresh = vectors if there is None else pending(vectors, there, key)
    fresh.write.mode("append").parquet(f"{path}/vectors")
    return spark.read.parquet(f"{path}/vectors")
