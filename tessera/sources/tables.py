"""Readers of labels, exclusions, manifests, sources, predictions and attention, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labels(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, base_id, label (int; anything else fails the job), graphml_path. A byte-order mark is dropped."""
    d = spark.read.schema("sample_id string, base_id string, label string, graphml_path string").option("header", True).option("enforceSchema", False).csv(path)
    return d.select(F.trim("sample_id").alias("sample_id"), "base_id", F.expr("cast(trim(label) as int)").alias("label"), "graphml_path")


def exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """sample_id, reason; no rows without a path. Of repeated ids the last row stays, by the names of files and the places in them."""
    schema = "sample_id string, reason string"
    if path is None:
        return spark.createDataFrame([], schema)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("__at", at).groupBy("sample_id").agg(F.max_by("reason", "__at").alias("reason"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sample_id string, label int, graphml_path string, source_path string, source_hash string").json(path).where("sample_id is not null")


def override_rows(spark: SparkSession, path: str | None) -> DataFrame:
    """sample_id, line_offset, notes, not yet judged; no rows without a path. Any other header fails the job."""
    schema = "sample_id string, line_offset string, notes string"
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def source_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files; bytes that are no UTF-8 become replacement characters."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def existing_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def source_lines(texts: DataFrame, key: str = "path") -> DataFrame:
    return texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("sample_id string, label int, probability double, prediction int").option("header", True).csv(path)
    return d.where("sample_id is not null and probability is not null")


def node_attention(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, line, score out of one JSON object: sample_id -> list of lines with scores."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<struct<line: bigint, score: double>>>")).alias("sample_id", "lines"))
    return d.select("sample_id", F.explode("lines").alias("x")).select("sample_id", "x.line", "x.score")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("positive_id string, negative_id string, pair_score double, motif_similarity double, structure_similarity double, scale_similarity double, false_positive_probability double").json(path)


def run_metrics(spark: SparkSession, pattern: str, final: str | None = None) -> DataFrame:
    """run (folder name) beside what each metrics.json holds. final: where runs may have metrics of a later evaluation; what a run has
    there goes before what it has here, column by column, and columns that only stand there are added."""

    def read(at: str) -> DataFrame:
        d = spark.read.option("multiLine", True).json(at)
        return d.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))

    d = read(pattern)
    if final is None:
        return d
    later = read(final)
    named = later.select(F.col("run").alias("__run"), *[F.col(c).alias(f"__{c}") for c in later.columns if c != "run"])
    both = [F.coalesce(f"__{c}", c).alias(c) if c in later.columns and c != "run" else F.col(c) for c in d.columns]
    added = [F.col(f"__{c}").alias(c) for c in later.columns if c not in d.columns]
    return d.join(named, F.col("run") == F.col("__run"), "left").select(*both, *added)
