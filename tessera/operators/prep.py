"""Cleaning, hashing, exclusion, splitting and source maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_tokens
from .ordering import numbered


def exclusion_cascade(labels: DataFrame, known: DataFrame, graphs: DataFrame, sources: DataFrame, conflicts: list[str]) -> DataFrame:
    """labels with reason, null for what is included. The first that holds decides: a known exclusion (its own reason),
    a conflicting id, a missing graph, a missing source. known: sample_id, reason; graphs, sources: sample_id."""
    known = known.groupBy("sample_id").agg(F.max("reason").alias("known_reason"))
    has = lambda df, c: df.select("sample_id").distinct().withColumn(c, F.lit(True))
    d = labels.join(known, "sample_id", "left").join(has(graphs, "has_graph"), "sample_id", "left").join(has(sources, "has_source"), "sample_id", "left")
    reason = F.coalesce("known_reason", F.when(F.col("sample_id").isin(conflicts), "conflicting_duplicate").when(F.col("has_graph").isNull(), "missing_graphml").when(F.col("has_source").isNull(), "missing_source"))
    return d.withColumn("reason", reason).drop("known_reason", "has_graph", "has_source")


def excluded(cascade: DataFrame, known: DataFrame) -> DataFrame:
    """(sample_id, reason) of all exclusions: the known ones also where the labels lack them."""
    fresh = cascade.where("reason is not null").select("sample_id", "reason")
    return known.groupBy("sample_id").agg(F.max("reason").alias("reason")).unionByName(fresh.join(known, "sample_id", "left_anti"))


def split_sizes(n: Column) -> tuple[Column, Column]:
    """Rows of train and of validation, by rounding half to even; the rest is test."""
    train = F.least(n, F.bround(n * F.lit(0.8), 0).cast("int"))
    return train, F.greatest(F.lit(0), F.least(n - train, F.bround(n * F.lit(0.1), 0).cast("int")))


def shuffle_key(seed: int, *parts: str) -> Column:
    """A seeded order that does not depend on partitions: the hash of seed and key."""
    return F.sha2(F.concat(F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]), 256)


def stratified_split(rows: DataFrame, seed: int = 42, id_col: str = "sample_id", label_col: str = "label") -> DataFrame:
    """rows with part (train, val, test), by 80/10/10 within each label. Rows are numbered by label over ranges, and each
    label's start comes from a table of one row a label, so no task holds a label."""
    sizes = rows.groupBy(F.col(label_col).alias("__label")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__label").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0)))
    key = shuffle_key(seed, label_col, id_col)
    d = numbered(rows, "__at", label_col, key.isNull(), key, F.col(id_col).isNull(), id_col)  # what has no key comes last
    d = d.join(F.broadcast(sizes), F.col(label_col).eqNullSafe(F.col("__label"))).withColumn("__r", F.col("__at") - F.col("__before") + 1)
    train, val = split_sizes(F.col("__n"))
    part = F.when(F.col("__r") <= train, "train").when(F.col("__r") <= train + val, "val").otherwise("test")
    return d.withColumn("part", part).drop("__n", "__r", "__at", "__before", "__label")


def grouped_split(rows: DataFrame, seed: int = 42, group_col: str = "source_hash", label_col: str = "label", mixed: str = "fail") -> DataFrame:
    """rows with part, where rows of one group share a part; groups are split, not rows. A group with several labels
    fails the job, or (mixed="least") is dealt out with those of its least label. Rows without a group are left out, but count as the last group of
    their least label."""
    groups = rows.groupBy(group_col).agg(F.min(label_col).alias("__lo"), F.max(label_col).alias("__hi"))
    bad = F.raise_error(F.concat(F.lit("a group has several labels: "), F.col(group_col).cast("string"))).cast("int")
    least = F.col("__lo") if mixed == "least" else F.when(F.col("__lo").eqNullSafe(F.col("__hi")) | F.col(group_col).isNull(), F.col("__lo")).otherwise(bad)
    groups = groups.select(group_col, least.alias(label_col))
    parts = stratified_split(groups, seed, group_col, label_col).select(group_col, "part")
    return rows.join(parts, group_col)


def leaking_groups(split: DataFrame, group_col: str = "source_hash") -> DataFrame:
    """Groups that are in more than one part."""
    return split.groupBy(group_col).agg(F.count_distinct("part").alias("n_parts")).where("n_parts > 1")


def evenly_sampled(rows: DataFrame, limit: int, key: list[str], order: list[str]) -> DataFrame:
    """At most `limit` rows of each key, evenly spaced in order, with first and last among them."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    by = Window.partitionBy(*key)
    d = rows.withColumn("__n", F.count("*").over(by)).withColumn("__i", F.row_number().over(by.orderBy(*order)) - 1)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.bround(k * (F.col("__n") - 1) / F.lit(float(max(1, limit - 1))), 0).cast("int")))
    return d.where((F.col("__n") <= limit) | F.array_contains(places, F.col("__i"))).drop("__n", "__i")


def source_map(manifest: DataFrame, overrides: DataFrame, prepared: DataFrame) -> DataFrame:
    """sample_id, raw_source_path, prepared_source_path, line_offset, offset_source, mapping_status, notes."""
    d = manifest.join(overrides.withColumnRenamed("line_offset", "__offset"), "sample_id", "left").join(prepared, "sample_id", "left")
    return d.select(
        "sample_id",
        F.col("source_path").alias("raw_source_path"),
        F.coalesce("prepared_source_path", F.lit("")).alias("prepared_source_path"),
        F.coalesce("__offset", F.lit(0)).alias("line_offset"),
        F.when(F.col("__offset").isNull(), "default").otherwise("override").alias("offset_source"),
        F.when(F.col("prepared_source_path").isNull(), "missing_prepared_source").otherwise("ok").alias("mapping_status"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def validated_overrides(overrides: DataFrame, known: DataFrame) -> DataFrame:
    """Overrides (strings) with line_offset as int; an unknown or repeated id, or an offset that is no non-negative
    integer, fails the job."""
    n = Window.partitionBy("sample_id")
    d = overrides.withColumn("__c", F.count("*").over(n)).join(known.select("sample_id").distinct().withColumn("__k", F.lit(True)), "sample_id", "left")
    offset = F.expr("try_cast(line_offset as int)")
    bad = F.when(F.col("__k").isNull(), F.lit("unknown sample_id: ")).when(F.col("__c") > 1, F.lit("repeated sample_id: ")).when(offset.isNull() | (offset < 0), F.lit("line_offset must be a non-negative integer: "))
    value = F.when(bad.isNull(), offset).otherwise(F.raise_error(F.concat(bad, F.col("sample_id"))).cast("int"))
    return d.withColumn("line_offset", value).drop("__c", "__k")


def offset_evidence(evidence: DataFrame, lines: DataFrame, radius: int) -> DataFrame:
    """(sample_id, n_evidence, n_matched, out_of_range): evidence nodes (sample_id, line, code) whose key tokens occur
    within `radius` lines of the lines (sample_id, line, text). The range becomes an equi-join on exploded lines."""
    last = lines.groupBy("sample_id").agg(F.max("line").alias("__last"))
    e = evidence.withColumn("__e", F.monotonically_increasing_id()) if "evidence_id" not in evidence.columns else evidence.withColumnRenamed("evidence_id", "__e")
    e = e.join(last, "sample_id", "left").withColumn("__out", F.coalesce((F.col("line") < 1) | (F.col("line") > F.col("__last")), F.lit(True)))
    e = e.withColumn("__tokens", key_tokens(F.col("code")))
    near = e.withColumn("__at", F.explode(F.sequence(F.col("line") - radius, F.col("line") + radius)))
    texts = lines.select("sample_id", F.col("line").alias("__at"), key_tokens(F.col("text")).alias("__line_tokens"))
    hits = near.join(texts, ["sample_id", "__at"]).where(F.arrays_overlap("__tokens", "__line_tokens")).select("sample_id", "__e").distinct().withColumn("__hit", F.lit(1))
    d = e.join(hits, ["sample_id", "__e"], "left")
    return d.groupBy("sample_id").agg(F.count("*").alias("n_evidence"), F.count("__hit").alias("n_matched"), F.max("__out").alias("out_of_range"))
