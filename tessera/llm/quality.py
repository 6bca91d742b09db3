"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, DataFrame functions only.

A sketch is a table of bucket counts. A bucket keeps the six leading bits of a value (relative error below 1/32), so
sketches of any two sets of rows merge by adding counts, in any order and with the same result; the number of buckets
is bounded by the width of a long, not by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled

#: A word is a run of anything else.
SPACE = r"[\\x20\\x09-\\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rates that are judged, in thousandths (word length in tenths of a character), and what is added to each fence.
SLACK = {"symbol_rate": 50, "dup_line_rate": 400, "word_length": 50, "repeat_rate": 300}
#: A fence is q66 + SPREAD * (q66 - q50) + slack: far outside what the group's own documents show, and at quantiles that
#: junk does not reach while it is less than a third of a group.
HIGH, SPREAD = 66, 10
#: Smallest number of documents whose sketch decides alone; below it the language's sketch does, then that of all.
MIN_GROUP = 50
#: Groups up to which the fences (some 100 bytes each) are broadcast; beyond, they are joined by shuffle, each in SALTS copies.
BROADCAST_GROUPS, SALTS = 100_000, 16


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Positions that lie in three-word windows whose hash occurs twice or more; hashes: array<long> of all windows."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(z: Column) -> Column:
        near = lambda e, k: F.coalesce(F.get(z, k)["h"] == e["h"], F.lit(False))
        at = F.array_sort(F.transform(F.filter(z, lambda e, k: near(e, k - 1) | near(e, k + 1)), lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(ordered, count))


def quality_measures(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs as struct __row, with n_words, word_chars, n_symbols, n_lines (lines with a word),
    n_dup_lines, n_repeat_words and base_failed beside it. Null texts count as empty and fail the base
    rules; a very long text is one row's arrays. carry: the columns to keep."""
    kept = F.struct(*[F.col(f"`{c}`") for c in (carry if carry is not None else docs.columns)])
    d = docs.select(kept.alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("*", F.expr(f"array_remove(split(t, '{SPACE}'), '')").alias("w"), F.expr("filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"))
    d = d.select(
        "__row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("g"),
    )
    d = d.select(*[c for c in d.columns if c != "g"], _covered(F.col("g")).alias("n_repeat_words"))
    # One row out of one: a filter on a measure is not pushed below, where it would compute its arrays again for each use.
    d = d.select("__row", F.explode(F.array(F.struct(*[c for c in d.columns if c != "__row"]))).alias("m")).select("__row", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _rates() -> dict[str, Column]:
    whole = lambda n, of, times: F.expr(f"({times} * {n}) div greatest({of}, 1)")
    return {"symbol_rate": whole("n_symbols", "word_chars", 1000), "dup_line_rate": whole("n_dup_lines", "n_lines", 1000), "word_length": whole("word_chars", "n_words", 10), "repeat_rate": whole("n_repeat_words", "n_words", 1000)}


def quality_sketch(measures: DataFrame) -> DataFrame:
    """Sketches of the documents that the base rules keep: (lang, source, metric, bucket, n), with null lang and source
    where languages or all documents are merged (level 2: one source of a language, 1: a language, 0: all)."""
    d = measures.where(~F.col("base_failed")).select(F.coalesce("__row.lang", F.lit("")).alias("lang"), F.coalesce("__row.source", F.lit("")).alias("source"), *[v.alias(k) for k, v in _rates().items()])
    d = d.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in SLACK])).alias("x")).select("lang", "source", "x.*")
    low = F.greatest(F.length(F.bin("v")) - 6, F.lit(0))
    d = d.withColumn("low", low).withColumn("bucket", F.expr("shiftleft(shiftright(v, low), low)"))
    fine = d.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    both = fine.select(F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[F.col(c) if level > k else F.lit("").alias(c) for k, c in enumerate(("lang", "source"))]) for level in (0, 1, 2)])).alias("at"), "metric", "bucket", "n")
    return both.groupBy("at.level", "at.lang", "at.source", "metric", "bucket").agg(F.sum("n").alias("n"))


def quality_fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, fence_<metric> ...): one row per language and source, each fence from the finest sketch that has
    MIN_GROUP documents: the source's own, else its language's, else that of all documents."""
    key = ["level", "lang", "source", "metric"]
    over = Window.partitionBy(*key)
    c = sketch.withColumn("total", F.sum("n").over(over)).withColumn("below", F.sum("n").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    q = c.groupBy(*key).agg(*[F.min(F.when(100 * F.col("below") >= p * F.col("total"), F.col("bucket"))).alias(f"q{p}") for p in (50, HIGH)], F.max("total").alias("total"))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    q = settled(q.select(*key, "total", (F.col(f"q{HIGH}") + SPREAD * (F.col(f"q{HIGH}") - F.col("q50")) + slack[F.col("metric")]).cast("long").alias("fence")))
    at = lambda level, *keys: q.where(F.col("level") == level).select(*keys, "metric", F.col("total").alias(f"n{level}"), F.col("fence").alias(f"f{level}"))
    one = at(2, "lang", "source").join(at(1, "lang"), ["lang", "metric"]).join(at(0), "metric")
    one = one.withColumn("fence", F.when(F.col("n2") >= MIN_GROUP, F.col("f2")).when(F.col("n1") >= MIN_GROUP, F.col("f1")).otherwise(F.col("f0")))
    return one.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col("fence"))).alias(f"fence_{k}") for k in SLACK])


def quality_verdict(measures: DataFrame, fences: DataFrame) -> DataFrame:
    """measures with the rates, and kept: not base_failed, and every rate at or below the fence of its language and
    source (null ones are a group like any other). The fences, one row per group, are counted: up to BROADCAST_GROUPS they
    are broadcast and no row of measures moves; beyond, a group's rows are dealt to SALTS tasks."""
    key = ["__lang", "__source"]
    d = measures.withColumns({"__lang": F.coalesce("__row.lang", F.lit("")), "__source": F.coalesce("__row.source", F.lit("")), **_rates()})
    fences = settled(fences.withColumnsRenamed({"lang": "__lang", "source": "__source"}))
    if fences.count() <= BROADCAST_GROUPS:
        d = d.join(F.broadcast(fences), key, "left")
    else:
        d = d.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)))
        d = d.join(fences.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*key, "__salt"], "left")
    fine = F.lit(True)
    for k in SLACK:
        fine = fine & F.coalesce(F.col(k) <= F.col(f"fence_{k}"), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & fine)


def quality_query(docs: DataFrame) -> DataFrame:
    """The measures and verdict of every document."""
    m = settled(quality_measures(docs, carry=("doc_id", "lang", "source")))
    v = quality_verdict(m, quality_fences(quality_sketch(m)))
    return v.select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they come. What the base rules leave is written once with
    its measures, so texts are measured once and never shuffled."""
    m = settled(quality_measures(docs).where(~F.col("base_failed")))
    return quality_verdict(m, quality_fences(quality_sketch(m))).where("kept").select("__row.*")
