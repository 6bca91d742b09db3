"""Vectors of texts by an encoder that workers load once, over windows of tokens, committed part by part."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import opened_cache, pending

#: Windows that go through the encoder at once, and texts whose windows a task holds.
BATCH, HELD = 64, 256


class Encoder(Protocol):
    """What a worker asks of a model: ids of a text, begin and end ids, and a vector for each token of windows that are
    padded to the longest among them (mask 0)."""

    begin: int
    end: int
    pad: int

    def ids(self, text: str) -> np.ndarray: ...

    def vectors(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


@lru_cache(maxsize=2)
def _loaded(load: Callable[[], Encoder]) -> Encoder:
    return load()


def windows_of(n: int, size: int, overlap: int) -> list[int]:
    """Starts of the windows over n tokens, up to the one that reaches the end; one empty window for none."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    return list(range(0, max(1, n - overlap), size - overlap)) if n > size else [0]


def encode_texts(encoder: Encoder, texts: list[str], size: int, overlap: int, batch: int = BATCH) -> tuple[np.ndarray, list[int]]:
    """(a vector for each text, its number of windows). A text's vector is the mean of its windows', a window's the mean of its
    tokens' with begin and end. Windows of all texts go through in the order of their length, so little is padded."""
    rows = [(k, part) for k, ids in enumerate(map(encoder.ids, texts)) for start in windows_of(len(ids), size, overlap) for part in [ids[start : start + size]]]
    rows.sort(key=lambda r: len(r[1]))
    total, count = None, np.zeros(len(texts), np.int64)
    for at in range(0, len(rows), batch):
        some = rows[at : at + batch]
        wide = len(some[-1][1]) + 2
        ids, mask = np.full((len(some), wide), encoder.pad, np.int64), np.zeros((len(some), wide))
        for r, (_, part) in enumerate(some):
            ids[r, : len(part) + 2] = [encoder.begin, *part, encoder.end]
            mask[r, : len(part) + 2] = 1
        means = (encoder.vectors(ids, mask) * mask[:, :, None]).sum(1) / mask.sum(1)[:, None]
        total = np.zeros((len(texts), means.shape[1])) if total is None else total
        owner = np.array([k for k, _ in some])
        np.add.at(total, owner, means)
        count += np.bincount(owner, minlength=len(texts))
    return (np.zeros((0, 0)) if total is None else total / count[:, None]), count.tolist()


def encoded(texts: DataFrame, load: Callable[[], Encoder], size: int = 510, overlap: int = 256, transform: Callable[[Column], Column] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n_windows, vector) of each text. load: makes the encoder, once a worker; transform: what is done to a text before, as a
    column. Null texts count as empty, and an empty text has one window of begin and end. A task holds the ids of HELD texts; a
    very long text is many windows, all of them read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = texts.select(F.col(id_col).cast("string").alias("id"), (transform(text) if transform else text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(load)
        for b in batches:
            for k in range(0, b.num_rows, HELD):
                part = b.slice(k, HELD)
                vectors, count = encode_texts(encoder, [x or "" for x in part.column("text").to_pylist()], size, overlap)
                yield pa.record_batch([part.column("id"), pa.array(count, pa.int64()), pa.array(list(vectors), pa.list_(pa.float64()))], names=["id", "n_windows", "vector"])

    return d.mapInArrow(run, "id string, n_windows long, vector array<double>")


def encoded_into(texts: DataFrame, load: Callable[[], Encoder], path: str, metadata: dict[str, str], parts: int = 16, id_col: str = "id", **how: object) -> DataFrame:
    """The cache at path (id, n_windows, vector, part), in which every text of `texts` has a vector now. metadata: what made the
    vectors (model, windows, normalisation); a cache that was made with anything else is an error.

    Ids are dealt to `parts` parts by hash, and a part is written before the next one is encoded, so a run that is killed has lost one part at
    most, and the next run asks the encoder for what is missing alone. Each id is there once, whatever was killed when; of rows that share an id, one
    is encoded (the one with the least text)."""
    spark = texts.sparkSession
    known = metadata | {"parts": str(parts)}
    if opened_cache(spark, path, known) is None:
        spark.createDataFrame(sorted(known.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/metadata")
        spark.createDataFrame([], "id string, n_windows long, vector array<double>, part int").write.mode("append").partitionBy("part").parquet(f"{path}/vectors")
    schema = "id string, n_windows long, vector array<double>, part int"
    there = spark.read.schema(schema).parquet(f"{path}/vectors")
    text_col = str(how.get("text_col", "text"))
    one = texts.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(F.col(text_col).cast("string")).alias("text"))
    one = one.where("id is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    rest = {k: v for k, v in how.items() if k != "text_col"}
    for part in [r.part for r in pending(one.select("id", "part"), there, "id").select("part").distinct().orderBy("part").collect()]:  # `parts` rows at most
        left = pending(one.where(F.col("part") == part), there.where(F.col("part") == part), "id")
        vectors = encoded(left, load, **rest).withColumn("part", F.lit(part))
        vectors.write.mode("append").partitionBy("part").parquet(f"{path}/vectors")
        there = spark.read.schema(schema).parquet(f"{path}/vectors")
    return there


class HashedEncoder:
    """A small encoder without a model: a word's id comes from its length and first letter, an id's vector from a rule."""

    begin, end, pad = 0, 1, 2

    def __init__(self, dimensions: int = 4) -> None:
        self.dimensions = dimensions

    def ids(self, text: str) -> np.ndarray:
        return np.array([3 + (31 * len(w) + ord(w[0])) % 1000 for w in text.replace("\n", " ").split(" ") if w], np.int64)

    def vectors(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        k = np.arange(self.dimensions) + 3
        return (ids[:, :, None] * k % 17) / 17.0 - 0.5
