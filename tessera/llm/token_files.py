"""Token-ID output: Arrow files of fixed-size lists, with zero-copy access to equal-length sequences and their masks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, parts, vocabulary_path
from .storage import scratch

SEQUENCE = 1024
#: Sequences in one record batch of a file.
BATCH = 256


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Writer:
    """Writes one shard: ids in lists of `sequence`, the last list padded; masks say which ids are real."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype, sequence: int) -> None:
        self.sequence, self.dtype, self.left = sequence, dtype, np.empty(0, dtype)
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.count += len(ids)
        if self.count >= self.sequence * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([self.left, *self.waiting]) if self.waiting or len(self.left) else self.left
        n = len(ids) if last else len(ids) // (self.sequence * BATCH) * self.sequence * BATCH
        ids, self.left, self.waiting = ids[:n], ids[n:], []
        self.count = len(self.left)
        for k in range(0, n, self.sequence * BATCH):
            part = ids[k : k + self.sequence * BATCH]
            lists = -(-len(part) // self.sequence)
            full = np.zeros(lists * self.sequence, self.dtype)
            full[: len(part)] = part
            mask = np.arange(len(full)) < len(part)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (full, mask)]
            self.file.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.out.close()


def write_token_files(docs: DataFrame, uri: str, vocabulary: str | None = None, shards: int | None = None, sequence: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, each followed by end_id, and writes the id stream of each shard in ascending order of id_col.

    Shards are ranges of ids, so the stream of all shards in order is the stream of all documents. A shard is two Arrow
    files under uri (any store that pyarrow opens and all executors see): `<shard>.arrow` with the sequences, and
    `<shard>.index.arrow` with (doc_id, start, n_tokens) of its documents. A shard's name holds its number, the attempt of its task
    and a random part, nothing is renamed or overwritten, and only names that Spark committed are returned: files of a lost
    or second attempt, or of an earlier write, are never read. A list of the shards is written as `shards.parquet` beside.

    Null texts count as empty (the end id alone); null ids come first; rows with the same id are ordered by text; an
    empty table gives no files. A task holds a few MB of texts and one batch of sequences; a very long text spans sequences.
    A control string of the vocabulary in a text becomes its id, as the library's call has it. Returns the rows of
    `shards.parquet`: (shard int, path string, n_docs long, n_tokens long).
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(uri)
        task = TaskContext.get()
        shard = task.partitionId()
        tag = f"{shard:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        code = encoder(vocabulary)
        writer, docs_ids, counts = None, [], []
        for batch in batches:
            for _, texts in parts(batch):
                for ids in code.encode([x or "" for x in texts]):
                    writer = writer or _Writer(fs, f"{root}/{tag}.arrow", code.dtype, sequence)
                    writer.add(np.append(ids, np.array(end_id, code.dtype)))
                    counts.append(len(ids) + 1)
            docs_ids.append(batch.column(0))
        if writer is None:
            return
        writer.close()
        n = np.array(counts, np.int64)
        index = pa.table([pa.chunked_array(docs_ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)], names=["doc_id", "start", "n_tokens"])
        with fs.open_output_stream(f"{root}/{tag}.index.arrow") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{uri}/{tag}"]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    fs, root = _open(uri)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard int, path string, n_docs long, n_tokens long"
    rows.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{uri}/shards.parquet")
    return spark.read.schema(schema).parquet(f"{uri}/shards.parquet")


def sequences(path: str, memory_map: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of each record batch of a shard, ids as a (lists, sequence) view of the file's memory."""
    fs, name = _open(f"{path}.arrow")
    source = pa.memory_map(name) if memory_map and isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
    with source, pa.ipc.open_file(source) as file:
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            width = batch.schema.field("ids").type.list_size
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True).reshape(-1, width)
            yield ids, batch.column("mask").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _list_at(path: str, column: str, k: int) -> pa.Array:
    fs, name = _open(f"{path}.arrow")
    source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
    return pa.ipc.open_file(source).get_batch(k // BATCH).column(column)[k % BATCH].values  # holds the map open as long as it lives


def sequence(path: str, k: int) -> np.ndarray:
    """The k-th sequence of a shard, by its place alone: a view of the file's memory where the file is mapped, not to be written to."""
    return _list_at(path, "ids", k).to_numpy(zero_copy_only=True)


def mask(path: str, k: int) -> np.ndarray:
    """Which ids of the k-th sequence are real. The file has a bit for each, which are read in place and unpacked (an eighth of the
    bytes that a view of whole bytes would need on disk)."""
    return _list_at(path, "mask", k).to_numpy(zero_copy_only=False)


def read_documents(shards: DataFrame) -> DataFrame:
    """The documents of written shards, read back from the files: doc_id, start (in the stream of all shards),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers). A task reads one batch at a time."""
    total = shards.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = total.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    spread = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _open(row["path"] + ".index.arrow")
                with fs.open_input_file(name) as source:
                    index = pa.ipc.open_file(source).read_all()
                ends = np.cumsum(index.column("n_tokens").to_numpy())
                crcs, at, doc, crc = np.zeros(len(ends), np.int64), 0, 0, 0
                for ids, mask in sequences(row["path"]):
                    flat = ids.reshape(-1)
                    flat = flat[: int(mask.sum())].astype("<u4")
                    low = 0
                    while low < len(flat):
                        high = min(len(flat), int(ends[doc]) - at)
                        crc = zlib.crc32(flat[low:high], crc)
                        if at + high == ends[doc]:
                            crcs[doc], doc, crc = crc, doc + 1, 0
                        low = high
                    at += len(flat)
                starts = index.column("start").to_numpy() + row["base"]
                out = [index.column("doc_id").combine_chunks(), pa.array(starts), index.column("n_tokens").combine_chunks(), pa.array(crcs)]
                yield from pa.table(out, names=["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches(max_chunksize=10_000)

    return placed.repartition(spread, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents written and read back: null, empty and repeated rows, long texts and other columns as in write_token_files."""
    return read_documents(write_token_files(docs, scratch(spark, "token-files")))
