"""Harmonic packing of token ids into sequences: every worker fills the bins of each class on its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, parts, vocabulary_path

CAPACITY = 1024
#: Pieces below capacity / SMALLEST_CUT are not cut further.
SMALLEST_CUT = 16
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pieces(n: int, capacity: int = CAPACITY, smallest_cut: int = SMALLEST_CUT) -> list[int]:
    """Lengths that a document of n tokens is cut into: whole sequences, then halves, quarters ... of one, each at most
    once and down to capacity / smallest_cut, then the rest (shorter than that) as it is."""
    out, k = [capacity] * (n // capacity), 2
    n %= capacity
    while k <= smallest_cut and n:
        if n >= capacity // k:
            out.append(capacity // k)
            n -= capacity // k
        k *= 2
    return out + [n] * bool(n)


class Bins:
    """Open bins of one worker, one for each class. A piece of length l is of class capacity // l = k, and k pieces of
    class k fill a bin. What is left in bins that never fill is repacked at the end, longest first."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def put(self, piece: tuple) -> list[tuple[int, int, tuple]]:
        """Adds (length, ...); the placements (sequence, offset, piece) of the bin that became full, if one did."""
        k = self.capacity // piece[0]
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        return self._close(self.open.pop(k)) if len(waiting) == k else []

    def _close(self, members: list[tuple]) -> list[tuple[int, int, tuple]]:
        out, at = [], 0
        for piece in members:
            out.append((self.next_id, at, piece))
            at += piece[0]
        self.next_id += 1
        return out

    def finish(self) -> list[tuple[int, int, tuple]]:
        """Places the rest: at most one part-filled bin's worth for each class, first fit by falling length."""
        rest = sorted((p for members in self.open.values() for p in members), key=lambda p: -p[0])
        bins: list[list] = []
        for piece in rest:
            for b in bins:
                if b[0] + piece[0] <= self.capacity:
                    b[0] += piece[0]
                    b[1].append(piece)
                    break
            else:
                bins.append([piece[0], [piece]])
        self.open = {}
        return [x for _, members in bins for x in self._close(members)]


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids).

    No shuffle: each task packs the rows it reads; what it keeps open is below two sequences for each class, and a
    sequence id carries the partition in its upper bits. A padded sequence ends a task's class at most, and repacking
    leaves about one of those a task. Null texts count as empty: one piece with the end id. Null and repeated ids are
    kept, row by row; an empty table gives no rows. A task holds a few MB of texts at a time; a very long text is one document
    with many pieces. A control string of the vocabulary in a text becomes its id, as the library's call has it.
    """
    vocabulary = vocabulary or vocabulary_path()
    fields = FIELDS + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        rows: list[list] = []

        def emit(placed: list[tuple[int, int, tuple]]) -> None:
            for sequence_id, offset, (length, doc, start, crc, total, ids) in placed:
                rows.append([doc, start, length, crc, total, sequence_id, offset, ids][: len(fields)])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[x for x, _ in fields])

        for batch in batches:
            for docs_ids, texts in parts(batch):
                for doc, ids in zip(docs_ids, code.encode([x or "" for x in texts]), strict=True):
                    ids, text_ids = np.full(len(ids) + 1, end_id, "<u4"), ids
                    ids[:-1] = text_ids
                    start = 0
                    for length in pieces(len(ids), capacity):
                        part = ids[start : start + length]
                        emit(bins.put((length, doc, start, zlib.crc32(part), len(ids), part if with_ids else None)))
                        start += length
                if len(rows) > 5000:
                    yield flush()
        emit(bins.finish())
        yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
