"""Tokens with their places in a text: from ids to bytes, characters and lines through a byte-level vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.byte_pairs import encoder

#: Tokens of a batch that a task gives out.
TOKENS = 50_000
_SPANS = "id string, pos int, token int, char_start int, char_end int, first_line int, last_line int"


@lru_cache(maxsize=2)
def _vocabulary(path: str):  # noqa: ANN202
    """(tokenizer, bytes of each token): a token of a byte-level vocabulary has a character for each byte; an added one is itself."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = {k: len(v.content.encode()) for k, v in t.get_added_tokens_decoder().items()}
    return t, np.array([added.get(k, len(t.id_to_token(k) or "")) for k in range(t.get_vocab_size())], np.int64)


def spans(ids: np.ndarray, lengths: np.ndarray, text: str) -> list[np.ndarray]:
    """[char_start, char_end, first_line, last_line] of each token of a whole text, lines from 1. A token that has a part of a
    character's bytes has the whole character."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    end = np.cumsum(lengths[ids])
    start = end - lengths[ids]
    if len(ids) and end[-1] != len(raw):
        raise ValueError(f"tokens have {end[-1]} bytes, the text has {len(raw)}: not a byte-level vocabulary, or the text was changed")
    char = np.cumsum(raw & 0xC0 != 0x80) - 1  # of each byte
    line = 1 + np.concatenate([[0], np.cumsum(raw == 10)])  # of the place before each byte
    return [char[start], char[end - 1] + 1, line[start], line[end - 1]] if len(ids) else [np.empty(0, np.int64)] * 4


def token_spans(texts: DataFrame, vocabulary: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, char_start, char_end, first_line, last_line) of all tokens of whole texts, as the tokenizers library cuts them.
    vocabulary: the path of a byte-level tokenizer file that all workers can read. Null and empty texts have no rows; repeated rows
    come again; a task holds one text's tokens beyond a batch."""
    d = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lengths = _vocabulary(vocabulary)
        names = [x.split()[0] for x in _SPANS.split(", ")]
        out: list[list] = [[] for _ in names]

        def batch() -> pa.RecordBatch:
            columns = [pa.array([x for x, n in out[0] for _ in range(n)], pa.string()), *(pa.array(np.concatenate(c) if c else np.empty(0), pa.int32()) for c in out[1:])]
            for c in out:
                c.clear()
            return pa.record_batch(columns, names=names)

        held = 0
        for b in batches:
            for k in range(b.num_rows):
                name, text = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], np.int64)
                out[0].append((name, len(ids)))
                for c, x in zip(out[1:], (np.arange(len(ids)), ids, *spans(ids, lengths, text or "")), strict=True):
                    c.append(x)
                held += len(ids)
                if held >= TOKENS:
                    yield batch()
                    held = 0
        yield batch()

    return d.mapInArrow(run, _SPANS)


def chunk_lines(tokens: DataFrame, size: int, overlap: int) -> DataFrame:
    """(id, chunk, n_tokens, char_start, char_end, first_line, last_line) of the windows of `size` tokens that overlap, up to the one that reaches
    a text's end. Each token goes to the windows that hold it and is counted there, with a map-side part, so a text of any length is many
    tasks' work."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = tokens.groupBy(F.col("id").alias("of")).agg(F.max("pos").alias("end"))
    d = tokens.join(last, F.col("id").eqNullSafe(F.col("of")))
    chunks = F.greatest(F.lit(0), F.ceil((F.col("end") + 1 - size) / F.lit(float(step))).cast("int"))  # the last window
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / F.lit(float(step))).cast("int") + 1)
    high = F.least(chunks, F.floor(F.col("pos") / F.lit(float(step))).cast("int"))
    d = d.withColumn("chunk", F.explode(F.sequence(low, high)))
    first = [F.min(c).alias(c) for c in ("char_start", "first_line")]
    return d.groupBy("id", "chunk").agg(F.count("*").alias("n_tokens"), *first, *[F.max(c).alias(c) for c in ("char_end", "last_line")])


_CHUNKS = "id string, chunk int, n_tokens long, char_start int, first_line int, char_end int, last_line int, whole boolean"


def text_chunks(texts: DataFrame, vocabulary: str, size: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """chunk_lines of token_spans, without a row for each token: a text's tokens are with its task, which takes its windows from them. Only
    windows are shuffled, to meet those of other rows of the same id; a row that is shorter than another one of its id also has
    tokens in windows beyond its own last one, which count if the longer one has them."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    d = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, made = _vocabulary(vocabulary)[1], encoder(vocabulary)
        names = [x.split()[0] for x in _CHUNKS.split(", ")]

        def encoded(b: pa.RecordBatch) -> Iterator[tuple]:
            k = 0
            while k < b.num_rows:
                rows, held = [], 0
                while k < b.num_rows and len(rows) < 500 and held < 4 << 20:  # few texts stand beside their ids
                    name, text = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                    rows += [(name, text)] if text else []
                    held, k = held + len(text or ""), k + 1
                yield from ((name, text, ids) for (name, text), ids in zip(rows, made.encode([t for _, t in rows]), strict=True) if len(ids))

        for b in batches:
            found: list[list] = [[] for _ in names]
            for name, text, ids in encoded(b):
                char_start, char_end, first_line, last_line = spans(ids, lengths, text)
                chunk = np.arange((len(ids) - 1) // step + 1)
                a, z = chunk * step, np.minimum(chunk * step + size, len(ids)) - 1
                found[0] += [name] * len(chunk)
                whole = chunk <= max(0, -((size - len(ids)) // step))
                for c, x in zip(found[1:], (chunk, z + 1 - a, char_start[a], first_line[a], char_end[z], last_line[z], whole), strict=True):
                    c.append(x)
            kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.bool_()]
            columns = [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()) if c else [], t) for c, t in zip(found[1:], kinds, strict=True)]
            yield pa.record_batch([pa.array(found[0], pa.string()), *columns], names=names)

    least = [F.min(c).alias(c) for c in ("char_start", "first_line")]
    n = d.mapInArrow(run, _CHUNKS).groupBy("id", "chunk").agg(F.sum("n_tokens").alias("n_tokens"), *least, *[F.max(c).alias(c) for c in ("char_end", "last_line", "whole")])
    return n.where("whole").drop("whole")
