"""Byte-level BPE ids of whole texts with the tokenizers library; words that come again are encoded once per worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from ..functions.byte_pairs import Encoder, encoder  # noqa: F401

VOCABULARY = "byte_bpe_50k.json"
#: Rows and bytes of text that a worker holds as Python strings at a time (one text may be larger).
PART_ROWS, PART_BYTES = 500, 4 << 20


def parts(batch: pa.RecordBatch, text: int = 1, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[list[list]]:
    """The columns of a batch as lists, some rows at a time: at most `rows`, and at most `size` bytes of the text column
    unless a single text is larger. text: the place of that column."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).cast(pa.int64()))
    ends, k = np.cumsum(lengths), 0
    while k < batch.num_rows:
        stop = max(k + 1, min(k + rows, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right"))))
        yield [c.slice(k, stop - k).to_pylist() for c in batch.columns]
        k = stop


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
