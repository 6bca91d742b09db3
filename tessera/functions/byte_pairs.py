"""Byte-level BPE ids of whole texts with the tokenizers library; words that come again are encoded once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: White space other than blank and line feed, and the mark of the cuts: a text that holds one of these is encoded whole.
_ODD_ASCII = [chr(x) for x in (0, 9, 11, 12, 13, 28, 29, 30, 31)]
_ODD_OTHER = [chr(x) for x in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_PAIRS = [a + b for a in " \n" for b in " \n"]
_RUN = re.compile("[ \n]{3}|[ \n]{2}$")


class Encoder:
    """encode(texts) -> one array of ids per text, equal to the library's ids of the whole text.

    The pre-tokenizer never lets a piece run from a non-space into white space, so a text is cut before each blank or
    line feed, and a distinct unit is encoded once and kept. That is exact while a run of white space has one or two
    characters (the last one always starts a piece or joins the next word); texts with longer runs, runs at the end,
    other white space or a control string of the vocabulary take the library's path whole. New units are encoded many in a
    row: the ids are cut again where a token starts with a blank or line feed.

    Units are kept in two generations of about max_units each, some 200 bytes a unit (40 MB in all at the default); the
    older one goes when the younger one is full.
    """

    def __init__(self, path: str, max_units: int = 100_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.controls = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "")[:1] in ("Ġ", "Ċ") for i in range(size)])
        self.max_units, self.young, self.old = max_units, {}, {}

    def _whole(self, text: str) -> bool:
        """Whether the text must not be cut into units."""
        odd = _ODD_ASCII if text.isascii() else _ODD_ASCII + _ODD_OTHER
        return any(x in text for x in odd) or any(x in text for x in self.controls) or any(x in text for x in _PAIRS) and bool(_RUN.search(text))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_a_row(self, units: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        cuts = np.flatnonzero(self.starts[ids]) * self.dtype.itemsize
        if len(cuts) != len(units):
            return self._library(units)
        whole, cuts = ids.tobytes(), [*cuts.tolist(), ids.nbytes]
        return [whole[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, fresh: set[str]) -> None:
        """Puts units that the young generation lacks into it."""
        young, old = self.young, self.old
        back = fresh.intersection(old)
        young.update({x: old[x] for x in back})
        fresh -= back
        row = [x for x in fresh if x[:1] != "\0" and x and x != "\n"]
        rest = [x for x in fresh if x[:1] == "\0" or not x or x == "\n"]
        young.update(zip(rest, self._library([x[1:] if x[:1] == "\0" else x or " " for x in rest]), strict=True))
        for k in range(0, len(row), 2000):
            part = row[k : k + 2000]
            young.update(zip(part, self._in_a_row([x if x[0] == "\n" else " " + x for x in part]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > self.max_units:
            self.old, self.young = self.young, {}
        cut: list[list[str] | None] = []
        fresh: set[str] = set()
        for text in texts:
            if self._whole(text):
                cut.append(None)
                continue
            # a unit is what follows a blank, or a line feed and what follows it; the first one of a text has a mark before it
            units = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
            units[0] = "\0" + units[0]
            cut.append(units)
            fresh.update(units)
        fresh.difference_update(self.young)
        if fresh:
            self._learn(fresh)
        get = self.young.__getitem__
        ids = [b"".join(map(get, units)) if units is not None else self._library([x])[0] for x, units in zip(texts, cut, strict=True)]
        return [np.frombuffer(x, dtype=self.dtype) for x in ids]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path)
