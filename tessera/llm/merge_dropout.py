"""SentencePiece BPE with seeded merge-dropout: varied segmentations that decode to the text byte by byte."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts, vocabulary_path

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Probability that a candidate merge is skipped.
DROPOUT = 0.1
#: Lengths up to which units are merged side by side, and characters of a table of them; longer units go one by one.
LENGTHS, CELLS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256), 1 << 19
_A, _B, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1  # odd factors of the hashes, all bits
_NEVER = np.int32(2**31 - 1)


def draws(base: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The keyed hash of each candidate merge, uniform below 2^64. base: that of seed, document and unit; place: of its first
    character in the unit; piece: the id that it would give."""
    x = base ^ (place.astype(np.uint64) << np.uint64(20) | piece.astype(np.uint64)) * np.uint64(_A)
    x = (x ^ x >> np.uint64(29)) * np.uint64(_B)
    return (x ^ x >> np.uint64(31)) * np.uint64(_A)


class _Pairs:
    """The rank of the piece that two symbols make, looked up for arrays of pairs in an open table of fixed size."""

    def __init__(self, ranks: dict[tuple[int, int], int]) -> None:
        self.bits = max(10, (4 * len(ranks)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NEVER, np.int32)
        for (a, b), rank in ranks.items():
            key = a << 20 | b
            k = (key * _A & _ALL) >> 64 - self.bits
            while self.keys[k] >= 0:
                k = (k + 1) % len(self.keys)
            self.keys[k], self.ranks[k] = key, rank

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        k = ((key.view(np.uint64) * np.uint64(_A)) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[k]
        out = np.where(there == key, self.ranks[k], _NEVER)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            k[rest] = (k[rest] + 1) & len(self.keys) - 1
            there = self.keys[k[rest]]
            found = there == key[rest]
            out[rest[found]] = self.ranks[k[rest[found]]]
            rest = rest[~found & (there >= 0)]
        return out


class Codec:
    """Encodes and decodes with the pieces of a SentencePiece BPE model.

    Pieces never hold a blank after another character, so a text is cut before each run of blanks and each unit is
    merged by itself: the best-ranked candidate comes up first, the leftmost of equals, and is skipped for good if its
    hash says so. The hash is of (seed, document, place of the unit, place of the candidate, piece), so the same seed gives the
    same ids anywhere and every occurrence of a word draws by itself. The units of many texts take a step at a time side
    by side. Without dropout the ids are the library's. A literal U+2581 is a unit that is encoded as bytes, which keeps
    decoding lossless.
    """

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = 0) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = [(i, sp.id_to_piece(i)) for i in range(n) if not sp.is_control(i) and not sp.is_unknown(i)]
        self.byte = {int(p[3:5], 16): i for i, p in kinds if sp.is_byte(i)}
        ids = {p: i for i, p in kinds if not sp.is_byte(i)}
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.bytes_of = [b""] * n
        for p, i in ids.items():
            self.bytes_of[i] = p.replace(BLANK, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        merged = sorted((p for p in ids if len(p) > 1), key=lambda p: -sp.get_score(ids[p]))
        ranks = {x: k for k, x in enumerate(sorted({sp.get_score(ids[p]) for p in merged}, reverse=True))}
        rank_of = {p: ranks[sp.get_score(ids[p])] for p in merged}
        self.piece_of = np.full(len(ranks), -1, np.int32)  # by rank; -1 if several pieces share it
        count = np.bincount(list(rank_of.values()), minlength=len(ranks))
        for p, r in rank_of.items():
            if count[r] == 1:
                self.piece_of[r] = ids[p]
        # Symbols: piece ids; from n on, characters that are no piece but stand in one; the last one is none of all
        symbols = dict(ids)
        for c in sorted({c for p in merged for c in p} - ids.keys()):
            symbols[c] = n + len(symbols) - len(ids)
        self.pieces, self.none = n, n + len(symbols) - len(ids)
        pairs = [(p, (symbols[p[:k]], symbols[p[k:]])) for p in merged for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.pairs = {pair: rank_of[p] for p, pair in pairs}
        self.joined = {pair: ids[p] for p, pair in pairs}
        self.rank = _Pairs(self.pairs)
        self.symbol_of = np.full(0x110000, self.none, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.bound, self.seed = min(int(dropout * 2**64), _ALL), seed

    def _side_by_side(self, sym: np.ndarray, rank: np.ndarray, base: np.ndarray) -> None:
        """Merges units, a row each, in place: sym and rank (of the pair that begins there) have a last column of no symbol;
        a symbol that is merged into the one before it becomes -1."""
        width = sym.shape[1] - 1
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (len(sym), 1))
        before = after - np.int16(2)
        before[:, 0] = width
        row = np.arange(len(sym))
        while len(row):
            at = rank[row].argmin(1)
            best = rank[row, at]
            live = best < _NEVER
            row, at, best = row[live], at[live], best[live]
            piece = self.piece_of[best]
            for x in np.flatnonzero(piece < 0).tolist():  # runs of blanks
                r, i = row[x], at[x]
                piece[x] = self.joined[int(sym[r, i]), int(sym[r, after[r, i]])]
            skipped = draws(base[row], at, piece) < np.uint64(self.bound)
            rank[row[skipped], at[skipped]] = _NEVER
            r, i, piece = row[~skipped], at[~skipped], piece[~skipped]
            j = after[r, i]
            k, h = after[r, j], before[r, i]
            sym[r, i], sym[r, j], rank[r, j] = piece, -1, _NEVER
            after[r, i], before[r, k] = k, i
            rank[r, i] = self.rank(piece, sym[r, k])
            rank[r, h] = self.rank(sym[r, h], piece)

    def _alone(self, sym: list[int], base: int) -> list[int]:
        """The same for one long unit, by an agenda."""
        n, pairs = len(sym), self.pairs
        agenda = [(pairs[p], i, *p) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in pairs]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            rank, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            piece = self.joined[a, b]
            x = base ^ (i << 20 | piece) * _A & _ALL
            x = (x ^ x >> 29) * _B & _ALL
            if (x ^ x >> 31) * _A & _ALL < self.bound:
                continue
            sym[i], sym[j] = piece, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (piece, sym[k])) in pairs:
                    heapq.heappush(agenda, (pairs[p], i, *p))
            h = before[i]
            if h >= 0 and (p := (sym[h], piece)) in pairs:
                heapq.heappush(agenda, (pairs[p], h, *p))
        return sym

    def encode_all(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text; keys: what tells each document's draws from those of others."""
        sizes = np.array([len(t) + bool(t) for t in texts], np.int64)
        chars = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return [np.empty(0, self.dtype) for _ in texts]
        blank, literal = chars == 32, chars == ord(BLANK)
        sym = self.symbol_of[np.where(blank, ord(BLANK), chars)]
        sym[literal] = self.none
        head = np.zeros(len(chars) + 1, bool)
        text_at = np.cumsum(sizes) - sizes
        head[text_at] = True  # of an empty text: the next one's
        head[1:-1] |= blank[1:] & ~blank[:-1] | literal[1:] | literal[:-1]
        start = np.flatnonzero(head[:-1])
        length = np.diff(np.append(start, len(chars)))
        first = np.searchsorted(start, text_at)
        per_text = np.diff(np.append(first, len(start)))
        seeds = np.array([xxhash.xxh64_intdigest(b"%d" % k, self.seed) for k in keys], np.uint64)
        x = np.repeat(seeds, per_text) + (np.arange(len(start)) - np.repeat(first, per_text)).astype(np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(_B)
        base = (x ^ x >> np.uint64(27)) * np.uint64(_A)
        rank = np.full(len(chars), _NEVER, np.int32)
        inside = np.flatnonzero(~head[1:-1])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        order, at = np.argsort(length, kind="stable"), int((length == 1).sum())
        for width in LENGTHS:
            stop = int(np.searchsorted(length[order], width, "right"))
            for k in range(at, stop, CELLS // width):
                units = order[k : min(k + CELLS // width, stop)]
                place = start[units, None] + np.arange(width + 1)
                own = np.arange(width + 1) < length[units, None]
                place = np.where(own, place, 0)
                s, r = np.where(own, sym[place], np.int32(self.none)), np.where(own, rank[place], _NEVER)
                self._side_by_side(s, r, base[units])
                sym[place[own]] = s[own]
            at = stop
        for u in order[at:].tolist():
            a, b = start[u], start[u] + length[u]
            sym[a:b] = self._alone(sym[a:b].tolist(), int(base[u]))
        kept = np.flatnonzero(sym >= 0)
        odd = np.flatnonzero(sym[kept] >= self.pieces)  # no piece: bytes
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[kept[odd]].tolist()]
        times = np.ones(len(kept), np.int64)
        times[odd] = [len(x) for x in raw]
        ids, at = np.repeat(sym[kept], times).astype(self.dtype), np.cumsum(times) - times
        if len(odd):
            where = np.repeat(at[odd], times[odd]) + np.concatenate([np.arange(len(x)) for x in raw])
            ids[where] = np.array([self.byte[x] for x in b"".join(raw)], self.dtype)
        cuts = np.append(at, len(ids))[np.searchsorted(kept, text_at)]
        return [np.empty(0, self.dtype) if not t else ids[a:b] for t, a, b in zip(texts, cuts, [*cuts[1:], len(ids)], strict=True)]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the blank that encoding puts first goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:]


@lru_cache(maxsize=2)
def codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def encode_with_dropout(docs: DataFrame, dropout: float = DROPOUT, seed: int = 0, model: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), lossless (the decoded ids are the text),
    and ids if with_ids. No shuffle. Null texts count as empty and have no ids; null ids draw like document 0; rows with
    the same id and text have the same ids; a very long text is one row, and a task holds a few MB of texts beside it."""
    model = model or vocabulary_path(MODEL)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, dropout, seed)
        for batch in batches:
            for docs_ids, texts in parts(batch):
                rows = []
                texts = [x or "" for x in texts]
                for doc, text, ids in zip(docs_ids, texts, c.encode_all(texts, [x or 0 for x in docs_ids]), strict=True):
                    raw = text.encode()
                    rows.append([doc, len(raw), len(ids), zlib.crc32(ids.astype("<u4")), c.decode(ids) == raw, ids][: len(fields)])
                yield pa.record_batch([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])

    schema = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
