"""Exact substring dedup: suffix arrays of content-defined shards by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts as pieces
from .sliding import gram_hashes, runs, slide
from .storage import settled

LENGTH = 400
#: Bytes of the grams that deal strings to shards: each string of LENGTH goes where its smallest gram hash says.
GRAM = 200
#: Bytes of distinct segments under one gram beyond which its strings are compared one by one, and bytes of an array.
HOT_BYTES, ARRAY_BYTES = 1 << 22, 1 << 20
#: Names up to which the reduced string is sorted by ranks instead of another level of induced sorting.
SHORT = 1 << 16


# ---- suffix arrays

def _fill(sa: np.ndarray, t: np.ndarray, kept: np.ndarray, heads: np.ndarray, sizes: np.ndarray, rising: bool) -> None:
    """One inducing pass. Rising: places larger suffixes (kept) from those in sa, bucket by bucket from the smallest;
    falling: places smaller ones from the largest bucket. A bucket's own new entries are the next round's front."""
    step = 1 if rising else -1
    at = heads.copy()  # next free place of each bucket
    for c in range(len(sizes)) if rising else range(len(sizes) - 1, -1, -1):
        low, high = (heads[c], heads[c] + sizes[c]) if rising else (heads[c] - sizes[c] + 1, heads[c] + 1)
        done = heads[c]
        while True:
            front = sa[done : at[c]] if rising else sa[at[c] + 1 : done + 1][::-1]
            done = at[c]
            if not len(front):
                break
            _put(sa, t, kept, front, at, step)
        rest = sa[at[c] : high] if rising else sa[low : at[c] + 1][::-1]
        rest = rest[rest >= 0]
        if len(rest):
            _put(sa, t, kept, rest, at, step)


def _put(sa: np.ndarray, t: np.ndarray, kept: np.ndarray, front: np.ndarray, at: np.ndarray, step: int) -> None:
    before = front[front > 0] - 1
    before = before[kept[before]]
    if not len(before):
        return
    order = np.argsort(t[before], kind="stable")
    before = before[order]
    keys = t[before]
    first, last = runs(keys)
    count = last - first + 1
    buckets = keys[first]
    sa[np.repeat(at[buckets], count) + step * (np.arange(len(before)) - np.repeat(first, count))] = before
    at[buckets] += step * count


def _ranked(names: np.ndarray) -> np.ndarray:
    """Suffix array of a short string of names, by doubling the length that ranks cover; ranks that are settled drop out."""
    n = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    open_, h = order, 1
    while len(open_):
        key = rank[open_] * (n + 1) + np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        open_, key = open_[o], key[o]
        first, last = runs(key)
        # a group keeps the ranks from its old rank on: old rank + place among those of the same old rank
        old = rank[open_]
        group = np.repeat(first, last - first + 1)
        start = np.repeat(runs(old)[0], np.diff(np.append(runs(old)[0], len(old))))
        rank[open_] = old + group - start
        open_ = open_[np.repeat(last > first, last - first + 1)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of the reduced string, by the same induced sorting: its alphabet is as large as itself, so each name is
    written as two digits, whose string has the same order at even places, and the buckets stay few. SHORT names end it."""
    if len(names) <= SHORT:
        count = np.bincount(names)
        return _ranked((np.cumsum(count) - count)[names])
    base = int(np.sqrt(int(names.max()) + 1)) + 1
    digits = np.stack([names // base, names % base], axis=1).ravel() + 1
    sa = suffix_array(np.append(digits, 0))
    return sa[(sa % 2 == 0) & (sa < 2 * len(names))] // 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers, the last of which is the only 0. Induced sorting: suffixes are
    classed as smaller (S) or larger (L) than the next one; the leftmost S ones are sorted by their substrings, the
    string of their names is sorted in turn by this function, and two passes induce the rest. Each pass takes a bucket's
    entries at once.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.uint16)
    change = np.flatnonzero(t[1:] != t[:-1])
    up = np.zeros(n, bool)
    up[-1] = True
    if len(change):
        kinds = t[change] < t[change + 1]
        up[: change[-1] + 1] = np.repeat(kinds, np.diff(np.concatenate([[-1], change])))
    starts = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    sizes = np.bincount(t, minlength=int(t.max()) + 1)
    first = np.cumsum(sizes) - sizes
    last = first + sizes - 1

    def induced(lms: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        keys = t[lms]
        order = np.argsort(keys, kind="stable")
        lms = lms[order]
        low, high = runs(t[lms])
        count = high - low + 1
        sa[np.repeat(last[t[lms[low]]] + 1 - count, count) + np.arange(len(lms)) - np.repeat(low, count)] = lms
        _fill(sa, t, ~up, first, sizes, True)
        sa[sa >= 0] = np.where(up[sa[sa >= 0]], -1, sa[sa >= 0])
        sa[0] = n - 1
        _fill_small(sa)
        return sa

    def _fill_small(sa: np.ndarray) -> None:
        _fill(sa, t, up, last, sizes, False)
        sa[0] = n - 1

    sa = induced(starts)
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    sorted_ = sa[is_start[sa]]
    place = np.full(n, -1, np.int64)
    place[starts] = np.arange(len(starts))
    ends = np.append(starts[1:], n - 1)
    lengths = ends - starts + 1
    k = place[sorted_]
    same = lengths[k[1:]] == lengths[k[:-1]]
    pair = np.flatnonzero(same)
    depth = 0
    while len(pair):  # compare neighbours of equal length, a character of all at a time
        a, b = sorted_[pair] + depth, sorted_[pair + 1] + depth
        inside = depth < lengths[k[pair]]
        equal = (t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)]) | ~inside
        same[pair[~equal]] = False
        pair = pair[equal & inside]
        depth += 1
    names = np.empty(len(starts), np.int64)
    ids = np.concatenate([[0], np.cumsum(~same)]) if len(starts) else np.empty(0, np.int64)
    names[k] = ids
    if len(starts) and ids[-1] + 1 < len(starts):
        starts_sorted = starts[_sorted_names(names)]
    else:
        starts_sorted = sorted_
    return induced(starts_sorted)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, cap: int, sample: int = 16) -> np.ndarray:
    """Common prefix, up to cap, of each suffix (in text order) with the one before it in the array. Each sample-th is
    compared in full, up to cap + sample; the others start from what the one to the left leaves, one less each step."""
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    wide = np.concatenate([t.astype(np.uint64), np.zeros(4, np.uint64)])
    four = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)  # from each place
    out = np.zeros(n, np.int64)

    def extend(i: np.ndarray, most: int) -> None:
        """Four characters at a time; the last character of t is like no other, so no comparison runs past it."""
        i = i[phi[i] >= 0]
        while len(i):
            differ = four[i + out[i]] ^ four[phi[i] + out[i]]
            equal = differ == 0
            out[i[equal]] += 4
            rest = ~equal
            for k in (16, 32, 48):
                out[i[rest]] += (differ[rest] & np.uint64((1 << k) - 1)) == 0
            i = i[equal]
            i = i[out[i] < most]

    base = np.arange(0, n, sample)
    extend(base, cap + sample)
    rest = np.arange(n)
    rest = rest[rest % sample > 0]
    out[rest] = np.maximum(out[rest - rest % sample] - rest % sample, 0)
    out[phi < 0] = 0
    extend(rest[out[rest] < cap], cap)
    return out


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of distinct segments, whether the string of `length` bytes at each place occurs at another place of
    these segments (places with fewer bytes left are not judged)."""
    sizes = np.array([len(s) + 1 for s in segments])
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes) - 1
    t[ends] = 1
    t = np.append(t, 0)
    sa = suffix_array(t)
    shared = permuted_lcp(t, sa, length) >= length
    marked = shared.copy()
    before = sa[:-1][shared[sa[1:]]]
    marked[before] = True
    cuts = np.cumsum(sizes)[:-1]
    # a separator within the first `length` is the same in both, so it is judged by the room that is left
    return [m[: max(0, len(s) - length + 1)] for m, s in zip(np.split(marked[:-1], cuts), segments, strict=True)]


# ---- the Spark job

def segments_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start, repeats) of the runs of strings of `length` whose smallest gram hash is the same;
    repeats: that gram occurs more than once in data, so strings of the run may equal each other."""
    h = gram_hashes(data, gram)
    width = length - gram + 1
    low = slide(h, width)
    first, last = runs(low)
    key = low[first]
    pad = np.zeros(width - 1, np.uint64)
    anchors = np.sort(h[slide(np.concatenate([pad, low, pad]), width, np.maximum) == h])
    return key, first, last, np.isin(key, anchors[1:][anchors[1:] == anchors[:-1]])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _list_runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["h", "d", "doc_id", "th", "s1", "s2", "again"]
    for batch in batches:
        ids, hashes, texts = (c.to_pylist() for c in batch.columns)
        for k in range(0, len(texts), 200):
            columns: list[list] = [[] for _ in names]
            for doc, th, text in zip(ids[k : k + 200], hashes[k : k + 200], texts[k : k + 200], strict=True):
                raw = _raw(text)
                if len(raw) < length:
                    continue
                key, first, last, again = segments_of(np.frombuffer(raw, np.uint8), length, gram)
                digest = [xxhash.xxh3_128_digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                columns[0].append(_signed(key))
                columns[1] += digest
                columns[2] += [doc] * len(key)
                columns[3].append(np.full(len(key), th, np.int64))
                for c, v in zip(columns[4:], (first, last, again), strict=True):
                    c.append(v)
            join = lambda c, kind: np.concatenate(c).astype(kind) if c else np.empty(0, kind)
            arrays = [pa.array(join(columns[0], np.int64)), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(join(columns[3], np.int64)), pa.array(join(columns[4], np.int32)), pa.array(join(columns[5], np.int32)), pa.array(join(columns[6], bool))]
            yield pa.record_batch(arrays, names=names)


def _marks_of_arrays(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, d, i, j): intervals of repeated starts, by one suffix array for whole groups of h up to ARRAY_BYTES."""
    waiting: list[tuple[int, bytes, bytes]] = []
    size, now = 0, None

    def judged() -> pa.RecordBatch:
        rows: list[tuple[int, bytes, int, int]] = []
        if waiting:
            for (h, d, _), marked in zip(waiting, repeated_starts([s for _, _, s in waiting], length), strict=True):
                first, last = runs(marked)
                rows += [(h, d, a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if marked[a]]
            waiting.clear()
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["h", "d", "i", "j"])

    for batch in batches:
        for h, d, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != now and size > ARRAY_BYTES:
                yield judged()
                size = 0
            now = h
            waiting.append((h, d, content))
            size += len(content)
    yield judged()


def _cut(parts: list[dict], raw: bytes, length: int) -> list[bytes]:
    return [raw[p["s1"] : p["s2"] + length] for p in parts]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, spans): for documents with a string of `length` bytes that starts at two places of the table, the
    byte spans [a, b) that such strings cover, unmerged. docs: doc_id, th (hash of the text), text.

    A string goes to the key of its smallest gram hash, so equal strings meet under one key. Keys that only one segment
    has are dropped after one narrow shuffle. Equal segments, by 128 bits beside the key, are collapsed, and marked at once if there are several;
    distinct ones under a key are compared by a suffix array. A key with more than HOT_BYTES of distinct segments deals
    its strings out by a 128-bit hash each instead, so no group has to fit into one task.
    """
    found = settled(docs.mapInArrow(lambda it: _list_runs(it, length, gram), "h long, d binary, doc_id long, th long, s1 int, s2 int, again boolean"))
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.max("again").alias("again"), (F.min("d") != F.max("d")).alias("varied")).where("n > 1 or again").select("h", F.expr("again or varied").alias("sort"))
    members = settled(found.join(shared, "h").select("h", "d", "doc_id", "th", "s1", "s2", "sort"))
    kinds = members.groupBy("h", "d", "sort").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "s1", "s2")).alias("at"))
    kinds = settled(kinds.select("h", "d", "sort", "n", "at.*"))
    whole = kinds.where("n > 1").select("h", "d", F.lit(0).cast("long").alias("i"), (F.col("s2") - F.col("s1")).cast("long").alias("j"))
    sizes = kinds.where("sort").groupBy("h").agg((F.sum(F.col("s2") - F.col("s1") + length) > HOT_BYTES).alias("hot"))
    compared = kinds.where("sort").join(sizes, "h")
    parts = compared.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "d", "s1", "s2", "hot")).alias("parts"))
    texts = docs.join(parts, docs["doc_id"].eqNullSafe(parts["doc_id"]) & (docs["th"] == parts["th"])).select(docs["text"], "parts")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in (x for batch in batches for x in pieces(batch, 0, rows=200, size=2 << 20)):
            for text, rows in zip(*columns, strict=True):
                content = _cut(rows, _raw(text), length)
                yield pa.record_batch([pa.array([r["h"] for r in rows], pa.int64()), pa.array([r["d"] for r in rows], pa.binary()), pa.array([r["hot"] for r in rows], pa.bool_()), pa.array(content, pa.binary())], names=["h", "d", "hot", "content"])

    cut = texts.mapInArrow(contents, "h long, d binary, hot boolean, content binary").dropDuplicates(["h", "d"])
    cut = settled(cut)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, d, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(content) - length + 1
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)]), np.int64).reshape(n, 2)
                yield pa.record_batch([pa.array(np.full(n, h)), pa.array([d] * n, pa.binary()), pa.array(np.arange(n)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["h", "d", "i", "x", "y"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by bytes: sorting costs far more than reading
    sorted_ = cut.where("not hot").select("h", "d", "content").repartition(tasks, "h").sortWithinPartitions("h", "d")
    marks = sorted_.mapInArrow(lambda it: _marks_of_arrays(it, length), "h long, d binary, i long, j long")
    dealt = cut.where("hot").select("h", "d", "content").mapInArrow(strings, "h long, d binary, i long, x long, y long")
    twice = dealt.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    marks = marks.unionByName(dealt.join(twice, ["x", "y"]).select("h", "d", "i", F.col("i").alias("j"))).unionByName(whole)
    spans = members.join(marks, ["h", "d"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct((F.col("s1") + F.col("i")).cast("long").alias("a"), (F.col("s1") + F.col("j") + length).cast("long").alias("b"))).alias("spans"))
    return settled(spans)


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans in order, with those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removed(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        raw = _raw(text)
        cut = merged(found if found is not None else [])
        kept, at = [], 0
        for a, b in cut:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        rows.append((sum(b - a for a, b in cut), len(cut), hashlib.sha256(b"".join(kept)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])


def suffix_dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. Null texts are empty; a repeated row repeats all of
    its strings; ids may be null or repeat (a row's text tells rows of one id apart)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(d)
    spans = spans.select(F.col("doc_id").alias("k"), F.col("th").alias("kth"), "spans")
    j = d.join(spans, d["doc_id"].eqNullSafe(spans["k"]) & (d["th"] == spans["kth"]), "left")
    removed = F.pandas_udf(_removed, "n_removed long, n_spans long, kept_sha256 string")
    j = j.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.when(F.col("spans").isNull(), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("whole"), removed(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")).alias("r"))
    return j.select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", F.coalesce("whole", "r.kept_sha256").alias("kept_sha256"))
