"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import parts
from .components import components
from .storage import settled

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 2
#: Hashes that are unpacked to bits at a time.
_BLOCK = 1 << 14


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]), np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        counts += np.unpackbits(hashes[k : k + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with fp in place of their last column, text; a few MB of texts are Python strings at a time."""
    for batch in batches:
        last = batch.num_columns - 1
        fp = [fingerprint_of(x) for columns in parts(batch, last) for x in columns[last]]
        yield pa.record_batch([*batch.columns[:last], pa.array(fp, pa.int64())], names=[*batch.schema.names[:last], "fp"])


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """rows (columns of longs, text last) with fp in place of the text."""
    names = rows.columns[:-1]
    return rows.mapInArrow(_printed, ", ".join(f"{c} long" for c in (*names, "fp")))


def _ball(value: str, bits: int, radius: int) -> Column:
    """Array of all values within radius 0 or 1 of a segment."""
    near = [F.col(value)] + [F.col(value).bitwiseXOR(F.lit(1 << k)) for k in range(bits)] * (radius > 0)
    return F.array(*near)


def fingerprint_links(prints: DataFrame, col: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most `distance` (3 or less) bits apart, each once.

    The 64 bits are two segments of 32. Of at most three differing bits, one segment has at most one, so the table of
    each segment is probed with the 33 values of that segment's Hamming ball of radius one, and the full distance is
    verified in the join. Segments of 32 bits keep a table slot down to fingerprints that are close anyway: random
    ones meet there once in 2^32, which holds up where tables of 16-bit slots would pair N^2 / 2^16 rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one cover distances up to 3")
    p = prints.select(F.col(col).alias("fp")).distinct()
    segment = {0: F.shiftrightunsigned("fp", 32), 1: F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))}
    table = p.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("v")) for s, v in segment.items()])).alias("x"))
    table = table.select("fp", "x.seg", "x.v")
    probe = table.select(F.col("fp").alias("q"), "seg", F.explode(_ball("v", 32, distance // SEGMENTS)).alias("v"))
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= distance
    return probe.join(table, ["seg", "v"]).where((F.col("q") < F.col("fp")) & near).select(F.col("q").alias("a"), F.col("fp").alias("b")).distinct()


def print_groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (doc_id, fp, ...) with component_id: the smallest id of all rows whose fingerprints are linked, directly or over
    others. Fingerprints are the nodes, so a row without an id carries links on, and rows that share an id are apart unless their
    fingerprints are linked; where no row has an id, component_id is null."""
    classes = components(fingerprint_links(prints, distance=distance), "a", "b")
    classes = prints.select("fp").distinct().join(classes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("class"))
    named = prints.join(classes, "fp")
    least = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp").groupBy("class").agg(F.min("least").alias("component_id")))
    return named.join(least, "class").drop("class")


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), component_id: the smallest id that a document reaches over links of fingerprints.

    Copies share a fingerprint and count as one node, so a group of any size costs its members once. Null, empty and wordless texts have
    fingerprint zero and link like any other; very long texts are read whole; repeated rows stay; null ids and shared ids as in
    print_groups; an empty table gives no rows; other columns, whatever their names, are ignored."""
    prints = settled(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    return print_groups(prints, distance).select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    g = simhash_groups(docs)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near-duplicates, columns as they come: the one with the smallest id, a null id only
    if the group has no other, then the one whose columns hash lowest; of equal rows, one stays.

    Here fingerprints are the nodes, so documents without an id, or that share one without being alike, are told apart."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = settled(with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("id"), row.alias("row"), F.col("text").cast("string").alias("text"))))
    links = fingerprint_links(prints, distance=distance)
    groups = prints.join(components(links, "a", "b"), F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("group"))
    keep = groups.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).select(F.coalesce("best.id", F.lit(0)).alias("__kept_id"), F.col("best.none").alias("__kept_none"), F.col("best.row").alias("__kept_row"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")  # the columns of docs may have any names
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNull().alias("none"), row.alias("row"), whole)
    d = d.join(keep, (F.col("id") == F.col("__kept_id")) & (F.col("none") == F.col("__kept_none")) & (F.col("row") == F.col("__kept_row")), "left_semi")
    return d.dropDuplicates(["id", "none", "row"]).select("whole.*")
