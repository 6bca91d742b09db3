"""WARC archives: a writer with revisits, and a reader that salvages what it can of damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts
from .storage import scratch, settled

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Bytes of an archive after which a task starts another, and bytes read at a time.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
#: Revisits (some 100 bytes each) up to which their list is broadcast.
BROADCAST_REVISITS = 250_000
#: Longest header of a record.
HEADER = 1 << 16
DATE = "2000-01-01T00:00:00Z"
_URL = "%/:=&?~#+!$,;'@()*[]"
_SYNC = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION = re.compile(rb"WARC/1\.\d+\r\n")


class Damaged(Exception):
    """A record that fails a check; the text says which."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    payload: bytes = b""
    http: dict[str, str] = field(default_factory=dict)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record, not compressed: a response with its payload, or a revisit that has the HTTP header alone. The page's id is
    in the record's URN; a url's bytes outside printable ASCII are percent-encoded, so it cannot end a header."""
    name = lambda k: f"<urn:page:{'null' if k is None else k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or 'about:blank', safe=_URL, errors='surrogatepass')}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    """Names (lower case) and values; a line that begins with white space goes on the one before."""
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged("header line")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _matches(digest: str, data: bytes) -> bool:
    """Whether data has a digest, written as hex or base32; digests of other kinds are not judged."""
    kind, _, value = digest.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5") or not value:
        return True
    found = hashlib.new(kind.lower(), data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def parse_header(raw: bytes) -> tuple[dict[str, str], int]:
    """(headers, bytes of the header) of what begins with a version line."""
    if not _VERSION.match(raw):
        raise Damaged("version line")
    end = raw.find(b"\r\n\r\n", 0, HEADER)
    if end < 0:
        raise Damaged("header without end")
    first = raw.index(b"\r\n")
    headers = _headers(raw[first + 2 : end]) if end > first else {}
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers:
        raise Damaged("length or type missing")
    return headers, end + 4


def checked(headers: dict[str, str], block: bytes, after: bytes) -> Record:
    """The record of a header and its block, if the block ends where it should and has the digests it claims."""
    if len(block) < int(headers["content-length"]):
        raise Damaged("short block")
    if after != b"\r\n\r\n":
        raise Damaged("end of record")
    if not _matches(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest")
    record = Record(headers["warc-type"].lower(), headers, block, block)
    if headers.get("content-type", "").startswith("application/http"):
        head, blank, record.payload = block.partition(b"\r\n\r\n")
        if blank:
            try:
                record.http = _headers(head.partition(b"\r\n")[2]) if b"\r\n" in head else {}
            except Damaged:
                record.http = {}
    if record.kind != "revisit" and not _matches(headers.get("warc-payload-digest", ""), record.payload):
        raise Damaged("payload digest")
    return record


class _File:
    """Reads at any place of a file, through a buffer of one chunk."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.size, self.start, self.held = source, source.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.source.seek(at)
            self.start, self.held = at, self.source.read(max(n, CHUNK))
        return self.held[at - self.start : at - self.start + n]


def _member(file: _File, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at a place; its checksum and length are checked."""
    inflate, out, end, begun = zlib.decompressobj(31), [], at, b""
    while not inflate.eof:
        piece = file.read(end, min(CHUNK, file.size - end))
        if not piece:
            raise Damaged("member without end")
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            raise Damaged("gzip member") from None
        end += len(piece)
        if len(begun) < 7:
            begun = b"".join(out)[:7]
            if not b"WARC/1.".startswith(begun):
                raise Damaged("version line")
    return b"".join(out), end - len(inflate.unused_data)


def _of_member(content: bytes) -> Iterator[tuple[Record | None, str]]:
    """The records of a member's content; (None, reason) for what fails, after which the next version line that
    begins a sound record goes on."""
    at, lost = 0, False
    while at < len(content):
        try:
            headers, size = parse_header(content[at : at + HEADER])
            end = at + size + int(headers["content-length"])
            record = checked(headers, content[at + size : end], content[end : end + 4])
        except Damaged as why:
            if not lost:
                yield None, str(why)
            lost = True
            found = re.compile(rb"WARC/1\.").search(content, at + 1)
            at = found.start() if found else len(content)
            continue
        yield record, ""
        at, lost = end + 4, False


def _plain(file: _File, at: int) -> tuple[Record, int]:
    """(record, end) of the record that is not compressed at a place."""
    headers, size = parse_header(file.read(at, min(HEADER, file.size - at)))
    n = int(headers["content-length"])
    if at + size + n + 4 > file.size:
        raise Damaged("short block")
    block = file.read(at + size, n + 4)
    return checked(headers, block[:n], block[n:]), at + size + n + 4


def _next_sync(file: _File, at: int) -> int:
    """The next place from `at` on that looks like a member or a version line, or the file's end."""
    while at < file.size:
        piece = file.read(at, min(CHUNK, file.size - at))
        found = _SYNC.search(piece)
        if found:
            return at + found.start()
        at += max(1, len(piece) - 6) if at + len(piece) < file.size else len(piece)
    return file.size


def salvage(source: pa.NativeFile) -> Iterator[tuple[int, int, Record | None, str]]:
    """(start, end, record, "") for each sound record of an archive, compressed by member, not at all, or mixed, and
    (start, end, None, reason) for each gap of quarantined bytes. After a failed check the next place that looks like a member
    or a version line is tried, and the next, until one holds a sound record; the gap ends there. Bytes of gaps and records
    make up the whole file. reason: the first check that failed. A member that is sound but holds an unsound record is
    reported as a gap of its bytes, and its other records are given."""
    file = _File(source)
    at, gap, reason = 0, -1, ""
    while at < file.size:
        try:
            if file.read(at, min(3, file.size - at)) == b"\x1f\x8b\x08":
                content, end = _member(file, at)
                found: list[tuple[Record | None, str]] = list(_of_member(content)) or [(None, "empty member")]
                if all(r is None for r, _ in found):
                    raise Damaged(found[0][1])
            else:
                record, end = _plain(file, at)
                found = [(record, "")]
        except Damaged as why:
            if gap < 0:
                gap, reason = at, str(why)
            at = _next_sync(file, at + 1)
            continue
        if gap >= 0:
            yield gap, at, None, reason
            gap = -1
        for record, why in found:
            yield at, end, record, why
        at = end
    if gap >= 0:
        yield gap, file.size, None, reason


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest id with an equal payload (by SHA-256) of `least`
    bytes or more, null for that row itself and for shorter payloads.

    A null html is an empty payload; a null id never is the one that others refer to; rows that share the smallest id and
    the payload are all responses. Groups of any size meet in a minimum with a map-side part, and in a join of narrow rows.
    Payloads do not move while there are at most BROADCAST_REVISITS revisits (their list is broadcast then); beyond, they meet the
    list by a shuffle."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long_ones = settled(p.where(F.octet_length("html") >= least).select("page_id", "digest"))
    first = long_ones.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = long_ones.join(first, "digest").where("page_id is null or page_id > refers_to").where("refers_to is not null")
    again = settled(again.select(F.col("page_id").alias("k_id"), F.col("digest").alias("k_digest"), "refers_to").distinct())
    again = F.broadcast(again) if again.count() <= BROADCAST_REVISITS else again
    met = p.join(again, p["page_id"].eqNullSafe(again["k_id"]) & (p["digest"] == again["k_digest"]), "left")
    return met.select("page_id", "url", "html", "digest", "refers_to")


def write_warc(rows: DataFrame, uri: str, date: str = DATE, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of (page_id, url, html, digest, refers_to) to archives under uri, a gzip member for each,
    and returns (path, n_records, n_bytes) of the archives.

    Each task writes its own rows, and starts another archive after `archive_bytes`. An archive's name holds the attempt of
    its task and a random part, and only names that Spark committed (in `archives.parquet`) are returned, so files of a lost or
    second attempt are never read. A task holds one batch of rows and one record. No rows: no archives."""
    spark = rows.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        done, out, path, n, size = [], None, "", 0, 0
        for batch in batches:
            for columns in parts(batch, 2):
                for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                    if out is None:
                        path = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                        out, n, size = fs.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, date)) + pack.flush()
                    out.write(member)
                    n, size = n + 1, size + len(member)
                    if size >= archive_bytes:
                        out.close()
                        done.append((f"{uri}/{path}", n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{uri}/{path}", n, size))
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "n_records", "n_bytes"])

    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    schema = "path string, n_records long, n_bytes long"
    rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, schema).write.mode("overwrite").parquet(f"{uri}/archives.parquet")
    return spark.read.schema(schema).parquet(f"{uri}/archives.parquet")


SALVAGED = "path string, start long, end long, gap string, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records and quarantined gaps of the archives in column `path`, one row each: path, start, end (bytes of the file),
    gap (why, null for records), warc_type, record_id, target_uri, refers_to, payload_digest (bare lower-case hex SHA-256: of the
    payload that was read; for a revisit the one it claims), payload_bytes (for a revisit its HTTP length, null if it has none),
    payload (null without with_payload, and for revisits and gaps).

    An archive is one task's work, read a chunk at a time; a task holds one record. A path that cannot be opened is an error; a
    null path is skipped; an empty file has no rows."""
    names = [x.split()[0] for x in SALVAGED.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() if x.endswith("long") else pa.string() for x in SALVAGED.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist() if p is not None):
            fs, name = pafs.FileSystem.from_uri(path)
            rows, held = [], 0
            with fs.open_input_file(name) as source:
                for start, end, r, why in salvage(source):
                    if r is None:
                        rows.append((path, start, end, why, *[None] * 7))
                    else:
                        revisit = r.kind == "revisit"
                        length = r.http.get("content-length", "")
                        claimed = r.headers.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
                        digest = claimed if revisit else hashlib.sha256(r.payload).hexdigest()
                        size = (int(length) if length.isdecimal() else None) if revisit else len(r.payload)
                        kept = r.payload if with_payload and not revisit else None
                        held += len(kept or b"")
                        rows.append((path, start, end, None, r.kind, r.headers.get("warc-record-id"), r.headers.get("warc-target-uri"), r.headers.get("warc-refers-to"), digest, size, kept))
                    if len(rows) >= 2000 or held >= 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)

    spread = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(spread, "path").mapInArrow(read, SALVAGED)


def warc_query(pages: DataFrame) -> DataFrame:
    """The pages as written to archives and read back. Payloads null: empty; long ones whole; an empty table gives no rows;
    repeated rows are records of their own; other columns are ignored."""
    spark = pages.sparkSession
    uri = scratch(spark, "warc")
    rows = read_warc(write_warc(with_revisits(pages), uri), with_payload=False).where("gap is null")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"))
