"""GraphML files as nodes and edges, read element by element."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the parser is fed at a time, elements of a batch, and characters of their attributes.
CHUNK, ELEMENTS, CHARACTERS = 1 << 20, 5000, 4 << 20
_ROWS = "sample_id string, kind string, pos long, a string, b string, attrs map<string, string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(source: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[str, int, str | None, str | None, list[tuple[str, str]]]]:
    """(kind, place, id or source, target, attributes) of each node and edge, as the file goes by. Attributes go by the names that
    <key> elements before them declare, else by the key; of repeated names the last stays, an empty value is an empty text. An
    element is dropped once it is read, so a file of any size needs one chunk and its largest element. A file that is no XML is an error."""
    parser = ElementTree.XMLPullParser(events=("start", "end"))
    names: dict[str, str] = {}
    open_: list[ElementTree.Element] = []
    places = {"node": 0, "edge": 0}
    while True:
        piece = source.read(chunk)
        parser.feed(piece) if piece else parser.close()
        for event, element in parser.read_events():
            if event == "start":
                open_.append(element)
                continue
            open_.pop()
            tag = _local(element.tag)
            if tag == "key":
                names[element.get("id", "")] = element.get("attr.name") or element.get("id", "")
            elif tag in places:
                found = {names.get(d.get("key", ""), d.get("key", "")): d.text or "" for d in element if _local(d.tag) == "data"}
                ends = (element.get("id"), None) if tag == "node" else (element.get("source"), element.get("target"))
                yield tag, places[tag], *ends, list(found.items())
                places[tag] += 1
            if tag != "data" and open_:  # data stays until its node or edge has been read
                open_[-1].remove(element)
        if not piece:
            return


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _ROWS.replace("map<string, string>", "map").split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    batch = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)
    for b in batches:
        for path, sample in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file:///") else path
            fs, name = pafs.FileSystem.from_uri(uri)
            rows, size = [], 0
            with fs.open_input_stream(name) as source:
                try:
                    for row in elements(source):
                        rows.append((sample, *row))
                        size += sum(len(v) for _, v in row[4])
                        if len(rows) >= ELEMENTS or size >= CHARACTERS:
                            yield batch(rows)
                            rows, size = [], 0
                except ElementTree.ParseError as wrong:
                    raise ValueError(f"{path}: {wrong}") from None
            yield batch(rows)


def read_graphml(spark: SparkSession, path: str, sample: str = r"([^/]+?)(?:\.[^./]*)?$") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the files of a path. nodes: sample_id, node_id, label, attrs; edges: sample_id, edge_pos, src,
    dst, label, attrs. sample: a pattern whose first group finds the sample_id in a file's path (its name without the ending). A
    missing label is UNKNOWN; of a repeated node id the last stays.

    A file is one task's work, but it streams: a task holds a chunk of XML and a batch of elements, and what comes out is split like
    any table, so a graph of any size is read. A file without elements has no rows; one that is no XML fails the job, with its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.regexp_extract("path", sample, 1).alias("sample_id"))  # names, no contents
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = files.repartition(spread, "path").mapInArrow(_parsed, _ROWS)
    label = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("UNKNOWN")).alias("label")
    rest = lambda k: F.map_filter("attrs", lambda n, _: n != k).alias("attrs")
    last = F.max_by(F.map_entries("attrs"), "pos").alias("entries")
    nodes = d.where("kind = 'node'").groupBy("sample_id", F.col("a").alias("node_id")).agg(last).withColumn("attrs", F.map_from_entries("entries"))
    edges = d.where("kind = 'edge'").select("sample_id", F.col("pos").cast("int").alias("edge_pos"), F.col("a").alias("src"), F.col("b").alias("dst"), label("labelE"), rest("labelE"))
    return nodes.select("sample_id", "node_id", label("labelV"), rest("labelV")), edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file for each sample, under sample=<sample_id>. nodes: sample_id, node_id, label, attrs; edges: sample_id, edge_pos, src, dst,
    label. Lines are sorted, not collected; a sample is written by one task."""
    def escaped(c):  # noqa: ANN001, ANN202
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    data = lambda key, value: F.concat(F.lit('<data key="'), escaped(key), F.lit('">'), escaped(value), F.lit("</data>"))
    quoted = lambda name, c: F.concat(F.lit(f' {name}="'), escaped(F.col(c).cast("string")), F.lit('"'))
    more = F.array_join(F.transform(F.map_entries("attrs"), lambda x: data(x["key"], x["value"])), "")
    n = nodes.select("sample_id", F.lit(1).alias("place"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("<node"), quoted("id", "node_id"), F.lit(">"), data(F.lit("labelV"), F.col("label")), more, F.lit("</node>")).alias("line"))
    e = edges.select("sample_id", F.lit(2).alias("place"), F.col("edge_pos").cast("long").alias("at"), F.concat(F.lit("<edge"), quoted("source", "src"), quoted("target", "dst"), F.lit(">"), data(F.lit("labelE"), F.col("label")), F.lit("</edge>")).alias("line"))
    frame = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit('<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph id="G" edgedefault="directed">').alias("line")), F.struct(F.lit(3).alias("place"), F.lit("</graph></graphml>").alias("line"))))
    f = nodes.select("sample_id").distinct().select("sample_id", frame.alias("f")).select("sample_id", "f.place", F.lit(0).cast("long").alias("at"), "f.line")
    lines = n.unionByName(e).unionByName(f).withColumnRenamed("sample_id", "sample")
    lines.repartition("sample").sortWithinPartitions("sample", "place", "at", "line").select("sample", "line").write.partitionBy("sample").text(path)
