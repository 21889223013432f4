"""Element files and change files as XML, read in document order.

A document is parsed as a stream, so its size doesn't matter; several files are several partitions.  Compression is told by
the file's first bytes.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrafold import schemas
from terrafold.sources import paths
from terrafold.ship import ship

TYPES = ("node", "way", "relation")
ACTIONS = ("create", "modify", "delete")


def opened(path: str):
    """A binary stream of a file's plain content."""
    f = paths.reading(path)
    head = f.read(6)
    f.seek(0)
    if head[:2] == b"\x1f\x8b":
        return gzip.open(f)
    if head[:3] == b"BZh":
        return bz2.open(f)
    if head == b"\xfd7zXZ\x00":
        return lzma.open(f)
    return f


def epoch(text: str | None) -> int | None:
    """Seconds of ``YYYY-MM-DDTHH:MM:SSZ``."""
    if not text:
        return None
    return int(datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())


def fixed(text: str | None) -> int | None:
    """1e-7 degrees of a decimal text, exactly."""
    return None if text is None else int((Decimal(text) * 10_000_000).to_integral_value())


def _int(text: str | None) -> int | None:
    return None if text is None else int(text)


def row_of(e: ET.Element) -> tuple:
    """``type, id, version, lon_i, lat_i, nodes, members, tags, meta`` of an element of either kind of file."""
    a = e.attrib
    ident = int(a["id"])
    if ident < 0:
        raise ValueError(f"a negative id: {e.tag} {ident}")
    tags = [{"k": t.get("k"), "v": t.get("v")} for t in e.iter("tag")]
    nodes = [int(n.get("ref")) for n in e.iter("nd")] if e.tag == "way" else None
    members = [{"ref": int(m.get("ref")), "type": m.get("type"), "role": m.get("role") or ""} for m in e.iter("member")] if e.tag == "relation" else None
    version = _int(a.get("version"))
    meta = {"version": version, "timestamp": epoch(a.get("timestamp")), "changeset": _int(a.get("changeset")), "uid": _int(a.get("uid")), "user": a.get("user")}
    return e.tag, ident, version, fixed(a.get("lon")), fixed(a.get("lat")), nodes, members, tags, meta


def objects(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Objects of an element file with their place; one that isn't visible is left out."""
    pos, root = 0, None
    for event, e in ET.iterparse(stream, ("start", "end")):
        if root is None:
            root = e
        if event == "end" and e.tag in TYPES:
            if e.get("visible") != "false":
                yield (pos, *row_of(e))
                pos += 1
            root.clear()


def changes(stream: io.BufferedIOBase, seq: int) -> Iterator[tuple]:
    """Changes of a change file in document order, across its blocks."""
    pos, action, root = 0, None, None
    for event, e in ET.iterparse(stream, ("start", "end")):
        if root is None:
            root = e
        if event == "start" and e.tag in ACTIONS:
            action = e.tag
        elif event == "end" and e.tag in TYPES:
            gone = "delete" if e.get("visible") == "false" else action
            yield (seq, pos, gone, *row_of(e))
            pos += 1
        elif event == "end" and e.tag in ACTIONS:
            root.clear()


def header(path: str) -> dict[str, str]:
    """Attributes and bounds at the head of an element file."""
    with opened(path) as f:
        out: dict[str, str] = {}
        for event, e in ET.iterparse(f, ("start",)):
            if e.tag == "osm":
                out |= e.attrib
            elif e.tag == "bounds":
                out |= {f"bounds_{k}": v for k, v in e.attrib.items()}
            elif e.tag in TYPES:
                break
        return out


class _Files(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = paths.found(options["path"])
        if not self.paths:
            raise FileNotFoundError(options["path"])
        self.seq = int(options.get("seq", 0))

    def partitions(self):
        return [InputPartition((p, self.seq + i)) for i, p in enumerate(self.paths)]


class _XmlReader(_Files):
    def read(self, partition):
        with opened(partition.value[0]) as f:
            yield from schemas.record_batches(objects(f))


class _OscReader(_Files):
    def read(self, partition):
        path, seq = partition.value
        with opened(path) as f:
            yield from schemas.record_batches(changes(f, seq), changes=True)


class ElementsXml(DataSource):
    """``spark.read.format("elements_xml").load(path)``"""

    @classmethod
    def name(cls):
        return "elements_xml"

    def schema(self):
        return schemas.OBJECTS

    def reader(self, schema):
        return _XmlReader(self.options)


class OsmChange(DataSource):
    """``spark.read.format("changes_xml").option("seq", n).load(path)``; the files of a glob are n, n + 1, ..."""

    @classmethod
    def name(cls):
        return "changes_xml"

    def schema(self):
        return schemas.CHANGES

    def reader(self, schema):
        return _OscReader(self.options)


def register(spark: SparkSession) -> None:
    from terrafold.sources import pbf, pbfsink, replication, xmlsink

    ship(spark)
    for s in (ElementsXml, OsmChange, pbf.OsmPbf, replication.Replication, xmlsink.ElementsXmlSink, pbfsink.ElementsPbfSink):
        spark.dataSource.register(s)


def elements(objects_df: DataFrame) -> dict[str, DataFrame]:
    """The four element tables of a table of objects; nodes are the tagged ones alone."""
    n = objects_df.where("type = 'node'")
    return {
        "locations": n.select("id", "lon_i", "lat_i", "version"),
        "nodes": n.where("size(tags) > 0").select("id", "tags", "meta"),
        "ways": objects_df.where("type = 'way'").select("id", "nodes", "tags", "meta"),
        "relations": objects_df.where("type = 'relation'").select("id", "members", "tags", "meta"),
    }


def expand(spark: SparkSession, path: str, root: str) -> int:
    """Build and publish a dataset from an element file, XML or PBF.

    The file is parsed once, into a written table with a folder for each type; all nine tables are made from that.
    """
    from terrafold.dataset import FILENAME, SEQNUM, TIMESTAMP, OsmDataset
    from terrafold.scratch import Scratch
    from terrafold.sources import pbf

    register(spark)
    kind = "elements_pbf" if path.endswith(".pbf") else "elements_xml"
    head = pbf.header(path) if kind == "elements_pbf" else header(path)
    meta = {FILENAME: os.path.basename(path), TIMESTAMP: head.get("osmosis_replication_timestamp", head.get("timestamp", ""))}
    if head.get(SEQNUM):
        meta[SEQNUM] = head[SEQNUM]
    scratch, raw = Scratch(spark), spark.read.format(kind).load(path)
    parsed, _ = scratch.save(raw.select(*[c for c in raw.columns if c != "type"], "type"), by="type")
    try:
        return OsmDataset.from_elements(spark, elements(parsed), meta).publish(root)
    finally:
        scratch.drop()
