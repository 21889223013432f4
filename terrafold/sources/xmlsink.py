"""Element files as XML: nodes, ways and relations, each by ascending id."""

from __future__ import annotations

import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from terrafold import schemas
from terrafold.sources import paths

FOOT = "</osm>\n"


def degrees(x: int) -> str:
    sign, x = ("-", -x) if x < 0 else ("", x)
    return f"{sign}{x // 10_000_000}.{x % 10_000_000:07d}"


def head(info: dict) -> str:
    attrs = "".join(f" {k}={quoteattr(str(info[k]))}" for k in ("generator", "timestamp", "osmosis_replication_timestamp") if info.get(k))
    out = f'<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6"{attrs}>\n'
    if box := info.get("box"):
        lon_lo, lat_lo, lon_hi, lat_hi = box
        out += f'  <bounds minlon="{lon_lo:.7f}" minlat="{lat_lo:.7f}" maxlon="{lon_hi:.7f}" maxlat="{lat_hi:.7f}"/>\n'
    return out


def element(r: Row) -> str:
    from datetime import datetime, timezone

    m = r["meta"]
    attrs = [("id", r["id"]), ("version", r["version"] if r["version"] is not None else m and m["version"])]
    if m is not None:
        stamp = m["timestamp"]
        attrs += [("timestamp", None if stamp is None else datetime.fromtimestamp(stamp, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")), ("changeset", m["changeset"]), ("uid", m["uid"]), ("user", m["user"])]
    if r["type"] == "node":
        attrs += [("lat", degrees(r["lat_i"])), ("lon", degrees(r["lon_i"]))]
    line = f"  <{r['type']}" + "".join(f" {k}={quoteattr(str(v))}" for k, v in attrs if v is not None)
    inner = [f'    <nd ref="{n}"/>\n' for n in r["nodes"] or () if n is not None]
    inner += [f'    <member type={quoteattr(x["type"] or "")} ref="{x["ref"]}" role={quoteattr(x["role"] or "")}/>\n' for x in r["members"] or ()]
    inner += [f"    <tag k={quoteattr(t['k'])} v={quoteattr(t['v'] or '')}/>\n" for t in r["tags"] or () if t["k"] is not None]
    return f"{line}>\n{''.join(inner)}  </{r['type']}>\n" if inner else f"{line}/>\n"


@dataclass
class _Part(WriterCommitMessage):
    file: str
    first: tuple


class Parts(DataSourceWriter):
    """Each task writes a part beside the file; the parts are put together in order of their first element.

    The driver copies bytes one part after the other and holds none of them.
    """

    def __init__(self, options: dict):
        self.path, self.info = options["path"], {k: v for k, v in options.items() if k != "path"}
        if "box" in self.info:
            self.info["box"] = [float(x) for x in self.info["box"].split(",")]

    def encode(self, rows: Iterator[Row]) -> Iterator[bytes]:
        raise TypeError("a kind of file is needed")

    def ends(self) -> tuple[bytes, bytes]:
        raise TypeError("a kind of file is needed")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        import uuid

        rank = {"node": 0, "way": 1, "relation": 2}
        part, first = f"{self.path}.{uuid.uuid4().hex}.part", [(9, 0)]

        def seen() -> Iterator[Row]:
            for i, r in enumerate(iterator):
                if not i:
                    first[0] = (rank[r["type"]], r["id"])
                yield r

        with paths.writing(part) as f:
            for raw in self.encode(seen()):
                f.write(raw)
        return _Part(part, first[0])

    def commit(self, messages: list) -> None:
        before, after = self.ends()
        with paths.writing(f"{self.path}.tmp") as out:
            out.write(before)
            for m in sorted((m for m in messages if m), key=lambda m: m.first):
                with paths.reading(m.file) as f:
                    shutil.copyfileobj(f, out, 1 << 24)
                paths.remove(m.file)
            out.write(after)
        paths.rename(f"{self.path}.tmp", self.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m:
                paths.remove(m.file)


class _Writer(Parts):
    def encode(self, rows: Iterator[Row]) -> Iterator[bytes]:
        return (element(r).encode() for r in rows)

    def ends(self) -> tuple[bytes, bytes]:
        return head(self.info).encode(), FOOT.encode()


class ElementsXmlSink(DataSource):
    """``df.write.format("elements_xml_sink").mode("append").save(path)`` of a table of objects sorted by type and id.

    The folder, or the store behind an address, must be one that all executors and the driver share."""

    @classmethod
    def name(cls):
        return "elements_xml_sink"

    def schema(self):
        return schemas.OBJECTS

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def objects_of(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Objects from output tables ``id, lon_i, lat_i, version, tags, meta`` of nodes, and rows of ways and relations."""
    none = lambda kind: F.lit(None).cast(kind)
    pos = none("bigint").alias("pos")
    n = nodes.select(pos, F.lit("node").alias("type"), "id", "version", "lon_i", "lat_i", none("array<bigint>").alias("nodes"), none(schemas.MEMBERS).alias("members"), "tags", "meta")
    w = ways.select(pos, F.lit("way").alias("type"), "id", F.col("meta.version").alias("version"), none("int").alias("lon_i"), none("int").alias("lat_i"), "nodes", none(schemas.MEMBERS).alias("members"), "tags", "meta")
    r = relations.select(pos, F.lit("relation").alias("type"), "id", F.col("meta.version").alias("version"), none("int").alias("lon_i"), none("int").alias("lat_i"), none("array<bigint>").alias("nodes"), "members", "tags", "meta")
    return n.unionByName(w).unionByName(r)


def save_sorted(objects: DataFrame, sink: str, path: str, info: dict) -> None:
    from terrafold.sources.xmlfiles import register

    register(objects.sparkSession)
    rank = F.when(F.col("type") == "node", 0).when(F.col("type") == "way", 1).otherwise(2)
    w = objects.orderBy(rank, "id").write.format(sink).mode("append")
    for k, v in info.items():
        w = w.option(k, ",".join(map(str, v)) if isinstance(v, (list, tuple)) else v)
    w.save(path)


def write(objects: DataFrame, path: str, info: dict) -> None:
    save_sorted(objects, "elements_xml_sink", path, info)
