"""Element files in the public binary format: nodes (dense), ways and relations, each by ascending id."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource

from terrafold import schemas
from terrafold.sources.pbf import KINDS
from terrafold.sources.xmlsink import Parts, save_sorted

#: Objects of one block at most.
BLOCK = 8000


def varint(x: int) -> bytes:
    """Base-128, low groups first; a negative number as its 64-bit pattern."""
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def zigzag(x: int) -> int:
    return x << 1 if x >= 0 else (-x << 1) - 1


def number(field: int, x: int) -> bytes:
    return varint(field << 3) + varint(x)


def chunk(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def packed(field: int, xs: Iterable[int]) -> bytes:
    body = b"".join(map(varint, xs))
    return chunk(field, body) if body else b""


def steps(xs: Iterable[int]) -> Iterator[int]:
    """Zigzag-coded differences."""
    last = 0
    for x in xs:
        yield zigzag(x - last)
        last = x


class Strings:
    """The string table of a block; entry 0 is empty, as it ends a dense node's tags."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {"": 0}

    def __call__(self, text: str | None) -> int:
        return self.at.setdefault(text or "", len(self.at))

    def message(self) -> bytes:
        return b"".join(chunk(1, s.encode()) for s in self.at)


def _info(m: Row | None, version: int | None) -> dict:
    m = m.asDict() if m is not None else {}
    return {"version": version if version is not None else m.get("version"), **{k: m.get(k) for k in ("timestamp", "changeset", "uid", "user")}}


def _tags(r: Row) -> list:
    return [t for t in r["tags"] or () if t is not None and t["k"]]


def _dense(rows: list[Row], strings: Strings) -> bytes:
    infos = [_info(r["meta"], r["version"]) for r in rows]
    own = lambda k: [i[k] or 0 for i in infos]
    info = packed(1, [-1 if i["version"] is None else i["version"] for i in infos]) + packed(2, steps(own("timestamp"))) + packed(3, steps(own("changeset"))) + packed(4, steps(own("uid"))) + packed(5, steps([strings(i["user"]) for i in infos]))
    tags: list[int] = []
    for r in rows:
        for t in _tags(r):
            tags += [strings(t["k"]), strings(t["v"])]
        tags.append(0)
    body = packed(1, steps(r["id"] for r in rows)) + chunk(5, info) + packed(8, steps(r["lat_i"] for r in rows)) + packed(9, steps(r["lon_i"] for r in rows))
    return chunk(2, body + (packed(10, tags) if any(tags) else b""))


def _single(r: Row, strings: Strings) -> bytes:
    tags, i = _tags(r), _info(r["meta"], r["version"])
    info = b"".join(number(f, i[k]) for f, k in ((1, "version"), (2, "timestamp"), (3, "changeset"), (4, "uid")) if i[k] is not None)
    if i["user"] is not None:
        info += number(5, strings(i["user"]))
    body = number(1, r["id"]) + packed(2, [strings(t["k"]) for t in tags]) + packed(3, [strings(t["v"]) for t in tags]) + chunk(4, info)
    if r["type"] == "way":
        return chunk(3, body + packed(8, steps(n for n in r["nodes"] or () if n is not None)))
    members = [m for m in r["members"] or () if m["ref"] is not None and m["type"] in KINDS]
    body += packed(8, [strings(m["role"]) for m in members]) + packed(9, steps(m["ref"] for m in members)) + packed(10, [KINDS.index(m["type"]) for m in members])
    return chunk(4, body)


def block(rows: list[Row]) -> bytes:
    """A primitive block of objects of one type."""
    strings = Strings()
    group = _dense(rows, strings) if rows[0]["type"] == "node" else b"".join(_single(r, strings) for r in rows)
    return chunk(1, strings.message()) + chunk(2, group)


def blob(kind: str, raw: bytes) -> bytes:
    body = number(2, len(raw)) + chunk(3, zlib.compress(raw))
    head = chunk(1, kind.encode()) + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def head(info: dict) -> bytes:
    from terrafold.sources.xmlfiles import epoch

    out = b""
    if box := info.get("box"):
        lon_lo, lat_lo, lon_hi, lat_hi = (zigzag(round(x * 1e9)) for x in box)
        out += chunk(1, number(1, lon_lo) + number(2, lon_hi) + number(3, lat_hi) + number(4, lat_lo))
    out += b"".join(chunk(4, f.encode()) for f in ("OsmSchema-V0.6", "DenseNodes")) + chunk(16, str(info.get("generator", "terrafold")).encode())
    if stamp := info.get("osmosis_replication_timestamp"):
        out += number(32, epoch(stamp))
    return blob("OSMHeader", out)


class _Writer(Parts):
    def encode(self, rows: Iterator[Row]) -> Iterator[bytes]:
        from itertools import groupby

        for _, same in groupby(rows, key=lambda r: r["type"]):
            for part in batched(same, BLOCK):
                yield blob("OSMData", block(list(part)))

    def ends(self) -> tuple[bytes, bytes]:
        return head(self.info), b""


class ElementsPbfSink(DataSource):
    """``df.write.format("elements_pbf_sink").mode("append").save(path)`` of a table of objects sorted by type and id.

    A node without a position can't be written and must be left out before.  An unknown version, time, changeset or user of
    a node comes back as -1, 0 or empty, since dense nodes have no way to leave one out."""

    @classmethod
    def name(cls):
        return "elements_pbf_sink"

    def schema(self):
        return schemas.OBJECTS

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write(objects: DataFrame, path: str, info: dict) -> None:
    save_sorted(objects.where("type <> 'node' or (lon_i is not null and lat_i is not null)"), "elements_pbf_sink", path, info)
