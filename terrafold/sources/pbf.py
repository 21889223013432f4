"""Element files in the public binary format, read block by block.

A file is a row of blocks, each with its own length, so blocks are found by reading their headers alone; every block is a
partition of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, InputPartition

from terrafold import schemas
from terrafold.sources import paths
from terrafold.sources.xmlfiles import _Files

KINDS = ("node", "way", "relation")


def varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 0x7F) << shift
        if c < 0x80:
            return x, i
        shift += 7


def zigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a message: varints as numbers, the rest as bytes."""
    i, n = 0, len(b)
    while i < n:
        key, i = varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = varint(b, i)
        elif kind == 2:
            size, i = varint(b, i)
            value, i = b[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = b[i : i + size], i + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def packed(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, i = [], 0
    while i < len(value):
        x, i = varint(value, i)
        out.append(x)
    return out


def running(xs: list[int]) -> list[int]:
    """Sums of zigzag-coded differences."""
    out, t = [], 0
    for x in xs:
        t += zigzag(x)
        out.append(t)
    return out


def blocks(path: str) -> Iterator[tuple[str, int, int]]:
    """Kind, offset and length of each block."""
    with paths.reading(path) as f:
        while head := f.read(4):
            size = struct.unpack(">I", head)[0]
            got = dict(fields(f.read(size)))
            yield got[1].decode(), f.tell(), got[3]
            f.seek(got[3], 1)


def content(path: str, at: int, size: int) -> bytes:
    with paths.reading(path) as f:
        f.seek(at)
        blob = dict(fields(f.read(size)))
    if 1 in blob:
        return blob[1]
    if 3 in blob:
        return zlib.decompress(blob[3])
    if 7 in blob:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(blob[7], max_output_size=blob.get(2, 1 << 25))
    if 4 in blob:
        import lzma

        return lzma.decompress(blob[4], lzma.FORMAT_ALONE if blob[4][:1] == b"]" else lzma.FORMAT_AUTO)
    if 6 in blob:
        import pyarrow as pa

        return pa.Codec("lz4_raw").decompress(blob[6], decompressed_size=blob[2], asbytes=True)
    raise ValueError("an unknown compression of a block")


def header(path: str) -> dict[str, str]:
    """Generator, replication time and sequence number, and the box in degrees."""
    kind, at, size = next(blocks(path))
    if kind != "OSMHeader":
        raise ValueError("the file doesn't begin with a header")
    from datetime import datetime, timezone

    out: dict[str, str] = {}
    for n, v in fields(content(path, at, size)):
        if n == 1:
            box = {k: zigzag(x) / 1e9 for k, x in fields(v)}
            out |= {"bounds_minlon": str(box.get(1)), "bounds_maxlon": str(box.get(2)), "bounds_maxlat": str(box.get(3)), "bounds_minlat": str(box.get(4))}
        elif n == 16:
            out["generator"] = v.decode()
        elif n == 32:
            out["osmosis_replication_timestamp"] = datetime.fromtimestamp(v, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        elif n == 33:
            out["osmosis_replication_sequence_number"] = str(v)
    return out


def rows(block: bytes) -> Iterator[tuple]:
    """``type, id, version, lon_i, lat_i, nodes, members, tags, meta`` of a block's objects in order."""
    strings: list[str] = []
    groups, grain, lat0, lon0, date_grain = [], 100, 0, 0, 1000
    for n, v in fields(block):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n == 18:
            date_grain = v
        elif n == 19:
            lat0 = signed(v)
        elif n == 20:
            lon0 = signed(v)
    nano = lambda off, x: round((off + grain * x) / 100)
    lists = lambda keys, vals: [{"k": strings[k], "v": strings[v]} for k, v in zip(keys, vals)]

    def info(raw: bytes | None) -> tuple[dict, bool]:
        got = dict(fields(raw)) if raw is not None else {}
        stamp = got.get(2)
        meta = {"version": got.get(1), "timestamp": None if stamp is None else signed(stamp) * date_grain // 1000, "changeset": got.get(3), "uid": got.get(4), "user": strings[got[5]] if 5 in got else None}
        return meta, got.get(6, 1) != 0

    for g in groups:
        for n, v in fields(g):
            if n == 2:
                yield from _dense(v, strings, nano, lat0, lon0, date_grain)
            elif n in (1, 3, 4):
                got = dict(fields(v))
                tags = lists(packed(got.get(2, b"")), packed(got.get(3, b"")))
                meta, visible = info(got.get(4))
                if not visible:
                    continue
                if n == 1:
                    yield "node", zigzag(got[1]), meta["version"], nano(lon0, zigzag(got[9])), nano(lat0, zigzag(got[8])), None, None, tags, meta
                elif n == 3:
                    yield "way", got[1], meta["version"], None, None, running(packed(got.get(8, b""))), None, tags, meta
                else:
                    roles, refs, kinds = packed(got.get(8, b"")), running(packed(got.get(9, b""))), packed(got.get(10, b""))
                    members = [{"ref": r, "type": KINDS[k], "role": strings[s]} for s, r, k in zip(roles, refs, kinds)]
                    yield "relation", got[1], meta["version"], None, None, None, members, tags, meta


def _dense(raw: bytes, strings: list[str], nano, lat0: int, lon0: int, date_grain: int) -> Iterator[tuple]:
    got = dict(fields(raw))
    ids, lats, lons = (running(packed(got.get(k, b""))) for k in (1, 8, 9))
    di = dict(fields(got[5])) if 5 in got else {}
    versions, visible = packed(di.get(1, b"")), packed(di.get(6, b""))
    stamps, sets, uids, users = (running(packed(di.get(k, b""))) for k in (2, 3, 4, 5))
    kv, at = packed(got.get(10, b"")), 0
    pick = lambda xs, i: xs[i] if i < len(xs) else None
    for i, ident in enumerate(ids):
        tags = []
        while at < len(kv) and kv[at]:
            tags.append({"k": strings[kv[at]], "v": strings[kv[at + 1]]})
            at += 2
        at += 1
        if pick(visible, i) == 0:
            continue
        stamp, user = pick(stamps, i), pick(users, i)
        meta = {"version": pick(versions, i), "timestamp": None if stamp is None else stamp * date_grain // 1000, "changeset": pick(sets, i), "uid": pick(uids, i), "user": None if user is None else strings[user]}
        yield "node", ident, meta["version"], nano(lon0, lons[i]), nano(lat0, lats[i]), None, None, tags, meta


class _PbfReader(_Files):
    def partitions(self):
        found = [(p, at, size) for p in self.paths for kind, at, size in blocks(p) if kind == "OSMData"]
        return [InputPartition((i, *b)) for i, b in enumerate(found)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        i, path, at, size = partition.value
        found = rows(content(path, at, size))
        yield from schemas.record_batches((i << 32 | k, *r) for k, r in enumerate(found))


class OsmPbf(DataSource):
    """``spark.read.format("elements_pbf").load(path)``"""

    @classmethod
    def name(cls):
        return "elements_pbf"

    def schema(self):
        return schemas.OBJECTS

    def reader(self, schema):
        return _PbfReader(self.options)
