"""Augmented diffs as XML.  The text of each action is made on the executors; the driver only passes the sorted texts on."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold import schemas
from terrafold.dataset import OsmDataset
from terrafold.operators import augdiff
from terrafold.scratch import Scratch
from terrafold.ship import ship
from terrafold.sources.xmlsink import degrees

# Fixed value: the attribution that readers of such files expect.
NOTE = "The data included in this document is from www.openstreetmap.org. The data is made available under ODbL."
#: Attributes of an image besides its id, in the order of the file.
ATTRIBUTES = ("version", "user", "uid", "timestamp", "changeset")
_TEXTS = ", ".join(f"{a}:string" for a in ATTRIBUTES)
_SIDE = f"struct<{_TEXTS},visible:boolean,lon_i:int,lat_i:int,nodes:array<bigint>,members:{schemas.MEMBERS},tags:{schemas.TAGS}>"
_PLACE = "array<struct<member:int,idx:int,lon_i:int,lat_i:int>>"


def _element(kind: str, ident: int, side: dict, places: list[dict]) -> ET.Element:
    e = ET.Element(kind, id=str(ident), **{a: side[a] for a in ATTRIBUTES if side[a] is not None})
    if side["visible"] is False:
        e.set("visible", "false")
    place = lambda v: {} if v is None or v["lon_i"] is None or v["lat_i"] is None else {"lat": degrees(v["lat_i"]), "lon": degrees(v["lon_i"])}
    if kind == "node":
        e.attrib |= place(side)
    of: dict[int, list[dict]] = {}
    for v in places:
        of.setdefault(v["member"], []).append(v)
    own = {v["idx"]: v for v in of.get(-1, ())}
    for i, ref in enumerate(side["nodes"] or ()):
        ET.SubElement(e, "nd", ref=str(ref), **place(own.get(i)))
    for i, m in enumerate(side["members"] or ()):
        seen = of.get(i, [])
        at = place(seen[0]) if m["type"] == "node" and seen else {}
        x = ET.SubElement(e, "member", type=m["type"] or "", ref=str(m["ref"]), role=m["role"] or "", **at)
        if m["type"] == "way":
            for v in sorted(seen, key=lambda v: v["idx"]):
                ET.SubElement(x, "nd", **place(v))
    for t in side["tags"] or ():
        ET.SubElement(e, "tag", k=t["k"] or "", v=t["v"] or "")
    return e


def _action(r: dict) -> str:
    e = ET.Element("action", type=r["action"])
    old, new = ET.SubElement(e, "old"), ET.SubElement(e, "new")
    if r["old"] is not None:
        old.append(_element(r["type"], r["id"], r["old"], r["old_places"] or []))
        if r["box"] is not None:
            b = r["box"]
            old[0].insert(0, ET.Element("bounds", minlat=degrees(b["min_lat"]), minlon=degrees(b["min_lon"]), maxlat=degrees(b["max_lat"]), maxlon=degrees(b["max_lon"])))
    new.append(_element(r["type"], r["id"], r["new"], r["new_places"] or []))
    ET.indent(e, level=1)
    return "  " + ET.tostring(e, encoding="unicode") + "\n"


def _side(version: str, meta: str, visible: Column, prefix: str) -> Column:
    """An image whose user, time and so on come from a column of meta structs; what isn't known is left out."""
    text = lambda c: c.cast("string")
    cols = [text(F.col(version)), text(F.col(f"{meta}.user")), text(F.col(f"{meta}.uid")), augdiff.iso(F.col(f"{meta}.timestamp")), text(F.col(f"{meta}.changeset"))]
    return F.struct(*[c.alias(a) for c, a in zip(cols, ATTRIBUTES)], visible.alias("visible"), *[F.col(f"{prefix}_{c}").alias(c) for c in ("lon_i", "lat_i", "nodes", "members", "tags")]).cast(_SIDE)


def texts(db: OsmDataset, changes: DataFrame) -> DataFrame:
    """``rank, id, xml``: one action for each element, with its old and new image, the positions in both, and the bounds.

    Old images, also those of elements that are only moved along, have the metadata of the dataset, ``?`` for what it
    doesn't have; new images of changed elements have that of the change, and those of others the old.
    """
    scratch = Scratch(db.spark)
    save = lambda df: scratch.save(df)[0]
    actions = save(augdiff.newest(changes))
    changed = save(augdiff.old_new(db, actions))
    hit = save(augdiff.affected(db, actions, changed))
    moved = save(augdiff.old_images(db, hit))
    order = augdiff.augmented_diff(db, changes)
    whole = changed.select("type", "id", "old_nodes", "new_nodes", "old_members", "new_members").unionByName(
        moved.select("type", "id", "old_nodes", F.col("old_nodes").alias("new_nodes"), "old_members", F.col("old_members").alias("new_members"))
    )
    rows = save(augdiff.vertices(whole, db, actions))
    known = [F.col(f"old_{a}").alias(a) for a in ATTRIBUTES]
    old = F.when(F.col("action") != "create", F.struct(*known, F.lit(None).cast("boolean").alias("visible"), *[F.col(f"old_{c}").alias(c) for c in ("lon_i", "lat_i", "nodes", "members", "tags")]).cast(_SIDE))
    gone = F.when(~F.col("visible"), F.lit(False))
    own = changed.select("type", "id", old.alias("old"), _side("new_version", "new_meta", gone, "new").alias("new"))
    unknown = lambda c: F.coalesce(c, F.lit(augdiff.UNKNOWN))
    still = _side("old_version", "old_meta", F.lit(None).cast("boolean"), "old")
    for a in ATTRIBUTES:
        still = still.withField(a, unknown(still[a]))
    spread = moved.select("type", "id", still.alias("old"), still.alias("new"))
    place = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("member", "idx", "lon_i", "lat_i")))).cast(_PLACE).alias(f"{side}_places")
    places = rows.groupBy("type", "id").agg(place("old"), place("new"))
    box = augdiff.bounds(rows).select("type", "id", F.struct("min_lon", "min_lat", "max_lon", "max_lat").alias("box"))
    j = order.select("rank", "type", "id", "action").join(own.unionByName(spread), ["type", "id"]).join(places, ["type", "id"], "left").join(box, ["type", "id"], "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(map(_action, found)), pa.string())], names=["rank", "id", "xml"])

    ship(db.spark)
    cols = ["rank", "type", "id", "action", "old", "new", "old_places", "new_places", "box"]
    return j.select(*cols).mapInArrow(run, "rank int, id bigint, xml string")


def lines(db: OsmDataset, changes: DataFrame) -> Iterator[str]:
    """The document piece by piece: a note, then the actions by type and id; the driver holds one partition at most."""
    changes, _ = Scratch(db.spark).save(changes)
    done, _ = Scratch(db.spark).save(texts(db, changes))
    note = ET.Element("note")
    note.text = NOTE
    yield '<osm version="0.6" generator="terrafold">\n  ' + ET.tostring(note, encoding="unicode") + "\n"
    for r in done.orderBy("rank", "id").select("xml").toLocalIterator():
        yield r["xml"]
    yield "</osm>\n"


def render(db: OsmDataset, changes: DataFrame) -> str:
    """The whole document, for small diffs."""
    return "".join(lines(db, changes))


def write(db: OsmDataset, changes: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(lines(db, changes))
