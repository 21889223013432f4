"""Reading, publishing, extracting, updating and streaming of a small hand-made dataset."""

import gzip
import io
import json
import os
import struct
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import DATA

from terrafold import cli, schemas
from terrafold import tables as T
from terrafold.dataset import SEQNUM, TIMESTAMP, Busy, OsmDataset, vacuum, writer_lock
from terrafold.files import Files
from terrafold.functions import lookup
from terrafold.operators import augdiff, extract as ex, geometry as geo, indexes, update as up
from terrafold.progress import Progress
from terrafold.region import Region
from terrafold.sources import augdiffxml, pbf, pbfsink, replication, xmlfiles, xmlsink
from terrafold.streaming import catchup

OSM = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6" generator="test" osmosis_replication_timestamp="2024-01-01T00:00:00Z">
 <bounds minlat="0" minlon="0" maxlat="2" maxlon="2"/>
 <node id="1" lat="0.0000001" lon="-0.0000001" version="1" timestamp="2020-01-01T00:00:00Z" changeset="9" uid="3" user="&lt;a&quot;b&gt;"/>
 <node id="2" lat="0.5" lon="0.5" version="2"><tag k="name" v="N &amp; é"/><tag k="name" v="last"/></node>
 <node id="3" lat="1.5" lon="1.5" version="1"/>
 <node id="4" lat="1.6" lon="1.6" version="1"/>
 <node id="5" lat="9.0" lon="9.0" version="1"/>
 <way id="10" version="1"><nd ref="1"/><nd ref="2"/><nd ref="1"/><nd ref="99"/><tag k="name" v="W"/></way>
 <way id="11" version="1"><nd ref="3"/><nd ref="4"/></way>
 <way id="12" version="1"/>
 <way id="13" version="1"><nd ref="5"/></way>
 <relation id="20" version="1"><member type="way" ref="10" role="outer"/><member type="way" ref="11" role=""/><member type="way" ref="77" role="outer"/><member type="node" ref="5" role="label"/><tag k="type" v="multipolygon"/></relation>
 <relation id="21" version="1"><member type="relation" ref="20" role=""/><member type="relation" ref="22" role=""/><member type="way" ref="13" role=""/><tag k="type" v="boundary"/></relation>
 <relation id="22" version="1"><member type="relation" ref="21" role=""/><member type="relation" ref="22" role="self"/></relation>
 <relation id="23" version="1"><member type="way" ref="11" role=""/></relation>
</osm>
"""
OSC = """<osmChange version="0.6">
 <create><node id="6" lat="1.0" lon="1.0" version="1"/></create>
 <delete><node id="6" version="2"/></delete>
 <create><node id="6" lat="1.25" lon="1.0" version="3"><tag k="a" v="b"/></node></create>
 <modify>
  <way id="11" version="2"><nd ref="3"/><nd ref="6"/></way>
  <node id="3" lat="1.51" lon="1.5" version="2"/>
  <node id="2" lat="0.5" lon="0.5" version="3"/>
  <way id="10" version="5"><nd ref="1"/></way>
  <way id="10" version="4"><nd ref="2"/><nd ref="3"/></way>
  <node id="50" lat="3" lon="3" version="7"/>
 </modify>
 <delete><relation id="23" version="2"/><node id="404" version="2"/><node id="5" version="2"/></delete>
</osmChange>
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.osm").write_text(OSM, encoding="utf-8")
    (d / "a.osc.gz").write_bytes(gzip.compress(OSC.encode()))
    return d


@pytest.fixture(scope="module")
def db(spark, files):
    root = str(files / "db")
    xmlfiles.expand(spark, str(files / "a.osm"), root)
    return OsmDataset.open(spark, root)


@pytest.fixture(scope="module")
def osc(spark, files):
    xmlfiles.register(spark)
    return spark.read.format("changes_xml").option("seq", 5).load(str(files / "a.osc.gz"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_file_head_and_published_tables(files, db):
    head = xmlfiles.header(str(files / "a.osm"))
    assert head["generator"] == "test" and head["bounds_maxlat"] == "2"
    assert db.get_metadata("import_filename") == "a.osm" and db.get_metadata(TIMESTAMP) == "2024-01-01T00:00:00Z" and db.get_metadata("none") == ""
    assert {r["table_name"]: r["n"] for r in db.stats().collect()} == {"locations": 5, "nodes": 1, "ways": 4, "relations": 4, "cell_node": 5, "node_way": 6, "node_relation": 1, "way_relation": 5, "relation_relation": 4}
    r = db.locations.where("id = 1").first()
    assert (r["lon_i"], r["lat_i"]) == (-1, 1)
    assert pairs(db.node_way) == [(1, 10), (2, 10), (3, 11), (4, 11), (5, 13), (99, 10)]


def test_extract_follows_the_equations(db):
    e = ex.extract(db, Region.parse("-1,-1,1,1", "bbox"), "exact")
    assert (ids(e.n0), ids(e.w0), ids(e.r0), ids(e.r), ids(e.w), ids(e.n)) == ([1, 2], [10], [20], [20, 21, 22], [10, 11], [1, 2, 3, 4, 99])
    assert ids(e.nodes()) == [1, 2, 3, 4] and e.nodes().where("id = 1").first()["tags"] is None
    m = e.nodes(user_data=False).where("id = 2").first()["meta"]
    assert m["version"] == 2 and m["uid"] is None
    wide = ex.extract(db, Region.parse("-1,-1,1,1", "bbox"), "covering")
    assert set(ids(e.n0)) <= set(ids(wide.n0))
    nothing = ex.extract(db, Region.parse("50,50,51,51", "bbox"))
    assert [r["n"] for r in nothing.counts().collect()] == [0] * 6
    with pytest.raises(ValueError):
        ex.nodes_in(db, Region.parse("0,0,1,1", "bbox"), "other")


def test_relations_above_by_a_walk_and_in_rounds(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (9, 1), (7, 8), (4, None), (2, 3)], "child_id bigint, parent_id bigint")
    start = spark.createDataFrame([(1,), (4,), (50,), (1,)], "id bigint")
    for most in (0, 100):
        assert ids(ex.closure(links, start, most)) == [1, 2, 3, 4, 50]
        assert ids(ex.closure(links, start.limit(0), most)) == [] and ids(ex.closure(links.limit(0), start, most)) == [1, 4, 50]


def test_exact_boxes_take_whole_numbers(db):
    assert ex._whole(0.1, 0.3) == (1_000_000, 3_000_000) and ex._whole(-179.0000001, 5.0) == (-1790000001, 50000000)
    plan = ex.nodes_in(db, Region.parse("-1,-1,1,1", "bbox"), "exact")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat_i,-10000000)" in plan
    assert ids(ex.nodes_in(db, Region.parse("0.5,0.5,0.1", "disc"), "exact")) == [2]


def test_lookups_reach_the_scan(db):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,10)" in plan(db.ways.where("id = 10")) and "EqualTo(node_id,3)" in plan(db.node_way.where("node_id = 3"))


def test_many_ranges_equal_few(spark, monkeypatch):
    cells = spark.range(0, 200000, 7).select((F.col("id") * 4099).alias("cell"))
    ranges = [(k * 8_000_000, k * 8_000_000 + 3_000_000 + k) for k in range(90)]
    want = sum(any(lo <= c < hi for lo, hi in ranges) for c in (7 * k * 4099 for k in range(-(-200000 // 7))))
    assert ex.in_ranges(cells, ranges).count() == want == sum(ex.in_ranges(cells, ranges[i : i + 45]).count() for i in (0, 45))
    assert ex.in_ranges(cells, []).count() == 0
    monkeypatch.setattr(ex, "BROADCAST_RANGES", 10)
    assert ex.in_ranges(cells, ranges).count() == want


def test_geometry(db):
    w = {r["id"]: (r["wkt"], r["missing"]) for r in geo.way_wkt(db.ways, db.locations).collect()}
    assert w[10] == ("W\tLINESTRING (-0.0000001 0.0000001,0.5000000 0.5000000,-0.0000001 0.0000001)", 1)
    assert w[12] == ("\tLINESTRING ()", 0)
    f = geo.node_geojson(db.locations, db.nodes).select("id", geo.feature(F.col("geometry"), F.col("tags")).alias("f"))
    got = {r["id"]: json.loads(r["f"]) for r in f.collect()}
    assert got[2] == {"type": "Feature", "properties": {"name": "last"}, "geometry": {"type": "Point", "coordinates": [0.5, 0.5]}} and got[1]["properties"] == {}
    r = {x["id"]: json.loads(x["geometry"]) for x in geo.relation_geojson(db.relations, db.ways, db.locations).collect()}
    assert [g["type"] for g in r[21]["geometries"]] == ["Point", "LineString", "LineString", "LineString"]  # the cycle ends
    assert r[22] == r[21]


def test_change_file_keeps_document_order(osc):
    rows = osc.orderBy("pos").collect()
    assert [(r["action"], r["type"], r["id"]) for r in rows][:4] == [("create", "node", 6), ("delete", "node", 6), ("create", "node", 6), ("modify", "way", 11)]
    assert [r["pos"] for r in rows] == list(range(len(rows))) and {r["seq"] for r in rows} == {5}


def test_update_equals_rebuilding(spark, db, osc):
    new = up.update(db, osc)
    loc = {r["id"]: (r["lon_i"], r["lat_i"], r["version"]) for r in new.locations.collect()}
    assert set(loc) == {1, 2, 3, 4, 6, 50} and loc[6] == (10000000, 12500000, 3) and loc[3][1] == 15100000
    assert ids(new.nodes) == [6]  # node 2 lost its tags
    assert {r["id"]: r["nodes"] for r in new.ways.collect()}[10] == [2, 3]  # the last change counts, not the highest version
    assert ids(new.relations) == [20, 21, 22]
    for name in indexes.COLUMNS:
        again = indexes.build(name, new.locations, new.ways, new.relations)
        assert pairs(getattr(new, name)) == pairs(again), name
    assert (5, 13) in pairs(new.node_way)  # a deleted node stays referred to
    assert pairs(up.index_delta(db, osc)) == [(1, 10, "delete"), (3, 10, "insert"), (4, 11, "delete"), (6, 11, "insert"), (99, 10, "delete")]
    half = [osc.where("pos < 5"), osc.where("pos >= 5 and pos < 8"), osc.where("pos >= 8")]
    one_by_one = db
    for h in half:
        one_by_one = up.update(one_by_one, h)
    for name in new.tables:
        assert sorted(map(repr, getattr(new, name).collect())) == sorted(map(repr, getattr(one_by_one, name).collect())), name


def test_commit_rehearsal_lock_and_pinned_versions(spark, files, osc):
    root = str(files / "db2")
    first = xmlfiles.expand(spark, str(files / "a.osm"), root)
    pinned = OsmDataset.open(spark, root)
    before = sorted(os.listdir(root))
    assert up.apply_file(pinned, osc, root, 5, "2024-02-02T00:00:00Z") is None
    assert sorted(os.listdir(root)) == before  # a rehearsal writes nothing
    assert OsmDataset.open(spark, root).version == first
    assert up.apply_file(pinned, osc, root, 5, "2024-02-02T00:00:00Z", commit=True) == first + 1
    now = OsmDataset.open(spark, root)
    assert now.get_metadata(SEQNUM) == "5" and now.relations.count() == 3 and pinned.relations.count() == 4
    assert OsmDataset.open(spark, root, first).relations.count() == 4
    for name, df in up.update(pinned, osc).tables.items():  # the delta gives what a full update gives
        assert sorted(map(repr, getattr(now, name).collect())) == sorted(map(repr, df.collect())), name
    with pytest.raises(Busy):  # made for a version that is no longer the current one
        up.apply_file(pinned, osc, root, 6, "2024-02-03T00:00:00Z", commit=True)
    with writer_lock(root):
        code = f"from terrafold.dataset import *\nwith writer_lock({root!r}): pass"
        tried = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert tried.returncode and "Busy" in tried.stderr


def test_an_update_writes_what_it_changes(spark, tmp_path, monkeypatch):
    root, read = str(tmp_path / "db"), lambda t: spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet")
    el = {"locations": T.current(read("locations"), "version"), **{n: T.current(read(n), "meta.version") for n in ("nodes", "ways", "relations")}}
    OsmDataset.from_elements(spark, el).publish(root, partitions=2)
    halves = [read("changes").where(f"seq % 2 = {i}") for i in (0, 1)]
    few = halves[0].select("type", "id").where("id is not null").distinct().count()
    rows = lambda df: sorted(map(repr, df.collect()))
    want = up.update(up.update(OsmDataset.open(spark, root), halves[0]), halves[1])
    want = {n: rows(getattr(want, n)) for n in ("locations", "ways", "node_way", "cell_node")}
    up.apply_file(OsmDataset.open(spark, root), halves[0], root, 1, "x", commit=True)
    n = {t: spark.read.parquet(f"{root}/v2/{t}").count() for t in ("touched", "locations", "cell_node")}
    assert n["touched"] == few and max(n.values()) <= few < len(want["locations"])
    up.apply_file(OsmDataset.open(spark, root), halves[1], root, 2, "y", commit=True)
    now = OsmDataset.open(spark, root)
    assert OsmDataset.manifest(spark, root)["deltas"] == [2, 3] and now.get_metadata(SEQNUM) == "2"
    assert {n: rows(getattr(now, n)) for n in want} == want
    monkeypatch.setattr("terrafold.dataset.MAX_DELTAS", 3)
    up.apply_file(now, halves[1], root, 3, "z", commit=True)
    m = OsmDataset.manifest(spark, root)
    assert (m["version"], m["full"], m["deltas"], m["metadata"][SEQNUM]) == (5, 5, [], "3")
    assert vacuum(spark, root, keep=1) == [1, 2, 3, 4]
    now = OsmDataset.open(spark, root)
    assert {n: rows(getattr(now, n)) for n in want} == want


def test_a_file_is_parsed_once(spark, files, tmp_path, monkeypatch):
    """Each parse of the rows leaves a mark."""
    marks, root = str(tmp_path / "marks"), f"file://{tmp_path}/db"  # a path with a scheme
    os.mkdir(marks)
    real = xmlfiles.elements

    def marked(parsed):
        assert all("elements_xml" not in str(x) for x in parsed.inputFiles())  # a written table
        return real(parsed)

    class Marking(xmlfiles._XmlReader):
        def read(self, partition):
            import uuid

            open(os.path.join(marks, uuid.uuid4().hex), "w").close()
            yield from super().read(partition)

    class Source(xmlfiles.ElementsXml):
        def reader(self, schema):
            return Marking(self.options)

    monkeypatch.setattr(xmlfiles, "elements", marked)
    monkeypatch.setattr(xmlfiles, "register", lambda s: s.dataSource.register(Source))
    xmlfiles.expand(spark, str(files / "a.osm"), root)
    monkeypatch.undo()
    xmlfiles.register(spark)
    assert len(os.listdir(marks)) == 1
    assert OsmDataset.open(spark, root).ways.count() == 4
    assert up.apply_file(OsmDataset.open(spark, root), spark.read.format("changes_xml").option("seq", 5).load(str(files / "a.osc.gz")), root, 5, "t", commit=True) == 2


def test_small_files(spark, tmp_path):
    f = Files(spark)
    f.makedirs(str(tmp_path / "x"))
    f.write(str(tmp_path / "x/a"), "é1", new=True)
    with pytest.raises(Exception):
        f.write(str(tmp_path / "x/a"), "2", new=True)
    f.replace(str(tmp_path / "x/a"), "3")
    assert f.read(str(tmp_path / "x/a")) == "3" and f.names(str(tmp_path / "x")) == ["a"]
    f.delete(str(tmp_path / "x"))
    assert not f.exists(str(tmp_path / "x/a")) and f.names(str(tmp_path / "x")) == []
    with pytest.raises(FileNotFoundError):
        f.read(str(tmp_path / "none"))


def test_augmented_diff(spark, db, osc):
    actions = augdiff.newest(osc)
    got = {(r["type"], r["id"]): r for r in augdiff.old_new(db, actions).collect()}
    assert got["way", 10]["new_nodes"] == [1] and got["way", 10]["new_version"] == 5  # the highest version counts
    assert got["node", 50]["action"] == "create" and got["node", 6]["action"] == "create"
    d = got["node", 404]
    assert d["action"] == "delete" and d["old_version"] == "?" and not d["visible"] and d["new_lon_i"] is None
    assert got["node", 3]["old_version"] == "1" and got["node", 3]["old_user"] == "?"
    assert pairs(augdiff.affected(db, actions, augdiff.old_new(db, actions))) == [("relation", 20)]
    order = augdiff.augmented_diff(db, osc).collect()
    assert [(r["type"], r["id"]) for r in order] == sorted(((r["type"], r["id"]) for r in order), key=lambda x: (augdiff.RANK[x[0]], x[1]))
    assert ("relation", 20) not in {(r["type"], r["id"]) for r in order}  # one of its ways doesn't exist
    text = augdiffxml.render(db, osc)
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    assert root[0].tag == "note" and len(root.findall("action")) == len(order)
    way = root.find("action/old/way[@id='11']")
    assert root.find("action/new/node[@id='404']").get("visible") == "false" and root.find("action/old/node[@id='404']").get("timestamp") == "?"
    plain = ET.fromstring(augdiffxml.render(db, spark.createDataFrame([(1, 0, "modify", "node", 1, 9, 5, 5, None, None, None, (9, 1600000000, 3, 4, "me"))], schemas.CHANGES)))
    new, old = plain.find("action/new/node"), plain.find("action/old/node")
    assert new.attrib == {"id": "1", "version": "9", "user": "me", "uid": "4", "timestamp": "2020-09-13T12:26:40Z", "changeset": "3", "lat": "0.0000005", "lon": "0.0000005"}
    assert old.attrib == {"id": "1", "version": "1", "user": "?", "uid": "?", "timestamp": "?", "changeset": "?", "lat": "0.0000001", "lon": "-0.0000001"}
    spread = plain.find("action/old/way[@id='10']")  # moved along with its node
    assert {k: spread.get(k) for k in ("version", "user", "timestamp")} == {"version": "1", "user": "?", "timestamp": "?"}
    assert plain.find("action/new/way[@id='10']").attrib == spread.attrib
    assert way.find("bounds").get("maxlat") == "1.6000000" and root.find("action/new/way[@id='11']")[0].get("lat") == "1.5100000"


def test_xml_round_trip(spark, db, files):
    out = str(files / "out.osm")
    xmlsink.write(xmlsink.objects_of(db.locations.join(db.nodes, "id", "left").select("id", "lon_i", "lat_i", "version", "tags", "meta"), db.ways, db.relations), out, {"generator": "x", "box": [0, 0, 1, 1]})
    back = xmlfiles.elements(spark.read.format("elements_xml").load(out))
    for name in ("locations", "ways", "relations"):
        cols = [c for c in getattr(db, name).columns if c != "meta"]
        assert sorted(map(repr, back[name].select(cols).collect())) == sorted(map(repr, getattr(db, name).select(cols).collect()))
    rows = spark.read.format("elements_xml").load(out).orderBy("pos").collect()
    assert [(r["type"], r["id"]) for r in rows] == [("node", i) for i in (1, 2, 3, 4, 5)] + [("way", i) for i in (10, 11, 12, 13)] + [("relation", i) for i in (20, 21, 22, 23)]
    assert xmlfiles.header(out)["bounds_maxlon"] == "1.0000000"


def test_binary_round_trip(spark, db, files):
    out = str(files / "out.pbf")
    nodes = db.locations.join(db.nodes, "id", "left").select("id", "lon_i", "lat_i", "version", "tags", "meta")
    own = spark.createDataFrame([(2**40, -1800000000, 900000000, 3, [("k", "é"), ("", "x")], (3, 1600000000, 7, 8, "me")), (9, None, 5, 1, None, None)], nodes.schema)
    pbfsink.write(xmlsink.objects_of(nodes.unionByName(own), db.ways, db.relations), out, {"generator": "x", "box": [-1.5, 0, 1, 1], "osmosis_replication_timestamp": "2024-01-01T00:00:00Z"})
    assert pbf.header(out) == {"generator": "x", "osmosis_replication_timestamp": "2024-01-01T00:00:00Z", "bounds_minlon": "-1.5", "bounds_maxlon": "1.0", "bounds_maxlat": "1.0", "bounds_minlat": "0.0"}
    rows = spark.read.format("elements_pbf").load(out).orderBy("pos").collect()
    assert [(r["type"], r["id"]) for r in rows] == [("node", i) for i in (1, 2, 3, 4, 5, 2**40)] + [("way", i) for i in (10, 11, 12, 13)] + [("relation", i) for i in (20, 21, 22, 23)]
    back = xmlfiles.elements(spark.read.format("elements_pbf").load(out))
    for name in ("ways", "relations"):
        cols = [c for c in getattr(db, name).columns if c != "meta"]
        assert sorted(map(repr, back[name].select(cols).collect())) == sorted(map(repr, getattr(db, name).select(cols).collect()))
    far = rows[5]
    assert (far["lon_i"], far["lat_i"], far["version"], far["tags"], tuple(far["meta"])) == (-1800000000, 900000000, 3, [("k", "é")], (3, 1600000000, 7, 8, "me"))


def test_addresses(spark, db, files):
    """Through the file systems that know addresses, on driver and executors."""
    nodes = db.locations.join(db.nodes, "id", "left").select("id", "lon_i", "lat_i", "version", "tags", "meta")
    for kind, sink, reader in (("osm", xmlsink, "elements_xml"), ("pbf", pbfsink, "elements_pbf")):
        out = f"file://{files}/addressed.{kind}"
        sink.write(xmlsink.objects_of(nodes, db.ways, db.relations), out, {"generator": "x"})
        assert spark.read.format(reader).load(out).count() == 13
    assert not [n for n in os.listdir(files) if n.endswith((".part", ".tmp"))]


def vint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def zz(x):
    return x << 1 if x >= 0 else (-x << 1) - 1


def msg(*items):
    out = b""
    for n, v in items:
        out += vint(n << 3 | 2) + vint(len(v)) + v if isinstance(v, bytes) else vint(n << 3) + vint(v)
    return out


def deltas(xs):
    return b"".join(vint(zz(b - a)) for a, b in zip([0, *xs], xs))


def blob(kind, raw, plain=False):
    body = msg((1, raw)) if plain else msg((2, len(raw)), (3, zlib.compress(raw)))
    head = msg((1, kind), (3, len(body)))
    return struct.pack(">I", len(head)) + head + body


def test_binary_file(spark, tmp_path):
    strings = msg(*[(1, s) for s in (b"", b"k", b"v", b"me", b"outer")])
    dense = msg((1, deltas([5, 3])), (5, msg((1, vint(1) + vint(2)), (2, deltas([100, 200])), (3, deltas([7, 8])), (4, deltas([9, 9])), (5, deltas([3, 3])))), (8, deltas([10, -20])), (9, deltas([-30, 40])), (10, bytes([1, 2, 0, 0])))
    way = msg((1, 50), (2, vint(1)), (3, vint(2)), (4, msg((1, 4), (2, 300), (5, 3))), (8, deltas([5, 3, 5])))
    rel = msg((1, 60), (8, vint(4) + vint(0)), (9, deltas([50, 5])), (10, vint(1) + vint(0)))
    one = msg((1, strings), (2, msg((2, dense))), (2, msg((3, way))))
    two = msg((1, strings), (2, msg((4, rel))), (17, 1000))
    head = blob(b"OSMHeader", msg((16, b"gen"), (32, 86400), (33, 12)))
    p = tmp_path / "a.pbf"
    p.write_bytes(head + blob(b"OSMData", one) + blob(b"OSMData", two, plain=True))
    assert pbf.header(str(p)) == {"generator": "gen", "osmosis_replication_timestamp": "1970-01-02T00:00:00Z", "osmosis_replication_sequence_number": "12"}
    xmlfiles.register(spark)
    rows = spark.read.format("elements_pbf").load(str(p)).orderBy("pos").collect()
    assert [(r["type"], r["id"]) for r in rows] == [("node", 5), ("node", 3), ("way", 50), ("relation", 60)]
    assert (rows[0]["lon_i"], rows[0]["lat_i"], rows[0]["version"], rows[0]["meta"]["timestamp"], rows[0]["meta"]["user"]) == (-30, 10, 1, 100, "me")
    assert rows[0]["tags"][0]["v"] == "v" and rows[1]["tags"] == [] and (rows[1]["lon_i"], rows[1]["lat_i"]) == (40, -20)
    assert rows[2]["nodes"] == [5, 3, 5] and rows[2]["meta"]["timestamp"] == 300
    assert [(m["ref"], m["type"], m["role"]) for m in rows[3]["members"]] == [(50, "way", "outer"), (5, "node", "")]
    root = str(tmp_path / "db")
    xmlfiles.expand(spark, str(p), root)
    assert OsmDataset.open(spark, root).get_metadata(SEQNUM) == "12"


def feed(folder, last):
    for s in range(1, last + 1):
        at = os.path.join(folder, replication.path_of(s))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        body = f'<osmChange><modify><node id="{s}" lat="1" lon="{s}" version="{s + 10}"/></modify><delete><node id="{s - 1}" version="99"/></delete></osmChange>'
        with open(at + ".osc.gz", "wb") as f:
            f.write(gzip.compress(body.encode()))
        if s != 3:  # one state file is missing
            with open(at + ".state.txt", "w") as f:
                f.write(f"#comment\nsequenceNumber={s}\ntimestamp=2024-01-0{s}T00\\:00\\:00Z\n")
    with open(os.path.join(folder, "state.txt"), "w") as f:
        f.write(f"sequenceNumber={last}\ntimestamp=2024-01-0{last}T00\\:00\\:00Z\n")


def test_replication_states(tmp_path):
    feed(str(tmp_path), 5)
    f = replication.Feed(str(tmp_path))
    day = lambda d, h=0: xmlfiles.epoch(f"2024-01-0{d}T{h:02d}:00:00Z")
    assert replication.path_of(4005006) == "004/005/006"
    assert [f.sequence_at(t) for t in (day(9), day(5), day(4, 5), day(4), day(3, 5), day(2, 1), day(2), day(1) - 5)] == [5, 5, 4, 2, 2, 2, 1, 1]
    with pytest.raises(replication.FeedError):
        f.state(3)
    with pytest.raises(replication.FeedError):
        replication.parse_state("nothing")


def test_catching_up_equals_one_batch_and_does_not_repeat(spark, files, tmp_path):
    root, folder = str(tmp_path / "db"), str(tmp_path / "feed")
    os.makedirs(folder)
    feed(folder, 2)
    xmlfiles.expand(spark, str(files / "a.osm"), root)
    start = OsmDataset.open(spark, root)
    start.metadata[SEQNUM] = "0"
    start.publish(root)
    run = lambda: catchup.catch_up(spark, folder, root, str(tmp_path / "cp")).awaitTermination(120)
    run()
    mid = OsmDataset.open(spark, root)
    assert mid.get_metadata(SEQNUM) == "2" and mid.locations.where("id = 2").first()["version"] == 12
    feed(folder, 5)
    run()
    now = OsmDataset.open(spark, root)
    assert now.get_metadata(SEQNUM) == "5" and now.get_metadata(TIMESTAMP) == "2024-01-05T00:00:00Z"
    xmlfiles.register(spark)
    files_now = ",".join(os.path.join(folder, replication.path_of(s)) + ".osc.gz" for s in range(1, 6))
    at_once = up.update(start, spark.read.format("changes_xml").option("seq", 1).load(files_now))
    assert pairs(now.locations) == pairs(at_once.locations)
    version = now.version
    assert catchup.apply_batch(spark, root, replication.Feed(folder), spark.read.format("changes_xml").option("seq", 1).load(files_now)) is None
    run()
    assert OsmDataset.open(spark, root).version == version


def test_command_line(spark, files, tmp_path, capsys):
    root, out = str(tmp_path / "db"), str(tmp_path / "x.osm")
    assert cli.main(["expand", str(files / "a.osm"), root], spark) == 0
    assert cli.main(["extract", root, out, "--bbox", "-1,-1,1,1", "--noUserData", "--jsonOutput"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert set(lines[-1]) == {"Timestamp", "CellsTotal", "CellsProg", "NodesTotal", "NodesProg", "ElemsTotal", "ElemsProg"}
    assert sorted(r["id"] for r in spark.read.format("elements_xml").load(out).where("type <> 'node'").collect()) == [10, 11, 20, 21, 22]
    assert 'uid="3"' not in open(out).read()
    assert cli.main(["update", root, str(files / "a.osc.gz"), "5", "2024-02-02T00:00:00Z", "--commit"], spark) == 0
    for what, want in ((["seqnum"], "5"), (["timestamp"], "2024-02-02T00:00:00Z"), (["way", "10"], "2 3"), (["relation", "21"], "relation 20"), (["node", "6"], "1.2500000 1.0000000\na=b"), (["node", "404"], "not found"), ([], "locations: 6")):
        assert cli.main(["query", root, *what], spark) == 0
        assert want in capsys.readouterr().out
    assert cli.main(["extract", root, out], spark) == 1
    assert cli.main(["query", root], spark) == 0
    said = capsys.readouterr().out
    assert "Timestamp: 2024-02-02T00:00:00Z" in said and "Sequence #: 5" in said
    assert cli.main(["extract", root, out + ".pbf", "--disc", "0,0,1"], spark) == 0
    assert spark.read.format("elements_pbf").load(out + ".pbf").where("type = 'way'").count() == 2
    env = lookup.Environment(spark, root)
    with lookup.Transaction(env) as txn:
        assert lookup.Locations(txn).get(6) == (1.25, 1.0, 3) and lookup.Locations(txn).get(404) is None
        assert lookup.Nodes(txn).get("1") is None and lookup.Ways(txn).get("10")["nodes"] == [2, 3]
        assert lookup.NodeWay(txn).get(3) == [10, 11] and lookup.RelationRelation(txn).get(20) == [21]
    assert lookup.tag_dict(["a", "b", "c", "d", "a", "z"]) == {"a": "z", "c": "d"}


def test_progress_bar():
    out = io.StringIO()
    p = Progress(out=out)
    p.start("Nodes", 1000)
    for i in (1, 2, 500, 1000):
        p.step("Nodes", i)
    assert out.getvalue().count("\r") == 3 and "100%" in out.getvalue()
