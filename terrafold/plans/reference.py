"""Queries of the element store: lookups, indexes, extracts, updates and augmented diffs, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import coverer, tables as T, tags
from terrafold.dataset import FILENAME, SEQNUM, OsmDataset
from terrafold.functions import s2
from terrafold.operators import augdiff, extract as ex, geometry as geo, indexes, update as up
from terrafold.region import Region
from terrafold.scratch import Scratch

#: The region of the extract queries: a box around a crowded place, and a disc within it.
BOX = "4.9,75.7,5.5,76.4"
DISC = "5.0,76.0,0.1"
REGION = Region.parse(BOX, "bbox")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prelude: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("--raw") else f"WITH RECURSIVE {prelude or PRELUDE} {sql}"
        return f

    return add


def _joined(c, sep: str = ","):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), sep)


def _tags(c: str = "tags"):
    return F.coalesce(_joined(F.transform(F.col(c), lambda t: F.concat(t["k"], F.lit("="), F.coalesce(t["v"], F.lit("")))), "|"), F.lit(""))


def _members(c: str = "members"):
    one = lambda m: F.concat_ws(":", m["type"], m["ref"].cast("string"), F.coalesce(m["role"], F.lit("")))
    return F.coalesce(_joined(F.transform(F.col(c), one), "|"), F.lit(""))


# SQL texts of the same lists
_S_TAGS = "coalesce(array_to_string(list_transform({0}, lambda t: t.k || '=' || coalesce(t.v, '')), '|'), '')"
_S_MEMBERS = "coalesce(array_to_string(list_transform({0}, lambda m: concat_ws(':', m.type, CAST(m.ref AS VARCHAR), coalesce(m.role, ''))), '|'), '')"
_S_REFS = "array_to_string(list_transform({0}, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',')"
_S_FIXED = "(CASE WHEN {0} < 0 THEN '-' ELSE '' END || CAST(abs(CAST({0} AS BIGINT)) // 10000000 AS VARCHAR) || '.' || lpad(CAST(abs(CAST({0} AS BIGINT)) % 10000000 AS VARCHAR), 7, '0'))"
_S_PAIR = "'[' || " + _S_FIXED.format("x.lon_i") + " || ',' || " + _S_FIXED.format("x.lat_i") + " || ']'"

PRELUDE = """
cl AS (SELECT id, r.lon_i AS lon_i, r.lat_i AS lat_i, r.version AS version FROM (SELECT id, max({'version': version, 'lon_i': lon_i, 'lat_i': lat_i}) AS r FROM locations GROUP BY id)),
cn AS (SELECT id, tags, meta FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(meta.version, -1) DESC) AS rn FROM nodes) WHERE rn = 1),
cw AS (SELECT id, nodes, tags, meta FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(meta.version, -1) DESC) AS rn FROM ways) WHERE rn = 1),
cr AS (SELECT id, members, tags, meta FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(meta.version, -1) DESC) AS rn FROM relations) WHERE rn = 1),
nw AS (SELECT DISTINCT node_id, way_id FROM (SELECT unnest(nodes) AS node_id, id AS way_id FROM cw) WHERE node_id IS NOT NULL),
mem AS (SELECT id, m.type AS t, m.ref AS ref FROM (SELECT id, unnest(members) AS m FROM cr)),
nr AS (SELECT DISTINCT ref AS node_id, id AS relation_id FROM mem WHERE t = 'node' AND ref IS NOT NULL),
wr AS (SELECT DISTINCT ref AS way_id, id AS relation_id FROM mem WHERE t = 'way' AND ref IS NOT NULL),
rr AS (SELECT DISTINCT ref AS child_id, id AS parent_id FROM mem WHERE t = 'relation' AND ref IS NOT NULL),
n0 AS (SELECT id FROM cl WHERE lat_i BETWEEN 49000000 AND 55000000 AND lon_i BETWEEN 757000000 AND 764000000),
w0 AS (SELECT DISTINCT way_id AS id FROM nw WHERE node_id IN (SELECT id FROM n0)),
r0 AS (SELECT relation_id AS id FROM nr WHERE node_id IN (SELECT id FROM n0) UNION SELECT relation_id FROM wr WHERE way_id IN (SELECT id FROM w0)),
ra(id) AS (SELECT id FROM r0 UNION SELECT parent_id FROM ra JOIN rr ON rr.child_id = ra.id),
mp AS (SELECT DISTINCT ref AS id FROM mem WHERE t = 'way' AND ref IN (SELECT id FROM cw)
       AND id IN (SELECT id FROM cr WHERE len(list_filter(tags, lambda t: t.k = 'type' AND t.v = 'multipolygon')) > 0) AND id IN (SELECT id FROM ra)),
wa AS (SELECT id FROM w0 UNION SELECT id FROM mp),
na AS (SELECT id FROM n0 UNION SELECT node_id FROM nw WHERE way_id IN (SELECT id FROM wa)),
lo AS (SELECT *, lower(trim(action)) = 'delete' AS gone FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY seq DESC, pos DESC, version DESC, meta.timestamp DESC NULLS LAST, lower(trim(action)) = 'delete' DESC, lon_i DESC NULLS LAST, lat_i DESC NULLS LAST) AS rn FROM changes) WHERE rn = 1),
hv AS (SELECT type, id, version, lower(trim(action)) AS action, lon_i, lat_i, nodes, members, tags, meta, first_seq, first_pos FROM (
  SELECT *, first_value(seq) OVER f AS first_seq, first_value(pos) OVER f AS first_pos,
         row_number() OVER (PARTITION BY type, id ORDER BY version DESC, seq DESC, pos DESC, meta.timestamp DESC NULLS LAST, lower(trim(action)) DESC, lon_i DESC NULLS LAST, lat_i DESC NULLS LAST) AS rn
  FROM changes WINDOW f AS (PARTITION BY type, id ORDER BY seq, pos)) WHERE rn = 1),
vis AS (SELECT id, u.pos - 1 AS pos, u.node AS node_id FROM (SELECT id, unnest(list_transform(nodes, lambda x, i: {'node': x, 'pos': i})) AS u FROM cw)),
seen AS (SELECT v.id, v.pos, v.node_id, cl.lon_i, cl.lat_i FROM vis v LEFT JOIN cl ON cl.id = v.node_id AND cl.lon_i IS NOT NULL AND cl.lat_i IS NOT NULL),
img AS (SELECT h.*, CASE h.type WHEN 'node' THEN cl.id IS NOT NULL WHEN 'way' THEN cw.id IS NOT NULL ELSE cr.id IS NOT NULL END AS in_db,
               cl.lon_i AS o_lon, cl.lat_i AS o_lat, cw.nodes AS o_nodes, cr.members AS o_members,
               CASE h.type WHEN 'node' THEN coalesce(cn.meta.version, cl.version) WHEN 'way' THEN cw.meta.version ELSE cr.meta.version END AS o_version,
               CASE h.type WHEN 'node' THEN CASE WHEN cl.id IS NOT NULL THEN cn.meta END WHEN 'way' THEN cw.meta ELSE cr.meta END AS o_meta
        FROM hv h LEFT JOIN cl ON h.type = 'node' AND cl.id = h.id LEFT JOIN cn ON h.type = 'node' AND cn.id = h.id
        LEFT JOIN cw ON h.type = 'way' AND cw.id = h.id LEFT JOIN cr ON h.type = 'relation' AND cr.id = h.id),
act AS (SELECT *, CASE WHEN action = 'modify' AND NOT in_db THEN 'create' ELSE action END AS act FROM img),
moved AS (SELECT id FROM act WHERE act = 'modify' AND type = 'node' AND (o_lon IS DISTINCT FROM lon_i OR o_lat IS DISTINCT FROM lat_i)),
bent AS (SELECT id FROM act WHERE act = 'modify' AND type = 'way' AND coalesce(o_nodes, []) IS DISTINCT FROM coalesce(nodes, [])),
aw AS (SELECT DISTINCT way_id AS id FROM nw WHERE node_id IN (SELECT id FROM moved) AND way_id NOT IN (SELECT id FROM hv WHERE type = 'way')),
ar AS (SELECT id FROM (SELECT relation_id AS id FROM nr WHERE node_id IN (SELECT id FROM moved)
       UNION SELECT relation_id FROM wr WHERE way_id IN (SELECT id FROM aw) OR way_id IN (SELECT id FROM bent)) WHERE id NOT IN (SELECT id FROM hv WHERE type = 'relation'))
"""


def _db(spark: SparkSession, d: str, *settled: str) -> OsmDataset:
    return OsmDataset.from_raw(spark, d, settled)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "changes")


# ---- lookups, filters, projections


@query("""SELECT 'locations' AS table_name, count(*) AS n FROM cl UNION ALL SELECT 'nodes', count(*) FROM cn UNION ALL SELECT 'ways', count(*) FROM cw
UNION ALL SELECT 'relations', count(*) FROM cr UNION ALL SELECT 'node_way', count(*) FROM nw UNION ALL SELECT 'node_relation', count(*) FROM nr
UNION ALL SELECT 'way_relation', count(*) FROM wr UNION ALL SELECT 'relation_relation', count(*) FROM rr
UNION ALL SELECT 'cell_node', count(*) FROM cl WHERE lon_i BETWEEN -1800000000 AND 1800000000 AND lat_i BETWEEN -900000000 AND 900000000""")
def table_stats(spark, d):
    return _db(spark, d).stats()


def _published(spark: SparkSession, d: str, *names: str, metadata: dict[str, str] | None = None) -> str:
    """The root of a dataset that is published, with some of its tables, in the shared folder."""
    db = _db(spark, d)
    root = f"{Scratch(spark).root}/published"
    OsmDataset(spark, {n: getattr(db, n) for n in names}, metadata or {}).publish(root)
    return root


@query("""SELECT k AS key, coalesce(v, '') AS value FROM (VALUES ('osmosis_replication_sequence_number', (SELECT CAST(max(seq) AS VARCHAR) FROM changes)), ('import_filename', 'relations.parquet'), ('absent', NULL)) t(k, v)""")
def metadata_get(spark, d):
    """The value that a published dataset has for each key, empty where there is none; its sequence number is that of the
    newest change of the feed."""
    newest = str(_changes(spark, d).agg(F.max("seq").alias("s")).first()["s"])
    root = _published(spark, d, "relations", metadata={SEQNUM: newest, FILENAME: "relations.parquet"})
    db = OsmDataset.open(spark, root)
    return spark.createDataFrame([(k, db.get_metadata(k)) for k in (SEQNUM, FILENAME, "absent")], "key string, value string")


@query(f"SELECT 'way' AS kind, id, {_S_REFS.format('nodes')} AS body, {_S_TAGS.format('tags')} AS tags FROM cw WHERE id = (SELECT max(id) FROM cw) UNION ALL SELECT 'node_way', node_id, CAST(way_id AS VARCHAR), '' FROM nw WHERE way_id = (SELECT max(id) FROM cw)")
def lookup_by_id(spark, d):
    """The way with the highest id, found by that id in a published dataset, and its entries of the node index."""
    db = OsmDataset.open(spark, _published(spark, d, "ways", "node_way"))
    last = db.ways.agg(F.max("id").alias("i")).first()["i"]
    way = db.ways.where(F.col("id") == last)
    index = db.node_way.where(F.col("way_id") == last)
    return way.select(F.lit("way").alias("kind"), "id", _joined(F.col("nodes")).alias("body"), _tags().alias("tags")).unionByName(
        index.select(F.lit("node_way").alias("kind"), F.col("node_id").alias("id"), F.col("way_id").cast("string").alias("body"), F.lit("").alias("tags"))
    )


@query("SELECT id, lat_i / 1e7 AS lat, lon_i / 1e7 AS lon, version FROM cl")
def location_lookup(spark, d):
    return T.current_locations(spark, d).select("id", geo.degrees("lat_i").alias("lat"), geo.degrees("lon_i").alias("lon"), "version")


@query(f"SELECT cl.id, cl.version, {_S_TAGS.format('cn.tags')} AS tags, cn.meta.changeset AS changeset FROM cl LEFT JOIN cn ON cn.id = cl.id")
def node_lookup(spark, d):
    db = _db(spark, d)
    return db.locations.join(db.nodes, "id", "left").select("id", "version", _tags().alias("tags"), F.col("meta.changeset").alias("changeset"))


@query(f"SELECT id, {_S_REFS.format('nodes')} AS refs, {_S_TAGS.format('tags')} AS tags, meta.version AS version, meta.timestamp AS stamp FROM cw")
def way_lookup(spark, d):
    return T.current_ways(spark, d).select("id", _joined(F.col("nodes")).alias("refs"), _tags().alias("tags"), F.col("meta.version").alias("version"), F.col("meta.timestamp").alias("stamp"))


@query(f"SELECT id, {_S_MEMBERS.format('members')} AS members, {_S_TAGS.format('tags')} AS tags, meta.version AS version FROM cr")
def relation_lookup(spark, d):
    return T.current_relations(spark, d).select("id", _members().alias("members"), _tags().alias("tags"), F.col("meta.version").alias("version"))


@query("""SELECT 'node_way' AS index_name, node_id AS key, string_agg(CAST(way_id AS VARCHAR), ',' ORDER BY way_id) AS vals FROM nw GROUP BY node_id
UNION ALL SELECT 'node_relation', node_id, string_agg(CAST(relation_id AS VARCHAR), ',' ORDER BY relation_id) FROM nr GROUP BY node_id
UNION ALL SELECT 'way_relation', way_id, string_agg(CAST(relation_id AS VARCHAR), ',' ORDER BY relation_id) FROM wr GROUP BY way_id
UNION ALL SELECT 'relation_relation', child_id, string_agg(CAST(parent_id AS VARCHAR), ',' ORDER BY parent_id) FROM rr GROUP BY child_id""")
def reverse_lookup(spark, d):
    db, out = _db(spark, d), None
    for n in ("node_way", "node_relation", "way_relation", "relation_relation"):
        r = indexes.reverse(getattr(db, n)).select(F.lit(n).alias("index_name"), "key", _joined(F.col("values")).alias("vals"))
        out = r if out is None else out.unionByName(r)
    return out


@query("SELECT id FROM cr WHERE len(list_filter(tags, lambda t: t.k = 'type' AND t.v = 'multipolygon')) > 0")
def tag_filter(spark, d):
    return T.current_relations(spark, d).where(tags.has(F.col("tags"), "type", "multipolygon")).select("id")


@query("SELECT id, list_filter(tags, lambda t: t.k = 'name')[-1].v AS name FROM cw")
def tag_project(spark, d):
    return T.current_ways(spark, d).select("id", tags.value(F.col("tags"), "name").alias("name"))


@query("SELECT id, coalesce(len(tags), 0) > 0 AS tagged FROM cn")
def tagged_nodes(spark, d):
    return T.current_nodes(spark, d).select("id", tags.tagged(F.col("tags")).alias("tagged"))


@query("""SELECT id, u.k AS k, list_filter(tags, lambda t: t.k = u.k)[-1].v AS v FROM (SELECT id, tags, unnest(tags) AS u FROM cw) GROUP BY id, u.k, v""")
def tags_to_map(spark, d):
    """One row per entry of each way's tag map; of repeated keys the last counts."""
    m = T.current_ways(spark, d).select("id", tags.to_map(tags.from_flat(tags.flat(F.col("tags")))).alias("m"))
    return m.select("id", F.explode("m").alias("k", "v"))


@query("SELECT id, strftime(to_timestamp(meta.timestamp) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM cw")
def iso_timestamp(spark, d):
    return T.current_ways(spark, d).select("id", augdiff.iso(F.col("meta.timestamp")).alias("iso"))


@query("SELECT DISTINCT seq, lpad(CAST(seq // 1000000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(seq % 1000000 // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(seq % 1000 AS VARCHAR), 3, '0') AS path FROM changes")
def seq_path(spark, d):
    return _changes(spark, d).select("seq").distinct().select("seq", up.sequence_path(F.col("seq")).alias("path"))


@query(""", st AS (SELECT seq, max(meta.timestamp) AS stamp FROM changes WHERE meta IS NOT NULL GROUP BY seq), asked AS (SELECT DISTINCT meta.timestamp AS a FROM cw)
SELECT a AS stamp, CASE WHEN a >= (SELECT max({'seq': seq, 'at': stamp}).at FROM st) THEN (SELECT max(seq) FROM st)
 ELSE coalesce((SELECT max(seq) FROM st WHERE st.stamp < a), (SELECT min(seq) FROM st)) END AS seq FROM (SELECT a FROM asked UNION SELECT stamp FROM st) q""")
def ts_to_seq(spark, d):
    """The sequence that holds each time at which a way was edited or a sequence ends."""
    states = _changes(spark, d).where("meta is not null").groupBy("seq").agg(F.max("meta.timestamp").alias("at"))
    wanted = T.current_ways(spark, d).select(F.col("meta.timestamp").alias("at")).union(states.select("at"))
    return up.sequence_before(states, wanted).select(F.col("at").alias("stamp"), "seq")


# ---- indexes


@query("SELECT node_id, way_id FROM nw")
def build_node_way(spark, d):
    return indexes.node_way(T.current_ways(spark, d))


@query("SELECT node_id, relation_id FROM nr")
def build_node_relation(spark, d):
    return indexes.node_relation(T.current_relations(spark, d))


@query("SELECT way_id, relation_id FROM wr")
def build_way_relation(spark, d):
    return indexes.way_relation(T.current_relations(spark, d))


@query("SELECT child_id, parent_id FROM rr")
def build_relation_relation(spark, d):
    return indexes.relation_relation(T.current_relations(spark, d))


def _hilbert_sql() -> str:
    """Cells by nested selects, one per bit, from the published tables."""
    pos = "[" + ",".join(str(p) for o in range(4) for p in s2.QUADRANT_POSITION[o]) + "]"
    turn = "[" + ",".join(str(s2.ORIENTATION_CHANGE[p]) for o in range(4) for p in s2.QUADRANT_POSITION[o]) + "]"
    sql = """SELECT id, face, CAST(0 AS BIGINT) AS pos, face % 2 AS o,
  CAST(least(greatest(floor(65536 * (CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END)), 0), 65535) AS INTEGER) AS i,
  CAST(least(greatest(floor(65536 * (CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END)), 0), 65535) AS INTEGER) AS j
FROM (SELECT id, face, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u,
             CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v
 FROM (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face
  FROM (SELECT id, cos(radians(lat_i / 1e7)) * cos(radians(lon_i / 1e7)) AS x, cos(radians(lat_i / 1e7)) * sin(radians(lon_i / 1e7)) AS y, sin(radians(lat_i / 1e7)) AS z
   FROM cl WHERE lon_i BETWEEN -1800000000 AND 1800000000 AND lat_i BETWEEN -900000000 AND 900000000)))"""
    for k in range(15, -1, -1):
        at = f"o * 4 + ((i >> {k}) & 1) * 2 + ((j >> {k}) & 1) + 1"
        sql = f"SELECT id, face, pos * 4 + {pos}[{at}] AS pos, xor(o, {turn}[{at}]) AS o, i, j FROM ({sql})"
    return f", cells AS (SELECT CAST(face * 4294967296 + pos AS BIGINT) AS cell, id AS node_id FROM ({sql}))"


@query(_hilbert_sql() + " SELECT cell, node_id FROM cells")
def build_cell_node(spark, d):
    return indexes.cell_node(T.current_locations(spark, d))


@query("--raw\nSELECT DISTINCT cell, (cell >> 12) AS prefix, ((cell >> 12) << 12) AS range_from, (((cell >> 12) + 1) << 12) AS range_to FROM cell_node WHERE cell IS NOT NULL")
def cell_parent_range(spark, d):
    """The level-10 cell above each stored cell and its key range."""
    c = T.read(spark, d, "cell_node").select("cell").where("cell is not null").distinct()
    prefix = s2.parent(F.col("cell"), 10)
    lo, hi = s2.range_of(prefix, 10)
    return c.select("cell", prefix.alias("prefix"), lo.alias("range_from"), hi.alias("range_to"))


_RANGES = coverer.covering(REGION)


@query("--raw\nSELECT DISTINCT node_id FROM cell_node WHERE " + " OR ".join(f"cell BETWEEN {lo} AND {hi - 1}" for lo, hi in _RANGES))
def cell_range_nodes(spark, d):
    """Nodes of the stored index in the covering of the box."""
    return ex.in_ranges(T.read(spark, d, "cell_node").select("cell", "node_id"), _RANGES).select("node_id").distinct()


# ---- regions and extracts


@query("SELECT id FROM n0")
def nodes_in_bbox(spark, d):
    return ex.nodes_in(_db(spark, d), REGION, "exact")


@query("""SELECT id FROM cl WHERE lon_i IS NOT NULL AND degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(lat_i / 1e7 - 5.0) / 2), 2)
 + cos(radians(5.0)) * cos(radians(lat_i / 1e7)) * pow(sin(radians(lon_i / 1e7 - 76.0) / 2), 2))))) <= 0.1""")
def nodes_in_disc(spark, d):
    return ex.nodes_in(_db(spark, d), Region.parse(DISC, "disc"), "exact")


def _n0(db):
    return ex.nodes_in(db, REGION, "exact")


@query("SELECT id FROM w0")
def ways_of_nodes(spark, d):
    db = _db(spark, d)
    return ex.parents(db.node_way, _n0(db))


@query("SELECT DISTINCT relation_id AS id FROM nr WHERE node_id IN (SELECT id FROM n0)")
def relations_of_nodes(spark, d):
    db = _db(spark, d)
    return ex.parents(db.node_relation, _n0(db))


@query("SELECT DISTINCT relation_id AS id FROM wr WHERE way_id IN (SELECT id FROM w0)")
def relations_of_ways(spark, d):
    db = _db(spark, d)
    return ex.parents(db.way_relation, ex.parents(db.node_way, _n0(db)))


@query("SELECT id FROM ra")
def relation_closure(spark, d):
    return ex.extract(_db(spark, d, "locations", "ways", "relations"), REGION, "exact").r


@query("SELECT DISTINCT ref AS id FROM mem WHERE t = 'way' AND ref IN (SELECT id FROM cw) AND id IN (SELECT id FROM cr WHERE len(list_filter(tags, lambda t: t.k = 'type' AND t.v = 'multipolygon')) > 0)")
def multipolygon_ways(spark, d):
    db = _db(spark, d)
    return ex.multipolygon_ways(db.relations, db.ways, db.relations.select("id"))


@query("SELECT DISTINCT node_id AS id FROM nw WHERE way_id IN (SELECT id FROM w0)")
def way_complete_nodes(spark, d):
    db = _db(spark, d)
    return ex.way_nodes(db.ways, ex.parents(db.node_way, _n0(db)))


@query("SELECT 'n0' AS set_name, count(*) AS n FROM n0 UNION ALL SELECT 'w0', count(*) FROM w0 UNION ALL SELECT 'r0', count(*) FROM r0 UNION ALL SELECT 'r', count(*) FROM ra UNION ALL SELECT 'w', count(*) FROM wa UNION ALL SELECT 'n', count(*) FROM na")
def extract_counts(spark, d):
    return ex.extract(_db(spark, d, "locations", "ways", "relations"), REGION, "exact").counts()


_ELEMENTS = f"""SELECT 0 AS rank, cl.id, cl.version AS version, {{u0}} AS uid, {_S_FIXED.format('cl.lon_i')} || ' ' || {_S_FIXED.format('cl.lat_i')} AS body, {_S_TAGS.format('cn.tags')} AS tags FROM cl LEFT JOIN cn ON cn.id = cl.id
 WHERE cl.id IN (SELECT id FROM na) AND cl.lon_i IS NOT NULL AND cl.lat_i IS NOT NULL
UNION ALL SELECT 1, id, meta.version, {{u}}, {_S_REFS.format('nodes')}, {_S_TAGS.format('tags')} FROM cw WHERE id IN (SELECT id FROM wa)
UNION ALL SELECT 2, id, meta.version, {{u}}, {_S_MEMBERS.format('members')}, {_S_TAGS.format('tags')} FROM cr WHERE id IN (SELECT id FROM ra)"""


def _elements(spark, d, user_data: bool, mode: str = "exact"):
    e = ex.extract(_db(spark, d, "locations", "ways", "relations"), REGION, mode)
    n = e.nodes(user_data).select(F.lit(0).alias("rank"), "id", "version", F.col("meta.uid").alias("uid"), F.concat(geo.fixed(F.col("lon_i")), F.lit(" "), geo.fixed(F.col("lat_i"))).alias("body"), _tags().alias("tags"))
    w = e.ways(user_data).select(F.lit(1).alias("rank"), "id", F.col("meta.version").alias("version"), F.col("meta.uid").alias("uid"), _joined(F.col("nodes")).alias("body"), _tags().alias("tags"))
    r = e.relations(user_data).select(F.lit(2).alias("rank"), "id", F.col("meta.version").alias("version"), F.col("meta.uid").alias("uid"), _members().alias("body"), _tags().alias("tags"))
    return n.unionByName(w).unionByName(r).orderBy("rank", "id")


@query(_ELEMENTS.format(u0="cn.meta.uid", u="meta.uid"))
def extract_elements(spark, d):
    return _elements(spark, d, True)


@query(_ELEMENTS.format(u0="CAST(NULL AS BIGINT)", u="CAST(NULL AS BIGINT)"))
def extract_no_user_data(spark, d):
    return _elements(spark, d, False)


_COVERED = PRELUDE.replace(
    "n0 AS (SELECT id FROM cl WHERE lat_i BETWEEN 49000000 AND 55000000 AND lon_i BETWEEN 757000000 AND 764000000)",
    _hilbert_sql().lstrip(", ") + ", n0 AS (SELECT DISTINCT node_id AS id FROM cells WHERE " + " OR ".join(f"cell BETWEEN {lo} AND {hi - 1}" for lo, hi in _RANGES) + ")",
)


@query(SQL["extract_counts"].split(PRELUDE)[1], _COVERED)
def extract_covering(spark, d):
    """The sizes of an extract by whole cells, as the box's covering has it."""
    return ex.extract(_db(spark, d, "locations", "ways", "relations"), REGION, "covering").counts()


@query(_ELEMENTS.format(u0="cn.meta.uid", u="meta.uid"), _COVERED)
def extract_elements_covering(spark, d):
    """All elements of an extract by whole cells."""
    return _elements(spark, d, True, "covering")


# ---- geometry


@query("SELECT id, CAST(pos AS INTEGER) AS pos, node_id, lon_i, lat_i FROM seen")
def way_coords(spark, d):
    db = _db(spark, d)
    return geo.visits(db.ways, db.locations)


_WKT = f"""SELECT cw.id, coalesce(list_filter(cw.tags, lambda t: t.k = 'name')[-1].v, '') || chr(9) || 'LINESTRING (' || coalesce(string_agg({_S_FIXED.format('s.lon_i')} || ' ' || {_S_FIXED.format('s.lat_i')}, ',' ORDER BY s.pos) FILTER (s.lon_i IS NOT NULL), '') || ')' AS wkt,
 CAST(count(s.id) FILTER (s.lon_i IS NULL) AS INTEGER) AS missing FROM cw LEFT JOIN seen s ON s.id = cw.id {{where}} GROUP BY cw.id, cw.tags"""


@query(_WKT.format(where=""))
def way_wkt(spark, d):
    db = _db(spark, d)
    return geo.way_wkt(db.ways, db.locations)


@query(_WKT.format(where="WHERE cw.id IN (SELECT id FROM w0)"))
def bbox_wkt(spark, d):
    db = _db(spark, d)
    own = db.ways.join(ex.parents(db.node_way, _n0(db)), "id", "left_semi")
    return geo.way_wkt(own, db.locations)




@query(f"""SELECT id, '{{"type":"Point","coordinates":' || {_S_PAIR} || '}}' AS geometry FROM cl x WHERE lon_i IS NOT NULL AND lat_i IS NOT NULL""")
def geojson_node(spark, d):
    db = _db(spark, d)
    return geo.node_geojson(db.locations, db.nodes).select("id", "geometry")


_LINE = f"""ln AS (SELECT cw.id, '{{"type":"LineString","coordinates":[' || coalesce(string_agg({_S_PAIR}, ',' ORDER BY x.pos) FILTER (x.lon_i IS NOT NULL), '') || ']}}' AS g FROM cw LEFT JOIN seen x ON x.id = cw.id GROUP BY cw.id)"""


@query(f", {_LINE} SELECT id, g AS geometry FROM ln")
def geojson_way(spark, d):
    db = _db(spark, d)
    return geo.way_geojson(db.ways, db.locations).select("id", "geometry")


_BELOW = "down(top, id) AS (SELECT id, id FROM cr UNION SELECT top, rr.child_id FROM down JOIN rr ON rr.parent_id = down.id), leafs AS (SELECT DISTINCT top AS id, t, ref FROM down JOIN mem ON mem.id = down.id WHERE t <> 'relation' AND ref IS NOT NULL)"


@query(f", {_BELOW} SELECT id, t AS member_type, ref AS member_id FROM leafs")
def relation_members_recursive(spark, d):
    return geo.members_below(T.current_relations(spark, d))


@query(f""", {_LINE}, {_BELOW}, parts AS (SELECT l.id, 0 AS rank, ref, '{{"type":"Point","coordinates":' || {_S_PAIR} || '}}' AS g FROM leafs l JOIN cl x ON x.id = l.ref WHERE l.t = 'node' AND x.lon_i IS NOT NULL AND x.lat_i IS NOT NULL
 UNION ALL SELECT l.id, 1, ref, ln.g FROM leafs l JOIN ln ON ln.id = l.ref WHERE l.t = 'way')
SELECT cr.id, '{{"type":"GeometryCollection","geometries":[' || coalesce(string_agg(p.g, ',' ORDER BY p.rank, p.ref), '') || ']}}' AS geometry FROM cr LEFT JOIN parts p ON p.id = cr.id GROUP BY cr.id""")
def geojson_relation(spark, d):
    db = _db(spark, d, "ways", "relations")
    return geo.relation_geojson(db.relations, db.ways, db.locations).select("id", "geometry")


# ---- updates


def _updated(spark, d):
    return up.update(_db(spark, d), _changes(spark, d))


def _s_replaced(base: str, cols: str, kind: str, new: str = "") -> str:
    return f"SELECT {cols} FROM {base} WHERE id NOT IN (SELECT id FROM lo WHERE type = '{kind}') UNION ALL SELECT {cols} FROM lo WHERE type = '{kind}' AND NOT gone {new}"


@query(_s_replaced("cl", "id, lon_i, lat_i, version", "node"))
def update_locations(spark, d):
    return _updated(spark, d).locations


@query(_s_replaced("cn", f"id, {_S_TAGS.format('tags')} AS tags, meta.version AS version", "node", "AND len(tags) > 0"))
def update_nodes(spark, d):
    return _updated(spark, d).nodes.select("id", _tags().alias("tags"), F.col("meta.version").alias("version"))


@query(_s_replaced("cw", f"id, {_S_REFS.format('nodes')} AS refs, {_S_TAGS.format('tags')} AS tags, meta.version AS version", "way"))
def update_ways(spark, d):
    return _updated(spark, d).ways.select("id", _joined(F.col("nodes")).alias("refs"), _tags().alias("tags"), F.col("meta.version").alias("version"))


@query(_s_replaced("cr", f"id, {_S_MEMBERS.format('members')} AS members, {_S_TAGS.format('tags')} AS tags, meta.version AS version", "relation"))
def update_relations(spark, d):
    return _updated(spark, d).relations.select("id", _members().alias("members"), _tags().alias("tags"), F.col("meta.version").alias("version"))


@query("SELECT node_id, way_id FROM nw WHERE way_id NOT IN (SELECT id FROM lo WHERE type = 'way') UNION ALL SELECT DISTINCT node_id, way_id FROM (SELECT unnest(nodes) AS node_id, id AS way_id FROM lo WHERE type = 'way' AND NOT gone) WHERE node_id IS NOT NULL")
def update_node_way(spark, d):
    return _updated(spark, d).node_way


def _s_member_index(base: str, child: str, parent: str, kind: str) -> str:
    return f"SELECT {child}, {parent} FROM {base} WHERE {parent} NOT IN (SELECT id FROM lo WHERE type = 'relation') UNION ALL SELECT DISTINCT m.ref, id FROM (SELECT id, unnest(members) AS m FROM lo WHERE type = 'relation' AND NOT gone) WHERE m.type = '{kind}' AND m.ref IS NOT NULL"


@query(_s_member_index("nr", "node_id", "relation_id", "node"))
def update_node_relation(spark, d):
    return _updated(spark, d).node_relation


@query(_s_member_index("wr", "way_id", "relation_id", "way"))
def update_way_relation(spark, d):
    return _updated(spark, d).way_relation


@query(_s_member_index("rr", "child_id", "parent_id", "relation"))
def update_relation_relation(spark, d):
    return _updated(spark, d).relation_relation


@query(_hilbert_sql().replace("FROM cl WHERE", "FROM (" + _s_replaced("cl", "id, lon_i, lat_i", "node") + ") WHERE") + " SELECT cell, node_id FROM cells")
def update_cell_node(spark, d):
    return _updated(spark, d).cell_node


@query(""", b AS (SELECT node_id, way_id FROM nw WHERE way_id IN (SELECT id FROM lo WHERE type = 'way')),
a AS (SELECT DISTINCT node_id, way_id FROM (SELECT unnest(nodes) AS node_id, id AS way_id FROM lo WHERE type = 'way' AND NOT gone) WHERE node_id IS NOT NULL)
SELECT *, 'delete' AS op FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'insert' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def update_index_delta(spark, d):
    return up.index_delta(_db(spark, d), _changes(spark, d))


@query("""SELECT 'locations' AS table_name, count(*) AS n FROM (""" + _s_replaced("cl", "id", "node") + """)
UNION ALL SELECT 'nodes', count(*) FROM (""" + _s_replaced("cn", "id", "node", "AND len(tags) > 0") + """)
UNION ALL SELECT 'ways', count(*) FROM (""" + _s_replaced("cw", "id", "way") + """)
UNION ALL SELECT 'relations', count(*) FROM (""" + _s_replaced("cr", "id", "relation") + """)
UNION ALL SELECT 'relation_relation', count(*) FROM (""" + _s_member_index("rr", "child_id", "parent_id", "relation") + """)""")
def update_published(spark, d):
    """Table sizes of a published dataset after the feed was applied to it as a delta."""
    names = ("locations", "nodes", "ways", "relations", "relation_relation")
    root = _published(spark, d, *names)
    up.apply_file(OsmDataset.open(spark, root), _changes(spark, d), root, 1, "", commit=True)
    return OsmDataset.open(spark, root).stats()


# ---- augmented diffs


def _diff(spark, d):
    db = _db(spark, d, "locations", "ways", "relations")
    actions, _ = Scratch(spark).save(augdiff.newest(_changes(spark, d)))
    return db, actions, augdiff.old_new(db, actions)


@query("SELECT type, id, version, action, first_seq, first_pos FROM hv")
def augdiff_dedup(spark, d):
    return augdiff.newest(_changes(spark, d)).select("type", "id", "version", "action", "first_seq", "first_pos")


@query(f"""SELECT type, id, act AS action, CASE WHEN act = 'create' THEN NULL WHEN act = 'delete' THEN lon_i ELSE o_lon END AS old_lon_i, CASE WHEN act = 'create' THEN NULL WHEN act = 'delete' THEN lat_i ELSE o_lat END AS old_lat_i,
 {_S_REFS.format("CASE WHEN act = 'create' THEN NULL WHEN act = 'delete' THEN nodes ELSE o_nodes END")} AS old_refs,
 {_S_MEMBERS.format("CASE WHEN act = 'create' THEN NULL WHEN act = 'delete' THEN members ELSE o_members END")} AS old_members,
 version AS new_version, act <> 'delete' AS visible, CASE WHEN act <> 'delete' THEN lon_i END AS new_lon_i, {_S_REFS.format("CASE WHEN act <> 'delete' THEN nodes END")} AS new_refs FROM act""")
def augdiff_old_new(spark, d):
    c = _diff(spark, d)[2]
    return c.select("type", "id", "action", "old_lon_i", "old_lat_i", _joined(F.col("old_nodes")).alias("old_refs"), _members("old_members").alias("old_members"), "new_version", "visible", "new_lon_i", _joined(F.col("new_nodes")).alias("new_refs"))


@query("""SELECT type, id, coalesce(CAST(o_version AS VARCHAR), '?') AS old_version, coalesce(o_meta."user", '?') AS old_user, coalesce(CAST(o_meta.uid AS VARCHAR), '?') AS old_uid, coalesce(CAST(o_meta.changeset AS VARCHAR), '?') AS old_changeset,
 coalesce(strftime(to_timestamp(o_meta.timestamp) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '?') AS old_timestamp FROM act WHERE act <> 'create'""")
def augdiff_old_meta(spark, d):
    c = _diff(spark, d)[2]
    return c.where("action <> 'create'").select("type", "id", "old_version", "old_user", "old_uid", "old_changeset", "old_timestamp")


_VERTICES = """
everything AS (SELECT type, id, CASE act WHEN 'create' THEN NULL WHEN 'delete' THEN nodes ELSE o_nodes END AS old_nodes, CASE WHEN act <> 'delete' THEN nodes END AS new_nodes,
   CASE act WHEN 'create' THEN NULL WHEN 'delete' THEN members ELSE o_members END AS old_members, CASE WHEN act <> 'delete' THEN members END AS new_members FROM act{spread}),
pos AS (SELECT coalesce(cl.id, h.id) AS ref, cl.lon_i AS o_lon, cl.lat_i AS o_lat, CASE WHEN h.id IS NULL THEN cl.lon_i ELSE h.lon_i END AS n_lon, CASE WHEN h.id IS NULL THEN cl.lat_i ELSE h.lat_i END AS n_lat
        FROM cl FULL JOIN (SELECT * FROM hv WHERE type = 'node') h ON h.id = cl.id),
newlists AS (SELECT coalesce(cw.id, h.id) AS id, CASE WHEN h.id IS NULL THEN cw.nodes ELSE coalesce(h.nodes, []) END AS nodes FROM cw FULL JOIN (SELECT * FROM hv WHERE type = 'way') h ON h.id = cw.id),
mm AS (SELECT type, id, 'old' AS side, u.i AS member, u.m AS m FROM (SELECT type, id, unnest(list_transform(old_members, lambda x, i: {{'m': x, 'i': i - 1}})) AS u FROM everything WHERE type = 'relation')
  UNION ALL SELECT type, id, 'new', u.i, u.m FROM (SELECT type, id, unnest(list_transform(new_members, lambda x, i: {{'m': x, 'i': i - 1}})) AS u FROM everything WHERE type = 'relation')),
wl AS (SELECT mm.type, mm.id, side, member, coalesce(CASE WHEN side = 'old' THEN cw.nodes ELSE n.nodes END, [NULL]) AS l FROM mm LEFT JOIN cw ON cw.id = mm.m.ref LEFT JOIN newlists n ON n.id = mm.m.ref WHERE mm.m.type = 'way'),
vert AS (SELECT type, id, side, member, idx, ref, nd, CASE WHEN side = 'old' THEN o_lon ELSE n_lon END AS lon_i, CASE WHEN side = 'old' THEN o_lat ELSE n_lat END AS lat_i FROM (
  SELECT type, id, 'old' AS side, -1 AS member, u.i AS idx, u.r AS ref, true AS nd FROM (SELECT type, id, unnest(list_transform(old_nodes, lambda x, i: {{'r': x, 'i': i - 1}})) AS u FROM everything WHERE type = 'way')
  UNION ALL SELECT type, id, 'new', -1, u.i, u.r, true FROM (SELECT type, id, unnest(list_transform(new_nodes, lambda x, i: {{'r': x, 'i': i - 1}})) AS u FROM everything WHERE type = 'way')
  UNION ALL SELECT type, id, side, member, 0, m.ref, false FROM mm WHERE m.type = 'node'
  UNION ALL SELECT type, id, side, member, u.i, u.r, true FROM (SELECT type, id, side, member, unnest(list_transform(l, lambda x, i: {{'r': x, 'i': i - 1}})) AS u FROM wl)) q LEFT JOIN pos USING (ref))
"""
_PLAIN = _VERTICES.format(spread="")


@query(f", {_PLAIN} SELECT type, id, side, CAST(member AS INTEGER) AS member, CAST(idx AS INTEGER) AS idx, ref, lon_i, lat_i FROM vert")
def augdiff_geometry(spark, d):
    db, actions, c = _diff(spark, d)
    return augdiff.vertices(c, db, actions).drop("nd")


@query("SELECT 'way' AS type, id FROM aw UNION ALL SELECT 'relation', id FROM ar")
def augdiff_affected(spark, d):
    return augdiff.affected(*_diff(spark, d))


@query(f", {_PLAIN} SELECT type, id, min(lon_i) AS min_lon, min(lat_i) AS min_lat, max(lon_i) AS max_lon, max(lat_i) AS max_lat FROM vert WHERE side = 'old' AND nd AND lon_i IS NOT NULL AND lat_i IS NOT NULL GROUP BY type, id")
def augdiff_bounds(spark, d):
    db, actions, c = _diff(spark, d)
    return augdiff.bounds(augdiff.vertices(c, db, actions))


@query(", " + _VERTICES.format(spread=" UNION ALL SELECT 'way', id, nodes, nodes, NULL, NULL FROM cw WHERE id IN (SELECT id FROM aw) UNION ALL SELECT 'relation', id, NULL, NULL, members, members FROM cr WHERE id IN (SELECT id FROM ar)") + """,
hole AS (SELECT DISTINCT type, id FROM vert WHERE lon_i IS NULL OR lat_i IS NULL),
li AS (SELECT type, id, act AS action, false AS spread FROM act UNION ALL SELECT 'way', id, 'modify', true FROM aw UNION ALL SELECT 'relation', id, 'modify', true FROM ar)
SELECT CASE li.type WHEN 'node' THEN 1 WHEN 'way' THEN 2 ELSE 3 END AS rank, li.type, li.id, action, spread, h.id IS NOT NULL AS incomplete FROM li LEFT JOIN hole h ON h.type = li.type AND h.id = li.id
WHERE NOT (spread AND li.type = 'relation' AND h.id IS NOT NULL)""")
def augdiff_sorted(spark, d):
    return augdiff.augmented_diff(_db(spark, d, "locations", "ways", "relations"), _changes(spark, d))
