"""Queries pN_ of the general problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import tables as T
from terrafold.operators import changefeed, hierarchy, history, orphans, skew, spatial

NEAR_M = 10.0
KEY_SHARE = 100


def _relation_links(spark: SparkSession, d: str) -> DataFrame:
    r = T.read(spark, d, "relations").select("id", "members", F.struct(F.col("meta.version").alias("version")).alias("meta"))
    return hierarchy.member_links(T.current(r, "meta.version"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    m = hierarchy.resolve(spark, _relation_links(spark, d)).membership()
    return m.select(F.col("id").alias("relation_id"), F.col("top").alias("root_id"), "depth", F.when(F.col("cyclic"), "cycle").otherwise("tree").alias("kind"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path to each relation from every top that reaches it, as heavy-path segments ``first+steps`` and as
    the ids of its relations."""
    h = hierarchy.resolve(spark, _relation_links(spark, d))
    p = h.spelled(h.paths(every=True))
    text = F.array_join(F.transform("path", lambda s: F.concat(s["chain"].cast("string"), F.lit("+"), s["upto"].cast("string"))), "/")
    return p.select(F.col("id").alias("relation_id"), F.col("top").alias("root_id"), "depth", text.alias("path"), F.col("ids").alias("relation_ids"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How many relations lie below each, from the intervals of numbers."""
    i = hierarchy.resolve(spark, _relation_links(spark, d)).below()
    return i.groupBy(F.col("id").alias("relation_id")).agg(F.sum(F.col("to_pre") - F.col("from_pre") + 1).alias("n_below"))


def p1_below(spark: SparkSession, d: str) -> DataFrame:
    """Every relation below each, from the intervals of numbers."""
    b = hierarchy.resolve(spark, _relation_links(spark, d)).descendants()
    return b.select(F.col("id").alias("relation_id"), F.col("descendant").alias("descendant_id"))


def _cell_sizes(spark: SparkSession, d: str) -> DataFrame:
    index = T.read(spark, d, "cell_node").select("cell", "node_id")
    return skew.key_sizes(index, "cell", "node_id", rows=index.count())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_cell_sizes(spark, d), "cell", KEY_SHARE)


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cell_sizes(spark, d).select("cell", F.col("n").alias("n_nodes"), F.col("low").alias("first_node"), F.col("high").alias("last_node"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.named_state(*[T.read(spark, d, t) for t in ("changes", "locations", "ways", "relations")]).select("type", "id", "version")


def p3_ways(spark: SparkSession, d: str) -> DataFrame:
    """The state of all ways after the feed; lists as text."""
    s = changefeed.apply_changes(T.read(spark, d, "ways").select("id", "nodes", "meta"), T.read(spark, d, "changes"), "way", ["nodes"], "meta.version")
    return s.select("id", "version", F.array_join(F.col("nodes").cast("array<string>"), ",", "-").alias("refs"), "source")


def p3_locations(spark: SparkSession, d: str) -> DataFrame:
    """The position of all nodes after the feed."""
    s = changefeed.apply_changes(T.read(spark, d, "locations"), T.read(spark, d, "changes"), "node", ["lon_i", "lat_i"])
    return s.select("id", "version", "lon_i", "lat_i", "source")


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The whole state of all nodes after the feed, tagged or not."""
    return changefeed.node_states(*[T.read(spark, d, t) for t in ("locations", "nodes", "changes")])


def p3_ways_whole(spark: SparkSession, d: str) -> DataFrame:
    """The whole state of all ways after the feed, tags and meta included."""
    return changefeed.apply_changes(T.read(spark, d, "ways"), T.read(spark, d, "changes"), "way", ["nodes", "tags", "meta"], "meta.version")


def p3_relations(spark: SparkSession, d: str) -> DataFrame:
    """The whole state of all relations after the feed."""
    return changefeed.apply_changes(T.read(spark, d, "relations"), T.read(spark, d, "changes"), "relation", ["members", "tags", "meta"], "meta.version")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return spatial.tagged_positions(T.read(spark, d, "locations"), T.read(spark, d, "nodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.scratch import Scratch

    at, _ = Scratch(spark).save(_positions(spark, d))
    pairs = spatial.near(at, NEAR_M).select(F.lit("near").alias("kind"), "left_id", "right_id")
    areas = T.read(spark, d, "extracts").select(F.col("extract_id").alias("region_id"), "kind", "spec")
    held = spatial.inside(at, areas).select(F.lit("inside").alias("kind"), F.col("region_id").alias("left_id"), F.col("id").alias("right_id"))
    return pairs.unionByName(held)


def p5_areas(spark: SparkSession, d: str) -> DataFrame:
    """Tagged nodes in each area beside the cells that its job counts."""
    jobs = T.read(spark, d, "extracts")
    held = spatial.inside(_positions(spark, d), jobs.select(F.col("extract_id").alias("region_id"), "kind", "spec"))
    n = held.groupBy(F.col("region_id").alias("extract_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    return jobs.select("extract_id", "kind", "cells_total").join(n, "extract_id", "left").select("extract_id", "kind", "cells_total", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The references of current rows, written once, the keys and versions of base rows, and the feed."""
    from terrafold.scratch import Scratch

    locations, ways, relations, changes = (T.read(spark, d, t) for t in ("locations", "ways", "relations", "changes"))
    stamp = F.struct(F.col("meta.version").alias("version"), F.col("meta.timestamp").alias("timestamp")).alias("meta")
    refs = orphans.references(T.current(ways.select("id", "nodes", stamp), "meta.version"), T.current(relations.select("id", "members", stamp), "meta.version"))
    refs, _ = Scratch(spark).save(refs)
    keys = locations.select(F.lit("node").alias("type"), "id", "version")
    for kind, t in (("way", ways), ("relation", relations)):
        keys = keys.unionByName(t.select(F.lit(kind).alias("type"), "id", "meta.version"))
    return refs, keys, changes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    refs, keys, changes = _references(spark, d)
    return orphans.orphan_refs(refs, orphans.orphan_keys(refs, keys, changes)).select("source_type", "source_id", "ref_type", "ref_id", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_references(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return history.history(T.read(spark, d, "snapshots")).select("type", "id", "version", "valid_from", "valid_to")


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    return history.history(T.read(spark, d, "snapshots"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_below, p2_found, p2_cells, p3_found, p3_ways, p3_locations, p3_nodes, p3_ways_whole, p3_relations, p5_found, p5_areas, p6_found, p6_report, p7_found, p7_history)}

_CURRENT_RELATIONS = "cr AS (SELECT id, arg_max(members, coalesce(meta.version, -1)) AS members, arg_max(meta, coalesce(meta.version, -1)) AS meta FROM relations WHERE id IS NOT NULL GROUP BY id)"
_CURRENT_WAYS = "cw AS (SELECT id, arg_max(nodes, coalesce(meta.version, -1)) AS nodes, arg_max(meta, coalesce(meta.version, -1)) AS meta FROM ways WHERE id IS NOT NULL GROUP BY id)"

_FEED = """
ranked AS (
  SELECT type, id, CAST(version AS BIGINT) AS version, lower(trim(action)) = 'delete' AS gone, lon_i, lat_i, nodes,
         row_number() OVER (PARTITION BY type, id ORDER BY version DESC, meta.timestamp DESC NULLS LAST) AS rn
  FROM changes),
last_change AS (SELECT * FROM ranked WHERE rn = 1),
base AS (
  SELECT 'node' AS type, id, CAST(max(version) AS BIGINT) AS bv FROM locations GROUP BY id
  UNION ALL SELECT 'way', id, CAST(max(meta.version) AS BIGINT) FROM ways GROUP BY id
  UNION ALL SELECT 'relation', id, CAST(max(meta.version) AS BIGINT) FROM relations GROUP BY id),
after AS (
  SELECT c.type, c.id, b.bv IS NOT NULL AS has_base,
         CASE WHEN b.bv IS NULL OR c.version > b.bv THEN c.version ELSE b.bv END AS version,
         CASE WHEN b.bv IS NULL OR c.version > b.bv THEN NOT c.gone ELSE true END AS alive,
         (b.bv IS NULL OR c.version > b.bv) AS replaced
  FROM last_change c LEFT JOIN base b USING (type, id))
"""

_REFS = f"""
{_CURRENT_WAYS}, {_CURRENT_RELATIONS},
refs AS (
  SELECT DISTINCT 'way' AS source_type, id AS source_id, meta.timestamp AS stamp, 'node' AS ref_type, unnest(nodes) AS ref_id FROM cw
  UNION SELECT DISTINCT 'relation', id, ts, m.type, m.ref FROM (SELECT id, meta.timestamp AS ts, unnest(members) AS m FROM cr)),
found AS (
  SELECT r.*, CASE WHEN b.id IS NULL AND NOT coalesce(a.alive, false) THEN 'missing' WHEN b.id IS NULL THEN 'late'
                   WHEN NOT coalesce(a.alive, true) THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN base b ON b.type = r.ref_type AND b.id = r.ref_id LEFT JOIN after a ON a.type = r.ref_type AND a.id = r.ref_id
  WHERE r.ref_id IS NOT NULL)
"""

_VERSIONS = """
v AS (SELECT type, id, CAST(meta.version AS BIGINT) AS version, max(meta.timestamp) AS valid_from, max(meta.changeset) AS changeset,
             max(meta.uid) AS uid, max(meta.user) AS "user" FROM snapshots GROUP BY ALL),
cal AS (SELECT snap_id, coalesce(lead(taken) OVER (ORDER BY snap_id), -1) AS next_at
        FROM (SELECT snap_id, min(CAST(epoch(snap_at) AS BIGINT)) AS taken FROM snapshots GROUP BY snap_id)),
gone AS (SELECT type, id, next_at FROM (SELECT type, id, max(snap_id) AS snap_id FROM snapshots GROUP BY type, id) JOIN cal USING (snap_id)),
h AS (SELECT v.*, coalesce(lead(valid_from) OVER (PARTITION BY type, id ORDER BY version), next_at) AS valid_to FROM v JOIN gone USING (type, id))
"""

_NEARBY = r"""
place AS (SELECT id, r.x / 1e7 AS lon, r.y / 1e7 AS lat FROM (SELECT id, max({'v': version, 'x': lon_i, 'y': lat_i}) AS r FROM locations WHERE id IN (SELECT id FROM nodes) GROUP BY id)
       WHERE r.x BETWEEN -1800000000 AND 1800000000 AND r.y BETWEEN -900000000 AND 900000000),
pairs AS (SELECT 'near' AS kind, a.id AS left_id, b.id AS right_id FROM place a JOIN place b ON a.id < b.id AND abs(a.lat - b.lat) < 0.0001
          WHERE 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 10),
num AS (SELECT extract_id, kind, list_transform(string_split(spec, ','), lambda x: CAST(trim(x) AS DOUBLE)) AS a FROM extracts WHERE kind IN ('bbox', 'disc')),
box AS (SELECT extract_id, id FROM num JOIN place ON lat BETWEEN a[1] AND a[3] AND CASE WHEN a[2] <= a[4] THEN lon BETWEEN a[2] AND a[4] ELSE lon >= a[2] OR lon <= a[4] END WHERE kind = 'bbox'),
disc AS (SELECT extract_id, id FROM num JOIN place ON abs(lat - a[1]) <= a[3] + 0.001 WHERE kind = 'disc'
         AND degrees(2 * asin(least(1.0, sqrt(pow(sin(radians(lat - a[1]) / 2), 2) + cos(radians(lat)) * cos(radians(a[1])) * pow(sin(radians(lon - a[2]) / 2), 2))))) <= a[3]),
line AS (SELECT extract_id, u.i AS i, u.s AS s FROM (SELECT extract_id, unnest(list_transform(regexp_split_to_array(spec, '\r?\n'), lambda x, i: {'i': i, 's': trim(x)})) AS u FROM extracts WHERE kind = 'poly')),
ring AS (SELECT extract_id, i, s, count(*) FILTER (s = 'END') OVER (PARTITION BY extract_id ORDER BY i) AS ring FROM line),
pt AS (SELECT extract_id, ring, i, CAST(p[1] AS DOUBLE) AS x, CAST(p[2] AS DOUBLE) AS y FROM (SELECT *, regexp_split_to_array(s, '\s+') AS p FROM ring) WHERE len(p) = 2 AND s <> 'END'),
side AS (SELECT extract_id, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pt WINDOW w AS (PARTITION BY extract_id, ring ORDER BY i)),
poly AS (SELECT DISTINCT extract_id, id FROM (SELECT extract_id, ring, id, count(*) AS n FROM side JOIN place ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL) WHERE n % 2 = 1),
held AS (SELECT * FROM box UNION ALL SELECT * FROM disc UNION ALL SELECT * FROM poly)
"""

SQL = {
    "p5_found": f"WITH {_NEARBY} SELECT * FROM pairs UNION ALL SELECT 'inside', extract_id, id FROM held",
    "p5_areas": f"WITH {_NEARBY} SELECT e.extract_id, e.kind, e.cells_total, count(h.id) AS n_nodes FROM extracts e LEFT JOIN held h ON h.extract_id = e.extract_id GROUP BY ALL",
    "p1_found": f"""
WITH RECURSIVE {_CURRENT_RELATIONS},
e AS (SELECT DISTINCT id AS p, m.ref AS c FROM (SELECT id, unnest(members) AS m FROM cr) WHERE m.type = 'relation' AND m.ref IN (SELECT id FROM cr)),
reach(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM reach r JOIN e ON e.p = r.b),
node AS (SELECT p AS x FROM e UNION SELECT c FROM e),
grp AS (SELECT n.x, least(n.x, coalesce(min(f.b), n.x)) AS g, count(l.a) > 0 AS cyc
        FROM node n LEFT JOIN (SELECT f.a, f.b FROM reach f JOIN reach g ON f.b = g.a AND f.a = g.b) f ON f.a = n.x
        LEFT JOIN reach l ON l.a = n.x AND l.b = n.x GROUP BY n.x),
entered AS (SELECT DISTINCT gc.g FROM e JOIN grp gp ON gp.x = e.p JOIN grp gc ON gc.x = e.c WHERE gp.g <> gc.g),
tops AS (SELECT x, g FROM grp WHERE g NOT IN (SELECT g FROM entered)),
walk(top, x, d) AS (SELECT g, x, CAST(0 AS BIGINT) FROM tops
                    UNION SELECT w.top, e.c, w.d + 1 FROM walk w JOIN e ON e.p = w.x JOIN grp gc ON gc.x = e.c
                    WHERE gc.g <> w.top AND w.d < (SELECT count(*) FROM node))
SELECT w.x AS relation_id, w.top AS root_id, min(w.d) AS depth, CASE WHEN any_value(grp.cyc) THEN 'cycle' ELSE 'tree' END AS kind
FROM walk w JOIN grp ON grp.x = w.x GROUP BY w.x, w.top""",
    "p1_descendants": f"""
WITH RECURSIVE {_CURRENT_RELATIONS},
e AS (SELECT DISTINCT id AS p, m.ref AS c FROM (SELECT id, unnest(members) AS m FROM cr) WHERE m.type = 'relation' AND m.ref IN (SELECT id FROM cr)),
reach(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM reach r JOIN e ON e.p = r.b)
SELECT a AS relation_id, count(*) AS n_below FROM reach GROUP BY a""",
    "p1_below": f"""
WITH RECURSIVE {_CURRENT_RELATIONS},
e AS (SELECT DISTINCT id AS p, m.ref AS c FROM (SELECT id, unnest(members) AS m FROM cr) WHERE m.type = 'relation' AND m.ref IN (SELECT id FROM cr)),
reach(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM reach r JOIN e ON e.p = r.b)
SELECT a AS relation_id, b AS descendant_id FROM reach""",
    "p2_found": """
WITH s AS (SELECT cell, count(DISTINCT node_id) AS n FROM cell_node WHERE cell IS NOT NULL GROUP BY cell)
SELECT cell FROM s WHERE n * 100 >= (SELECT sum(n) FROM s)""",
    "p2_cells": """
SELECT cell, count(DISTINCT node_id) AS n_nodes, min(node_id) AS first_node, max(node_id) AS last_node
FROM cell_node WHERE cell IS NOT NULL GROUP BY cell""",
    "p3_found": f"WITH {_FEED} SELECT type, id, version FROM after WHERE alive",
    "p3_ways": f"""
WITH {_FEED}, {_CURRENT_WAYS}, j AS (
  SELECT coalesce(c.id, w.id) AS id, c.id IS NOT NULL AND (w.id IS NULL OR c.version > w.meta.version) AS win, c.version AS v, c.gone, c.nodes AS cn, w.meta.version AS wv, w.nodes AS wn
  FROM (SELECT * FROM last_change WHERE type = 'way') c FULL JOIN cw w ON w.id = c.id)
SELECT id, CAST(CASE WHEN win THEN v ELSE wv END AS BIGINT) AS version,
       array_to_string(list_transform(CASE WHEN win THEN cn ELSE wn END, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS refs,
       CASE WHEN win THEN 'change' ELSE 'base' END AS source
FROM j WHERE NOT (win AND gone)""",
    "p3_locations": f"""
WITH {_FEED}, cl AS (SELECT id, max(version) AS version, arg_max(lon_i, version) FILTER (lon_i IS NOT NULL) AS x, arg_max(ROW(lon_i, lat_i), version) AS p FROM locations GROUP BY id), j AS (
  SELECT coalesce(c.id, w.id) AS id, c.id IS NOT NULL AND (w.id IS NULL OR c.version > w.version) AS win, c.version AS v, c.gone, c.lon_i AS cx, c.lat_i AS cy, w.version AS wv, w.p AS wp
  FROM (SELECT * FROM last_change WHERE type = 'node') c FULL JOIN cl w ON w.id = c.id)
SELECT id, CAST(CASE WHEN win THEN v ELSE wv END AS BIGINT) AS version, CASE WHEN win THEN cx ELSE wp[1] END AS lon_i, CASE WHEN win THEN cy ELSE wp[2] END AS lat_i,
       CASE WHEN win THEN 'change' ELSE 'base' END AS source
FROM j WHERE NOT (win AND gone)""",
    "p6_found": f"WITH {_FEED}, {_REFS} SELECT DISTINCT source_type, source_id, ref_type, ref_id, reason FROM found WHERE reason IS NOT NULL",
    "p6_report": f"""
WITH {_FEED}, {_REFS}, d AS (SELECT DISTINCT source_type, source_id, ref_type, ref_id, reason, stamp FROM found WHERE reason IS NOT NULL)
SELECT ref_type, reason, strftime(to_timestamp(stamp) AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS refs FROM d GROUP BY ALL""",
    "p7_found": f"WITH {_VERSIONS} SELECT type, id, version, valid_from, valid_to FROM h",
    "p7_history": f'WITH {_VERSIONS} SELECT type, id, version, changeset, uid, "user", valid_from, valid_to FROM h',
}
