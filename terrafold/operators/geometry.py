"""Ways and relations with their coordinates, as WKT and GeoJSON text.

A node that is missing or has no position is left out of a line and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold import tags as tg
from terrafold.operators.closure import transitive
from terrafold.scratch import Scratch


def degrees(c: str) -> Column:
    return F.col(c) / 1e7


def fixed(c: Column) -> Column:
    """1e-7 degrees as text with seven decimals, by whole numbers alone."""
    a = F.abs(c.cast("bigint"))
    sign = F.when(c < 0, "-").otherwise("")
    return F.concat(sign, F.call_function("div", a, F.lit(10_000_000)).cast("string"), F.lit("."), F.lpad((a % 10_000_000).cast("string"), 7, "0"))


def visits(ways: DataFrame, locations: DataFrame) -> DataFrame:
    """``id, pos, node_id, lon_i, lat_i``: each visit of a way to a node, with nulls where it has no position."""
    v = ways.select("id", F.posexplode("nodes").alias("pos", "node_id"))
    at = locations.where("lon_i is not null and lat_i is not null").select(F.col("id").alias("node_id"), "lon_i", "lat_i")
    return v.join(at, "node_id", "left").select("id", "pos", "node_id", "lon_i", "lat_i")


def lines(ways: DataFrame, locations: DataFrame) -> DataFrame:
    """``id, coords, missing``: the positions of each way in order; a way without any position has an empty list."""
    v = visits(ways, locations)
    point = F.when(F.col("lon_i").isNotNull(), F.struct("pos", "lon_i", "lat_i"))
    g = v.groupBy("id").agg(F.array_sort(F.collect_list(point)).alias("c"), F.sum(F.col("lon_i").isNull().cast("int")).cast("int").alias("missing"))
    empty = F.array().cast("array<struct<pos:int,lon_i:int,lat_i:int>>")
    j = ways.select("id").join(g, "id", "left")
    return j.select("id", F.coalesce("c", empty).alias("coords"), F.coalesce("missing", F.lit(0)).alias("missing"))


def wkt(coords: Column) -> Column:
    """LINESTRING of (lon, lat) in fixed decimals, without blanks after commas."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(coords, lambda p: F.concat(fixed(p["lon_i"]), F.lit(" "), fixed(p["lat_i"]))), ","), F.lit(")"))


def way_wkt(ways: DataFrame, locations: DataFrame) -> DataFrame:
    """``id, wkt, missing``; the text begins with the way's name and a tab."""
    named = ways.select("id", F.coalesce(tg.value(F.col("tags"), "name"), F.lit("")).alias("name"))
    j = lines(ways, locations).join(named, "id")
    return j.select("id", F.concat("name", F.lit("\t"), wkt(F.col("coords"))).alias("wkt"), "missing")


def _pair(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("["), fixed(lon), F.lit(","), fixed(lat), F.lit("]"))


def point_json(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":'), _pair(lon, lat), F.lit("}"))


def line_json(coords: Column) -> Column:
    return F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(F.transform(coords, lambda p: _pair(p["lon_i"], p["lat_i"])), ","), F.lit("]}"))


def feature(geometry: Column, tags: Column) -> Column:
    """A GeoJSON Feature around a geometry's text, with the tags as properties."""
    props = F.coalesce(F.to_json(tg.to_map(tags)), F.lit("{}"))
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))


def node_geojson(locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, geometry, tags`` of every located node."""
    at = locations.where("lon_i is not null and lat_i is not null")
    return at.join(nodes.select("id", "tags"), "id", "left").select("id", point_json(F.col("lon_i"), F.col("lat_i")).alias("geometry"), "tags")


def way_geojson(ways: DataFrame, locations: DataFrame) -> DataFrame:
    return lines(ways, locations).join(ways.select("id", "tags"), "id").select("id", line_json(F.col("coords")).alias("geometry"), "tags")


def members_below(relations: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``id, member_type, member_id``: the distinct node and way members of each relation and of all relations below it,
    cycles included."""
    m, _ = Scratch(relations.sparkSession).save(relations.select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("member_type"), F.col("m.ref").alias("member_id")).where("member_type is not null and member_id is not null").distinct())
    below = transitive(m.where("member_type = 'relation'").select("id", "member_id"))
    tops = (relations if starts is None else starts).select(F.col("id").alias("top"))
    seen = tops.select("top", F.col("top").alias("id")).union(below.join(tops, below["a"] == tops["top"], "left_semi")).distinct()
    return seen.join(m.where("member_type <> 'relation'"), "id").select(F.col("top").alias("id"), "member_type", "member_id").distinct()


def relation_geojson(relations: DataFrame, ways: DataFrame, locations: DataFrame) -> DataFrame:
    """``id, geometry, tags``: a GeometryCollection of the nodes and then the ways, each by ascending id, of each relation
    and all relations below it.  Members that are missing have no geometry."""
    m, _ = Scratch(relations.sparkSession).save(members_below(relations))
    n = m.where("member_type = 'node'").join(locations.where("lon_i is not null and lat_i is not null").select(F.col("id").alias("member_id"), "lon_i", "lat_i"), "member_id")
    n = n.select("id", F.lit(0).alias("rank"), "member_id", point_json(F.col("lon_i"), F.col("lat_i")).alias("g"))
    used = ways.join(m.where("member_type = 'way'").select(F.col("member_id").alias("id")).distinct(), "id", "left_semi")
    w = m.where("member_type = 'way'").join(lines(used, locations).select(F.col("id").alias("member_id"), "coords"), "member_id")
    w = w.select("id", F.lit(1).alias("rank"), "member_id", line_json(F.col("coords")).alias("g"))
    parts = n.unionByName(w).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "member_id", "g"))).alias("p"))
    text = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.coalesce(F.array_join(F.transform("p", lambda x: x["g"]), ","), F.lit("")), F.lit("]}"))
    return relations.select("id", "tags").join(parts, "id", "left").select("id", text.alias("geometry"), "tags")
