"""Augmented diffs: the old and new image of every element that a change table changes or that is moved along with one.

    deduplicate -> pair with the old image -> resolve coordinates -> spread to referring elements -> bounds -> sort

Must be worked out against the dataset before the changes are applied to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.dataset import OsmDataset
from terrafold.scratch import Scratch

RANK = {"node": 1, "way": 2, "relation": 3}
UNKNOWN = "?"


def iso(seconds: Column) -> Column:
    """Epoch seconds as ``YYYY-MM-DDTHH:MM:SSZ``; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def type_rank(kind: Column) -> Column:
    return F.when(kind == "node", 1).when(kind == "way", 2).otherwise(3)


def newest(changes: DataFrame) -> DataFrame:
    """One row per element: its highest version, among equals the last in document order, with the place of its first
    appearance.  action is create, modify or delete."""
    payload = ("lon_i", "lat_i", "nodes", "members", "tags", "meta")
    at = F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("pos", F.lit(-1)).alias("pos"))
    state = F.struct(F.coalesce("version", F.lit(-1)).alias("version"), at.alias("at"), F.col("meta.timestamp").alias("stamp"), F.lower(F.trim("action")).alias("action"), *payload)
    g = changes.where("type is not null and id is not null").groupBy("type", "id").agg(F.max(state).alias("s"), F.min(at).alias("first"))
    return g.select("type", "id", "s.version", "s.action", F.col("first.seq").alias("first_seq"), F.col("first.pos").alias("first_pos"), *[f"s.{c}" for c in payload])


def old_images(db: OsmDataset, keys: DataFrame) -> DataFrame:
    """``type, id, in_db, old_version, old_lon_i, old_lat_i, old_nodes, old_members, old_tags, old_meta`` of the keys.

    A node is in the database if it has a location; without a row among the tagged nodes its version is the location's.
    """
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kinds = {"members": db.relations.schema["members"].dataType, "tags": db.ways.schema["tags"].dataType, "meta": db.ways.schema["meta"].dataType}
    key = lambda t: keys.where(F.col("type") == t).select("id")
    loc = db.locations.join(key("node"), "id", "left_semi")
    n = loc.join(db.nodes, "id", "left").select(F.lit("node").alias("type"), "id", F.coalesce("meta.version", "version").alias("old_version"), F.col("lon_i").alias("old_lon_i"), F.col("lat_i").alias("old_lat_i"), none("old_nodes", "array<bigint>"), none("old_members", kinds["members"]), F.col("tags").alias("old_tags"), F.col("meta").alias("old_meta"))
    w = db.ways.join(key("way"), "id", "left_semi").select(F.lit("way").alias("type"), "id", F.col("meta.version").alias("old_version"), none("old_lon_i", "int"), none("old_lat_i", "int"), F.col("nodes").alias("old_nodes"), none("old_members", kinds["members"]), F.col("tags").alias("old_tags"), F.col("meta").alias("old_meta"))
    r = db.relations.join(key("relation"), "id", "left_semi").select(F.lit("relation").alias("type"), "id", F.col("meta.version").alias("old_version"), none("old_lon_i", "int"), none("old_lat_i", "int"), none("old_nodes", "array<bigint>"), F.col("members").alias("old_members"), F.col("tags").alias("old_tags"), F.col("meta").alias("old_meta"))
    return n.unionByName(w).unionByName(r).withColumn("in_db", F.lit(True))


def old_new(db: OsmDataset, actions: DataFrame) -> DataFrame:
    """Old and new image of each changed element.

    A modify of an element that isn't in the database becomes a create.  A create has no old image; a delete has no new
    one (``visible`` false), and its old image is the element of the change under the database's metadata.
    """
    j = actions.join(old_images(db, actions), ["type", "id"], "left").withColumn("in_db", F.coalesce("in_db", F.lit(False)))
    action = F.when((F.col("action") == "modify") & ~F.col("in_db"), "create").otherwise(F.col("action"))
    gone, made = F.col("action") == "delete", F.col("action") == "create"
    old = lambda c, own: F.when(made, None).when(gone, F.col(own)).otherwise(F.col(c)).alias(c)
    new = lambda c: F.when(~gone, F.col(c)).alias(f"new_{c}")
    return j.withColumn("action", action).select(
        "type", "id", "action", "in_db", "first_seq", "first_pos",
        F.when(~made, F.coalesce(F.col("old_version").cast("string"), F.lit(UNKNOWN))).alias("old_version"),
        *[F.when(~made, F.coalesce(F.col(f"old_meta.{f}").cast("string"), F.lit(UNKNOWN))).alias(f"old_{f}") for f in ("user", "uid", "changeset")],
        F.when(~made, F.coalesce(iso(F.col("old_meta.timestamp")), F.lit(UNKNOWN))).alias("old_timestamp"),
        *[old(f"old_{c}", c) for c in ("lon_i", "lat_i", "nodes", "members", "tags")],
        F.col("version").alias("new_version"), (~gone).alias("visible"), *[new(c) for c in ("lon_i", "lat_i", "nodes", "members", "tags", "meta")],
    )


def _overlay(db: OsmDataset, actions: DataFrame) -> DataFrame:
    """``ref, old_lon, old_lat, has_old, new_lon, new_lat, has_new``: node positions before and after the changes; a
    changed node's new position is that of its change."""
    loc = db.locations.select(F.col("id").alias("ref"), F.col("lon_i").alias("old_lon"), F.col("lat_i").alias("old_lat"))
    ch = actions.where("type = 'node'").select(F.col("id").alias("ref"), F.col("lon_i").alias("c_lon"), F.col("lat_i").alias("c_lat"), F.lit(True).alias("changed"))
    j = loc.join(ch, "ref", "full")
    changed = F.coalesce("changed", F.lit(False))
    return j.select("ref", "old_lon", "old_lat", F.when(changed, F.col("c_lon")).otherwise(F.col("old_lon")).alias("new_lon"), F.when(changed, F.col("c_lat")).otherwise(F.col("old_lat")).alias("new_lat"))


def vertices(images: DataFrame, db: OsmDataset, actions: DataFrame) -> DataFrame:
    """``type, id, side, member, idx, ref, nd, lon_i, lat_i``: the positions of the nodes of both images of ways, and of the
    node and way members of relations.

    images: ``type, id, old_nodes, new_nodes, old_members, new_members``.  On the new side, changed ways and nodes count as
    changed.  member is -1 for a way's own nodes, and nd tells nodes of ways from node members.  A way member that nobody knows gives one row without ref.
    """
    own = []
    for side in ("old", "new"):
        v = images.where("type = 'way'").select("type", "id", F.lit(side).alias("side"), F.lit(-1).alias("member"), F.lit(True).alias("nd"), F.posexplode(f"{side}_nodes").alias("idx", "ref"))
        own.append(v)
        m = images.where("type = 'relation'").select("type", "id", F.lit(side).alias("side"), F.posexplode(f"{side}_members").alias("member", "m"))
        own.append(m.where("m.type = 'node'").select("type", "id", "side", "member", F.lit(False).alias("nd"), F.lit(0).alias("idx"), F.col("m.ref").alias("ref")))
        w = m.where("m.type = 'way'").select("type", "id", "side", "member", F.col("m.ref").alias("way"))
        lists = db.ways.select(F.col("id").alias("way"), "nodes")
        if side == "new":
            ch = actions.where("type = 'way'").select(F.col("id").alias("way"), F.col("nodes").alias("c_nodes"), F.lit(True).alias("changed"))
            lists = lists.join(ch, "way", "full").select("way", F.when(F.col("changed"), F.coalesce("c_nodes", F.array().cast("array<bigint>"))).otherwise(F.col("nodes")).alias("nodes"))
        j = w.join(lists, "way", "left")
        none = F.array(F.lit(None).cast("bigint"))
        own.append(j.select("type", "id", "side", "member", F.lit(True).alias("nd"), F.posexplode(F.coalesce("nodes", none)).alias("idx", "ref")))
    rows = own[0]
    for o in own[1:]:
        rows = rows.unionByName(o)
    j = rows.join(_overlay(db, actions), "ref", "left")
    pick = lambda c: F.when(F.col("side") == "old", F.col(f"old_{c}")).otherwise(F.col(f"new_{c}"))
    return j.select("type", "id", "side", "member", "idx", "ref", "nd", pick("lon").alias("lon_i"), pick("lat").alias("lat_i"))


def incomplete(vertex_rows: DataFrame) -> DataFrame:
    """``type, id``: elements of which some position isn't known."""
    return vertex_rows.where("lon_i is null or lat_i is null").select("type", "id").distinct()


def affected(db: OsmDataset, actions: DataFrame, changed: DataFrame) -> DataFrame:
    """``type, id``: unchanged elements that a change shows in.

    A moved node affects its ways, its relations and those ways' relations; a way with another node list its relations.
    Only elements that were and still are there spread; relations don't affect the relations above them.
    """
    live = changed.where("action = 'modify'")
    moved = live.where("type = 'node' and not (old_lon_i <=> new_lon_i and old_lat_i <=> new_lat_i)").select(F.col("id").alias("node_id"))
    bent = live.where("type = 'way' and not (coalesce(old_nodes, array()) <=> coalesce(new_nodes, array()))").select(F.col("id").alias("way_id"))
    named = lambda t, c: actions.where(F.col("type") == t).select(F.col("id").alias(c))
    ways = db.node_way.join(moved, "node_id", "left_semi").select("way_id").distinct().join(named("way", "way_id"), "way_id", "left_anti")
    by_node = db.node_relation.join(moved, "node_id", "left_semi").select("relation_id")
    by_way = db.way_relation.join(ways.union(bent), "way_id", "left_semi").select("relation_id")
    relations = by_node.union(by_way).distinct().join(named("relation", "relation_id"), "relation_id", "left_anti")
    return ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id")).unionByName(relations.select(F.lit("relation").alias("type"), F.col("relation_id").alias("id")))


def bounds(vertex_rows: DataFrame) -> DataFrame:
    """``type, id, min_lon, min_lat, max_lon, max_lat`` over the way nodes of each old image."""
    v = vertex_rows.where("side = 'old' and lon_i is not null and lat_i is not null and nd")
    return v.groupBy("type", "id").agg(*[f(c).alias(f"{n}_{c[:3]}") for c in ("lon_i", "lat_i") for n, f in (("min", F.min), ("max", F.max))])


def augmented_diff(db: OsmDataset, changes: DataFrame) -> DataFrame:
    """All actions in order of type and id: ``rank, type, id, action, spread, incomplete``.

    Changed elements stay even if incomplete; affected relations that are incomplete are left out.
    """
    scratch = Scratch(db.spark)  # both are read by several branches
    actions, _ = scratch.save(newest(changes))
    changed, _ = scratch.save(old_new(db, actions))
    own = changed.select("type", "id", "action", F.lit(False).alias("spread"), "old_nodes", "new_nodes", "old_members", "new_members")
    hit = affected(db, actions, changed)
    w = db.ways.join(hit.where("type = 'way'").select("id"), "id", "left_semi").select(F.lit("way").alias("type"), "id", F.col("nodes").alias("l"), F.lit(None).cast(db.relations.schema["members"].dataType).alias("m"))
    r = db.relations.join(hit.where("type = 'relation'").select("id"), "id", "left_semi").select(F.lit("relation").alias("type"), "id", F.lit(None).cast("array<bigint>").alias("l"), F.col("members").alias("m"))
    spread = w.unionByName(r).select("type", "id", F.lit("modify").alias("action"), F.lit(True).alias("spread"), F.col("l").alias("old_nodes"), F.col("l").alias("new_nodes"), F.col("m").alias("old_members"), F.col("m").alias("new_members"))
    everything, _ = scratch.save(own.unionByName(spread))
    holes = incomplete(vertices(everything, db, actions)).withColumn("incomplete", F.lit(True))
    j = everything.select("type", "id", "action", "spread").join(holes, ["type", "id"], "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
    kept = j.where("not (spread and incomplete and type = 'relation')")
    return kept.select(type_rank(F.col("type")).alias("rank"), "type", "id", "action", "spread", "incomplete").orderBy("rank", "id")
