"""Inverted indexes: which ways and relations refer to an element, and which nodes lie in a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import s2

#: Index -> its columns, the referred element first.
COLUMNS = {
    "cell_node": ("cell", "node_id"),
    "node_way": ("node_id", "way_id"),
    "node_relation": ("node_id", "relation_id"),
    "way_relation": ("way_id", "relation_id"),
    "relation_relation": ("child_id", "parent_id"),
}


def cell_node(locations: DataFrame) -> DataFrame:
    located = locations.where("lon_i between -1800000000 and 1800000000 and lat_i between -900000000 and 900000000")
    return located.select(s2.cell_of_fixed().alias("cell"), F.col("id").alias("node_id")).distinct()


def node_way(ways: DataFrame) -> DataFrame:
    """Each (node, way) once, however often the way visits the node; repeats are dropped before the shuffle that a
    table of repeated rows still needs."""
    return ways.select(F.explode(F.array_distinct("nodes")).alias("node_id"), F.col("id").alias("way_id")).where("node_id is not null").distinct()


def _members(relations: DataFrame, kind: str, child: str, parent: str) -> DataFrame:
    refs = F.array_distinct(F.transform(F.filter("members", lambda m: m["type"] == kind), lambda m: m["ref"]))
    return relations.select(F.explode(refs).alias(child), F.col("id").alias(parent)).where(f"{child} is not null").distinct()


def node_relation(relations: DataFrame) -> DataFrame:
    return _members(relations, "node", "node_id", "relation_id")


def way_relation(relations: DataFrame) -> DataFrame:
    return _members(relations, "way", "way_id", "relation_id")


def relation_relation(relations: DataFrame) -> DataFrame:
    return _members(relations, "relation", "child_id", "parent_id")


def build(name: str, locations: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """An index by name from current rows."""
    if name == "cell_node":
        return cell_node(locations)
    return node_way(ways) if name == "node_way" else globals()[name](relations)


def reverse(index: DataFrame) -> DataFrame:
    """``key, values``: the sorted distinct entries of each key, for reports; a hot key makes a long list."""
    key, val = index.columns
    return index.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(val)).alias("values"))
