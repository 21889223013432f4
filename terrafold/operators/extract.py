"""Region extracts.

    N0 = nodes in the region             W0 = ways of N0
    R0 = relations of N0 or W0           R  = R0 and all relations above
    W  = W0 and the ways that multipolygons of R are made of, where they exist
    N  = N0 and the nodes of W

Parents of what W and N add aren't looked up: there is one pass.  The region is taken by its covering, as a superset of
the region in whole cells (mode ``covering``), or point by point (mode ``exact``, an extension).
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold import coverer, tags
from terrafold.dataset import OsmDataset
from terrafold.functions import s2
from terrafold.operators.onetask import TASK_LINKS, spread_in_tasks
from terrafold.region import Rect, Region
from terrafold.scratch import Scratch

#: Up to so many ranges become one predicate that reaches the Parquet scan; more are joined by a coarse prefix.
MAX_PREDICATES = 64
BROADCAST_RANGES = 100_000
_BUCKET_LEVEL = 7


def in_ranges(df: DataFrame, ranges: list[tuple[int, int]], cell: str = "cell") -> DataFrame:
    """Rows whose cell lies in one of some sorted disjoint half-open ranges.

    A plain range join would compare every row with every range; here rows meet ranges by the equality of a coarse cell.  The
    table of ranges by coarse cell is counted first: up to ``BROADCAST_RANGES`` rows it is broadcast, beyond it (coverings
    that were grown by fine cells) the join is left to Spark.
    """
    if not ranges:
        return df.where("false")
    if len(ranges) <= MAX_PREDICATES:
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | F.col(cell).between(lo, hi - 1)
        return df.where(hit)
    shift = 2 * (s2.LEVEL - _BUCKET_LEVEL)
    rows = [(b, lo, hi) for lo, hi in ranges for b in range(lo >> shift, ((hi - 1) >> shift) + 1)]
    table = df.sparkSession.createDataFrame(rows, "__b bigint, __lo bigint, __hi bigint")
    met = df.withColumn("__b", F.shiftright(F.col(cell), shift)).join(F.broadcast(table) if len(rows) <= BROADCAST_RANGES else table, "__b")
    return met.where(f"{cell} >= __lo and {cell} < __hi").select(*df.columns)


def contains(region: Region, lat: Column, lon: Column) -> Column:
    """The region's exact test as a column."""
    from terrafold.operators.spatial import _shape, within

    s = _shape(region)
    pick = lambda rows, fields: F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in rows])
    out = F.lit(False)
    for name, fields in (("rects", "abcd"), ("caps", ("lat", "lon", "r"))):
        if s[name]:
            out = out | within({"rects": F.array().cast("array<struct<a:double,b:double,c:double,d:double>>"), "caps": F.array().cast("array<struct<lat:double,lon:double,r:double>>"), "polys": F.array().cast("array<array<struct<x1:double,t1:double,x2:double,t2:double>>>"), name: pick(s[name], fields)}, lat, lon)
    if s["polys"]:
        polys = F.array(*[pick(p, ("x1", "t1", "x2", "t2")) for p in s["polys"]])
        out = out | within({"rects": F.array().cast("array<struct<a:double,b:double,c:double,d:double>>"), "caps": F.array().cast("array<struct<lat:double,lon:double,r:double>>"), "polys": polys}, lat, lon)
    return out


def nodes_in(db: OsmDataset, region: Region, mode: str = "covering", grow: int | None = None) -> DataFrame:
    """N0: ``id``.

    The exact mode looks at the nodes of the covering only, by way of the cell index.  A box is tested by whole numbers,
    which reach the scan of the locations; other regions by their formula.
    """
    if mode not in ("covering", "exact"):
        raise ValueError(f"unknown mode {mode!r}")
    held = in_ranges(db.cell_node, coverer.covering(region, grow)).select(F.col("node_id").alias("id")).distinct()
    if mode == "covering":
        return held
    near = db.locations.where("lon_i is not null and lat_i is not null")
    rects = [p for p in region.parts if isinstance(p, Rect)]
    if len(rects) == len(region.parts):
        test = F.lit(False)
        for p in rects:
            for lo, hi in p.spans:
                test = test | (F.col("lat_i").between(*_whole(p.lat_lo, p.lat_hi)) & F.col("lon_i").between(*_whole(lo, hi)))
        return near.where(test).select("id")
    return near.join(held, "id", "left_semi").where(contains(region, F.col("lat_i") / 1e7, F.col("lon_i") / 1e7)).select("id")


def _whole(lo: float, hi: float) -> tuple[int, int]:
    """The 1e-7 degrees x with lo <= x / 1e7 <= hi."""
    a, b = math.floor(lo * 1e7) - 1, math.ceil(hi * 1e7) + 1
    while a / 1e7 < lo:
        a += 1
    while b / 1e7 > hi:
        b -= 1
    return a, b


def parents(index: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``: what refers to any of the ids, by an index of two columns."""
    key, val = index.columns
    return index.join(ids.select(F.col("id").alias(key)), key, "left_semi").select(F.col(val).alias("id")).distinct()


def closure(relation_relation: DataFrame, start: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``id``: the start and all relations above it, cycles included.

    Upward from the start, so the work follows the result: by one task if it can hold the links between relations, else in
    rounds, one for each level of relations, in which only what is new goes on.
    """
    scratch = Scratch(start.sparkSession)
    links, n = scratch.save(relation_relation.select("child_id", "parent_id").where("parent_id is not null").distinct())
    if n["n"] <= task_links:
        if not n["n"]:
            return start.select("id").distinct()
        steps = links.select(F.col("child_id").alias("head"), F.col("child_id").alias("via"), F.col("parent_id").alias("child"), F.lit(1).cast("long").alias("w"))
        seeds = start.select(F.lit(0).cast("long").alias("top"), F.col("id").alias("head")).join(links.select(F.col("child_id").alias("head")), "head", "left_semi").select("top", "head")
        return start.select("id").union(spread_in_tasks(scratch, seeds, steps, n["n"]).select("head")).distinct()
    seen, m = scratch.save(start.select("id").distinct())
    front = seen
    while m["n"]:
        front, m = scratch.save(parents(links, front).join(seen, "id", "left_anti"))
        if m["n"]:
            seen = seen.union(front)
    return seen


def multipolygon_ways(relations: DataFrame, ways: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``: existing way members of the relations tagged type=multipolygon among ids."""
    r = relations.where(tags.has(F.col("tags"), "type", "multipolygon")).join(ids, "id", "left_semi")
    refs = r.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct()
    return refs.join(ways.select("id"), "id", "left_semi")


def way_nodes(ways: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``: the nodes of ways, whether they exist or not."""
    return ways.select("id", "nodes").join(ids, "id", "left_semi").select(F.explode(F.array_distinct("nodes")).alias("id")).where("id is not null").distinct()


@dataclass
class Extract:
    """The id sets of an extract; n, w, r are the whole result."""

    db: OsmDataset
    n0: DataFrame
    w0: DataFrame
    r0: DataFrame
    r: DataFrame
    w: DataFrame
    n: DataFrame

    def counts(self) -> DataFrame:
        parts = [getattr(self, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("set_name"), "n") for k in ("n0", "w0", "r0", "r", "w", "n")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def nodes(self, user_data: bool = True) -> DataFrame:
        """Located nodes with their tags, if they have any; a node without a position isn't part of the output."""
        at = self.db.locations.where("lon_i is not null and lat_i is not null").join(self.n, "id", "left_semi")
        out = at.join(self.db.nodes, "id", "left").select("id", "lon_i", "lat_i", "version", "tags", "meta")
        return out if user_data else anonymous(out)

    def ways(self, user_data: bool = True) -> DataFrame:
        out = self.db.ways.join(self.w, "id", "left_semi")
        return out if user_data else anonymous(out)

    def relations(self, user_data: bool = True) -> DataFrame:
        out = self.db.relations.join(self.r, "id", "left_semi")
        return out if user_data else anonymous(out)


def anonymous(df: DataFrame) -> DataFrame:
    """Without changeset, uid and user; version and timestamp stay."""
    meta = F.col("meta")
    for f in ("changeset", "uid", "user"):
        meta = meta.withField(f, F.lit(None).cast(df.schema["meta"].dataType[f].dataType))
    return df.withColumn("meta", F.when(F.col("meta").isNotNull(), meta))


def extract(db: OsmDataset, region: Region, mode: str = "covering", grow: int | None = None, watch: Callable = contextlib.nullcontext) -> Extract:
    """watch: a context around the search for the region's nodes, to tell its progress."""
    scratch = Scratch(db.spark)
    save = lambda df: scratch.save(df)[0]
    with watch():
        n0 = save(nodes_in(db, region, mode, grow))
    w0 = save(parents(db.node_way, n0))
    r0 = save(parents(db.node_relation, n0).union(parents(db.way_relation, w0)).distinct())
    r = save(closure(db.relation_relation, r0))
    w = save(w0.union(multipolygon_ways(db.relations, db.ways, r)).distinct())
    n = save(n0.union(way_nodes(db.ways, w)).distinct())
    return Extract(db, n0, w0, r0, r, w, n)


def header(db: OsmDataset, region: Region) -> dict:
    """The header of an extract's file; the box is left out where its longitudes don't ascend."""
    from terrafold.dataset import TIMESTAMP

    b, ts = region.bounds(), db.get_metadata(TIMESTAMP)
    out = {"generator": "terrafold", "timestamp": ts, "osmosis_replication_timestamp": ts}
    if b.lon_lo < b.lon_hi:
        out["box"] = [b.lon_lo, b.lat_lo, b.lon_hi, b.lat_hi]
    return out
