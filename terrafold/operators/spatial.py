"""Points near other points and points within regions.

*Regions* are covered by cells of an adaptive quadtree over longitude and latitude: a cell that lies wholly inside is kept
as an interior cell, one that the boundary crosses is split until the cell budget or the finest level is reached.  Points
meet cells by equality of cell keys; an interior match is accepted at once, only a boundary match gets the exact test.

*Neighbours* use cubes of the space around the sphere, which know neither poles nor an antimeridian.  Points in the same
small cube, whose diagonal is the distance asked for, are accepted at once; other candidates get the exact test.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.region import Cap, Polygon, Rect, Region, RegionError
from terrafold.scratch import Scratch
from terrafold.ship import ship

EARTH_M = 6_371_000.0
MIN_LEVEL, MAX_LEVEL, MAX_CELLS = 3, 16, 400
WORLD_LON, WORLD_LAT = 3_600_000_000, 1_800_000_000
#: Coarse cells of this level tell which levels occur below them; there are 16,384 of them at most.
COARSE = 7
#: Points of one cube that one task compares with the cube's other points.
CUBE_BLOCK = 4_000

_SHAPE = "struct<rects:array<struct<a:double,b:double,c:double,d:double>>,caps:array<struct<lat:double,lon:double,r:double>>,polys:array<array<struct<x1:double,t1:double,x2:double,t2:double>>>>"


def on_earth(lon_i: str = "lon_i", lat_i: str = "lat_i") -> Column:
    return F.col(lon_i).between(-WORLD_LON // 2, WORLD_LON // 2) & F.col(lat_i).between(-WORLD_LAT // 2, WORLD_LAT // 2)


def cover(region: Region, max_cells: int = MAX_CELLS, max_level: int = MAX_LEVEL) -> list[tuple[int, int, int, bool]]:
    """Disjoint cells (level, x, y, interior) that hold the whole region; the coarsest boundary cells are split first."""
    out, heap = [], []

    def add(level: int, x: int, y: int, parts: list) -> None:
        w, h = 360.0 / (1 << level), 180.0 / (1 << level)
        box = (-90 + y * h, -180 + x * w, -90 + (y + 1) * h, -180 + (x + 1) * w)
        kept = []
        for p, edges in parts:
            if isinstance(p, Polygon):  # only the edges that met the parent can meet the cell
                edges = [e for e in edges if p.crosses(e, *box)]
                side = 1 if edges else 2 if p.contains((box[0] + box[2]) / 2, (box[1] + box[3]) / 2) else 0
            else:
                side = p.classify(*box)
            if side == 2 and level >= MIN_LEVEL:
                out.append((level, x, y, True))
                return
            if side:
                kept.append((p, edges))
        if kept:
            heapq.heappush(heap, (level, x, y, kept))

    add(0, 0, 0, [(p, p.edges if isinstance(p, Polygon) else None) for p in region.parts])
    while heap and (heap[0][0] < MIN_LEVEL or (len(heap) + len(out) + 3 <= max_cells and heap[0][0] < max_level)):
        level, x, y, parts = heapq.heappop(heap)
        for dx in (0, 1):
            for dy in (0, 1):
                add(level + 1, 2 * x + dx, 2 * y + dy, parts)
    return out + [(level, x, y, False) for level, x, y, _ in heap]


def _shape(region: Region) -> dict:
    tan = lambda y: math.tan(math.radians(y))
    return {
        "rects": [{"a": p.lat_lo, "b": lo, "c": p.lat_hi, "d": hi} for p in region.parts if isinstance(p, Rect) for lo, hi in p.spans],
        "caps": [{"lat": p.lat, "lon": p.lon, "r": p.radius} for p in region.parts if isinstance(p, Cap)],
        "polys": [[{"x1": e[0], "t1": tan(e[1]), "x2": e[2], "t2": tan(e[3])} for e in p.edges if e[0] != e[2]] for p in region.parts if isinstance(p, Polygon)],
    }


def _at_cell(shape: dict, level: int, x: int) -> dict:
    """A shape with those edges alone that share a meridian with a cell."""
    if not shape["polys"]:
        return shape
    width = 360.0 / (1 << level)
    lo, hi = -180 + x * width - 1e-6, -180 + (x + 1) * width + 1e-6
    spans = [(lo + k, hi + k) for k in (-360, 0, 360)]  # edges may run on beyond 180 degrees
    return shape | {"polys": [[e for e in p if any(e["x1"] <= b and e["x2"] >= a for a, b in spans)] for p in shape["polys"]]}


def coverage(regions: DataFrame, max_cells: int = MAX_CELLS, max_level: int = MAX_LEVEL) -> DataFrame:
    """``region_id, cell, interior, shape`` of a table ``region_id, kind, spec``; each region is covered on an executor.

    Only boundary cells carry the shape, for their exact test, and of its polygons only the edges that share a meridian with
    the cell: no other edge lies north of one of its points.  A null or senseless spec covers nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, kind, spec in b.itertuples(index=False):
                try:
                    r = Region.parse(spec, kind.strip().lower())
                except (RegionError, AttributeError, ValueError, KeyError, TypeError):
                    continue
                shape = _shape(r)
                cells = cover(r, max_cells, max_level)
                yield pd.DataFrame({"region_id": i, "cell": [(lv << 58) | (x << 29) | y for lv, x, y, _ in cells], "interior": [c[3] for c in cells], "shape": [None if c[3] else _at_cell(shape, c[0], c[1]) for c in cells]})

    ship(regions.sparkSession)
    rows = regions.select(F.col("region_id").cast("long"), "kind", "spec").where("region_id is not null").distinct()
    rows = rows.repartition(min(256, regions.sparkSession.sparkContext.defaultParallelism), "region_id")  # few rows, each much work
    return rows.mapInPandas(run, f"region_id bigint, cell bigint, interior boolean, shape {_SHAPE}")


def cell_key(level: int, lon_i: str = "lon_i", lat_i: str = "lat_i") -> Column:
    """Key of the level's cell that holds a point; integer arithmetic, so a point never falls between cells."""
    n = 1 << level
    x = f"least((cast({lon_i} as bigint) + {WORLD_LON // 2}) * {n} div {WORLD_LON}, {n - 1})"
    y = f"least((cast({lat_i} as bigint) + {WORLD_LAT // 2}) * {n} div {WORLD_LAT}, {n - 1})"
    return F.expr(f"shiftleft({level}L, 58) | shiftleft({x}, 29) | {y}")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle in radians between points given in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2


def within(shape: Column, lat: Column, lon: Column) -> Column:
    """The exact test of a point against a shape."""
    rect = F.exists(shape["rects"], lambda r: lat.between(r["a"], r["c"]) & lon.between(r["b"], r["d"]))
    cap = F.exists(shape["caps"], lambda c: F.degrees(haversine(c["lat"], c["lon"], lat, lon)) <= c["r"])
    t = F.tan(F.radians(lat))

    def crossed(e: Column, x: Column) -> Column:
        high = (e["t1"] * F.sin(F.radians(e["x2"] - x)) + e["t2"] * F.sin(F.radians(x - e["x1"]))) / F.sin(F.radians(e["x2"] - e["x1"]))
        return F.when((x >= e["x1"]) & (x < e["x2"]) & (high > t), 1).otherwise(0)

    odd = lambda edges: F.aggregate(edges, F.lit(0), lambda acc, e: acc + crossed(e, lon - 360) + crossed(e, lon) + crossed(e, lon + 360)) % 2 == 1
    return rect | cap | F.exists(shape["polys"], odd)


def levels_at(cells: DataFrame) -> DataFrame:
    """``coarse, levels``: for each coarse cell the levels of the cells above, at or below it; at most 4**COARSE rows."""
    level, x, y = F.shiftright("cell", 58).cast("int"), F.shiftright("cell", 29).bitwiseAND((1 << 29) - 1), F.col("cell").bitwiseAND((1 << 29) - 1)
    at = cells.select("cell").distinct().select(level.alias("level"), x.alias("x"), y.alias("y"))
    up = F.expr(f"greatest(level - {COARSE}, 0)")
    wide = F.expr(f"shiftleft(1L, greatest({COARSE} - level, 0))")
    run = lambda c: F.sequence(F.expr(f"shiftright({c}, greatest(level - {COARSE}, 0))") * wide, F.expr(f"shiftright({c}, greatest(level - {COARSE}, 0))") * wide + wide - 1)
    spread = at.withColumn("up", up).select("level", F.explode(run("x")).alias("cx"), "y").withColumn("cy", F.explode(run("y")))
    key = F.shiftleft(F.lit(COARSE).cast("long"), 58).bitwiseOR(F.shiftleft("cx", 29)).bitwiseOR(F.col("cy"))
    return spread.select(key.alias("coarse"), "level").groupBy("coarse").agg(F.collect_set("level").alias("levels"))


def inside(points: DataFrame, regions: DataFrame, max_cells: int = MAX_CELLS, max_level: int = MAX_LEVEL) -> DataFrame:
    """``region_id, id`` of the points ``id, lon_i, lat_i`` in each region.  Points with null or impossible coordinates
    are nowhere.  A region takes part in one match per point, as its cells are disjoint.

    A point first meets its coarse cell, in a broadcast table of at most 4**COARSE rows, and goes on only with the cells
    of the levels that occur there; points far from all regions end here.
    """
    cells, _ = Scratch(points.sparkSession).save(coverage(regions, max_cells, max_level))
    near_cells = points.where(on_earth()).select("id", "lon_i", "lat_i", cell_key(COARSE).alias("coarse")).join(F.broadcast(levels_at(cells)), "coarse")
    fine = near_cells.select("id", "lon_i", "lat_i", "levels", cell_key(max_level).alias("fine"))
    up = f"({max_level} - level)"
    above = F.expr(f"shiftleft(cast(level as bigint), 58) | shiftleft(shiftright(shiftright(fine, 29) & {(1 << 29) - 1}, {up}), 29) | shiftright(fine & {(1 << 29) - 1}, {up})")
    keyed = fine.select("id", "lon_i", "lat_i", "fine", F.explode("levels").alias("level")).select("id", "lon_i", "lat_i", above.alias("cell"))
    met = keyed.join(cells, "cell")
    exact = within(F.col("shape"), F.col("lat_i") / 1e7, F.col("lon_i") / 1e7)
    return met.where(F.when(F.col("interior"), True).otherwise(exact)).select("region_id", "id")


def near(points: DataFrame, metres: float, cube_block: int = CUBE_BLOCK) -> DataFrame:
    """``left_id, right_id, metres`` of all pairs of different points ``id, lon_i, lat_i`` at most so far apart, the smaller
    id on the left.  One row per id is taken; points with null or impossible coordinates are nowhere.

    metres of a pair that was accepted by its cube is the exact distance, too.  Cubes with more than cube_block points
    are compared in blocks, each with the whole cube, by tasks of their own.
    """
    spark = points.sparkSession
    side, fine = metres * 4, metres / math.sqrt(3) * (1 - 1e-9)
    lat, lon = F.radians(F.col("lat_i") / 1e7), F.radians(F.col("lon_i") / 1e7)
    p = points.where(on_earth()).select("id", "lon_i", "lat_i", (F.cos(lat) * F.cos(lon) * EARTH_M).alias("x"), (F.cos(lat) * F.sin(lon) * EARTH_M).alias("y"), (F.sin(lat) * EARTH_M).alias("z"))
    at = lambda c, step: F.floor(c / step)
    pack = lambda i, j, k, bits: F.shiftleft(i + (1 << bits - 1), 2 * bits) + F.shiftleft(j + (1 << bits - 1), bits) + k + (1 << bits - 1)
    bits = max(2, math.ceil(math.log2(EARTH_M / fine)) + 2)
    own = pack(*[at(F.col(c), side) for c in "xyz"], min(bits, 21))
    small = F.array(*[at(F.col(c), fine) for c in "xyz"])
    p, _ = Scratch(spark).save(p.select("id", "lon_i", "lat_i", "x", "y", "z", own.alias("cube"), small.alias("fine")))
    reach = metres * (1 + 1e-6) + 1e-6
    spans = [F.sequence(at(F.col(c) - reach, side), at(F.col(c) + reach, side)) for c in "xyz"]
    cubes = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: pack(i, j, k, min(bits, 21)))))))
    cols = ["id", "lon_i", "lat_i", "fine"]
    left = p.select(*cols, "cube")
    right = p.select(*cols, F.explode(cubes).alias("cube"))
    hot, n = Scratch(spark).save(p.groupBy("cube").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > cube_block).select("cube", F.ceil(F.col("k") / cube_block).cast("int").alias("blocks")))
    if n["n"]:
        left = left.join(hot, "cube", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
        right = right.join(hot, "cube", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        key = ["cube", "block"]
    else:
        key = ["cube"]
    left = left.select(*key, *[F.col(c).alias(f"l_{c}") for c in cols])
    right = right.select(*key, *[F.col(c).alias(f"r_{c}") for c in cols])
    deg = lambda c: F.col(c) / 1e7
    apart = haversine(deg("l_lat_i"), deg("l_lon_i"), deg("r_lat_i"), deg("r_lon_i")) * EARTH_M
    pairs = left.join(right, key).where(F.col("l_id") < F.col("r_id"))
    accepted = pairs.where(F.when(F.col("l_fine") == F.col("r_fine"), True).otherwise(apart <= metres))
    return accepted.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), apart.alias("metres"))


def tagged_positions(locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, lon_i, lat_i`` of the nodes that have a row in ``nodes``, at their current location."""
    ids = nodes.select("id").where("id is not null").distinct()
    own = locations.select("id", "lon_i", "lat_i", "version").join(ids, "id", "left_semi")
    best = own.groupBy("id").agg(F.max(F.struct("version", "lon_i", "lat_i")).alias("p"))
    return best.select("id", "p.lon_i", "p.lat_i")
