"""Cells of the published S2 scheme as Spark columns and as plain Python.

A level-16 cell is stored as ``face * 2**32 + position`` (35 bits, in the order of the cells' unsigned ids), a cell of a
coarser level as the half-open range of the level-16 cells below it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL = 16
# Fixed values of the scheme: the position along the curve of each quadrant (by orientation, then 2 * i + j), and how the
# orientation changes within the quadrant at each position.
QUADRANT_POSITION = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
ORIENTATION_CHANGE = (1, 0, 0, 3)


# ---- columns


def _along_curve(i: Column, j: Column, face: Column) -> Column:
    """Position along the curve, 16 bits of i and j from high to low; the state is ``position * 4 + orientation``."""
    turn = [(p, o ^ ORIENTATION_CHANGE[p]) for o in range(4) for p in QUADRANT_POSITION[o]]
    after = F.array(*[F.lit(p * 4 + o).cast("bigint") for p, o in turn])  # by 4 * orientation + quadrant

    def step(state: Column, shift: Column) -> Column:
        bit = lambda x: F.call_function("shiftright", x, shift).bitwiseAND(F.lit(1))
        quad = bit(i) * 2 + bit(j)
        hit = F.get(after, (state.bitwiseAND(F.lit(3)) * 4 + quad).cast("int"))
        return F.shiftright(state, 2) * 16 + hit

    start = face.bitwiseAND(F.lit(1)).cast("bigint")
    return F.shiftright(F.aggregate(F.array(*map(F.lit, range(15, -1, -1))), start, step), 2)


def cell(lat: Column, lon: Column) -> Column:
    """Key of the level-16 cell that holds a point given in degrees; null for a null coordinate."""
    phi, theta = F.radians(lat), F.radians(lon)
    point = F.struct((F.cos(phi) * F.cos(theta)).alias("x"), (F.cos(phi) * F.sin(theta)).alias("y"), F.sin(phi).alias("z"))

    def faced(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
        axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2)
        main = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
        face = F.when(main < 0, axis + 3).otherwise(axis)
        u = F.when(face == 0, y / x).when(face == 1, -x / y).when(face == 2, -x / z).when(face == 3, z / x).when(face == 4, z / y).otherwise(-y / z)
        v = F.when(face == 0, z / x).when(face == 1, z / y).when(face == 2, -y / z).when(face == 3, y / x).when(face == 4, -x / y).otherwise(-x / z)
        return F.struct(face.cast("bigint").alias("f"), u.alias("u"), v.alias("v"))

    def placed(q: Column) -> Column:
        st = lambda u: F.when(u >= 0, F.sqrt(1 + 3 * u) / 2).otherwise(1 - F.sqrt(1 - 3 * u) / 2)
        ij = lambda s: F.least(F.greatest(F.floor(s * 65536), F.lit(0)), F.lit(65535)).cast("bigint")
        return F.struct(q["f"].alias("f"), ij(st(q["u"])).alias("i"), ij(st(q["v"])).alias("j"))

    def numbered(r: Column) -> Column:
        return F.shiftleft(r["f"], 32) + _along_curve(r["i"], r["j"], r["f"])

    let = lambda value, body: F.transform(value, body)
    key = F.element_at(let(let(let(F.array(point), faced), placed), numbered), 1)
    return F.when(lat.isNotNull() & lon.isNotNull(), key)


def cell_of_fixed(lon_i: str = "lon_i", lat_i: str = "lat_i") -> Column:
    """Key of the cell of coordinates in 1e-7 degrees."""
    return cell(F.col(lat_i) / 1e7, F.col(lon_i) / 1e7)


def parent(key: Column, level: int) -> Column:
    """The prefix ``face * 4**level + position`` of a key's cell of a coarser level."""
    return F.shiftright(key, 2 * (LEVEL - level))


def range_of(prefix: Column, level: int) -> tuple[Column, Column]:
    """The half-open range of keys below a cell."""
    return F.shiftleft(prefix, 2 * (LEVEL - level)), F.shiftleft(prefix + 1, 2 * (LEVEL - level))


def cell_id(key: Column) -> Column:
    """The cell's canonical 64-bit id, negative as a signed number on faces 4 and 5."""
    return F.shiftleft(F.shiftleft(key, 1) + 1, 28)


def key_of_id(ident: Column) -> Column:
    return F.shiftrightunsigned(ident, 29)


# ---- plain Python, for coverings


def position(face: int, i: int, j: int, level: int) -> int:
    o, pos = face & 1, 0
    for k in range(level - 1, -1, -1):
        p = QUADRANT_POSITION[o][((i >> k & 1) << 1) | (j >> k & 1)]
        pos, o = pos * 4 + p, o ^ ORIENTATION_CHANGE[p]
    return pos


def _uv(s: float) -> float:
    return (4 * s * s - 1) / 3 if s >= 0.5 else (1 - 4 * (1 - s) ** 2) / 3


def lat_lon(face: int, s: float, t: float) -> tuple[float, float]:
    """The point of a face's square (s, t in 0..1) in degrees."""
    u, v = _uv(s), _uv(t)
    x, y, z = ((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[face]
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def face_ij(lat: float, lon: float) -> tuple[int, int, int]:
    """Face and level-16 coordinates of a point."""
    phi, theta = math.radians(lat), math.radians(lon)
    p = (math.cos(phi) * math.cos(theta), math.cos(phi) * math.sin(theta), math.sin(phi))
    a = [abs(c) for c in p]
    axis = 0 if a[0] >= a[1] and a[0] >= a[2] else 1 if a[1] >= a[2] else 2
    face = axis + 3 * (p[axis] < 0)
    x, y, z = p
    u, v = ((lambda: (y / x, z / x)), (lambda: (-x / y, z / y)), (lambda: (-x / z, -y / z)), (lambda: (z / x, y / x)), (lambda: (z / y, -x / y)), (lambda: (-y / z, -x / z)))[face]()
    st = lambda w: 0.5 * math.sqrt(1 + 3 * w) if w >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * w)
    ij = lambda s: min(max(int(math.floor(s * 65536)), 0), 65535)
    return face, ij(st(u)), ij(st(v))


def key_at(lat: float, lon: float) -> int:
    face, i, j = face_ij(lat, lon)
    return (face << 32) + position(face, i, j, LEVEL)
