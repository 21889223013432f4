"""Coverings of regions by cells, as ranges of level-16 cell keys.

A covering holds the whole region and perhaps a little more.  A cell is judged by the cap around it: it counts as inside
only if the whole cap is, and as outside only if the cap is.
"""

from __future__ import annotations

import heapq
import math

from terrafold.functions import s2
from terrafold.region import Cap, Polygon, Rect, Region, angle

MAX_CELLS = 1024


def _cap(face: int, i: int, j: int, level: int) -> Cap:
    n = 1 << level
    lat, lon = s2.lat_lon(face, (i + 0.5) / n, (j + 0.5) / n)
    return Cap(lat, lon, max(angle(lat, lon, *s2.lat_lon(face, (i + a) / n, (j + b) / n)) for a in (0, 1) for b in (0, 1)) + 1e-9)


def _to_edge(lat: float, lon: float, e: tuple[float, float, float, float]) -> float:
    """A lower bound of the angle between a point and an edge, exact where the nearest point is not an end."""
    def xyz(y: float, x: float) -> tuple[float, float, float]:
        y, x = math.radians(y), math.radians(x)
        return math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)

    def cross(p, q):
        return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]

    def dot(p, q):
        return sum(c * d for c, d in zip(p, q))

    p, a, b = xyz(lat, lon), xyz(e[1], e[0]), xyz(e[3], e[2])
    n = cross(a, b)
    size = math.sqrt(dot(n, n))
    if size > 1e-15 and dot(cross(n, a), p) >= 0 and dot(cross(b, n), p) >= 0:
        return abs(math.degrees(math.asin(max(-1.0, min(1.0, dot(p, n) / size)))))
    return min(angle(lat, lon, e[1], e[0]), angle(lat, lon, e[3], e[2]))


def _side(part, c: Cap) -> int:
    """0 outside, 1 in question, 2 inside."""
    if isinstance(part, Cap):
        d = angle(part.lat, part.lon, c.lat, c.lon)
        return 0 if d > part.radius + c.radius else 2 if d + c.radius <= part.radius else 1
    if isinstance(part, Rect):
        b = c.bounds()
        found = [part.classify(b.lat_lo, lo, b.lat_hi, hi) for lo, hi in b.spans]
        return 0 if not any(found) else 2 if all(f == 2 for f in found) else 1
    assert isinstance(part, Polygon)
    if any(_to_edge(c.lat, c.lon, e) <= c.radius for e in part.edges):
        return 1
    return 2 if part.contains(c.lat, c.lon) else 0


def cover(region: Region, max_cells: int = MAX_CELLS, max_level: int = s2.LEVEL) -> list[tuple[int, int, int, int]]:
    """Disjoint cells (level, face, i, j); the coarsest cells in question are split while the budget lasts."""
    out, heap = [], []

    def add(level: int, face: int, i: int, j: int) -> None:
        c = _cap(face, i, j, level)
        side = max(_side(p, c) for p in region.parts)
        if side == 2 or (side == 1 and level == max_level):
            out.append((level, face, i, j))
        elif side:
            heapq.heappush(heap, (level, face, i, j))

    for face in range(6):
        add(0, face, 0, 0)
    while heap and len(heap) + len(out) + 3 <= max_cells:
        level, face, i, j = heapq.heappop(heap)
        for a in (0, 1):
            for b in (0, 1):
                add(level + 1, face, 2 * i + a, 2 * j + b)
    return out + heap


def ranges(cells: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint half-open key ranges of cells, neighbours put together."""
    spans = []
    for level, face, i, j in cells:
        q = (face << 2 * level) + s2.position(face, i, j, level)
        spans.append((q << 2 * (s2.LEVEL - level), (q + 1) << 2 * (s2.LEVEL - level)))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def expand(cells: list[tuple[int, int, int, int]], level: int) -> list[tuple[int, int, int, int]]:
    """The cells and all neighbours of the given level around them; finer cells are first raised to it."""
    if not 0 <= level <= s2.LEVEL:
        raise ValueError("a level from 0 to 16 is needed")
    out, n = set(), 1 << level
    for lv, face, i, j in cells:
        if lv > level:
            i, j, lv = i >> (lv - level), j >> (lv - level), level
        out.add((lv, face, i, j))
        k = 1 << (level - lv)  # cells of the level along a side
        x0, y0 = i * k, j * k
        rim = [(x, y) for x in range(x0 - 1, x0 + k + 1) for y in (y0 - 1, y0 + k)] + [(x, y) for x in (x0 - 1, x0 + k) for y in range(y0, y0 + k)]
        for x, y in rim:
            f, a, b = face, x, y
            if not (0 <= x < n and 0 <= y < n):  # over the edge of the face: found by its point in space
                lat, lon = _beyond(face, (x + 0.5) / n, (y + 0.5) / n)
                f, a16, b16 = s2.face_ij(lat, lon)
                a, b = a16 >> (s2.LEVEL - level), b16 >> (s2.LEVEL - level)
            out.add((level, f, a, b))
    return sorted(out)


def _beyond(face: int, s: float, t: float) -> tuple[float, float]:
    """A point a little outside a face's square, by its linear continuation."""
    def run_on(w: float) -> float:
        if w > 1:
            return 1 + (w - 1) * 2
        return -1 + w * 2 if w < 0 else s2._uv(w)

    u, v = run_on(s), run_on(t)
    x, y, z = ((1, u, v), (-u, 1, v), (-u, -v, 1), (-1, -v, -u), (v, -1, -u), (v, u, -1))[face]
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def covering(region: Region, grow: int | None = None, max_cells: int = MAX_CELLS) -> list[tuple[int, int]]:
    """Key ranges of a region's covering, grown by the neighbours of a level if asked for."""
    cells = cover(region, max_cells)
    return ranges(expand(cells, grow) if grow is not None else cells)
