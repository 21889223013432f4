"""Regions: bounding boxes, discs and polygons, parsed from text and tested on the sphere.

Polygon edges are great circles.  Containment counts the edges that a point's meridian crosses to the north of it, so no
pole may lie inside a polygon.  A region is the union of its parts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

Ring = list[tuple[float, float]]  # (lon, lat), open


def wrap(lon: float) -> float:
    """Longitude in -180..180."""
    return lon if -180 <= lon <= 180 else math.remainder(lon, 360.0)


def clamp(lat: float) -> float:
    return max(-90.0, min(90.0, lat))


def angle(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Angle between two points at the earth's centre, in degrees."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


@dataclass(frozen=True)
class Rect:
    lat_lo: float
    lon_lo: float
    lat_hi: float
    lon_hi: float

    @property
    def spans(self) -> list[tuple[float, float]]:
        """Longitude intervals; two of them if the antimeridian is crossed."""
        return [(self.lon_lo, self.lon_hi)] if self.lon_lo <= self.lon_hi else [(self.lon_lo, 180.0), (-180.0, self.lon_hi)]

    def contains(self, lat: float, lon: float) -> bool:
        return self.lat_lo <= lat <= self.lat_hi and any(a <= lon <= b for a, b in self.spans)

    def bounds(self) -> Rect:
        return self

    def classify(self, lat0: float, lon0: float, lat1: float, lon1: float) -> int:
        """Of a closed cell: 0 outside, 1 on the boundary, 2 inside."""
        if lat1 < self.lat_lo or lat0 > self.lat_hi or not any(lon1 >= a and lon0 <= b for a, b in self.spans):
            return 0
        return 2 if lat0 >= self.lat_lo and lat1 <= self.lat_hi and any(lon0 >= a and lon1 <= b for a, b in self.spans) else 1


@dataclass(frozen=True)
class Cap:
    lat: float
    lon: float
    radius: float

    def contains(self, lat: float, lon: float) -> bool:
        return angle(self.lat, self.lon, lat, lon) <= self.radius

    def bounds(self) -> Rect:
        lo, hi = self.lat - self.radius, self.lat + self.radius
        if lo <= -90 or hi >= 90:
            return Rect(max(lo, -90.0), -180.0, min(hi, 90.0), 180.0)
        d = math.degrees(math.asin(min(1.0, math.sin(math.radians(self.radius)) / math.cos(math.radians(self.lat)))))
        return Rect(lo, wrap(self.lon - d), hi, wrap(self.lon + d))

    def classify(self, lat0: float, lon0: float, lat1: float, lon1: float) -> int:
        mid = angle(self.lat, self.lon, (lat0 + lat1) / 2, (lon0 + lon1) / 2)
        widest = 1.0 if lat0 <= 0 <= lat1 else math.cos(math.radians(min(abs(lat0), abs(lat1))))
        reach = (lat1 - lat0) / 2 + (lon1 - lon0) / 2 * widest + 1e-12
        return 0 if mid - reach > self.radius else 2 if mid + reach <= self.radius else 1


def edges_of(ring: Ring) -> list[tuple[float, float, float, float]]:
    """Edges (lon1, lat1, lon2, lat2) with lon1 <= lon2 that nowhere span more than 180 degrees; longitudes run on past
    180 where the ring crosses the antimeridian."""
    out = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        x2 = x1 + math.remainder(x2 - x1, 360.0)
        out.append((x1, y1, x2, y2) if x1 <= x2 else (x2, y2, x1, y1))
    return out


def tan_at(edge: tuple[float, float, float, float], lon: float) -> float:
    """Tangent of the latitude at which the great circle through the edge's ends meets a meridian."""
    x1, y1, x2, y2 = edge
    s = math.sin(math.radians(x2 - x1))
    return (math.tan(math.radians(y1)) * math.sin(math.radians(x2 - lon)) + math.tan(math.radians(y2)) * math.sin(math.radians(lon - x1))) / s


@dataclass(frozen=True)
class Polygon:
    """An outer ring and its holes; the direction of rings and a repeated last point mean nothing."""

    rings: tuple[tuple[tuple[float, float], ...], ...]
    edges: tuple = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "edges", tuple(e for r in self.rings for e in edges_of(list(r)) if e[0] != e[2] or e[1] != e[3]))

    def contains(self, lat: float, lon: float, edges: tuple | None = None) -> bool:
        t, odd = math.tan(math.radians(lat)), False
        for e in self.edges if edges is None else edges:
            for x in (lon - 360, lon, lon + 360):
                if e[0] <= x < e[2] and tan_at(e, x) > t:
                    odd = not odd
        return odd

    def bounds(self) -> Rect:
        ring = self.rings[0]
        lat = [y for _, y in ring]
        x = [ring[0][0]]
        for a, _ in ring[1:]:
            x.append(x[-1] + math.remainder(a - x[-1], 360.0))
        return Rect(min(lat), wrap(min(x)), max(lat), wrap(max(x)))

    def crosses(self, e: tuple[float, float, float, float], lat0: float, lon0: float, lat1: float, lon1: float) -> bool:
        """Whether an edge meets a closed cell, by the exact range of latitudes over the shared longitudes."""
        for shift in (-360, 0, 360):
            a, b = max(e[0], lon0 + shift), min(e[2], lon1 + shift)
            if a > b:
                continue
            if e[0] == e[2]:
                lats = [e[1], e[3]]
            else:
                lats = [math.degrees(math.atan(tan_at(e, x))) for x in (a, b)]
                s, c = tan_at(e, e[0]), tan_at(e, e[0] + 90) if e[2] - e[0] < 180 else 0.0
                top = e[0] + math.degrees(math.atan2(c, s))  # where the circle is furthest from the equator
                lats += [math.degrees(math.atan(tan_at(e, x))) for x in (top - 180, top, top + 180) if a < x < b]
            if min(lats) - 1e-12 <= lat1 and max(lats) + 1e-12 >= lat0:
                return True
        return False

    def classify(self, lat0: float, lon0: float, lat1: float, lon1: float) -> int:
        if any(self.crosses(e, lat0, lon0, lat1, lon1) for e in self.edges):
            return 1
        return 2 if self.contains((lat0 + lat1) / 2, (lon0 + lon1) / 2) else 0


class RegionError(ValueError):
    """Text that doesn't describe a region."""


def _numbers(text: str, n: int) -> list[float]:
    try:
        x = [float(p) for p in text.strip().split(",")]
    except ValueError as e:
        raise RegionError(f"not {n} numbers: {text!r}") from e
    if len(x) != n or not all(map(math.isfinite, x)):
        raise RegionError(f"not {n} numbers: {text!r}")
    return x


def _ring(points: list) -> tuple[tuple[float, float], ...]:
    ring = [(float(p[0]), clamp(float(p[1]))) for p in points]
    while len(ring) > 1 and ring[-1] == ring[0]:
        ring.pop()
    if len(ring) < 3:
        raise RegionError("a ring needs three different points")
    return tuple(ring)


def _geojson(g: dict) -> list:
    kind = g.get("type")
    if kind == "Polygon":
        return [Polygon(tuple(_ring(r) for r in g["coordinates"]))]
    if kind == "MultiPolygon":
        return [Polygon(tuple(_ring(r) for r in p)) for p in g["coordinates"]]
    if kind == "Feature":
        return _geojson(g["geometry"])
    if kind in ("FeatureCollection", "GeometryCollection"):
        return [p for x in g["features" if kind == "FeatureCollection" else "geometries"] for p in _geojson(x)]
    raise RegionError(f"no region in {kind!r}")


def _poly(text: str) -> list:
    """Sections of points after a title line, each closed by END; a ``!`` before a section's name makes it a hole."""
    outer, holes, points, name = [], [], None, ""
    for raw in text.splitlines()[1:]:
        line = raw.strip()
        if not line:
            continue
        if line == "END":
            if points is None:
                break
            (holes if name.startswith("!") else outer).append(_ring(points))
            points = None
        elif points is None:
            name, points = line, []
        else:
            parts = line.split()
            if len(parts) < 2:
                raise RegionError(f"no point: {line!r}")
            points.append((float(parts[0]), float(parts[1])))
    return [Polygon((r, *[h for h in holes if Polygon((r,)).contains(h[0][1], h[0][0])])) for r in outer]


@dataclass(frozen=True)
class Region:
    parts: tuple

    @staticmethod
    def parse(text: str, kind: str) -> Region:
        """kind: bbox ``minLat,minLon,maxLat,maxLon``, disc ``lat,lon,radiusDegrees``, geojson, or poly."""
        if kind == "bbox":
            a, b, c, d = _numbers(text, 4)
            parts = [Rect(clamp(a), wrap(b), clamp(c), wrap(d))]
        elif kind == "disc":
            a, b, r = _numbers(text, 3)
            parts = [Cap(clamp(a), wrap(b), r)]
        elif kind in ("geojson", "json"):
            parts = _geojson(json.loads(text))
        elif kind == "poly":
            parts = _poly(text)
        else:
            raise RegionError(f"unknown kind of region: {kind!r}")
        if not parts:
            raise RegionError("an empty region")
        return Region(tuple(parts))

    @staticmethod
    def from_file(path: str) -> Region:
        """The suffix of the file's name tells the kind."""
        for kind in ("bbox", "disc", "json", "poly"):
            if path.endswith(kind):
                with open(path, encoding="utf-8") as f:
                    return Region.parse(f.read(), kind)
        raise RegionError(f"the kind of {path} is unknown")

    @staticmethod
    def from_options(bbox=None, disc=None, geojson=None, poly=None, region=None) -> Region:
        """The first option that is given, in this order."""
        for kind, text in (("bbox", bbox), ("disc", disc), ("geojson", geojson), ("poly", poly)):
            if text:
                return Region.parse(text, kind)
        if region:
            return Region.from_file(region)
        raise RegionError("no region is given")

    def contains(self, lat: float, lon: float) -> bool:
        return any(p.contains(lat, lon) for p in self.parts)

    def classify(self, lat0: float, lon0: float, lat1: float, lon1: float) -> int:
        return max(p.classify(lat0, lon0, lat1, lon1) for p in self.parts)

    def bounds(self) -> Rect:
        b = [p.bounds() for p in self.parts]
        return Rect(min(x.lat_lo for x in b), min(x.lon_lo for x in b), max(x.lat_hi for x in b), max(x.lon_hi for x in b))
