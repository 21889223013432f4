import json
import random

import pytest

from terrafold import coverer
from terrafold.functions import s2
from terrafold.operators import spatial
from terrafold.region import Cap, Polygon, Rect, Region, RegionError

SQUARE = [[-1, -1], [1, -1], [1, 1], [-1, 1], [-1, -1]]
POLY = "a\n1\n  {}\nEND\nEND\n"


def geo(kind, coordinates):
    return Region.parse(json.dumps({"type": kind, "coordinates": coordinates}), "geojson")


def rings(*parts):
    out = "name\n"
    for title, points in parts:
        out += f"{title}\n" + "".join(f"\t{x}  {y}\n" for x, y in points) + "END\n"
    return out + "END\n"


def test_box_is_latitude_first_and_closed():
    r = Region.parse(" -1.0, -2.0, 1.0, 2.0 ", "bbox")
    assert r.contains(0, 0) and r.contains(0.9, 1.9) and r.contains(1, 2) and not r.contains(1.9, 0.9)


def test_box_over_the_antimeridian():
    r = Region.parse("-1,179,1,-179", "bbox")
    assert r.contains(0, 179.5) and r.contains(0, -179.5) and not r.contains(0, 0)


def test_disc():
    r = Region.parse("0.0,0.0,1.0", "disc")
    assert r.contains(0, 0) and not r.contains(0.9, 0.9)


def test_polygon_hole_and_multipolygon():
    big = [[2 * x, 2 * y] for x, y in SQUARE]
    assert geo("Polygon", [SQUARE]).contains(0, 0) and not geo("Polygon", [SQUARE]).contains(2, 2)
    holed = geo("Polygon", [big, SQUARE])
    assert holed.contains(1.5, 1.5) and not holed.contains(0, 0)
    two = geo("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]], [[[2, 2], [3, 2], [3, 3], [2, 3], [2, 2]]]])
    assert two.contains(0.5, 0.5) and two.contains(2.5, 2.5) and not two.contains(1.5, 1.5)
    b = two.bounds()
    assert b.lat_lo <= 0 and b.lon_lo <= 0 and b.lat_hi >= 3 and b.lon_hi >= 3


def test_polygon_over_the_antimeridian():
    r = geo("Polygon", [[[180, -1], [181, -1], [181, 1], [180, 1], [180, -1]]])
    b = r.bounds()
    assert b.lon_lo == 180 and -179.1 <= b.lon_hi <= -178.9 and r.contains(0, -179.5)


def test_collections():
    g = {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [SQUARE]}]}
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {}}]}
    assert Region.parse(json.dumps(f), "geojson").contains(0, 0)


def test_poly_files():
    r = Region.parse(rings(("1", [("2.0E0", "1.0E+00"), (2, -1), (-2, -1), (-2, 1)])), "poly")
    assert r.contains(0, 0) and r.contains(0.5, 1.5) and not r.contains(2, 3)
    back = Region.parse(rings(("1", SQUARE[::-1])), "poly")
    assert back.contains(0, 0) and not back.contains(2, 2)
    two = Region.parse(rings(("1", SQUARE), ("2", [(3, 3), (4, 3), (4, 4), (3, 4)])), "poly")
    assert two.contains(0, 0) and two.contains(3.5, 3.5) and not two.contains(2, 2)
    holed = Region.parse(rings(("1", [(2 * x, 2 * y) for x, y in SQUARE]), ("!2", SQUARE)), "poly")
    assert holed.contains(1.5, 1.5) and not holed.contains(0, 0)


def test_edges_are_great_circles():
    r = geo("Polygon", [[[-60, 40], [60, 40], [60, 30], [-60, 30], [-60, 40]]])
    assert r.contains(50, 0) and not r.contains(35, 0)


@pytest.mark.parametrize("text,kind", [("1,2,3", "bbox"), ("a,b,c", "disc"), ("x\nEND\n", "poly"), ('{"type":"Point","coordinates":[0,0]}', "geojson"), ("1,2,3,4", "shape"), ("1,2,3,nan", "bbox")])
def test_senseless_text(text, kind):
    with pytest.raises(RegionError):
        Region.parse(text, kind)


def test_options_and_files(tmp_path):
    p = tmp_path / "a.bbox"
    p.write_text("-1,-1,1,1")
    assert Region.from_options(disc="0,0,1", region=str(p)).parts == (Cap(0, 0, 1),)
    assert Region.from_options(region=str(p)).parts == (Rect(-1, -1, 1, 1),)
    with pytest.raises(RegionError):
        Region.from_options()
    with pytest.raises(RegionError):
        Region.from_file("a.txt")


def random_regions(seed):
    rng = random.Random(seed)
    lat, lon = rng.uniform(-80, 80), rng.uniform(-180, 180)
    yield Region((Rect(lat - 3, lon - 5 if lon > -175 else lon, lat + 3, lon + 5 if lon < 175 else lon),))
    yield Region((Cap(lat, lon, rng.uniform(0.1, 20)),))
    ring = tuple((lon + rng.uniform(3, 8) * x, lat + rng.uniform(1, 3) * y) for x, y in ((-1, -1), (0, -1.4), (1, -1), (1.3, 0), (1, 1), (0, 1.2), (-1, 1)))
    yield Region((Polygon((ring,)),))


@pytest.mark.parametrize("seed", range(6))
def test_coverings_hold_their_region(seed):
    rng = random.Random(seed)
    for region in random_regions(seed):
        ranges = coverer.covering(region, max_cells=200)
        wide = coverer.covering(region, grow=6, max_cells=200)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        cells = spatial.cover(region)
        keys = {(lv, x, y): inner for lv, x, y, inner in cells}
        assert len(keys) == len(cells)
        b = region.bounds()
        for _ in range(300):
            lat = rng.uniform(max(-90, b.lat_lo - 1), min(90, b.lat_hi + 1))
            lon = rng.uniform(-180, 180) if b.lon_lo > b.lon_hi else rng.uniform(b.lon_lo, b.lon_hi)
            key = s2.key_at(lat, lon)
            held = any(lo <= key < hi for lo, hi in ranges)
            assert held or not region.contains(lat, lon)
            assert not held or any(lo <= key < hi for lo, hi in wide)
            met = [keys[c] for lv in range(spatial.MAX_LEVEL + 1) if (c := (lv, int((lon + 180) / 360 * 2**lv), int((lat + 90) / 180 * 2**lv))) in keys]
            assert len(met) <= 1
            if region.contains(lat, lon):
                assert met
            elif met:
                assert not met[0], "an interior cell reaches out of the region"


def test_covering_budget_and_overshoot():
    r = Region.parse("5.0,76.0,5.1,76.1", "bbox")
    cells = coverer.cover(r, 64)
    assert len(cells) <= 64 and all(level <= 16 for level, *_ in cells)
    ranges = coverer.ranges(cells)
    assert not any(lo <= s2.key_at(7, 79) < hi for lo, hi in ranges)
    with pytest.raises(ValueError):
        coverer.expand(cells, 17)


def test_growth_reaches_over_the_edge_of_a_face():
    cells = [(10, *[(f, i >> 6, j >> 6) for f, i, j in [s2.face_ij(0.0, 44.99)]][0])]
    ranges = coverer.ranges(coverer.expand(cells, 10))
    assert any(lo <= s2.key_at(0.0, 45.05) < hi for lo, hi in ranges)
