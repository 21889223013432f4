import math
import random

from terrafold.operators import spatial
from terrafold.region import Region, angle

POINT = "id bigint, lon_i int, lat_i int"


def metres(p, q):
    return math.radians(angle(p[2] / 1e7, p[1] / 1e7, q[2] / 1e7, q[1] / 1e7)) * spatial.EARTH_M


def test_near_against_all_pairs(spark):
    rng = random.Random(4)
    pts = []
    for lat, lon in ((0, 0), (52.1, 13.2), (89.9999, 12), (-90, 0), (10, 179.9999999), (10, -179.9999999), (-33, -70)):
        for _ in range(25):
            pts.append((len(pts), max(-1800000000, min(1800000000, int(lon * 1e7) + rng.randint(-2500, 2500))), max(-900000000, min(900000000, int(lat * 1e7) + rng.randint(-1500, 1500)))))
    pts += [(1000 + i, 131000000, 521000000) for i in range(20)]  # all in one place
    odd = [(2000, None, 5), (2001, 5, None), (2002, 1800000001, 0), (2003, 0, -900000001), (2004, None, None)]
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and metres(a, b) <= 10}
    assert len(want) > 250
    df = spark.createDataFrame(pts + odd, POINT)
    for block in (4000, 5):
        got = [(r["left_id"], r["right_id"]) for r in spatial.near(df, 10.0, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spatial.near(df.limit(0), 10.0).count() == 0


def test_inside_against_plain_tests(spark):
    rng = random.Random(8)
    poly = "x\n1\n 10 50\n 11 50\n 11.5 50.5\n 11 51\n 10 51\n 10.4 50.5\n 10 50\nEND\n2\n 12 50\n 12.2 50\n 12.2 50.3\nEND\nEND\n"
    specs = {1: ("bbox", "49.9,9.9,50.5,10.7"), 2: ("disc", " 50.5 , 10.5, 0.4"), 3: ("poly", poly), 4: ("bbox", "-1,179,1,-179"), 5: ("disc", "89.9,0,0.5"), 6: ("poly", "y\n1\n179 -1\n181 -1\n181 1\n179 1\nEND\nEND\n"), 7: ("bbox", "60,-175,85,140")}
    pts = [(i, int(rng.uniform(9.5, 12.5) * 1e7), int(rng.uniform(49.5, 51.5) * 1e7)) for i in range(1500)]
    pts += [(2000 + i, rng.choice([-1, 1]) * int(rng.uniform(178, 180) * 1e7), int(rng.uniform(-2, 2) * 1e7)) for i in range(300)]
    pts += [(3000 + i, int(rng.uniform(-180, 180) * 1e7), int(rng.uniform(59, 90) * 1e7)) for i in range(300)] + [(3999, 0, 900000000)]
    regions = {i: Region.parse(s, k) for i, (k, s) in specs.items()}
    want = {(i, p[0]) for i, r in regions.items() for p in pts if r.contains(p[2] / 1e7, p[1] / 1e7)}
    assert {i for i, _ in want} == set(specs)
    rows = [(i, k.upper() if i == 1 else k, s) for i, (k, s) in specs.items()] + [(8, "bbox", None), (9, None, "1,1,1,1"), (10, "bbox", "a,b"), (11, "line", "1,2"), (1, "BBOX", specs[1][1]), (None, "bbox", "0,0,1,1")]
    df = spark.createDataFrame(rows, "region_id bigint, kind string, spec string")
    points = spark.createDataFrame(pts + [(5000, None, 1), (5001, 1, 900000001)], POINT)
    for cells in (30, 400):
        got = [(r["region_id"], r["id"]) for r in spatial.inside(points, df, cells).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spatial.inside(points, df.limit(0)).count() == 0 and spatial.inside(points.limit(0), df).count() == 0


def test_positions_are_those_of_current_rows(spark):
    loc = spark.createDataFrame([(1, 5, 5, 1), (1, 6, 6, 2), (2, 1, 1, 1), (3, None, None, 4), (3, 1, 1, 3)], "id bigint, lon_i int, lat_i int, version int")
    nodes = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "id bigint")
    assert {tuple(r) for r in spatial.tagged_positions(loc, nodes).collect()} == {(1, 6, 6), (3, None, None)}
