"""Change feeds, orphans, history and skewed keys against plain Python."""

import random

from conftest import MEMBERS, META, TAGS, meta
from pyspark.sql import functions as F

from terrafold import tables as T
from terrafold.operators import changefeed, history, orphans, skew

CHANGE = f"seq bigint, pos bigint, action string, type string, id bigint, version int, lon_i int, lat_i int, nodes array<bigint>, members {MEMBERS}, tags {TAGS}, meta {META}"


def change(seq, action, kind, ident, version, stamp=0, nodes=None, members=None, lon=None, lat=None, tags=None, m=True):
    return (seq, 0, action, kind, ident, version, lon, lat, nodes, members, tags, meta(version, stamp) if m else None)


def feed(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def test_current_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "b", 3), (1, "c", 2), (2, None, None), (None, "x", 9)], "id bigint, v string, version int")
    assert {tuple(r) for r in T.current(df, "version").select("id", "v").collect()} == {(1, "b"), (2, None)}


def test_feed_order_and_tombstones(spark):
    rows = [
        change(1, "create", "way", 1, 1, 10, [1]),
        change(9, " Delete ", "way", 1, 2, 20),  # arrives after version 3, counts for less
        change(2, "modify", "way", 1, 3, 30, [3]),
        change(3, "modify", "way", 2, 4, 50, [4]),
        change(3, "DELETE", "way", 2, 4, 60),  # same version, later
        change(1, "modify", "way", 3, 2, 10, [5]),  # older than the base
        change(1, "delete", "way", 4, 3, 10),  # as old as the base
        change(1, "delete", "way", 5, 9, 10),
        change(1, None, "way", 6, 1, 10, [6]),
        change(1, "delete", "way", 99, 1, 10),  # unknown
        change(1, "create", "way", 7, 5, m=False, nodes=None),
        change(1, "modify", "node", 1, 9, 10, lon=5, lat=6),
        change(1, "modify", "way", None, 9, 10),
    ]
    base = spark.createDataFrame([(1, [0], 1), (3, [0], 3), (3, [9], 1), (4, [0], 3), (5, [0], 8), (8, [8], 1), (8, [8], 1)], "id bigint, nodes array<bigint>, version int")
    want = {(1, 3, (3,), "change"), (3, 3, (0,), "base"), (4, 3, (0,), "base"), (6, 1, (6,), "change"), (7, 5, None, "change"), (8, 1, (8,), "base")}
    for bands in (1, 2, 5):
        got = changefeed.apply_changes(base, feed(spark, rows), "way", ["nodes"], bands=bands)
        assert {(r["id"], r["version"], r["nodes"] and tuple(r["nodes"]), r["source"]) for r in got.collect()} == want
    assert changefeed.apply_changes(base.limit(0), feed(spark, []), "way", ["nodes"]).count() == 0
    assert changefeed.apply_changes(base, feed(spark, []), "way", ["nodes"]).count() == 5


def test_whole_state_of_nodes(spark):
    tags = lambda v: [("k", v)]
    at = spark.createDataFrame([(1, 10, 1, 2), (1, 99, 1, 1), (2, 20, 2, 5), (3, 30, 3, 1), (4, 40, 4, 1), (5, 50, 5, None)], "id bigint, lon_i int, lat_i int, version int")
    tagged = [(1, tags("old"), meta(1)), (1, tags("a"), meta(2)), (2, tags("b"), meta(5)), (4, tags("d"), meta(1)), (7, tags("g"), meta(3)), (8, tags("h"), meta(3)), (9, tags("i"), meta(3)), (10, tags("j"), None)]
    nodes = spark.createDataFrame(tagged, f"id bigint, tags {TAGS}, meta {META}")
    rows = [
        change(9, "modify", "node", 1, 3, 10, lon=11, lat=1, tags=tags("new")),
        change(10, "modify", "node", 1, 1, 20, lon=12, lat=1, tags=tags("late")),
        change(1, "modify", "node", 2, 5, 30, lon=21, lat=2),  # as old as the base
        change(1, "delete", "node", 4, 2, 30),
        change(1, "delete", "node", 8, 1, 30),
        change(1, "create", "node", 9, None, 30, lon=91, lat=9, m=False),
        change(1, "create", "node", 11, 1, 30, lon=13, lat=9, tags=tags("k"), m=False),
    ]
    want = {(1, 3, 11, "new", 3, "change"), (2, 5, 20, "b", 5, "base"), (3, 1, 30, None, None, "base"), (5, None, 50, None, None, "base"), (7, 3, None, "g", 3, "base")}
    want |= {(9, -1, 91, None, None, "change"), (10, None, None, "j", None, "base"), (11, 1, 13, "k", None, "change")}
    for bands in (1, 3):
        got = changefeed.node_states(at, nodes, feed(spark, rows), bands).collect()
        assert {(r["id"], r["version"], r["lon_i"], r["tags"] and r["tags"][0]["v"], r["meta"] and r["meta"]["version"], r["source"]) for r in got} == want and len(got) == len(want)


def test_random_feeds_do_not_depend_on_order_or_bands(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        ident = 1 if i % 3 == 0 else rng.randint(1, 60)  # one hot key
        rows.append(change(i, rng.choice(["modify", "delete", "create "]), "node", ident, rng.randint(1, 12), rng.choice([None, rng.randint(1, 5)]), lon=rng.randint(0, 9), lat=0))
    rows += rows[:50]
    best = {}
    for r in rows:
        key = (r[5], -1 if r[11][1] is None else r[11][1], r[2].strip() == "delete", r[6])
        best[r[4]] = max(best.get(r[4], (-9,)), key)
    base = spark.createDataFrame([(i, 7, 0, i % 10) for i in range(1, 80)], "id bigint, lon_i int, lat_i int, version int")
    want = set()
    for i in range(1, 80):
        b = best.get(i)
        if b is None or b[0] <= i % 10:
            want.add((i, i % 10, 7))
        elif not b[2]:
            want.add((i, b[0], b[3]))
    for bands in (1, 4):
        rng.shuffle(rows)
        got = changefeed.apply_changes(base, feed(spark, rows), "node", ["lon_i", "lat_i"], bands=bands)
        assert {(r["id"], r["version"], r["lon_i"]) for r in got.collect()} == want


def test_orphans(spark):
    ways = spark.createDataFrame([(1, [1, 2, 2, None, 7], None, meta(1, 0)), (2, None, [], meta(1, None)), (3, [], [], None)], f"id bigint, nodes array<bigint>, tags {TAGS}, meta {META}")
    rels = spark.createDataFrame([(5, [(1, "way", ""), (1, "way", "again"), (8, "way", None), (1, None, ""), (4, "area", ""), (None, "node", "")], None, meta(1, 2678400))], f"id bigint, members {MEMBERS}, tags {TAGS}, meta {META}")
    keys = spark.createDataFrame([("node", 1, 5), ("node", 7, None), ("way", 1, 1), ("way", 1, 3), ("way", None, 1)], "type string, id bigint, version int")
    after = feed(spark, [change(1, "create", "node", 2, 1), change(1, "delete", "node", 7, 1), change(1, "delete", "way", 8, 1), change(1, "delete", "way", 99, 1), change(1, "delete", "node", 1, 5), change(1, "delete", "way", 1, 2), change(1, "create", None, 1, 9)])
    refs = orphans.references(ways, rels)
    found = orphans.orphan_refs(refs, orphans.orphan_keys(refs, keys, after))
    got = {tuple(r) for r in found.select("source_type", "source_id", "ref_type", "ref_id", "reason").collect()}
    for hot in (0, 1):  # too many keys to broadcast: the hot ones are, the rest is shuffled
        again = orphans.orphan_refs(refs, orphans.orphan_keys(refs, keys, after), broadcast_keys=0, hot_refs=hot)
        assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))
    assert got == {("way", 1, "node", 2, "late"), ("way", 1, "node", 7, "deleted"), ("relation", 5, "way", 8, "missing"), ("relation", 5, None, 1, "missing"), ("relation", 5, "area", 4, "missing")}
    report = {tuple(r) for r in orphans.orphan_report(refs, keys, after).collect()}
    assert ("node", "late", "1970-01", 1) in report and ("way", "missing", "1970-02", 1) in report
    assert orphans.orphan_keys(refs.limit(0), keys, after).count() == 0


def test_history(spark):
    day = 86400
    rows = [
        (1, 1, "way", 1, meta(1, 100, 11, None, None)),
        (2, 2, "way", 1, meta(1, 100, 11, 5, "a")),  # hidden fields come out from another month
        (2, 2, "way", 1, meta(1, 100, 11, 5, "a")),
        (3, 3, "way", 1, meta(4, 90, 12, 5, "a")),  # the clock ran backwards
        (3, 3, "way", 1, meta(3, 100, 12, 5, "a")),  # outdated row
        (1, 1, "node", 1, meta(2, 50)),
        (2, 2, "node", 1, meta(2, 50)),  # vanishes after the second
        (3, 3, "node", 2, meta(1, None)),
        (3, 3, "node", 3, None),
        (3, 3, None, 3, meta(1)),
    ]
    df = spark.createDataFrame([(i, d, t, k, m) for i, d, t, k, m in rows], f"snap_id int, d int, type string, id bigint, meta {META}")
    df = df.withColumn("snap_at", F.timestamp_seconds(F.col("d") * day))
    got = {tuple(r) for r in history.history(df).select("type", "id", "version", "valid_from", "valid_to", "user").collect()}
    assert got == {("way", 1, 1, 100, 100, "a"), ("way", 1, 3, 100, 90, "a"), ("way", 1, 4, 90, -1, "a"), ("node", 1, 2, 50, 3 * day, "u"), ("node", 2, 1, None, -1, "u")}
    log = history.attribute_log(history.seen_versions(df)).where("type = 'way' and attribute = 'changeset'")
    assert {(r["value"], r["version"], r["until_version"]) for r in log.collect()} == {("11", 1, 3), ("12", 3, None)}
    assert history.history(df.limit(0)).count() == 0
    # without the version, rows that differ in nothing else are one
    got = {tuple(r) for r in history.history(df, ("uid", "user")).where("type = 'way'").collect()}
    assert got == {("way", 1, 5, "a", 100, -1)}
    got = {tuple(r) for r in history.history(df, ("changeset",)).where("type = 'way'").collect()}
    assert got == {("way", 1, 11, 100, 100), ("way", 1, 12, 100, -1)}


def test_tree_aggregation(spark):
    rng = random.Random(2)
    pairs = [(7 if rng.random() < 0.4 else rng.randint(1, 300), rng.randint(1, 2000)) for _ in range(6000)] + [(None, 1)] * 3 + [(9, None)]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "cell bigint, node_id bigint, n string").repartition(6)
    want = {}
    for a, b in set(pairs):
        if a is not None:
            want.setdefault(a, []).append(b)
    for rows, chunk, fan in ((6000, 100, 2), (6000, 10, 8), (6000, 10, 512), (1, 1000, 32)):
        got = skew.key_sizes(df, "cell", "node_id", rows, chunk, fan)
        assert {r["cell"]: (r["n"], r["low"], r["high"]) for r in got.collect()} == {k: (len(v), min(x for x in v if x is not None), max(x for x in v if x is not None)) for k, v in want.items()}
    assert skew.rounds_for(179_879) == 2  # the index at sf0.1
    total = sum(len(v) for v in want.values())
    assert {r["cell"] for r in skew.heavy_keys(got, "cell", 100).collect()} == {k for k, v in want.items() if len(v) * 100 >= total}
    empty = skew.key_sizes(df.limit(0), "cell", "node_id", 0)
    assert empty.count() == 0 and skew.heavy_keys(empty, "cell", 100).count() == 0
    assert [skew.rounds_for(n, 10, 4) for n in (0, 40, 41, 161)] == [1, 1, 2, 3]


def test_bands_follow_the_number_of_changes(spark):
    rows = [change(i, "modify", "node", i, i % 90) for i in range(900)]
    assert [changefeed.bands_for(n) for n in (0, 10_000, 10_001, 10**9)] == [1, 1, 2, changefeed.MAX_BANDS]
    assert changefeed.band_cuts(feed(spark, rows)) == [] and len(changefeed.band_cuts(feed(spark, rows), 3)) == 2
    state = [changefeed.named_state(feed(spark, rows), *[spark.createDataFrame([(5, meta(99))], f"id bigint, meta {META}").selectExpr("id", "meta", "meta.version as version")] * 3, bands=b) for b in (1, 4)]
    got = [sorted(map(tuple, s.collect())) for s in state]
    assert got[0] == got[1] and ("node", 5, 99, "base") in got[0] and len(got[0]) == 900
