import random
from collections import defaultdict

import pytest

from terrafold.llm import packing


def check(sizes, capacity):
    pieces = packing.pack(sizes, capacity)
    used, parts = defaultdict(int), defaultdict(list)
    for i, box, start, n in pieces:
        used[box] += n
        parts[i].append((start, n))
    assert all(v <= capacity for v in used.values())
    for i, n in enumerate(sizes):
        assert len(parts[i]) == max(1, -(-n // capacity))  # split only as far as it must be
        at = 0
        for start, k in sorted(parts[i]):
            assert start == at
            at += k
        assert at == n
    return len(used)


def test_random_sizes():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.randint(1, 50)
        check([rng.choice([0, 1, rng.randint(0, cap), rng.randint(0, 4 * cap), cap]) for _ in range(rng.randint(0, 80))], cap)


def test_little_is_left_unused():
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(5.5, 1.2)) for _ in range(8000)]
    for cap in (512, 2048, 8192):
        assert check(sizes, cap) <= -(-sum(sizes) // cap) * 1.005 + 1


def test_every_item_goes_to_the_lowest_cost_that_has_room():
    rng = random.Random(3)
    for cap in (60, 512, 2048):
        sizes = [min(cap, int(rng.lognormvariate(4, 1.2))) for _ in range(1500)]
        unit = packing.cost(cap) / packing.STEPS
        room, costs = defaultdict(lambda: cap), defaultdict(float)
        fewest = -(-sum(sizes) // cap)
        last = cap
        for i, box, _, n in packing.pack(sizes, cap):
            assert n == sizes[i] <= last  # in descending order, all by one rule
            last = n
            known = {*range(fewest), *room, box}
            fit = {(int(costs[c] // unit), room[c], c) for c in known if room[c] >= n and (c < fewest or c in costs)}
            if box in costs or box < fewest:
                assert (int(costs[box] // unit), room[box], box) == min(fit)
            else:
                assert not [f for f in fit if f[2] != box]  # opened as nothing else had room
            room[box] -= n
            costs[box] += packing.cost(n)


def test_costs_are_balanced():
    sizes = [100] * 40 + [10] * 400
    cost = defaultdict(float)
    for i, box, _, n in packing.pack(sizes, 400):
        cost[box] += packing.cost(n)
    assert max(cost.values()) < 1.05 * min(cost.values())


def test_contents_do_not_depend_on_the_split(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 300)) for i in range(400)] + [(5, 50)] * 300
    caps = spark.createDataFrame([(1, 256)], "pack_id int, capacity int")
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    got = [sorted(map(tuple, packing.pack_documents(df.repartition(k), caps, 700, shard_rows=100).collect())) for k in (1, 5)]
    assert got[0] == got[1] and len({r[1] >> 32 for r in got[0]}) > 4
    shard = defaultdict(int)
    for r in got[0]:
        shard[r[1] >> 32] += r[2] == 5
    assert max(shard.values()) < 100  # copies of one row are spread


def test_edges():
    assert packing.pack([], 5) == []
    assert packing.pack([0, 0], 5) == [(0, 0, 0, 0), (1, 0, 0, 0)]
    assert sorted(packing.pack([12], 5)) == [(0, 0, 0, 5), (0, 1, 5, 5), (0, 2, 10, 2)]
    assert packing.pack([5, 5], 5) == [(0, 0, 0, 5), (1, 1, 0, 5)]
    with pytest.raises(ValueError):
        packing.pack([1], 0)


def test_tables(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 900), "x") for i in range(500)] + [(7, 900, "x")] * 3 + [(None, 40, "x"), (2**60 + 1, None, "x")]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, pack_id string").repartition(3)
    caps = spark.createDataFrame([(1, 256), (2, 1000), (2, 1000), (3, 0), (None, 5), (4, None)], "pack_id int, capacity int")
    got = packing.pack_documents(sizes, caps, 500, shard_rows=120)
    data = got.collect()
    assert {r["pack_id"] for r in data} == {1, 2}
    for p, cap in ((1, 256), (2, 1000)):
        own = [r for r in data if r["pack_id"] == p]
        used, docs = defaultdict(int), defaultdict(int)
        for r in own:
            used[r["container_id"]] += r["n_tokens"]
            docs[r["doc_id"]] += r["n_tokens"]
        want = defaultdict(int)
        for i, n, _ in rows:
            want[i] += n or 0
        assert max(used.values()) <= cap and docs == want
    report = {r["pack_id"]: r for r in packing.fill_report(got, caps.where("capacity > 0")).collect()}
    assert report[1]["tokens"] == sum(n or 0 for _, n, _ in rows) and report[1]["containers"] >= report[1]["fewest"]
    assert packing.pack_documents(sizes.limit(0), caps, 0).count() == 0
    assert packing.pack_documents(sizes, caps.limit(0), 500).count() == 0
