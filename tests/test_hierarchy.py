import random
from collections import defaultdict

import pytest

from terrafold.operators import hierarchy


def brute(links):
    """Groups, tops and least depths, by plain search."""
    links = {(a, b) for a, b in links if a is not None and b is not None}
    nodes = {x for e in links for x in e}
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    r = {x: reach(x) for x in nodes}
    grp = {x: min({x} | {y for y in r[x] if x in r[y]}) for x in nodes}
    entered = {grp[b] for a, b in links if grp[a] != grp[b]}
    res = set()
    for top in {grp[x] for x in nodes} - entered:
        d, front = {x: 0 for x in nodes if grp[x] == top}, [x for x in nodes if grp[x] == top]
        while front:
            front = [y for x in front for y in out[x] if y not in d and not d.update({y: d[x] + 1})]
        res |= {(x, top, k, x in r[x]) for x, k in d.items()}
    return res


def solve(spark, links, task_links=hierarchy.TASK_LINKS):
    df = spark.createDataFrame([(*e, "extra") for e in links], "parent bigint, child bigint, id string")
    h = hierarchy.resolve(spark, df, task_links)
    return h, {tuple(r) for r in h.membership().select("id", "top", "depth", "cyclic").collect()}


CASES = {
    "chain": [(i, i + 1) for i in range(1, 40)],
    "ring": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)],
    "loop": [(1, 1), (1, 2), (2, 2)],
    "only a loop": [(7, 7)],
    "ring entered by a chain": [(9, 1), (1, 2), (2, 3), (3, 1), (2, 8)],
    "two rings": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 5), (5, 9), (3, 9)],
    "diamond": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5), (1, 2)],
    "star": [(1, i) for i in range(2, 60)] + [(1, 2)],
    "nulls": [(None, 1), (1, None), (1, 2)],
    "ring through a tree": [(0, 1), (1, 2), (2, 3), (3, 4), (4, 1), (3, 5), (5, 6), (6, 6)],
    "rings side by side": [(1, 2), (2, 1), (1, 3), (3, 1), (3, 10), (20, 10), (10, 11)],
    "far ids": [(2**40, 5), (5, 2**41)],
}


def shifted():
    """All cases and some random graphs side by side, with ids apart."""
    out, base = [], 0
    rng = random.Random(0)
    random_links = [[(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(n)] for n in (40, 50, 60, 80, 120)]
    for links in [*CASES.values(), *random_links]:
        base += 2**42
        out += [tuple(None if x is None else x + base for x in e) for e in links]
    return out


@pytest.mark.parametrize("task_links", [hierarchy.TASK_LINKS, 0])
def test_against_plain_search(spark, task_links):
    """By one task and in rounds."""
    links = shifted()
    h, got = solve(spark, links, task_links)
    assert got == brute(links)

    edges = {e for e in links if None not in e}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    nodes = h.nodes.collect()
    at, number = {(r["chain"], r["pos"]): r["id"] for r in nodes}, {(r["head"], r["pre"]): r["id"] for r in nodes}
    below = defaultdict(list)
    for r in h.below().collect():
        below[r["id"]] += [number[r["head"], k] for k in range(r["from_pre"], r["to_pre"] + 1)]
    for x in {x for e in edges for x in e}:
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert sorted(below[x]) == sorted(seen), x
    least = {}
    for i, top, d, _ in got:
        least[i] = min(least.get(i, (d, top)), (d, top))
    tops = {i for i, _, d, _ in got if d == 0}
    paths = h.paths().collect()
    assert {(r["id"], r["top"], r["depth"]) for r in paths} == {(i, top, d) for i, (d, top) in least.items()}
    for r in paths:
        way = [at[s["chain"], k] for s in r["path"] for k in range(s["upto"] + 1)]
        assert way[-1] == r["id"] and way[0] in tops and len(way) == r["depth"] + 1 and all(e in edges for e in zip(way, way[1:]))


def test_every_descendant_comes_out_by_name(spark):
    links = shifted()
    edges = {e for e in links if None not in e}
    pairs, new = set(), edges
    while new - pairs:
        pairs |= new
        new = {(a, d) for a, b in pairs for c, d in edges if b == c}
    h, _ = solve(spark, links)
    got = [tuple(r) for r in h.descendants().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs


@pytest.mark.parametrize("task_links", [hierarchy.TASK_LINKS, 0])
def test_every_top_has_its_path(spark, task_links):
    links = shifted()
    edges = {e for e in links if None not in e}
    h, got = solve(spark, links, task_links)
    group = {r["id"]: r["grp"] for r in h.nodes.collect()}
    paths = h.spelled(h.paths(every=True)).collect()
    assert len(paths) == len(got) and {(r["id"], r["top"], r["depth"]) for r in paths} == {(i, top, d) for i, top, d, _ in got}
    for r in paths:
        way = r["ids"]
        assert group[way[0]] == r["top"] and way[-1] == r["id"] and len(way) == r["depth"] + 1 and all(e in edges for e in zip(way, way[1:]))


def test_heads_and_depths_come_from_the_chain_segments(spark):
    """Spoilt segments spoil the result, so nothing else leads to it."""
    real = hierarchy.chain_segments
    try:
        hierarchy.chain_segments = lambda scratch, tree: real(scratch, tree).selectExpr("id", "pre", "transform(segs, s -> struct(s.chain as chain, s.upto + 1 as upto)) as segs")
        got = solve(spark, CASES["chain"])[1]
    finally:
        hierarchy.chain_segments = real
    assert got == {(i, t, d + 1, c) for i, t, d, c in brute(CASES["chain"])}


def ladder(n):
    """Each node under the two before it."""
    return [(i - k, i) for i in range(1, n) for k in (1, 2) if i >= k]


def test_rounds_do_not_follow_the_depth(spark, monkeypatch):
    made = {}
    for n in (32, 1024):
        h, got = solve(spark, ladder(n))
        assert got == {(i, 0, (i + 1) // 2, False) for i in range(n)}
        assert h.paths().where(f"id = {n - 1}").first()["depth"] == n // 2
        made[n] = h.scratch.made
    assert made[1024] - made[32] <= 3
    for n in (32, 1024):
        h, _ = solve(spark, [(i, i + 1) for i in range(n)])
        made[n] = h.scratch.made
    assert made[1024] - made[32] <= 12  # two passes of doubling, five times the logarithm


def test_a_spine_has_one_interval_for_each_node(spark):
    n = 200
    h, _ = solve(spark, [(i, i + 1) for i in range(n)] + [(i, 1000 + i) for i in range(n)])
    rows = h.intervals().collect()
    assert len(rows) == n and {r["id"]: r["to_pre"] - r["from_pre"] + 1 for r in rows} == {i: 2 * (n - i) for i in range(n)}
    assert h.below().count() == n


def test_many_children_are_numbered_in_buckets(spark):
    rows = [(1, None, 301)] + [(i, 1, 3 if i % 50 == 0 else 1) for i in range(2, 290)]
    tree = spark.createDataFrame(rows, "id bigint, parent bigint, size bigint")
    for siblings in (7, 1000):
        got = sorted((r["off"], r["size"], r["id"], r["heavy"]) for r in hierarchy.sibling_offsets(tree, siblings).where("parent is not null").collect())
        at = 1
        for off, size, ident, heavy in got:  # no gaps and no overlaps
            assert off == at and heavy == (ident == 50)
            at += size


def test_no_links(spark):
    h = hierarchy.resolve(spark, spark.createDataFrame([], "parent bigint, child bigint"))
    assert h.membership().count() == 0 and h.paths().count() == 0 and h.intervals().count() == 0 and h.below().count() == 0


def test_paths_and_intervals_of_a_random_tree(spark):
    rng = random.Random(5)
    parent = {i: rng.choice([j for j in range(1, i)][-6:]) for i in range(2, 120)}
    h, _ = solve(spark, [(p, c) for c, p in parent.items()])
    nodes = {r["id"]: r for r in h.nodes.collect()}
    at = {(r["chain"], r["pos"]): i for i, r in nodes.items()}
    below = defaultdict(set)
    for i in nodes:
        x = i
        while x in parent:
            x = parent[x]
            below[x].add(i)
    assert {i: r["size"] - 1 for i, r in nodes.items()} == {i: len(below[i]) for i in nodes}
    for r in h.paths().collect():
        way = [at[s["chain"], k] for s in r["path"] for k in range(s["upto"] + 1)]
        real, x = [r["id"]], r["id"]
        while x in parent:
            x = parent[x]
            real.insert(0, x)
        assert way == real and r["depth"] == len(real) - 1 and r["top"] == 1
        assert len(r["path"]) <= 7
    number = {(r["head"], r["pre"]): i for i, r in nodes.items()}
    got = {r["id"]: {number[r["head"], k] for k in range(r["from_pre"], r["to_pre"] + 1)} for r in h.intervals().collect()}
    assert got == {i: v for i, v in below.items() if v}


def test_members_of_other_types_and_missing_ones_make_no_links(spark):
    from conftest import MEMBERS

    rows = [(1, [(2, "relation", None), (3, "way", "x"), (9, "relation", ""), (2, "relation", "again"), (None, "relation", None), (2, None, None)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"id bigint, members {MEMBERS}")
    assert [tuple(r) for r in hierarchy.member_links(df).collect()] == [(1, 2)]


def test_closure_by_walks_and_by_squaring(spark):
    from terrafold.operators.closure import transitive

    rng = random.Random(11)
    links = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(45)] + [(None, 1), (1, None), (99, 99)]
    df = spark.createDataFrame(links, "x bigint, y bigint")
    pairs, new = set(), {e for e in links if None not in e}
    while new - pairs:
        pairs |= new
        new = {(a, d) for a, b in pairs for c, d in pairs if b == c}
    for most in (0, 1000):
        got = [tuple(r) for r in transitive(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
    assert transitive(df.limit(0)).count() == 0
