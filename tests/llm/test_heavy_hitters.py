import random
from collections import Counter

import numpy as np
from conftest import TAGS

from terrafold.llm import heavy_hitters as hh


def test_cells_keep_their_bounds_in_any_order_of_batches():
    rng = np.random.default_rng(1)
    for seed in range(20):
        items = rng.zipf(1.3, 3000) % 400
        h = (items.astype(np.int64) * 0x1E3779B97F4A7C15) ^ (items.astype(np.int64) << 40)
        s, real = hh.Sketch(4, 32), Counter(h.tolist())
        for part in np.array_split(h, rng.integers(1, 30)):
            s.add(part)
        for r in range(4):
            for x, n in real.items():
                c = int(hh.cell_of(np.array([x]), r, 32)[0])
                t, cand, plus = s.total[r, c], s.candidate[r, c], s.surplus[r, c]
                if cand == x:
                    assert plus <= n <= (t + plus) / 2
                else:
                    assert n <= (t - plus) / 2
            assert s.total[r].sum() == len(h)


def rows(spark, entries, parts=5):
    return spark.createDataFrame(entries, "k string, v string").repartition(parts)


def test_frequent_against_a_count(spark):
    rng = random.Random(2)
    entries = [("hot", "x")] * 900 + [(None, "x")] * 60 + [("x", None)] * 55 + [("", "x")] * 50 + [(None, None)] * 45
    entries += [("k", str(int(rng.paretovariate(0.4)) % 5000)) for _ in range(3000)]
    real = Counter(entries)
    want = {e: n for e, n in real.items() if n * 100 >= len(entries)}
    df = rows(spark, entries)
    for width in (4, 16, 2048):  # with few cells nearly all of them stay undecided
        got = {(r["k"], r["v"]): r for r in hh.frequent(df, ["k", "v"], 100, width=width).collect()}
        assert {e: r["n"] for e, r in got.items()} == want
        assert all(r["lower"] is None or r["lower"] <= r["n"] <= r["upper"] for r in got.values())


def test_top_k(spark):
    entries = [(c, None) for c in "aaaaaaaabbbbbbcccc"] + [(f"r{i}", "") for i in range(40)]
    got = hh.top_k(rows(spark, entries), ["k", "v"], 3).collect()
    assert {(r["k"], r["lower"], r["upper"]) for r in got} == {("a", 8, 8), ("b", 6, 6), ("c", 4, 4)}


def test_top_k_against_a_count(spark):
    rng = random.Random(4)
    entries = [("k", str(int(rng.paretovariate(0.6)) % 3000)) for _ in range(6000)] + [(None, "x")] * 90 + [("x", None)] * 85
    real = Counter(entries)
    df = rows(spark, entries)
    want = sorted(real.items(), key=lambda e: (-e[1], e[0][0] or "", e[0][1] or ""))[:12]
    for width in (4, 32, 2048):  # with few cells surpluses cancel out
        got = hh.top_k(df, ["k", "v"], 12, width=width).collect()
        assert [((r["k"], r["v"]), r["n"]) for r in got] == want, width
        assert all(r["lower"] <= r["n"] <= r["upper"] for r in got)


def test_empty_and_null_tags(spark):
    t = spark.createDataFrame([(None,), ([],), ([None, ("a", "b")],)], f"tags {TAGS}")
    e = hh.entries([t, t])
    assert [tuple(r) for r in e.collect()] == [("a", "b")] * 2
    assert hh.frequent(e.limit(0), ["k", "v"], 100).count() == 0
    assert hh.top_k(e.limit(0), ["k", "v"], 5).count() == 0
