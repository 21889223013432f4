"""Graphs that one task can hold: strongly connected groups and least distances.

Callers check the number of links against ``TASK_LINKS`` first and have another way beyond it, with the same result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.scratch import Scratch
from terrafold.ship import ship

#: Links that one task may hold; in plain Python about 200 bytes each.
TASK_LINKS = 1_000_000
#: Links times starts that one task walks before the starts are dealt to several.
TASK_STEPS = 20_000_000
_BATCH = 50_000


def strong(src: list[int], dst: list[int]) -> dict[int, int]:
    """Node -> least id of its strongly connected group, of groups of two or more."""
    out: dict[int, list[int]] = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    held: set[int] = set()
    stack: list[int] = []
    groups: dict[int, int] = {}
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        todo = [(root, iter(out[root]))]
        while todo:
            x, rest = todo[-1]
            for y in rest:
                if y not in order:
                    order[y] = low[y] = len(order)
                    stack.append(y)
                    held.add(y)
                    todo.append((y, iter(out.get(y, ()))))
                    break
                if y in held:
                    low[x] = min(low[x], order[y])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == order[x]:
                    part = []
                    while True:
                        y = stack.pop()
                        held.discard(y)
                        part.append(y)
                        if y == x:
                            break
                    if len(part) > 1:
                        least = min(part)
                        groups.update(dict.fromkeys(part, least))
    return groups


def groups_in_task(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``id, grp`` of the groups of distinct ``src, dst`` without loops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for b in batches:
            src += b.column(0).to_pylist()
            dst += b.column(1).to_pylist()
        g = strong(src, dst)
        yield pa.RecordBatch.from_arrays([pa.array(list(g), pa.int64()), pa.array(list(g.values()), pa.int64())], names=["id", "grp"])

    ship(scratch.spark)
    found, _ = scratch.save(edges.select("src", "dst").coalesce(1).mapInArrow(run, "id bigint, grp bigint"))
    return found


def walk(links: dict[int, list[tuple[int, int, int]]], seeds: list[int], closed: bool) -> dict[int, tuple[int, int, int]]:
    """Head -> (least distance from the seeds, parent of the last link, head before) of all heads that links lead to.

    The seeds themselves are left out unless ``closed`` and a way leads back to them.
    """
    best: dict[int, tuple[int, int, int]] = {}
    heap: list[tuple[int, int, int, int]] = []
    settled = set() if closed else set(seeds)
    for s in seeds:
        for child, w, via in links.get(s, ()):
            heapq.heappush(heap, (w, via, child, s))
    while heap:
        d, via, head, before = heapq.heappop(heap)
        if head in settled:
            continue
        settled.add(head)
        best[head] = (d, via, before)
        for child, w, v in links.get(head, ()):
            if child not in settled:
                heapq.heappush(heap, (d + w, v, child, head))
    return best


def spread_in_tasks(scratch: Scratch, seeds: DataFrame, bridges: DataFrame, n_links: int, trail: bool = False, closed: bool = False) -> DataFrame:
    """``top, head, d, via`` (and ``vias`` with ``trail``): the least distance from the seeds ``top, head`` of each top to
    the heads that ``head, via, child, w`` lead to.

    Each task holds all links, at most ``TASK_LINKS`` of them, and its share of the tops; what it puts out isn't held.
    """
    seeds, m = scratch.save(seeds)
    parts = max(1, min(256, n_links * m["n"] // TASK_STEPS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[int, list[tuple[int, int, int]]] = {}
        first: int | None = None
        starts: dict[int, list[int]] = {}
        for b in batches:
            for part, a, head, via, w in zip(*[c.to_pylist() for c in b.columns]):
                if w is None:
                    starts.setdefault(a, []).append(head)
                else:
                    first = part if first is None else first
                    if part == first:  # another part in this task brings the same links
                        links.setdefault(a, []).append((head, w, via))
        cols: list[list] = [[], [], [], [], []]

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            names = ["top", "head", "d", "via", "vias"]
            n = 5 if trail else 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names=names[:n])

        for top, own in starts.items():
            found = walk(links, own, closed)
            ways: dict[int, list[int]] = {}
            for head, (d, via, before) in found.items():  # in order of distance, so the head before has its way
                if trail:
                    ways[head] = [*ways.get(before, ()), via]
                for c, x in zip(cols, (top, head, d, via, ways.get(head))):
                    c.append(x)
                if len(cols[0]) >= _BATCH:
                    yield batch()
                    cols = [[], [], [], [], []]
        yield batch()

    k = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part") if parts > 1 else F.lit(0).alias("part")
    a = bridges.select(k, F.col("head").alias("a"), F.col("child").alias("head"), "via", F.col("w").cast("long").alias("w"))
    none = F.lit(None).cast("long")
    b = seeds.select(F.pmod(F.xxhash64("top"), F.lit(parts)).cast("int").alias("part"), F.col("top").alias("a"), "head", none.alias("via"), none.alias("w"))
    rows = a.unionByName(b)
    rows = rows.repartition(parts, "part") if parts > 1 else rows.coalesce(1)
    ship(scratch.spark)
    schema = "top bigint, head bigint, d bigint, via bigint" + (", vias array<bigint>" if trail else "")
    return scratch.save(rows.mapInArrow(run, schema))[0]
