"""Filling containers of a fixed token capacity with documents, balanced by cost.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n``, the second part standing for attention within it.
Documents go in descending order to the container of the lowest cost so far that still has room; as many containers are
open from the start as the tokens need at least, and one more is opened only when an item fits nowhere.  Costs are estimates
and are compared in steps of a STEPS-th of what a full container costs; of containers on the same step the one with the
tightest room takes the document.  The rule is the same for every document.  A document over the capacity, and only such a
one, is split: into full containers of its own and a rest that is packed like any other.

Packing is done in shards.  A shard holds so many documents that the last, part-filled containers are a negligible share
of all, and so few that one task packs it in memory.  A document's shard follows from its id, its size and its number among
rows that agree in both, so neither repeated rows nor equal lengths gather in one shard, and the containers' contents don't
depend on how the input is split.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.ship import ship

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Steps of cost between an empty and a full container.
STEPS = 8
#: Documents per shard, about.
SHARD_ROWS = 25_000
#: Copies of a row that one row stands for until they are told apart.
_COPIES = 10_000


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


class _Open:
    """Open containers by step of cost, on each step by room."""

    def __init__(self) -> None:
        self.steps: list[int] = []
        self.rooms: dict[int, list[tuple[int, int]]] = {}

    def put(self, step: int, room: int, box: int) -> None:
        if step not in self.rooms:
            self.rooms[step] = []
            bisect.insort(self.steps, step)
        bisect.insort(self.rooms[step], (room, box))

    def take(self, n: int) -> tuple[int, int] | None:
        """The container with room for n on the lowest step, there the tightest and then the oldest one."""
        for step in self.steps:
            here = self.rooms[step]
            at = bisect.bisect_left(here, (n, -1))
            if at < len(here):
                found = here.pop(at)
                if not here:
                    self.steps.remove(step)
                    del self.rooms[step]
                return found
        return None


def pack(sizes: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC, steps: int = STEPS) -> list[tuple[int, int, int, int]]:
    """``(item, container, start, length)`` of every piece, in the order in which they are placed; start is its offset
    within the item.

    Items are positions in ``sizes``.  Sizes of 0 take no room but still get a container.  Ties go to the smaller position
    and to the older container.
    """
    if capacity < 1:
        raise ValueError("a container needs a capacity of at least 1")
    out, made, rest = [], 0, []
    for i, n in enumerate(sizes):
        start = 0
        while n - start > capacity:
            out.append((i, made, start, capacity))
            made += 1
            start += capacity
        rest.append((n - start, i, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    unit = cost(capacity, linear, quadratic) / steps
    costs = [0.0] * -(-sum(n for n, _, _ in rest) // capacity)
    boxes = _Open()
    for c in range(len(costs)):
        boxes.put(0, capacity, c)
    for n, i, start in rest:
        found = boxes.take(n)
        if found is None:
            found = (capacity, len(costs))
            costs.append(0.0)
        room, c = found
        costs[c] += cost(n, linear, quadratic)
        boxes.put(int(costs[c] // unit), room - n, c)
        out.append((i, made + c, start, n))
    return out


def shards_for(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    return max(1, round(rows / shard_rows))


def dealt(sizes: DataFrame, shards: int) -> DataFrame:
    """``doc_id, n_tokens, shard`` of rows ``doc_id, n_tokens``, the same however they are split."""
    if shards == 1:
        return sizes.withColumn("shard", F.lit(0))
    copies = sizes.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("k"))
    some = copies.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {_COPIES}"))))
    last = F.least(F.lit(_COPIES), F.col("k") - F.col("block") * _COPIES).cast("int")
    each = some.withColumn("i", F.explode(F.sequence(F.lit(1), last)))
    return each.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens", "block", "i"), F.lit(shards)).cast("int").alias("shard"))


def pack_documents(sizes: DataFrame, capacities: DataFrame, rows: int, key: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pack_id, container_id, doc_id, start, n_tokens``: one row per piece of a document and capacity.

    sizes: ``doc_id, n_tokens``, a null size counts as 0; capacities: ``pack_id, capacity``, a short list that is known in
    advance (rows of the table are read to the driver); null or senseless capacities are left out.  rows: about how many
    documents there are; it sets the number of shards, each of which has a partition of the shuffle.  A container_id is
    unique within a pack_id.
    """
    packs = [(r["pack_id"], r["capacity"]) for r in capacities.where("pack_id is not null and capacity >= 1").select("pack_id", "capacity").distinct().orderBy("pack_id", "capacity").collect()]
    n = shards_for(rows, shard_rows)
    kind = dict(sizes.dtypes)[key]
    placed = dealt(sizes.select(F.col(key).cast("string").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens")), n).repartition(n, "shard")

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths, parts = pdf["n_tokens"].tolist(), []
        for pack_id, capacity in packs:
            item, box, start, length = zip(*pack(lengths, capacity))
            ids = pdf["doc_id"].take(list(item)).reset_index(drop=True)
            parts.append(pd.DataFrame({"pack_id": pack_id, "container_id": [int(keys[0]) << 32 | b for b in box], "doc_id": ids, "start": start, "n_tokens": length}))
        return pd.concat(parts)

    pack_kind = dict(capacities.dtypes)["pack_id"]
    ship(sizes.sparkSession)
    if not packs:
        placed = placed.where("false")
    out = placed.groupBy("shard").applyInPandas(run, f"pack_id {pack_kind}, container_id bigint, doc_id string, start int, n_tokens int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))  # as text on the way, since pandas would make floats of ids beside a null


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``pack_id, capacity, containers, tokens, fewest, unused_permille``: containers made, the fewest that could hold the
    tokens, and the unused share of all room."""
    boxes = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    g = boxes.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens")).join(capacities.select("pack_id", "capacity").distinct(), "pack_id")
    return g.select("pack_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), F.round(1000 - 1000 * F.col("tokens") / (F.col("containers") * F.col("capacity")), 3).alias("unused_permille"))
