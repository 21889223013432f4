"""Per-key results when a few keys hold most records.

A plain aggregation ends in one reducer per key, which receives one partial state from every map task - for a key that
holds a third of 100 TB that reducer is the whole job.  Here states climb a tree: rows are dealt to chunks of about a fixed
number of rows, each chunk is combined into one state a key, and each round merges at most ``fan_in`` chunks of a key, so
that no task ever receives more than ``fan_in`` states of one key, whatever the key's share.

Only keys with more states than that climb.  All others, nearly all keys where few hold most rows, are merged at once.

A row's chunk follows from its own columns, not from its place, so a task that runs again after an executor was lost deals
its rows as before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.scratch import Scratch

#: Rows that are combined locally into one state per key.
CHUNK_ROWS = 4096
#: States of a key that one task merges in a round.
FAN_IN = 32

Merge = Callable[[str], Column]
SUM: Merge = F.sum
MIN: Merge = F.min
MAX: Merge = F.max


def rounds_for(rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> int:
    """Rounds until one state per key is left: the logarithm of the number of chunks to the base ``fan_in``."""
    chunks, rounds = max(1, -(-rows // chunk_rows)), 1
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def tree_aggregate(df: DataFrame, keys: list[str], states: dict[str, tuple[Column, Merge]], rows: int, deal: list[str], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key with the merged states.

    states: name -> (state of one chunk as an aggregate over its rows, merge of several states), e.g.
    ``{"n": (F.count("id"), SUM)}``; both must be independent of order.  rows: about how many rows df has; it sets the
    number of chunks and with it the height of the tree.  deal: the columns that tell the rows of a key apart and deal them
    to chunks; rows that agree in them share a chunk.  A null key is a key like any other; an empty table gives no rows.
    """
    rounds = rounds_for(rows, chunk_rows, fan_in)
    chunks = max(1, -(-rows // chunk_rows))
    level = df.withColumn("__leaf", F.pmod(F.xxhash64(*deal), F.lit(chunks)))
    level = level.groupBy(*keys, "__leaf").agg(*[first.alias(name) for name, (first, _) in states.items()])
    merged = [merge(name).alias(name) for name, (_, merge) in states.items()]
    if rounds == 1:
        return level.groupBy(*keys).agg(*merged)
    leaves, _ = Scratch(df.sparkSession).save(level)
    # a wide key has over fan_in of the leaves, so there are at most chunks * (distinct keys of a chunk) / fan_in of them
    wide, n = Scratch(df.sparkSession).save(leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > fan_in).select(*[F.col(k).alias(f"__w_{k}") for k in keys]))
    if not n["n"]:
        return leaves.groupBy(*keys).agg(*merged)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__w_{k}"))
    level = leaves.join(wide, same, "left_semi")
    for r in range(1, rounds + 1):
        up = [] if r == rounds else [F.expr(f"__leaf div {fan_in}").alias("__leaf")]
        level = level.groupBy(*keys, *up).agg(*merged)
    return leaves.join(wide, same, "left_anti").groupBy(*keys).agg(*merged).unionByName(level)


def distinct_pairs(df: DataFrame, key: str, member: str) -> DataFrame:
    """The distinct (key, member) pairs with a non-null key; both columns take part in the hash, so a hot key is spread."""
    return df.select(key, member).where(F.col(key).isNotNull()).distinct()


def key_sizes(df: DataFrame, key: str, member: str, rows: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``key, n, low, high``: distinct members of each key, the least and the greatest of them."""
    states = {"n": (F.count(F.lit(1)), SUM), "low": (F.min(member), MIN), "high": (F.max(member), MAX)}
    return tree_aggregate(distinct_pairs(df, key, member), [key], states, rows, [member], chunk_rows, fan_in)


def heavy_keys(sizes: DataFrame, key: str, share: int) -> DataFrame:
    """The keys with at least 1/share of all that ``sizes`` counts; sizes is worked out once, its total in the same pass."""
    sizes, m = Scratch(sizes.sparkSession).save(sizes.select(key, "n"), total=F.sum("n"))
    return sizes.where(F.col("n") * share >= m["total"]).select(key)
