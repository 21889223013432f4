"""Transitive closure of a link table: by one task's walk if it can hold the links, else by squaring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.onetask import TASK_LINKS, spread_in_tasks
from terrafold.scratch import Scratch


def transitive(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``a, b``: all pairs with a way of one or more links from a to b.  links: two columns, from and to.

    Up to task_links links are walked from each start, by tasks that hold all links and share the starts.  Beyond it, round k
    knows all ways of up to 2**k links and joins them with one another; it ends when nothing new comes out, cycles included.
    """
    scratch = Scratch(links.sparkSession)
    a, b = links.columns
    ways, m = scratch.save(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    if m["n"] <= task_links:
        if not m["n"]:
            return ways
        steps = ways.select(F.col("a").alias("head"), F.col("a").alias("via"), F.col("b").alias("child"), F.lit(1).cast("long").alias("w"))
        starts = ways.select(F.col("a").alias("top"), F.col("a").alias("head")).distinct()
        return spread_in_tasks(scratch, starts, steps, m["n"], closed=True).select(F.col("top").alias("a"), F.col("head").alias("b"))
    n = 0
    while m["n"] > n:
        n = m["n"]
        longer = ways.join(ways.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        new, m = scratch.save(ways.union(longer).distinct())
        scratch.discard(ways)
        ways = new
    return ways
