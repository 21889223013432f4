"""Most frequent items in bounded memory by a majority-vote sketch.

A sketch has DEPTH rows of WIDTH cells.  An item falls into one cell of each row; a cell stores the total that fell into
it, a candidate, and the candidate's vote surplus.  Cells merge by vote cancellation, in any order.  For every cell

* a candidate occurred at least ``surplus`` and at most ``(total + surplus) / 2`` times,
* any other item of the cell at most ``(total - surplus) / 2`` times.

Each input partition folds its rows into one sketch, so its memory and what it sends on are DEPTH * WIDTH cells, however
many rows and distinct items there are.  Items are 64-bit hashes within the sketch; a second pass over the input names the
few that the bounds leave in question and counts them exactly.  Its filter also keeps the items that every row's cell
leaves undecided, so no item over the threshold is missed, whatever the hashes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.scratch import Scratch
from terrafold.ship import ship

DEPTH, WIDTH = 4, 2048
_SCHEMA = "row int, cell int, total bigint, candidate bigint, surplus bigint"


def entries(tags: list[DataFrame]) -> DataFrame:
    """``k, v`` of every tag entry of tables with a ``tags`` column, repeats included; null lists and entries give none."""
    parts = [t.select(F.explode("tags").alias("t")).where("t is not null").select("t.k", "t.v") for t in tags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_hash(*cols: str) -> Column:
    """64-bit hash of an item; a null part differs from an empty one and from a shift of the others."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))])


def cell_of(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of a hash in a row: 16 bits of the hash for each row; width is a power of two up to 65536."""
    return ((h >> (16 * row)) & (width - 1)).astype(np.int64)


class Sketch:
    """The cells of one partition."""

    def __init__(self, depth: int = DEPTH, width: int = WIDTH):
        self.depth, self.width = depth, width
        self.total = np.zeros((depth, width), np.int64)
        self.candidate = np.zeros((depth, width), np.int64)
        self.surplus = np.zeros((depth, width), np.int64)

    def add(self, h: np.ndarray) -> None:
        """Fold a batch of hashes: each cell's batch is itself settled by majority vote, then merged."""
        if not len(h):
            return
        items, counts = np.unique(h, return_counts=True)
        for r in range(self.depth):
            cells = cell_of(items, r, self.width)
            order = np.lexsort((items, counts, cells))
            c, n, x = cells[order], counts[order], items[order]
            last = np.append(c[1:] != c[:-1], True)  # the most frequent item of each cell
            total = np.bincount(c, weights=n, minlength=self.width).astype(np.int64)
            at = c[last]
            self.merge(r, at, total[at], x[last], np.maximum(0, 2 * n[last] - total[at]))

    def merge(self, r: int, at: np.ndarray, total: np.ndarray, candidate: np.ndarray, surplus: np.ndarray) -> None:
        """Merge cells into row r; ``at`` has no repeats."""
        c0, s0 = self.candidate[r, at], self.surplus[r, at]
        same = c0 == candidate
        wins = ~same & (surplus > s0)
        self.total[r, at] += total
        self.candidate[r, at] = np.where(wins, candidate, c0)
        self.surplus[r, at] = np.where(same, s0 + surplus, np.abs(s0 - surplus))

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.total)
        cols = [r.astype(np.int32), c.astype(np.int32), self.total[r, c], self.candidate[r, c], self.surplus[r, c]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["row", "cell", "total", "candidate", "surplus"])


def sketch(hashes: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``row, cell, total, candidate, surplus`` over a one-column table of hashes, at most depth * width rows.

    The cells of several partitions are merged at once: the surpluses of each candidate are summed, and the strongest
    candidate's sum is set against all others'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketch(depth, width)
        for b in batches:
            s.add(b.column(0).to_numpy(zero_copy_only=False))
        yield s.rows()

    ship(hashes.sparkSession)
    parts = hashes.mapInArrow(run, _SCHEMA)
    votes = parts.groupBy("row", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("surplus"))
    best = votes.groupBy("row", "cell").agg(F.sum("total").alias("total"), F.sum("surplus").alias("votes"), F.max(F.struct("surplus", "candidate")).alias("b"))
    return best.select("row", "cell", "total", F.col("b.candidate").alias("candidate"), F.greatest(F.lit(0), 2 * F.col("b.surplus") - F.col("votes")).cast("long").alias("surplus"))


def sketched(cells: DataFrame) -> DataFrame:
    """``candidate, lower, upper``: the bounds of the count of every candidate, the closest that any row gives."""
    at = cells.groupBy("candidate").agg(F.max("surplus").alias("lower"), F.min(F.floor((F.col("total") + F.col("surplus")) / 2)).alias("upper"))
    return at.select("candidate", "lower", F.col("upper").cast("long").alias("upper"))


def _in_question(items: DataFrame, cells: DataFrame, least: Column, depth: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The bounds of candidates that may reach ``least``, and of the cells that may hide another such item.

    Either has at most depth * share rows, since the cells of a row share the items between them.
    """
    up = (F.col("total") + F.col("surplus")) / 2
    other = (F.col("total") - F.col("surplus")) / 2
    named = cells.where(up >= least).groupBy("candidate").agg(F.max("surplus").alias("lower"), F.min(up).alias("upper"))
    return named, cells.where(other >= least).select("row", "cell")


def frequent(items: DataFrame, cols: list[str], share: int, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``*cols, n, lower, upper``: the items that make up at least 1/share of all rows, with their exact count and the
    bounds that the sketch had for it (null lower and upper: no candidate, found among the undecided).

    Null parts are values of their own.  An empty table gives no rows.
    """
    keyed = items.select(*cols, item_hash(*cols).alias("h"))
    cells, _ = Scratch(items.sparkSession).save(sketch(keyed.select("h"), depth, width))
    rows = cells.where("row = 0").agg(F.sum("total").alias("t")).first()["t"] or 0
    least = F.lit(rows / share)
    named, unsure = _in_question(items, cells, least, depth, width)
    bounds = {r["candidate"]: (r["lower"], int(r["upper"])) for r in named.collect()}  # at most depth * share rows
    open_cells: list[list[int]] = [[] for _ in range(depth)]
    for r in unsure.collect():  # at most depth * share rows
        open_cells[r["row"]].append(r["cell"])
    kept = F.col("h").isin(list(bounds)) if bounds else F.lit(False)
    if all(open_cells):  # an item can hide only if its cell is open in every row
        hidden = F.lit(True)
        for r, c in enumerate(open_cells):
            hidden = hidden & _cell_column(r, width).isin(c)
        kept = kept | hidden
    exact = keyed.where(kept).groupBy(*cols, "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if not bounds:
        return exact.select(*cols, "n", F.lit(None).cast("long").alias("lower"), F.lit(None).cast("long").alias("upper"))
    known = F.create_map(*[F.lit(x) for h, (lo, hi) in bounds.items() for x in (h, f"{lo},{hi}")])
    pair = F.split(known[F.col("h")], ",")
    return exact.select(*cols, "n", pair[0].cast("long").alias("lower"), pair[1].cast("long").alias("upper"))


def _cell_column(row: int, width: int) -> Column:
    """:func:`cell_of` as a column."""
    return F.shiftright("h", 16 * row).bitwiseAND(F.lit(width - 1)).cast("int")


def top_k(items: DataFrame, cols: list[str], k: int, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """``*cols, n, lower, upper``: the k most frequent items with their exact count and the bounds that the sketch had for
    it (0 and the count itself: no candidate, found among the undecided).

    At least k items reach the k-th highest lower bound, so only what the bounds allow to reach it is counted, and cut to k
    after that; of equal counts the least item comes first.  With fewer than k sure candidates everything is counted.
    """
    keyed = items.select(*cols, item_hash(*cols).alias("h"))
    cells, _ = Scratch(items.sparkSession).save(sketch(keyed.select("h"), depth, width))
    best = [r["lower"] for r in sketched(cells).orderBy(F.desc("lower")).limit(k).collect()]
    least = F.lit(max(1, best[-1] if len(best) == k else 1))
    named, unsure = _in_question(items, cells, least, depth, width)
    bounds = named.select(F.col("candidate").alias("h"), "lower", F.floor("upper").cast("long").alias("upper"))
    kept = keyed.join(F.broadcast(bounds), "h", "left")  # at most depth * width rows
    hidden = F.col("lower").isNull()
    for r, open_cells in enumerate(_open_cells(unsure, depth)):  # at most depth * width cells
        hidden = hidden & _cell_column(r, width).isin(open_cells)
    exact = kept.where(F.col("lower").isNotNull() | hidden).groupBy(*cols, "h").agg(F.count(F.lit(1)).alias("n"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    top = exact.orderBy(F.desc("n"), *cols).limit(k)
    return top.select(*cols, "n", F.coalesce("lower", F.lit(0)).cast("long").alias("lower"), F.coalesce("upper", "n").cast("long").alias("upper"))


def _open_cells(unsure: DataFrame, depth: int) -> list[list[int]]:
    """The cells of each row that may hide an item."""
    out: list[list[int]] = [[] for _ in range(depth)]
    for r in unsure.collect():
        out[r["row"]].append(r["cell"])
    return out
