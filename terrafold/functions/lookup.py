"""Lookups by id that return plain Python values, for interactive use.

Each call runs a small Spark job over a published dataset, whose tables are sorted by key, so that it reads little; many
ids should be looked up by a join instead.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from terrafold.dataset import OsmDataset


def tag_dict(tag_list: list[str]) -> dict[str, str]:
    """A dictionary of a flat list of keys and values; of repeated keys the last counts."""
    return dict(zip(tag_list[::2], tag_list[1::2]))


class Environment:
    """A published dataset."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root


class Transaction:
    """One version of a dataset: what is published meanwhile isn't seen."""

    def __init__(self, env: Environment):
        self.db = OsmDataset.open(env.spark, env.root)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *exc) -> None:
        return None


class Table:
    name = ""

    def __init__(self, txn: Transaction):
        self.df = getattr(txn.db, self.name)

    def _row(self, ident: int | str) -> Row | None:
        return self.df.where(F.col("id") == int(ident)).first()

    def get(self, ident: int | str) -> Row | None:
        """The row, or None."""
        return self._row(ident)


class Locations(Table):
    name = "locations"

    def get(self, ident):
        """(lat, lon, version), or None for a node without a position."""
        r = self._row(ident)
        return None if r is None or r["lon_i"] is None or r["lat_i"] is None else (r["lat_i"] / 1e7, r["lon_i"] / 1e7, r["version"])


class Nodes(Table):
    name = "nodes"


class Ways(Table):
    name = "ways"


class Relations(Table):
    name = "relations"


class Index(Table):
    def get(self, ident):
        """The sorted ids that the index has for a key."""
        key, val = self.df.columns
        return sorted(r[0] for r in self.df.where(F.col(key) == int(ident)).select(val).distinct().collect())


class NodeWay(Index):
    name = "node_way"


class NodeRelation(Index):
    name = "node_relation"


class WayRelation(Index):
    name = "way_relation"


class RelationRelation(Index):
    name = "relation_relation"
