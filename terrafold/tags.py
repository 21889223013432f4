"""Tags as lists of (k, v), as maps, and as flat lists of alternating keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unique(tags: Column) -> Column:
    """One entry per key, in the order in which keys appear first, with the last value; a null key is dropped."""
    keys = F.array_distinct(F.filter(F.transform(tags, lambda t: t["k"]), lambda k: k.isNotNull()))
    last = lambda k: F.element_at(F.filter(tags, lambda t: t["k"] == k), -1)["v"]
    return F.transform(keys, lambda k: F.struct(k.alias("k"), last(k).alias("v")))


def to_map(tags: Column) -> Column:
    return F.map_from_entries(unique(tags))


def value(tags: Column, key: str) -> Column:
    """The last value of a key, null if it is absent."""
    found = F.filter(tags, lambda t: t["k"] == key)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["v"])


def has(tags: Column, key: str, val: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: (t["k"] == key) & (t["v"] == val)), F.lit(False))


def tagged(tags: Column) -> Column:
    return F.coalesce(F.size(tags), F.lit(0)) > 0


def flat(tags: Column) -> Column:
    """Alternating keys and values."""
    return F.flatten(F.transform(tags, lambda t: F.array(t["k"], t["v"])))


def from_flat(items: Column) -> Column:
    """The inverse of :func:`flat`; a last key without a value is dropped."""
    n = F.floor(F.size(items) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get(items, 2 * i - 2).alias("k"), F.get(items, 2 * i - 1).alias("v")))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<k:string,v:string>>"))


def text(tags: Column) -> Column:
    """``k=v|k=v`` of the unique tags, for display."""
    return F.array_join(F.transform(unique(tags), lambda t: F.concat(t["k"], F.lit("="), F.coalesce(t["v"], F.lit("")))), "|")
