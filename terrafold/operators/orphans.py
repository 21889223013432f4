"""References to records that do not exist.

Parent keys, the elements that a feed names, and child keys are brought into one long table and grouped by the table and key
they point at; groups that lack a parent are orphan keys.  All states of the grouping are numbers of fixed size, so a key
that a third of all rows refer to costs one partial state per map task.

The report stays in the long form: child rows carry their month, counts are summed by key and month, and a key's months, of
which there are as many as the data span, are handed on if it proves an orphan.  Only the list of single references joins
orphan keys back to their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.changefeed import newest_first
from terrafold.scratch import Scratch

REF = ["ref_type", "ref_id"]
#: Orphan keys up to this number are broadcast to the references; their number is counted before.
BROADCAST_KEYS = 200_000
#: Of more keys, those with more references than this are broadcast, at most one for so many references there are.
HOT_REFS = 1_000_000


def references(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``source_type, source_id, at, ref_type, ref_id``: each distinct non-null ref of current rows.

    Null lists and null members give no rows; a null member type is a type of its own, which no table has.
    """
    w = ways.select(F.lit("way").alias("source_type"), F.col("id").alias("source_id"), F.col("meta.timestamp").alias("at"), F.explode(F.array_distinct("nodes")).alias("ref_id"))
    w = w.select("source_type", "source_id", "at", F.lit("node").alias("ref_type"), "ref_id")
    keys = F.array_distinct(F.transform("members", lambda m: F.struct(m["type"].alias("t"), m["ref"].alias("r"))))
    r = relations.select(F.lit("relation").alias("source_type"), F.col("id").alias("source_id"), F.col("meta.timestamp").alias("at"), F.explode(keys).alias("k"))
    r = r.select("source_type", "source_id", "at", F.col("k.t").alias("ref_type"), F.col("k.r").alias("ref_id"))
    return w.unionByName(r).where("ref_id is not null")


def reason(has_base: Column, alive: Column) -> Column:
    """missing, late, deleted, or null if the record exists."""
    return F.when(~has_base & ~alive, "missing").when(~has_base, "late").when(~alive, "deleted")


def _states(base: Column, cv: Column, gone: Column) -> Column:
    """The reason of a key with the highest base version, if any, and the version and kind of the change that counts."""
    wins = cv.isNotNull() & (base.isNull() | (cv > base))
    alive = F.when(wins, gone == 0).otherwise(base.isNotNull())
    return reason(base.isNotNull(), alive)


def _long(refs: DataFrame, base_keys: DataFrame, changes: DataFrame, by: list[Column]) -> DataFrame:
    """``ref_type, ref_id, base, cv, gone, child`` and the columns ``by`` of child rows, null on all others."""
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    names = refs.select(*by).dtypes
    blank = [none(c, t) for c, t in names]
    kids = refs.select(*REF, none("base", "long"), none("cv", "long"), none("gone", "int"), F.lit(1).cast("long").alias("child"), *by)
    base = base_keys.where("id is not null").select(F.col("type").alias("ref_type"), F.col("id").alias("ref_id"), F.coalesce("version", F.lit(-1)).cast("long").alias("base"), none("cv", "long"), none("gone", "int"), F.lit(0).cast("long").alias("child"), *blank)
    last = newest_first(changes, [], [])  # already one row a key, so that the grouping has numbers only
    after = last.select(F.col("type").alias("ref_type"), F.col("id").alias("ref_id"), none("base", "long"), F.col("version").alias("cv"), F.col("deleted").cast("int").alias("gone"), F.lit(0).cast("long").alias("child"), *blank)
    return kids.unionByName(base).unionByName(after)


def orphan_keys(refs: DataFrame, base_keys: DataFrame, changes: DataFrame) -> DataFrame:
    """``ref_type, ref_id, reason, refs`` of the keys that are referred to and don't exist.

    base_keys: ``type, id, version`` of all base rows; changes: a feed applied to them.
    """
    long = _long(refs, base_keys, changes, [])
    g = long.groupBy(*REF).agg(*[F.max(c).alias(c) for c in ("base", "cv", "gone")], F.sum("child").alias("refs")).where("refs > 0")
    return g.select(*REF, _states(F.col("base"), F.col("cv"), F.col("gone")).alias("reason"), "refs").where("reason is not null")


def orphan_refs(refs: DataFrame, keys: DataFrame, broadcast_keys: int = BROADCAST_KEYS, hot_refs: int = HOT_REFS) -> DataFrame:
    """The references to orphan keys with their reason.

    keys are written and counted first.  Few are broadcast.  Of many, the hot ones are broadcast and the rest joined by a
    shuffle, in which no key then has more than hot_refs rows.
    """
    keys, n = Scratch(refs.sparkSession).save(keys.select(F.col("ref_type").alias("kt"), F.col("ref_id").alias("kr"), "reason", F.col("refs").alias("kn")))
    same = F.col("ref_id").eqNullSafe(F.col("kr")) & F.col("ref_type").eqNullSafe(F.col("kt"))
    cols = [*refs.columns, "reason"]
    if n["n"] <= broadcast_keys:
        return refs.join(F.broadcast(keys), same).select(*cols)
    hot = refs.join(F.broadcast(keys.where(F.col("kn") > hot_refs)), same)
    return hot.select(*cols).unionByName(refs.join(keys.where(F.col("kn") <= hot_refs), same).select(*cols))


def orphan_report(refs: DataFrame, base_keys: DataFrame, changes: DataFrame) -> DataFrame:
    """``ref_type, reason, period, refs``: orphan references by referred table, reason and month of the referring row."""
    period = F.date_format(F.timestamp_seconds("at"), "yyyy-MM").alias("period")
    long = _long(refs, base_keys, changes, [period])
    months = long.groupBy(*REF, "period").agg(*[F.max(c).alias(c) for c in ("base", "cv", "gone")], F.sum("child").alias("child"))
    part = F.when(F.col("child") > 0, F.struct("period", F.col("child").alias("n")))
    g = months.groupBy(*REF).agg(*[F.max(c).alias(c) for c in ("base", "cv", "gone")], F.collect_list(part).alias("parts"))
    named = g.select("ref_type", _states(F.col("base"), F.col("cv"), F.col("gone")).alias("reason"), F.explode("parts").alias("p")).where("reason is not null")
    return named.groupBy("ref_type", "reason", F.col("p.period").alias("period")).agg(F.sum("p.n").alias("refs"))
