"""Full history of changing attributes from periodic snapshots.

Each attribute has a change log of its own: the versions at which its value differs from the one before, with the interval
for which it holds.  The logs are put together by splitting time at the union of their boundaries and carrying each
attribute's value forward; neighbours that agree in all attributes are coalesced.  Boundaries are ordered by version and
dated by the version's timestamp, so a version whose clock stands still or runs backwards keeps its row.

All steps after the first aggregation use one partitioning, by element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ATTRIBUTES = ("version", "changeset", "uid", "user")
ELEMENT = ["type", "id"]


def seen_versions(snapshots: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """One row per element and version: its time, its attributes (the non-null value if some months hide it), and the
    last snapshot that has a row of it.  Rows without id, type or version are left out."""
    s = snapshots.select(*ELEMENT, "snap_id", F.col("meta.version").cast("long").alias("version"), F.col("meta.timestamp").alias("at"), *[F.col(f"meta.{a}").alias(a) for a in attributes if a != "version"])
    s = s.where("type is not null and id is not null and version is not null")
    return s.groupBy(*ELEMENT, "version").agg(F.max("at").alias("at"), *[F.max(a).alias(a) for a in attributes if a != "version"], F.max("snap_id").alias("last_snap"))


def attribute_log(seen: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """``type, id, attribute, value, version, at, until_version``: the change log of each attribute; value is text."""
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = seen.select(*ELEMENT, "version", "at", F.explode(entries).alias("e")).select(*ELEMENT, "version", "at", "e.attribute", "e.value")
    w = W.partitionBy(*ELEMENT, "attribute").orderBy("version")
    changed = long.withColumn("__before", F.lag(F.struct("value")).over(w)).where("__before is null or not (__before.value <=> value)").drop("__before")
    return changed.withColumn("until_version", F.lead("version").over(w))


def combine(log: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Split at the union of all boundaries, one row per element and interval, with every attribute's value in force.

    kinds: attribute -> its type.  Neighbours that agree in all attributes are one interval."""
    bound = log.groupBy(*ELEMENT, F.col("version").alias("__v")).agg(F.max("at").alias("at"), *[F.max(F.when(F.col("attribute") == a, F.struct("value"))).alias(a) for a in kinds])
    run = W.partitionBy(*ELEMENT).orderBy("__v")
    so_far = run.rowsBetween(W.unboundedPreceding, 0)
    filled = bound.select(*ELEMENT, "__v", "at", *[F.last(a, ignorenulls=True).over(so_far)["value"].alias(a) for a in kinds])
    same = F.lag(F.struct(*kinds)).over(run).eqNullSafe(F.struct(*kinds))
    kept = filled.withColumn("__same", same).where("not __same")
    values = [F.col(a).cast(kind).alias(a) for a, kind in kinds.items()]
    return kept.select(*ELEMENT, *values, F.col("at").alias("valid_from"), F.lead("at").over(run).alias("next_from"), F.lead("__v").over(run).isNull().alias("newest"))


def calendar(snapshots: DataFrame) -> DataFrame:
    """``snap_id, next_at``: when the next snapshot was taken, -1 after the last.  As many rows as there are snapshots."""
    days = snapshots.where("snap_id is not null").groupBy("snap_id").agg(F.min(F.unix_timestamp(F.col("snap_at").cast("timestamp"))).alias("at"))
    return days.select("snap_id", F.coalesce(F.lead("at").over(W.orderBy("snap_id")), F.lit(-1)).cast("long").alias("next_at"))


def history(snapshots: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """``type, id, version, changeset, uid, user, valid_from, valid_to`` (epoch seconds) of every version seen.

    valid_to is the start of the next higher version; of the highest it is -1 while the element is in the last snapshot,
    else the time of the first snapshot that lacks it.  A null time stays null.

    attributes: the fields of ``meta`` whose history is wanted.  Without ``version``, versions that agree in all of them
    are one row, valid from the first of them on.
    """
    seen = seen_versions(snapshots, attributes).repartition(*ELEMENT)
    kinds = {a: "long" if a == "version" else dict(seen.dtypes)[a] for a in attributes}
    spans = combine(attribute_log(seen, attributes), kinds)
    last = seen.groupBy(*ELEMENT).agg(F.max("last_snap").alias("snap_id"))
    ends = spans.join(last, ELEMENT).join(calendar(snapshots), "snap_id", "left")
    return ends.select(*ELEMENT, *attributes, "valid_from", F.when(F.col("newest"), F.coalesce("next_at", F.lit(-1))).otherwise(F.col("next_from")).cast("long").alias("valid_to"))
