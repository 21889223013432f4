"""Applying inserts, updates and deletes that arrive late, repeatedly and out of order.

Newest first: the changes are cut into bands of their version, which the version order makes independent of the order of
arrival.  The newest band is resolved first and its keys are written down; from each older band only keys that are not yet
resolved remain, and join them.  Each key thus gets exactly one image or tombstone, the first that is seen going backwards,
and at the end the base rows that no change replaces are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.scratch import Scratch
from terrafold.tables import ELEMENTS, current

#: Changes that make a band, and the most bands that are made; beyond it they are larger, each a job over all executors.
BAND_ROWS, MAX_BANDS = 10_000, 4
KEY = ["type", "id"]
#: The version of tagged nodes without a position, which any change replaces, even one without a version.
NOWHERE = -2


def deletes(action: Column) -> Column:
    """Whether an action deletes; case and outer blanks mean nothing, and a null action is no delete."""
    return F.coalesce(F.lower(F.trim(action)) == "delete", F.lit(False))


def bands_for(rows: int) -> int:
    return max(1, min(MAX_BANDS, -(-rows // BAND_ROWS)))


def band_cuts(changes: DataFrame, bands: int | None = None) -> list[int]:
    """Descending versions at which the bands begin; the last band has all that is left.  Any cuts give the same result.
    bands: how many, by default as the number of changes asks for."""
    shares = [i / 100 for i in range(1, 100)]
    got = changes.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("version", shares, 1000).alias("p")).first()
    bands = bands or bands_for(got["n"])
    at = [got["p"][min(98, max(0, round(100 * i / bands) - 1))] for i in range(1, bands)] if got["p"] else []
    return sorted(set(at), reverse=True)


def newest_first(changes: DataFrame, payload: list[str], cuts: list[int]) -> DataFrame:
    """``type, id, version, deleted`` and the payload of the change that counts for each element.

    The highest version counts, among equal versions the latest ``meta.timestamp``; null versions and times are lowest.
    Should two rows agree in both and differ elsewhere, the greater row counts, so that a rerun finds the same.  Elements
    without type or id are left out.
    """
    rank = [F.coalesce("version", F.lit(-1)).cast("long").alias("version"), F.col("meta.timestamp").alias("at"), deletes(F.col("action")).alias("deleted")]
    rows = changes.where("type is not null and id is not null").select(*KEY, *rank, *[F.col(c).alias(f"p_{c}") for c in payload])
    state = F.struct("version", "at", "deleted", *[f"p_{c}" for c in payload])
    flat = [*KEY, "s.version", "s.deleted", *[F.col(f"s.p_{c}").alias(c) for c in payload]]
    if not cuts:
        return rows.groupBy(*KEY).agg(F.max(state).alias("s")).select(*flat)
    scratch = Scratch(changes.sparkSession)
    older = F.lit(0)
    for c in cuts:
        older = older + (F.col("version") < c).cast("int")
    banded, _ = scratch.save(rows.withColumn("band", older), by="band")
    done = None
    for k in range(len(cuts) + 1):
        first = banded.where(F.col("band") == k).groupBy(*KEY).agg(F.max(state).alias("s"))
        if done is not None:  # keys that newer bands have resolved, as images or as tombstones
            first = first.join(done.select(*KEY), KEY, "left_anti")
        found, _ = scratch.save(first.select(*flat))
        done = found if done is None else done.unionByName(found)
    return done


def base_versions(bases: dict[str, DataFrame]) -> DataFrame:
    """``type, id, base``: the highest base version of each element.  bases: type -> table with ``id, version``."""
    parts = [df.select(F.lit(t).alias("type"), "id", F.col("version").cast("long").alias("version")) for t, df in bases.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("id is not null").groupBy(*KEY).agg(F.coalesce(F.max("version"), F.lit(-1)).cast("long").alias("base"))


def apply_changes(base: DataFrame, changes: DataFrame, kind: str, payload: list[str], version: str = "version", bands: int | None = None) -> DataFrame:
    """The state of one base table after all changes: ``id, version``, the payload, and ``source`` (change or base).

    base: ``id``, the payload and its version, repeated and older rows included; changes: the whole feed.
    """
    own = changes.where(F.col("type") == kind)
    resolved = newest_first(own, payload, band_cuts(own, bands)).drop("type")
    now = current(base.select("id", F.col(version).cast("long").alias("__version"), *payload), "__version")
    marks = now.select("id", F.coalesce("__version", F.lit(-1)).alias("base"))
    images = resolved.join(marks, "id", "left").where("base is null or version > base")
    alive = images.where("not deleted").select("id", "version", *payload, F.lit("change").alias("source"))
    kept = now.join(images.select("id"), "id", "left_anti").select("id", F.col("__version").alias("version"), *payload, F.lit("base").alias("source"))
    return alive.unionByName(kept)


def node_states(locations: DataFrame, nodes: DataFrame, changes: DataFrame, bands: int | None = None) -> DataFrame:
    """``id, version, lon_i, lat_i, tags, meta, source``: the state of all nodes, tagged or not, after all changes.

    The base row of a node is its current position beside its current tags.  Whether a change replaces it, tags and all, is
    up to the version of the position; a node that only has tags and that no change names keeps the version of these.
    """
    at = current(locations.select("id", "lon_i", "lat_i", F.col("version").cast("long").alias("version")), "version").withColumn("placed", F.lit(True))
    base = at.join(current(nodes.select("id", "tags", "meta"), "meta.version"), "id", "full")
    base = base.withColumn("version", F.when(F.col("placed"), F.col("version")).otherwise(NOWHERE))
    s = apply_changes(base, changes, "node", ["lon_i", "lat_i", "tags", "meta"], bands=bands)
    version = F.when(F.col("version") == NOWHERE, F.col("meta.version").cast("long")).otherwise(F.col("version"))
    return s.select("id", version.alias("version"), "lon_i", "lat_i", "tags", "meta", "source")


def named_state(changes: DataFrame, locations: DataFrame, ways: DataFrame, relations: DataFrame, bands: int | None = None) -> DataFrame:
    """``type, id, version, source`` of the elements that a feed names and that exist after it, over the three base tables as
    stored: images of the feed, and of base rows that it names those that it doesn't replace.

    A change replaces the base row only if its version is higher.
    """
    scratch = Scratch(changes.sparkSession)
    bases = dict(zip(ELEMENTS, (locations.select("id", "version"), ways.select("id", "meta.version"), relations.select("id", "meta.version"))))
    cuts = band_cuts(changes, bands)
    resolved = newest_first(changes, [], cuts)
    if not cuts:  # bands are written anyway
        resolved, _ = scratch.save(resolved)
    base = base_versions(bases).join(resolved.select(*KEY), KEY, "left_semi")
    base, _ = scratch.save(base)
    images, _ = scratch.save(resolved.join(base, KEY, "left").where("base is null or version > base").select(*KEY, "version", "deleted"))
    kept = base.join(images.select(*KEY), KEY, "left_anti").select(*KEY, F.col("base").alias("version"), F.lit("base").alias("source"))
    return images.where("not deleted").select(*KEY, "version", F.lit("change").alias("source")).unionByName(kept)
