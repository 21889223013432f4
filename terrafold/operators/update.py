"""Applying a change file to the tables: upserts, deletes and index upkeep.

The last change of an element in document order counts, whatever its version.  As an element's index rows depend on its
current image alone, applying the last change once equals applying all of them one by one.  Deleting an element drops its
own row and the index rows in which it is the parent; rows in which others refer to it stay until those change.  A delete
or change of an unknown element is no error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold import tags
from terrafold.dataset import OWNER, SEQNUM, TIMESTAMP, OsmDataset
from terrafold.operators import indexes
from terrafold.operators.changefeed import deletes
from terrafold.scratch import Scratch

PAYLOAD = ("version", "lon_i", "lat_i", "nodes", "members", "tags", "meta")


def last_in_order(changes: DataFrame) -> DataFrame:
    """One row per element: its last change by (seq, pos), with ``deleted``.  Where rows share seq and pos, the higher
    version, then the later timestamp, then the greater row counts."""
    order = [F.coalesce(F.col(c), F.lit(-1)) for c in ("seq", "pos", "version")]
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("meta.timestamp").alias("at"), deletes(F.col("action")).alias("deleted"), *PAYLOAD)
    rows = changes.where("type is not null and id is not null").groupBy("type", "id").agg(F.max(packed).alias("s"))
    return rows.select("type", "id", "s.deleted", *[f"s.{c}" for c in PAYLOAD])


def replace(base: DataFrame, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Base rows whose key is untouched, and the new ones."""
    return base.join(touched.select(F.col("id").alias(key)), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def new_rows(last: DataFrame) -> dict[str, DataFrame]:
    """The rows of each of the nine tables that elements have after their last change; see :func:`last_in_order`."""
    new = {t: last.where((F.col("type") == t) & ~F.col("deleted")) for t in ("node", "way", "relation")}
    out = {
        "locations": new["node"].select("id", "lon_i", "lat_i", "version"),
        "nodes": new["node"].where(tags.tagged(F.col("tags"))).select("id", "tags", "meta"),
        "ways": new["way"].select("id", "nodes", "tags", "meta"),
        "relations": new["relation"].select("id", "members", "tags", "meta"),
        "cell_node": indexes.cell_node(new["node"]),
        "node_way": indexes.node_way(new["way"]),
    }
    return out | {n: getattr(indexes, n)(new["relation"]) for n in ("node_relation", "way_relation", "relation_relation")}


def update(db: OsmDataset, changes: DataFrame) -> OsmDataset:
    """The dataset after a change table ``seq, pos, action, type, id`` and payload.  The last changes are settled once, as all
    tables need them; the tables themselves are lazy."""
    last, _ = Scratch(db.spark).save(last_in_order(changes))
    touched = {t: last.where(F.col("type") == t).select("id") for t in ("node", "way", "relation")}
    out = {n: replace(getattr(db, n), touched[OWNER[n][0]], rows, OWNER[n][1]) for n, rows in new_rows(last).items()}
    return OsmDataset(db.spark, out, dict(db.metadata))


def index_delta(db: OsmDataset, changes: DataFrame) -> DataFrame:
    """``node_id, way_id, op``: the rows of the node-way index that a change table deletes and inserts."""
    last = last_in_order(changes).where("type = 'way'")
    old = db.ways.join(last.select("id"), "id", "left_semi")
    before = indexes.node_way(old).withColumn("was", F.lit(1))
    after = indexes.node_way(last.where("not deleted")).withColumn("now", F.lit(1))
    j = before.join(after, ["node_id", "way_id"], "full").where("was is null or now is null")
    return j.select("node_id", "way_id", F.when(F.col("was").isNull(), "insert").otherwise("delete").alias("op"))


def apply_file(db: OsmDataset, changes: DataFrame, root: str, seqnum: int | str, timestamp: str, commit: bool = False) -> int | None:
    """Apply a change table to the published dataset that db was opened from, as its next version, all or nothing.

    Without commit the changes are read and settled, and nothing is written to the dataset: a rehearsal.
    """
    last, _ = Scratch(db.spark).save(last_in_order(changes))
    if not commit:
        return None
    return db.publish_delta(root, last.select("type", "id"), new_rows(last), {SEQNUM: str(seqnum), TIMESTAMP: timestamp})


def sequence_path(seq):
    """``AAA/BBB/CCC`` of a replication sequence number, as a column."""
    part = lambda x: F.lpad(x.cast("string"), 3, "0")
    million, thousand = F.lit(1_000_000).cast("bigint"), F.lit(1000).cast("bigint")
    s = seq.cast("bigint")
    return F.concat_ws("/", part(F.call_function("div", s, million)), part(F.call_function("div", s % million, thousand)), part(s % thousand))


def sequence_before(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """``at, seq``: for each wanted time the highest sequence whose state is strictly older; the latest sequence for times
    from the latest state on, the lowest for times before all.  states: ``seq, at``; wanted: ``at``.

    An as-of join by one sorted pass over both tables, in ranges: within a range a running maximum, and between ranges the
    maximum of all earlier ones, of which there are as many as days.
    """
    day = lambda c: F.floor(c / 86_400)
    both = states.select(F.col("at"), F.lit(1).alias("kind"), "seq").unionByName(wanted.select("at", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("seq")).distinct())
    both = both.where("at is not null").withColumn("day", day(F.col("at")))
    days = both.groupBy("day").agg(F.max("seq").alias("m"))
    carried = days.select("day", F.max("m").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    run = W.partitionBy("day").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    asof = both.withColumn("own", F.max("seq").over(run)).where("kind = 0").join(carried, "day")
    ends = states.agg(F.max(F.struct("seq", "at")).alias("last"), F.min("seq").alias("first")).first()
    last, first = ends["last"] or {"at": None, "seq": None}, F.lit(ends["first"])
    return asof.select("at", F.when(F.col("at") >= F.lit(last["at"]), F.lit(last["seq"])).otherwise(F.coalesce(F.greatest("own", "before"), first)).alias("seq"))
